import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                     # columns that clash with names the operators use themselves
                     T.StructField("id", T.StringType()), T.StructField("piece", T.StringType()), T.StructField("score", T.StringType()),
                     T.StructField("bucket", T.StringType()), T.StructField("fp", T.StringType()), T.StructField("label", T.StringType())])

WORDS = "the anon thing erth stion haer wered onst blean inhe tion ofer rean ndou whes lyor shat eath".split()


def sentence(n, start=0):
    return " ".join(WORDS[(start + k * k + k) % len(WORDS)] + ("." if k % 9 == 8 else "") for k in range(n))


def make_docs(spark, rows):
    """``rows``: (id, text) or (id, text, lang)."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else None, "s", 0, *["x"] * 6) for r in rows], DOCS)


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank, tied, repeated, very long and non-Latin texts; a null id."""
    return [(1, None), (2, ""), (3, " \n\t "), (4, sentence(60)), (5, sentence(60)), (5, sentence(60)), (6, sentence(30_000, 3)),
            (7, "один два три 四五 ÀÉ ß  double  space   x"), (8, "a"), (9, "12 34 !!"), (None, sentence(12, 5))]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return make_docs(spark, odd_rows)


@pytest.fixture(scope="session")
def none(spark):
    return make_docs(spark, [])
