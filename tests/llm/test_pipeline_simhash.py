"""The pipeline's near-duplicate stage finds candidates by SimHash too; all are verified by Jaccard."""

import corpus_pipeline
from rememora.llm import op01_fingerprint as op1, op07_simhash as op7

from .conftest import make_docs


def words(c, n):
    return " ".join(f"{c}{k}" for k in range(n))


def test_candidates_of_another_method_are_verified(spark):
    """A pair that shares no band is linked when it is given and alike, and is not when it is given and unlike."""
    docs = make_docs(spark, [(1, words("a", 40) + " " + words("x", 80)), (2, words("a", 40) + " " + words("y", 80)), (3, words("z", 120))])
    keys = {r.id: r.key for r in op1.grouped(docs).collect()}
    linked = spark.createDataFrame([(keys[2], keys[1]), (keys[3], keys[1])], "a binary, b binary")
    firsts = lambda **more: {r.id: r.first_id for r in op1.grouped(docs, similarity=0.15, **more).collect()}
    assert firsts() == {1: 1, 2: 2, 3: 3} and firsts(linked=linked) == {1: 1, 2: 1, 3: 3}


def test_stage_asks_simhash(spark, monkeypatch):
    """Texts of one fingerprint are candidates of the stage; their low Jaccard keeps both."""
    body = "alpha beta gamma delta eps " * 200
    rows = [(1, body + words("x", 10)), (2, body + words("y", 10)), (3, words("q", 80)), (4, words("q", 80) + " ")]
    found = []
    monkeypatch.setattr(op7, "text_links", lambda df, real=op7.text_links: found.append(real(df)) or found[0])
    kept = corpus_pipeline.drop_near_duplicates(spark, make_docs(spark, rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3] and found[0].count() == 2


def test_texts_of_one_fingerprint_group_meet_each_other(spark):
    """Texts alike are found through a link to a third that neither is like, whichever of them has the least key."""
    rows = [(1, words("z", 120)), (2, words("a", 40) + " " + words("x", 80)), (3, words("a", 40) + " " + words("y", 80))]
    docs = make_docs(spark, rows)
    keys = {r.id: r.key for r in op1.grouped(docs).collect()}
    for hub in (1, 2, 3):
        linked = spark.createDataFrame([(keys[k], keys[hub]) for k in keys if k != hub], "a binary, b binary")
        for crowd in (1_024, 2):
            found = {r.id: r.first_id for r in op1.grouped(docs, similarity=0.15, crowd=crowd, linked=linked).collect()}
            assert found == {1: 1, 2: 2, 3: 2}
