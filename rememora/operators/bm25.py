"""BM25+ over entries: index build, query weighting, top-k and pair scoring.

Everything a query needs from the collection travels with the *query* terms
(document frequency, N, average length), so the large side of the join is read
once and is not re-shuffled while the weighted terms stay below the broadcast
limit; above it Spark falls back to a shuffled join with adaptive skew splits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from rememora.functions.text import repeat_array, term_frequencies, token_set, tokens
from rememora.operators.ranking import rounded, top_k
from rememora.params import DEFAULTS, Params
from rememora.session import settle, settle_bucketed


@dataclass(frozen=True)
class Index:
    """``documents(chat_id, id, seq, len, tfs)``: one row per entry."""

    documents: DataFrame

    @property
    def postings(self) -> DataFrame:
        return self.documents.select("chat_id", "id", "seq", "len", F.explode("tfs").alias("p")).select(
            "chat_id", "id", "seq", "len", F.col("p.term").alias("term"), F.col("p.tf").alias("tf"))

    @property
    def stats(self) -> DataFrame:
        return self.documents.groupBy("chat_id").agg(
            F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))


def indexed_tokens(params: Params = DEFAULTS) -> Column:
    """Content once, subject and tags repeated by their boosts."""
    return F.concat(
        tokens(F.col("content")),
        repeat_array(tokens(F.col("subject")), params.subject_boost),
        repeat_array(F.flatten(F.transform("tags", tokens)), params.tag_boost),
    )


def build_index(entries: DataFrame, params: Params = DEFAULTS, keep: bool = True) -> Index:
    """Index ``entries(chat_id, id, seq, content, subject, tags)``.

    With ``keep`` the index becomes a scratch table bucketed by entry: frequencies,
    scoring and beam scoring do not tokenise again, and scores are summed where
    the entry lies, so only the best of each task travel.
    """
    documents = entries.select(
        "chat_id", "id", "seq", term_frequencies(indexed_tokens(params)).alias("tfs"))
    documents = documents.select(
        "chat_id", "id", "seq",
        F.aggregate("tfs", F.lit(0).cast("long"), lambda acc, p: acc + p["tf"]).alias("len"), "tfs")
    return Index(settle_bucketed(documents, "index", ["chat_id", "id"]) if keep else documents)


def store_index(index: Index, table: str, buckets: int, path: str | None = None) -> Index:
    """The index as a table bucketed by entry.

    Scoring groups by entry and query, so it then needs no shuffle before the
    per-query cut: each task scores its own entries and passes on k per query.
    """
    writer = index.documents.write.mode("overwrite").bucketBy(buckets, "chat_id", "id")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    return Index(index.documents.sparkSession.table(table))


def query_terms(queries: DataFrame) -> DataFrame:
    """Distinct terms of ``queries(chat_id, query_id, query)``."""
    return queries.select("chat_id", "query_id", F.explode(token_set(F.col("query"))).alias("term"))


def weigh_terms(index: Index, queries: DataFrame) -> DataFrame:
    """``(chat_id, query_id, term, idf, avg_len)``; terms no entry holds drop out."""
    terms = settle(query_terms(queries), "query-terms")
    wanted = terms.select("chat_id", "term").distinct()
    frequency = (
        index.postings.select("chat_id", "term")
        .join(wanted, ["chat_id", "term"], "left_semi")
        .groupBy("chat_id", "term").agg(F.count("*").alias("df"))
    )
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = (
        frequency.join(index.stats, "chat_id")
        .select("chat_id", "term", idf.alias("idf"), "avg_len")
        .join(terms, ["chat_id", "term"])
        .select("chat_id", "query_id", "term", "idf", "avg_len")
    )
    return settle(weighted, "query-weights")


def contribution(params: Params = DEFAULTS) -> Column:
    """One term's share; the lower-bound delta stays outside the idf factor."""
    norm = 1 - params.b + params.b * (F.col("len") / F.col("avg_len"))
    return (F.col("idf") * (F.col("tf") * (params.k1 + 1)) / (F.col("tf") + params.k1 * norm)
            + params.delta)


def score_all(index: Index, weights: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Every (query, entry) pair that shares a term, with its BM25+ score.

    The terms of an entry sit in one task, so the map-side aggregate already
    folds them: the shuffle carries one row per pair, not one per term.
    """
    return (
        index.postings.join(weights, ["chat_id", "term"])
        .groupBy("chat_id", "query_id", "id", "seq")
        .agg(rounded(F.sum(contribution(params))).alias("bm25"))
    )


def score_pairs(index: Index, weights: DataFrame, pairs: DataFrame,
                params: Params = DEFAULTS) -> DataFrame:
    """BM25+ of the given ``(chat_id, query_id, id)`` pairs only; no match, no row.

    Entries are met before their terms are listed, so the terms of entries in no pair are not.
    """
    held = index.documents.join(pairs.select("chat_id", "query_id", "id").distinct(), ["chat_id", "id"])
    postings = held.select("chat_id", "query_id", "id", "len", F.inline("tfs"))
    return (
        postings.join(weights, ["chat_id", "query_id", "term"])
        .groupBy("chat_id", "query_id", "id")
        .agg(rounded(F.sum(contribution(params))).alias("bm25"))
    )


def search(index: Index, queries: DataFrame, k: int, params: Params = DEFAULTS) -> DataFrame:
    """Top ``k`` entries per query, best first, earlier entries first on ties."""
    scored = score_all(index, weigh_terms(index, queries), params)
    return top_k(scored, ["chat_id", "query_id"], [F.desc("bm25"), F.asc("seq")], k)
