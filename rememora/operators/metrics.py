"""Retrieval quality: gold matching, precision, recall, reciprocal rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rememora.functions.text import jaccard, tokens
from rememora.params import STANDARD_K

QUERY = ["chat_id", "query_id"]


def match_gold(retrieved: DataFrame, qa: DataFrame, keys: list[str] = QUERY) -> DataFrame:
    """Mark retrieved rows whose source turns meet the evidence turns.

    ``retrieved(chat_id, query_id, rank, id, source_messages)``,
    ``qa(chat_id, query_id, evidence)``; ``keys`` tell the questions apart.
    """
    hit = F.coalesce(F.arrays_overlap("source_messages", "evidence"), F.lit(False))
    return retrieved.join(qa.select(*keys, "evidence"), keys).withColumn("matched", hit).drop("evidence")


def per_gold(retrieved: DataFrame, qa: DataFrame, keys: list[str] = QUERY) -> DataFrame:
    """Which retrieved entries support which evidence turn."""
    sources = retrieved.select(*keys, "id", F.explode("source_messages").alias("turn"))
    gold = qa.select(*keys, F.explode("evidence").alias("turn"))
    return sources.join(gold, [*keys, "turn"]).distinct()


def match_gold_by_text(retrieved: DataFrame, gold: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Older rule: token overlap between an entry and a gold turn of the same query.

    ``retrieved(chat_id, query_id, id, content)``, ``gold(chat_id, query_id, turn, text)``;
    two texts without tokens count as equal.
    """
    a = retrieved.select(*QUERY, "id", tokens(F.col("content")).alias("a"))
    b = gold.select(*QUERY, "turn", tokens(F.col("text")).alias("b"))
    return a.join(b, QUERY).filter(
        jaccard(F.col("a"), F.col("b"), both_empty=1.0) >= threshold).select(*QUERY, "turn", "id")


def per_query(retrieved: DataFrame, qa: DataFrame, ks=STANDARD_K, keys: list[str] = QUERY) -> DataFrame:
    """One row per question; metrics are NULL where nothing retrieved is gold.

    Precision divides by what was returned up to k, recall by the *retrieved*
    gold entries, so recall at the retrieval depth is 1 by construction.
    ``evidence_recall`` divides by all evidence turns instead.
    """
    marked = match_gold(retrieved, qa, keys)
    hits = {k: F.count_if(F.col("matched") & (F.col("rank") <= k)) for k in ks}
    folded = marked.groupBy(*keys).agg(
        F.count("*").alias("n_retrieved"), F.count_if("matched").alias("n_matched"),
        F.min(F.when(F.col("matched"), F.col("rank"))).alias("first_rank"),
        *[hits[k].alias(f"hits_{k}") for k in ks])
    covered = per_gold(retrieved, qa, keys).groupBy(*keys).agg(F.countDistinct("turn").alias("turns_covered"))
    scored = F.coalesce(F.col("n_matched"), F.lit(0)) > 0
    out = qa.join(folded, keys, "left").join(covered, keys, "left")
    out = out.withColumn("scored", scored).withColumn("mrr", F.when(scored, 1 / F.col("first_rank")))
    for k in ks:
        out = out.withColumn(f"precision_{k}", F.when(scored, F.col(f"hits_{k}") / F.least(F.lit(k), "n_retrieved")))
        out = out.withColumn(f"recall_{k}", F.when(scored, F.col(f"hits_{k}") / F.col("n_matched")))
    return out.withColumn("evidence_recall", F.when(
        F.size("evidence") > 0, F.coalesce("turns_covered", F.lit(0)) / F.size(F.array_distinct("evidence"))))


def summarize(scores: DataFrame, by: list[str] | None = None, ks=STANDARD_K) -> DataFrame:
    """Means over questions that can be scored; abstention questions are set apart."""
    answerable = ~F.coalesce(F.col("abstention"), F.lit(False))
    n, n_scored = F.count_if(answerable), F.count_if(answerable & F.col("scored"))

    def mean(name):
        return F.avg(F.when(answerable, F.col(name))).alias(name)

    return scores.groupBy(*(by or [])).agg(
        n.alias("n"), n_scored.alias("n_scored"), (n - n_scored).alias("n_skipped"),
        F.try_divide(n_scored, n).alias("coverage"), mean("mrr"),
        *[mean(f"precision_{k}") for k in ks], *[mean(f"recall_{k}") for k in ks],
        F.count_if(~answerable).alias("abstentions"))


def by_task_type(scores: DataFrame, ks=STANDARD_K, keys: list[str] | None = None) -> DataFrame:
    """The summary per task type (and per ``keys``); untyped questions are left out."""
    typed = scores.filter(F.coalesce(F.length("task_type"), F.lit(0)) > 0)
    kept = typed.filter(~F.coalesce(F.col("abstention"), F.lit(False)))
    return summarize(kept, [*(keys or []), "task_type"], ks)
