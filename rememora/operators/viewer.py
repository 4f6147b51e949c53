"""What the memory viewer shows: filters, groups, limits, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rememora.operators.ranking import top_k

NO_SUBJECT = "(no subject)"
SORTS = {
    "importance": lambda: F.desc("importance"),
    "recency": lambda: F.desc("updated_at"),
    "added": lambda: F.desc("created_at"),
}


def subject_label() -> Column:
    return F.coalesce(F.nullif(F.col("subject"), F.lit("")), F.lit(NO_SUBJECT))


def subject_contains(needle: str, include_unnamed: bool = False) -> Column:
    """Case-insensitive filter; unnamed entries match only by their label."""
    field = subject_label() if include_unnamed else F.col("subject")
    return F.coalesce(F.lower(field).contains(needle.lower()), F.lit(False))


def subject_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("chat_id", subject_label().alias("label")).agg(F.count("*").alias("n"))


def grouped_page(entries: DataFrame, sort: str = "importance", limit: int = 500) -> DataFrame:
    """The first ``limit`` entries over all groups, groups by label, best first inside.

    A sort with a limit keeps ``limit`` rows per task, unlike a global window.
    """
    labelled = entries.withColumn("label", subject_label())
    return labelled.orderBy("label", SORTS[sort](), "chat_id", "seq").limit(limit)


def graph_page(edges: DataFrame, nodes: int = 200, per_node: int = 10) -> DataFrame:
    """The busiest nodes with their first out-neighbours."""
    degree = edges.groupBy("chat_id", "from_id").agg(F.count("*").alias("degree"))
    busiest = degree.orderBy(F.desc("degree"), "chat_id", "from_id").limit(nodes)
    shown = edges.join(busiest, ["chat_id", "from_id"])
    return top_k(shown, ["chat_id", "from_id"], [F.asc("seq"), F.asc("to_id")], per_node, "place")


# fixed values: labels of tiers and of generation causes
TIER_LABELS = {"0": "T0", "1": "T1", "2": "T3", "3": "T3", "floor": "Floor",
               "bm25only": "BM25", "recency": "Recent", "random": "Rand"}
CAUSE_LABELS = {"swipe": "swipe", "continue": "continue", "regenerate": "regen",
                "impersonate": "impersonate", "quiet": "quiet"}


def _labelled(value: Column, labels: dict[str, str], otherwise: Column) -> Column:
    out = None
    for key, label in labels.items():
        out = (F.when if out is None else out.when)(value == key, F.lit(label))
    return out.otherwise(otherwise)


def tier_label(tier: Column) -> Column:
    """Tiers 2 and 3 share one label; anything unknown shows as '?'."""
    return _labelled(tier, TIER_LABELS, F.lit("?"))


def cause_label(cause: Column) -> Column:
    """A badge for reruns of a query; NULL for a fresh turn."""
    return _labelled(cause, CAUSE_LABELS, F.lit(None).cast("string"))


def top_score(tier: Column, per_tier: Column) -> Column:
    """Score of the first row recorded for the resolving tier."""
    return F.get(F.try_element_at(per_tier, tier), F.lit(0))["score"]


def clipped(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def shown_time(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")


def newest_first(rows: DataFrame, order: str, limit: int) -> DataFrame:
    return rows.orderBy(F.desc(order)).limit(limit)


def group_shares(page: DataFrame) -> DataFrame:
    """Rows of a page per group (the page is at most a few hundred rows)."""
    window = Window.partitionBy("label")
    return page.withColumn("in_group", F.count("*").over(window))
