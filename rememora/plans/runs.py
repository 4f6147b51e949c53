"""Analytics over recorded runs, traces and sweep rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from rememora.operators.positions import at_floor_n1, at_nearest, order_statistics


def align_ranks(left: DataFrame, right: DataFrame, depth: int = 10) -> DataFrame:
    """Two retrievers side by side, rank by rank, the longer list keeping its tail."""
    keys = ["chat_id", "query_id", "rank"]
    a = left.filter(F.col("rank") <= depth).select(*keys, F.col("id").alias("left_id"))
    b = right.filter(F.col("rank") <= depth).select(*keys, F.col("id").alias("right_id"))
    return a.join(b, keys, "full").withColumn(
        "same", F.coalesce(F.col("left_id") == F.col("right_id"), F.lit(False)))


def latency_stats(calls: DataFrame, keys: list[str], latency: str = "lat_ms") -> DataFrame:
    """p50, p95, p99 (nearest index), extremes, mean, sample deviation, count."""
    picked = order_statistics(calls, keys, latency, {
        "p50": at_nearest(0.5), "p95": at_nearest(0.95), "p99": at_nearest(0.99)})
    moments = calls.groupBy(*keys).agg(
        F.min(latency).alias("min"), F.max(latency).alias("max"),
        F.avg(latency).alias("mean"), F.stddev_samp(latency).alias("std"))
    return picked.join(moments, keys)


def tier_distribution(calls: DataFrame, tier: str = "tier") -> DataFrame:
    counted = calls.groupBy(tier).agg(F.count("*").alias("count"))
    total = F.sum("count").over(Window.partitionBy())  # one row per tier, so the window is tiny
    return counted.withColumn("pct", F.col("count") * 100.0 / total)


def length_latency_correlation(calls: DataFrame, keys: list[str], length: str = "query_len",
                               latency: str = "lat_ms", least: int = 10) -> DataFrame:
    """Pearson r with its reading, for groups of at least ``least`` calls."""
    known = calls.filter(F.col(length).isNotNull())
    r = F.coalesce(F.corr(length, latency), F.lit(0.0))
    out = known.groupBy(*keys).agg(F.count("*").alias("n"), r.alias("r")).filter(F.col("n") >= least)
    return out.withColumn("reading", F.when(F.abs("r") < 0.1, "none").when(F.col("r") > 0.3, "moderate positive")
                          .when(F.col("r") < -0.3, "moderate negative").otherwise("weak"))


def extremes(calls: DataFrame, n: int, slowest: bool = True, latency: str = "lat_ms", tie: str = "id") -> DataFrame:
    """The n slowest or fastest calls; Spark keeps only n rows per task."""
    first = F.desc(latency) if slowest else F.asc(latency)
    return calls.orderBy(first, F.asc(tie)).limit(n)


def enrich(calls: DataFrame, answers: DataFrame) -> DataFrame:
    """Attach recorded answers to traced calls by query text; unmatched calls stay."""
    return calls.join(answers, "query", "left")


def sweep_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("sweep_name", "knob").agg(
        F.count("*").alias("n_points"), F.min("mrr").alias("mrr_min"), F.max("mrr").alias("mrr_max"),
        (F.max("mrr") - F.min("mrr")).alias("mrr_span"), F.avg("coverage").alias("coverage_mean"))


def run_summary(rows: DataFrame) -> DataFrame:
    """Calls, mean top score and most frequent tier of each run (smallest on ties)."""
    per_tier = rows.filter(F.col("top_tier").isNotNull()).groupBy("run", "top_tier").agg(F.count("*").alias("c"))
    mode = per_tier.groupBy("run").agg(F.min_by("top_tier", F.struct(-F.col("c"), "top_tier")).alias("top_tier_mode"))
    base = rows.groupBy("run").agg(
        F.count("*").alias("n_calls"), F.avg("top_score").alias("top_score_mean"),
        F.min("scorer_id").alias("scorer_id"), F.min("git_sha").alias("git_sha"))
    return base.join(mode, "run", "left")


def sweep_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Deltas of two sweep files over shared (knob, value) points, largest change first."""
    on = ["knob", "value"]
    left = a.select(*on, F.col("mrr").alias("mrr_a"), F.col("coverage").alias("coverage_a"))
    right = b.select(*on, F.col("mrr").alias("mrr_b"), F.col("coverage").alias("coverage_b"))
    return (left.join(right, on)
            .withColumn("delta_mrr", F.col("mrr_b") - F.col("mrr_a"))
            .withColumn("delta_coverage", F.col("coverage_b") - F.col("coverage_a"))
            .orderBy(F.desc(F.abs("delta_mrr")), *on))


def factor_distribution(ranked: DataFrame, factors: list[str]) -> DataFrame:
    """Least, median, 95th percentile and greatest value of each scoring factor."""
    pairs = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("double").alias("value")) for f in factors])
    long = ranked.select(F.explode(pairs).alias("p")).select("p.factor", "p.value")
    return order_statistics(long, ["factor"], "value", {
        "least": lambda n: n * 0, "p50": at_floor_n1(0.5), "p95": at_floor_n1(0.95), "greatest": lambda n: n - 1})
