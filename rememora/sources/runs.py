"""Recorded runs and sweep files as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rememora.schema import RUN_LINE, RUN_META, SWEEP_FILE

SWEEP_COLUMNS = ["file", "timestamp", "sweep_name", "round", "knob", "value", "mrr", "coverage", "n",
                 "n_scored", "n_skipped", "latency_p50", "latency_p95", "is_winner"]


def _file_name() -> Column:
    return F.element_at(F.split(F.input_file_name(), "/"), -1)


def write_runs(rows: DataFrame, metrics: DataFrame, path: str) -> None:
    """Run rows as JSON lines and the metrics beside them."""
    rows.write.mode("overwrite").json(f"{path}/runs")
    metrics.write.mode("overwrite").json(f"{path}/metrics")


def load_runs(spark: SparkSession, folder: str, run_id: str | None = None, pattern: str = "*.jsonl") -> DataFrame:
    """One row per recorded call of ``*.jsonl``, with the environment of its ``*.metrics.json``.

    Broken lines are dropped, a run without metadata keeps nulls.
    """
    stem = F.regexp_replace(_file_name(), r"\.jsonl$", "")
    lines = spark.read.schema(RUN_LINE).option("mode", "DROPMALFORMED").json(
        folder, pathGlobFilter=pattern).withColumn("run", stem)
    meta = spark.read.schema(RUN_META).option("multiLine", True).json(
        folder, pathGlobFilter="*.metrics.json").select(
        F.regexp_replace(_file_name(), r"\.metrics\.json$", "").alias("run"),
        F.col("envSnapshot.scorerId").alias("scorer_id"), F.col("envSnapshot.gitSha").alias("git_sha"),
        F.col("envSnapshot.nodeVersion").alias("node_version"))
    if run_id:
        lines = lines.filter(F.col("run").contains(run_id))
    top = F.try_element_at("retrieved", F.lit(1))
    return lines.join(meta, "run", "left").select(
        "run", "scorer_id", "git_sha", "node_version", F.col("conversationId").alias("conversation_id"),
        F.col("qa.question").alias("question"), F.col("qa.answer").alias("answer"), F.col("qa.category").alias("category"),
        F.coalesce(F.size("retrieved"), F.lit(0)).cast("long").alias("n_retrieved"),
        top["id"].alias("top_id"), top["score"].alias("top_score"), top["tier"].alias("top_tier"))


def metric_fields(point: str = "p") -> list[Column]:
    """Metrics of a sweep point; latency is an object or a bare number."""
    m, latency = F.col(f"{point}.metrics"), F.col(f"{point}.latencyMs")
    split = F.from_json(latency, "p50 double, p95 double")
    return [
        m["mrr"].alias("mrr"),
        F.coalesce(m["coverage"], F.try_divide(m["n_scored"], m["n"])).alias("coverage"),
        m["n"].alias("n"), m["n_scored"].alias("n_scored"), m["n_skipped"].alias("n_skipped"),
        F.coalesce(split["p50"], latency.try_cast("double")).alias("latency_p50"),
        split["p95"].alias("latency_p95")]


def load_sweeps(spark: SparkSession, folder: str) -> DataFrame:
    """Sweep files of four shapes as long rows, one per point and knob.

    Rounds (top level or wrapped) name their knob and winner; flat points yield
    one row per knob that takes more than one value; baseline points are keyed by
    retriever. Files that are not JSON are skipped.
    """
    raw = spark.read.schema(SWEEP_FILE).option("multiLine", True).option("mode", "DROPMALFORMED").json(
        folder, pathGlobFilter="*.json").withColumn("file", _file_name())
    raw = raw.filter(~F.col("file").endswith(".metrics.json"))
    sweep = F.coalesce("sweep_name", "name", F.lit("unknown"))
    head = raw.select(
        "file", F.coalesce("timestamp", F.lit("")).alias("timestamp"), sweep.alias("own_name"), "sweep_name",
        F.coalesce("rounds", "result.rounds").alias("rounds"),
        F.when(F.col("result.points").isNotNull(), F.coalesce("sweep_name", "result.name", sweep)).otherwise(sweep).alias("flat_name"),
        F.coalesce("result.points", "points").alias("points"))
    return _rounds(head).unionByName(_baselines(head)).unionByName(_flat(head)).select(*SWEEP_COLUMNS)


def _rounds(head: DataFrame) -> DataFrame:
    rounds = head.filter(F.col("rounds").isNotNull()).select(
        "file", "timestamp", F.col("own_name").alias("sweep_name"), F.explode("rounds").alias("r"))
    points = rounds.select("*", F.explode("r.points").alias("p"))
    value = F.try_element_at("p.overrides", "r.knob")
    return points.select(
        "file", "timestamp", "sweep_name", F.coalesce("r.name", "r.knob").alias("round"), F.col("r.knob").alias("knob"),
        value.alias("value"), *metric_fields(), value.eqNullSafe(F.col("r.winner.value")).alias("is_winner"))


def _is_baseline() -> Column:
    return F.coalesce(F.length(F.get("points", F.lit(0))["retrieverId"]) > 0, F.lit(False))


def _baselines(head: DataFrame) -> DataFrame:
    points = head.filter(F.col("rounds").isNull() & _is_baseline()).select(
        "file", "timestamp", F.explode("points").alias("p"))
    fixed = F.lit("baselines")
    return points.select("file", "timestamp", fixed.alias("sweep_name"), fixed.alias("round"), F.lit("retriever").alias("knob"),
                         F.col("p.retrieverId").alias("value"), *metric_fields(), F.lit(False).alias("is_winner"))


def _flat(head: DataFrame) -> DataFrame:
    files = head.filter(F.col("rounds").isNull() & ~_is_baseline())
    # a file's points are its grid: the knobs that vary are found inside the row
    keys = F.array_sort(F.array_distinct(F.flatten(F.transform("points", lambda p: F.coalesce(
        F.map_keys(p["overrides"]), F.array().cast("array<string>"))))))
    varying = F.filter(keys, lambda k: F.size(F.array_distinct(F.transform(
        "points", lambda p: F.coalesce(F.try_element_at(p["overrides"], k), F.lit("\x00"))))) > 1)
    chosen = F.when(F.size(varying) > 0, varying).when(F.size(keys) > 0, keys).otherwise(F.array(F.lit("(no-overrides)")))
    points = files.withColumn("knobs", chosen).select(
        "file", "timestamp", F.col("flat_name").alias("sweep_name"), "knobs", F.explode("points").alias("p"))
    rows = points.select("*", F.explode("knobs").alias("knob"))
    return rows.select("file", "timestamp", "sweep_name", F.col("knob").alias("round"), "knob",
                       F.try_element_at("p.overrides", "knob").alias("value"), *metric_fields(), F.lit(False).alias("is_winner"))
