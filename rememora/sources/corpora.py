"""Benchmark corpora as turns and questions; nothing leaves the row it came from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rememora.schema import LOCOMO_SAMPLE, LONGMEM_ITEM, SESSION_TURNS

Loader = Callable[..., tuple[DataFrame, DataFrame]]
_ADAPTERS: dict[str, Loader] = {}


def register_adapter(name: str, loader: Loader) -> None:
    if not isinstance(name, str) or not name:
        raise ValueError("adapter name must be a non-empty string")
    if not callable(loader):
        raise TypeError("adapter must be callable")
    _ADAPTERS[name] = loader


def get_adapter(name: str) -> Loader:
    if name not in _ADAPTERS:
        raise KeyError(f"unknown corpus '{name}'; known: {', '.join(list_adapters())}")
    return _ADAPTERS[name]


def list_adapters() -> list[str]:
    return sorted(_ADAPTERS)


def _read(spark: SparkSession, path: str, schema: str, lines: bool, limit: int | None) -> DataFrame:
    """A JSON array in one document, or one object per line, which splits over tasks."""
    rows = spark.read.schema(schema).option("multiLine", not lines).json(path)
    return rows if limit is None else rows.limit(limit)


def _flat_turns(sessions: Column) -> Column:
    """Array of (session, position, turn) over ordered (session, turns) pairs."""
    return F.flatten(F.transform(sessions, lambda s: F.transform(
        s["turns"], lambda t, i: F.struct(s["session"].alias("session"), i.alias("i"), t.alias("t")))))


def load_locomo(spark: SparkSession, path: str, lines: bool = False,
                limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Multi-session dialogues: ``(turns, qa)``.

    Only ``session_<n>`` keys that hold a list are sessions; they are ordered by
    number and their turns numbered through. Evidence names a turn by its own
    id, as ``D<session>:<turn from 1>`` or as ``S<session>:T<turn from 0>``;
    other names are dropped.
    """
    samples = _read(spark, path, LOCOMO_SAMPLE, lines, limit).withColumn(
        "chat_id", F.coalesce("sample_id", "id", F.lit("unknown")))
    named = F.filter(F.map_entries("conversation"), lambda e: e["key"].rlike("^session_[0-9]+$"))
    sessions = F.transform(named, lambda e: F.struct(
        F.substring(e["key"], 9, 12).cast("int").alias("session"),
        F.from_json(e["value"], SESSION_TURNS).alias("turns")))
    listed = F.sort_array(F.filter(sessions, lambda s: s["turns"].isNotNull()))
    flat = samples.select("chat_id", F.posexplode(_flat_turns(listed)).alias("turn", "x"))
    turns = flat.select(
        "chat_id", F.col("turn").cast("long").alias("turn"), F.col("x.session").alias("session"), "x.i",
        F.coalesce("x.t.speaker", F.lit("unknown")).alias("speaker"),
        F.coalesce("x.t.text", "x.t.content", F.lit("")).alias("text"), F.col("x.t.dia_id").alias("dia_id"))
    names = turns.select("chat_id", "turn", F.explode(F.array_compact(F.array(
        F.concat(F.lit("S"), "session", F.lit(":T"), "i"),
        F.concat(F.lit("D"), "session", F.lit(":"), F.col("i") + 1), F.col("dia_id")))).alias("name"))
    # a name given twice belongs to the later turn
    names = names.groupBy("chat_id", "name").agg(F.max("turn").alias("turn"))
    qa = samples.select("chat_id", F.posexplode("qa").alias("query_id", "q")).select(
        "chat_id", F.col("query_id").cast("long").alias("query_id"), F.col("q.question").alias("query"),
        F.coalesce("q.answer", F.lit("")).alias("answer"),
        F.coalesce("q.category", F.lit("unknown")).alias("category"), F.col("q.evidence").alias("refs"))
    refs = qa.select("chat_id", "query_id", F.posexplode("refs").alias("pos", "ref"))
    legacy = F.regexp_extract("ref", r"(S\d+:T\d+)", 1)
    found = (
        refs.join(names.withColumnRenamed("name", "ref"), ["chat_id", "ref"], "left")
        .withColumn("legacy", F.nullif(legacy, F.lit("")))
        .join(names.select("chat_id", F.col("name").alias("legacy"), F.col("turn").alias("legacy_turn")),
              ["chat_id", "legacy"], "left")
        .select("chat_id", "query_id", "pos", F.coalesce("turn", "legacy_turn").alias("turn"))
        .filter(F.col("turn").isNotNull()))
    # evidence of one question: a handful of references
    evidence = found.groupBy("chat_id", "query_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "turn"))), lambda r: r["turn"]).alias("evidence"))
    qa = qa.drop("refs").join(evidence, ["chat_id", "query_id"], "left").withColumn(
        "evidence", F.coalesce("evidence", F.array().cast("array<bigint>")))
    return turns.drop("i", "dia_id"), qa.withColumn("task_type", F.lit(None).cast("string")).withColumn(
        "abstention", F.lit(False))


def load_longmemeval(spark: SparkSession, path: str, lines: bool = False,
                     limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """One question over many sessions: ``(turns, qa)``.

    Evidence is the turns marked ``has_answer``; an answer session without any
    mark counts whole. Question ids that end in ``_abs`` expect no answer.
    """
    items = _read(spark, path, LONGMEM_ITEM, lines, limit).withColumnRenamed("question_id", "chat_id")
    numbered = F.transform("haystack_sessions", lambda s, n: F.struct(
        n.alias("session"), s.alias("turns"),
        (F.coalesce(F.array_contains("answer_session_ids", F.get("haystack_session_ids", n)), F.lit(False))
         & ~F.exists(s, lambda t: F.coalesce(t["has_answer"], F.lit(False)))).alias("whole")))
    flat = F.flatten(F.transform(numbered, lambda s: F.transform(s["turns"], lambda t: F.struct(
        s["session"].alias("session"), t["role"].alias("speaker"), t["content"].alias("text"),
        (F.coalesce(t["has_answer"], F.lit(False)) | s["whole"]).alias("is_evidence")))))
    rows = items.withColumn("flat", flat)
    turns = rows.select("chat_id", F.posexplode("flat").alias("turn", "x")).select(
        "chat_id", F.col("turn").cast("long").alias("turn"), "x.session", "x.speaker", "x.text")
    marks = F.transform("flat", lambda t, i: F.when(t["is_evidence"], i.cast("long")))
    qa = rows.select(
        "chat_id", F.lit(0).cast("long").alias("query_id"), F.col("question").alias("query"), "answer",
        F.col("question_type").alias("category"), F.array_compact(marks).alias("evidence"),
        F.col("question_type").alias("task_type"), F.col("chat_id").endswith("_abs").alias("abstention"))
    return turns, qa


register_adapter("locomo", load_locomo)
register_adapter("longmemeval", load_longmemeval)
