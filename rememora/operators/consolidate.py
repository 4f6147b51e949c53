"""Turns to facts: batching, extraction, de-duplication, lifecycle, edges."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from rememora.functions import extraction
from rememora.functions.identity import entry_id
from rememora.functions.lifecycle import bumped
from rememora.functions.text import strip_space
from rememora.operators.dedup import fold_duplicates
from rememora.operators.graph import build_edges, cap_edges
from rememora.operators.numbering import batch_of, number_rows
from rememora.params import DEFAULTS, Params
from rememora.session import settle

# insertion order: turn by turn, and after the turn that fires a batch its facts
_TURN_STRIDE = 1 << 32
_BATCH_STRIDE = 1 << 15
EXTRACTOR = "rules@v1"


def batches(turns: DataFrame, params: Params = DEFAULTS, role: str | None = "user") -> DataFrame:
    """Cut ``turns(chat_id, turn, role, text)`` into consolidation batches.

    ``(chat_id, batch, messages, sources, fired_at)``: messages in order, the
    turn numbers they come from, and the non-blank turn after which the batch
    fires. Blank turns do not count. ``role`` replaces the speaker, as the
    seeding harness does; pass None to keep the speakers.
    """
    speaking = turns.filter(F.length(strip_space(F.coalesce("text", F.lit("")))) > 0)
    placed = number_rows(speaking, "chat_id", "turn", "place")
    placed = placed.withColumn("batch", batch_of(F.col("place"), params.batch_size, params.buffer_threshold))
    spoken = F.lit(role) if role else F.col("role")
    # a batch holds at most batch_size turns, so this group is small by construction
    grouped = placed.groupBy("chat_id", "batch").agg(
        F.sort_array(F.collect_list(F.struct(
            "place", F.col("turn").cast("long").alias("turn"),
            spoken.alias("role"), F.col("text").alias("content")))).alias("rows"))
    drained = min(params.batch_size, params.buffer_threshold)
    last = placed.groupBy("chat_id").agg(F.max("place").alias("last"))
    fires = F.least(F.col("batch") * drained + params.buffer_threshold - 1, F.col("last"))
    return grouped.join(last, "chat_id").select(
        "chat_id", "batch",
        F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["content"].alias("content"))).alias("messages"),
        F.transform("rows", lambda r: r["turn"]).alias("sources"),
        fires.cast("long").alias("fired_at"))


def extract_by_rules(batched: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """``facts`` per batch by the deterministic rules; ``cut`` counts those beyond ``max_facts``."""
    found = batched.withColumn("status", F.lit("ok")).withColumn("found", extraction.rule_facts(F.col("messages"), params))
    return (found.withColumn("facts", extraction.first(F.col("found"), params.max_facts))
            .withColumn("skipped", F.lit(0).cast("long"))
            .withColumn("cut", (F.size("found") - F.size("facts")).cast("long")).drop("found"))


def extract_by_answers(batched: DataFrame, answers: DataFrame) -> DataFrame:
    """``facts`` per batch from model answers ``(chat_id, batch, answer)``.

    An answer that is not JSON yields no facts and marks the batch; a malformed
    item is skipped and counted, its siblings survive.
    """
    parsed = batched.join(answers, ["chat_id", "batch"]).withColumn("parsed", extraction.parse_answer(F.col("answer")))
    parsed = parsed.withColumn("status", extraction.answer_status(F.col("parsed")))
    items = F.try_variant_get("parsed", "$.entries", "array<variant>")
    judged = parsed.withColumn("items", F.when(F.col("status") == "ok", items))
    sound = F.filter("items", lambda i: extraction.skip_reason(i).isNull())
    return (
        judged.withColumn("facts", F.coalesce(
            F.transform(sound, extraction.item_fields), F.array().cast(extraction.FACT)))
        .withColumn("skipped", (F.coalesce(F.size("items"), F.lit(0)) - F.size("facts")).cast("long"))
        .withColumn("skipped", F.when(F.col("status") == "ok", F.col("skipped")).otherwise(0).cast("long"))
        .drop("items", "parsed", "answer"))


def answer_with(batched: DataFrame, client: Callable[[str, list], str]) -> DataFrame:
    """Ask a model client ``(system, user) -> answer`` per batch, inside the tasks."""
    requests = batched.select("chat_id", "batch", extraction.prompt_messages(F.col("messages")).alias("prompt"))
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema}

    def ask(frames: Iterator[pd.DataFrame]):
        for frame in frames:
            answers = [client(p[0]["content"], p[1]["content"]) for p in frame["prompt"]]
            yield frame[["chat_id", "batch"]].assign(answer=answers)

    return requests.mapInPandas(ask, f"chat_id {kinds['chat_id']}, batch {kinds['batch']}, answer string")


def fact_entries(extracted: DataFrame, at: Column, extractor: str = EXTRACTOR) -> DataFrame:
    """One episodic entry per extracted fact, in insertion order (``seq``)."""
    listed = extracted.select("chat_id", "batch", "sources", "fired_at", F.posexplode("facts").alias("pos", "f"))
    identity = entry_id(F.lit("episodic"), at, F.col("f.content"), F.col("f.subject"), F.col("f.tags"),
                        F.col("sources"), F.lit(extractor))
    return listed.select(
        "chat_id", identity.alias("id"),
        (F.col("fired_at") * _TURN_STRIDE + 1 + F.col("batch") % 65536 * _BATCH_STRIDE + F.col("pos")).alias("seq"),
        F.lit("episodic").alias("scope"), F.col("f.content").alias("content"), F.col("f.subject").alias("subject"),
        F.col("f.tags").alias("tags"), F.col("f.relations").alias("relations"), F.col("sources").alias("source_messages"),
        F.lit(extractor).alias("extractor"), at.alias("created_at"), "batch")


def working_entries(turns: DataFrame, at: Column, extractor: str = "seeder") -> DataFrame:
    """The raw turns as working entries; they stay in the store after a drain."""
    speaking = turns.filter(F.length(strip_space(F.coalesce("text", F.lit("")))) > 0)
    placed = number_rows(speaking, "chat_id", "turn", "place")
    sources = F.array(F.col("turn").cast("long"))
    none = F.array().cast("array<string>")
    return placed.select(
        "chat_id",
        entry_id(F.lit("working"), at, F.col("text"), F.lit(None).cast("string"), none, sources,
                 F.lit(extractor)).alias("id"),
        (F.col("place") * _TURN_STRIDE).alias("seq"), F.lit("working").alias("scope"),
        F.col("text").alias("content"), F.lit(None).cast("string").alias("subject"), none.alias("tags"),
        F.array().cast("array<struct<type:string,target:string>>").alias("relations"),
        sources.alias("source_messages"), F.lit(extractor).alias("extractor"), at.alias("created_at"))


def consolidate(extracted: DataFrame, at: Column, params: Params = DEFAULTS, extractor: str = EXTRACTOR,
                stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Fold extracted facts into episodic memory.

    Returns ``(entries, fates)``: the kept entries with their lifecycle after
    updates, and every fact with the entry it ended in (``target_seq``).
    ``stored`` holds episodic entries of earlier runs; new facts are numbered behind
    them. A stored entry keeps its lifecycle, and only a repeated one is updated.
    """
    facts = fact_entries(extracted, at, extractor)
    if stored is not None:
        first = facts.groupBy("chat_id").agg(F.min("seq").alias("first"))
        behind = stored.groupBy("chat_id").agg((F.max("seq") + 1).alias("behind")).join(first, "chat_id").select(
            "chat_id", F.greatest(F.lit(0), F.col("behind") - F.col("first")).alias("shift"))
        columns = facts.columns
        facts = facts.join(behind, "chat_id", "left").withColumn(
            "seq", F.col("seq") + F.coalesce("shift", F.lit(0))).select(columns)
    # same id means same fields: a later copy overwrites, so one row remains
    facts = settle(facts, "facts")
    columns = facts.columns
    if stored is not None:
        facts = facts.withColumn("stored", F.lit(False)).unionByName(
            stored.withColumn("stored", F.lit(True)), allowMissingColumns=True)
    fates = settle(fold_duplicates(facts, params), "fates")
    updates = fates.filter("target_seq <> seq").groupBy(
        "chat_id", F.col("target_seq").alias("seq")).agg(F.count("*").alias("updates"))
    kept = fates.filter("target_seq = seq").join(updates, ["chat_id", "seq"], "left")
    n = F.coalesce("updates", F.lit(0)).cast("long")
    had = lambda name, default: F.coalesce(name, default) if name in kept.columns else default
    untouched = (n == 0) & (F.col("stored") if stored is not None else F.lit(False))
    entries = kept.select(
        *columns, bumped(had("importance", F.lit(50.0)), n, params.update_bonus).alias("importance"),
        had("maturity", F.lit("draft")).alias("maturity"),
        F.when(untouched, had("updated_at", at)).otherwise(at).alias("updated_at"),
        had("access_count", F.lit(0).cast("long")).alias("access_count"),
        (had("update_count", F.lit(0).cast("long")) + n).alias("update_count"))
    one_per_id = entries.groupBy("chat_id", "id").agg(F.min_by(F.struct(*entries.columns), "seq").alias("e"))
    return one_per_id.select("e.*"), fates


def batch_report(extracted: DataFrame, fates: DataFrame) -> DataFrame:
    """Per batch: added, updated, drained, parse failures, skipped items, facts beyond the limit."""
    counted = fates.groupBy("chat_id", "batch").agg(
        F.count_if(F.col("target_seq") == F.col("seq")).alias("added"),
        F.count_if(F.col("target_seq") != F.col("seq")).alias("updated"))
    return extracted.join(counted, ["chat_id", "batch"], "left").select(
        "chat_id", "batch", F.coalesce("added", F.lit(0)).cast("long").alias("added"),
        F.coalesce("updated", F.lit(0)).cast("long").alias("updated"),
        F.size("sources").cast("long").alias("drained"),
        (F.col("status") == "parse_failure").cast("long").alias("parse_failures"),
        F.col("skipped").alias("entries_skipped"),
        (F.col("cut") if "cut" in extracted.columns else F.lit(0).cast("long")).alias("facts_cut"))


def chat_status(report: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Facts since the last rebuild, and whether a rebuild is due."""
    return report.groupBy("chat_id").agg(F.sum("added").alias("facts_since_rebuild")).withColumn(
        "rebuild_due", F.col("facts_since_rebuild") >= params.rebuild_suggestion)


def remember(turns: DataFrame, at: Column, params: Params = DEFAULTS) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Whole write path over a table of turns: entries, edges, fates, extracted."""
    extracted = settle(extract_by_rules(batches(turns, params), params), "extracted")
    entries, fates = consolidate(extracted, at, params)
    entries = settle(entries, "episodic")
    return entries, settle(build_edges(entries, params), "edges"), fates, extracted


def remember_more(turns: DataFrame, at: Column, entries: DataFrame, edges: DataFrame,
                  params: Params = DEFAULTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The write path over new turns of chats that already have ``entries`` and ``edges``.

    Returns ``(entries, edges, evicted)``: stored entries with their lifecycle and the new ones, the
    edges under the cap, and stored edges that stronger new ones put out.
    """
    extracted = settle(extract_by_rules(batches(turns, params), params), "extracted")
    merged = settle(consolidate(extracted, at, params, stored=entries)[0], "episodic")
    judged = settle(cap_edges(edges, build_edges(merged, params), params), "judged")
    alone = edges.join(judged.select("chat_id", "from_id").distinct(), ["chat_id", "from_id"], "left_anti")
    kept = alone.unionByName(judged.filter("fate = 'kept'").select(edges.columns))
    return merged, kept, judged.filter("fate = 'evicted'").select(edges.columns)
