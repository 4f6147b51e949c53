"""A conversation corpus run end to end: remember, ask, score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from rememora.functions.identity import row_digest
from rememora.operators import baselines, consolidate, graph, grid, metrics, tiers
from rememora.params import DEFAULTS, Params
from rememora.session import settle

QUERY = ["chat_id", "query_id"]


@dataclass(frozen=True)
class Memory:
    """State of all chats after seeding: what the ladder and the baselines search."""

    entries: DataFrame  # episodic and, for the baselines, working entries
    edges: DataFrame
    fates: DataFrame
    extracted: DataFrame


def seed(turns: DataFrame, at: Column, params: Params = DEFAULTS) -> Memory:
    episodic, edges, fates, extracted = consolidate.remember(turns, at, params)
    working = consolidate.working_entries(turns, at)
    entries = episodic.unionByName(working, allowMissingColumns=True)
    entries = entries.fillna({"importance": 50.0, "maturity": "draft"})
    return Memory(settle(entries, "memory"), edges, fates, extracted)


def questions(turns: DataFrame) -> DataFrame:
    """User turns as questions; the turn and its answer are the evidence.

    A question that nobody answers is an abstention item.
    """
    answers = turns.filter(F.col("role") == "assistant").select(
        "chat_id", (F.col("turn") - 1).alias("turn"), F.lit(True).alias("answered"))
    asked = turns.filter(F.col("role") == "user").join(answers, ["chat_id", "turn"], "left")
    turn = F.col("turn").cast("long")
    return asked.select(
        "chat_id", turn.alias("query_id"), F.col("text").alias("query"),
        F.array(turn, turn + 1).alias("evidence"),
        F.when(F.col("turn") <= 1, "opening").otherwise("follow-up").alias("task_type"),
        F.col("answered").isNull().alias("abstention"))


def with_sources(ranked: DataFrame, memory: Memory) -> DataFrame:
    return ranked.join(memory.entries.select("chat_id", "id", "source_messages"), ["chat_id", "id"])


def run(memory: Memory, qa: DataFrame, retriever: str, at: Column, k: int = 10,
        params: Params = DEFAULTS) -> DataFrame:
    """Ranked entries of one retriever for every question."""
    asked = qa.select(*QUERY, "query")
    if retriever == "ladder":
        found = tiers.ladder(memory.entries, memory.edges, asked, at, k, params)
    elif retriever == "bm25only":
        found = baselines.lexical_only(memory.entries, asked, k, params).withColumn("score", F.col("bm25"))
    elif retriever == "recency":
        found = baselines.most_recent(memory.entries, asked, k, "created_at")
    elif retriever == "random":
        found = baselines.seeded_random(memory.entries, asked, k)
    else:
        raise ValueError(f"unknown retriever: {retriever}")
    for name in ("tier", "bm25", "score"):
        if name not in found.columns:
            found = found.withColumn(name, F.lit(None).cast("string" if name == "tier" else "double"))
    return found.select(*QUERY, F.col("rank").cast("long").alias("rank"), "id", "tier", "bm25", "score")


def sweep(memory: Memory, qa: DataFrame, points: list[Params], at: Column, k: int = 10) -> DataFrame:
    """One row of metrics per grid point, with its swept knobs; memory, index, candidates and edges are shared by all points."""
    edges = graph.build_edges(memory.entries, grid.widest(points), ranked=True)
    found = grid.ladder_points(memory.entries, edges, qa.select(*QUERY, "query"), at, k, points)
    asked = qa.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(points) - 1))).alias("point"))
    scores = metrics.per_query(settle(with_sources(found, memory), "swept"), asked, keys=[*QUERY, "point"])
    knob = lambda name: F.get(F.array(*(F.lit(getattr(p, name)) for p in points)), F.col("point")).alias(name)
    return metrics.summarize(scores, ["point"]).select("*", *map(knob, grid.SWEPT))


def digest(entries: DataFrame) -> DataFrame:
    """Per chat: number of entries and a stable fingerprint of them in order.

    Row hashes include the position, so summing them needs no ordered gather.
    """
    row = row_digest(F.col("seq"), F.col("id"), F.col("content"), F.col("subject"))
    return entries.groupBy("chat_id").agg(
        F.count("*").alias("n_facts"), F.sum(row).cast("string").alias("fingerprint"))
