"""One generation request per chat: load, retrieve, persist, format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rememora.functions.text import intent
from rememora.operators import caches, tiers, upkeep
from rememora.params import DEFAULTS, Params
from rememora.session import settle
from rememora.sources.state import Store

QUERY = ["chat_id", "query_id"]


def _traces(resolved: DataFrame, asked: DataFrame, at: Column, scorer: str, cause: str | None) -> DataFrame:
    """One trace per query; a query returns at most k entries and the buffer."""
    ranked = resolved.groupBy(*QUERY, "tier").agg(
        F.sort_array(F.collect_list(F.struct("rank", "id", "bm25", "score"))).alias("rows"))
    scored = F.transform(F.filter("rows", lambda r: ~r["score"].isin(float("inf"))), lambda r: F.struct(
        r["id"].alias("id"), r["bm25"].alias("bm25"), r["score"].alias("score")))
    nothing = {name: F.lit(None).cast(kind) for name, kind in (
        ("fact_count", "long"), ("added", "long"), ("updated", "long"), ("duration_ms", "long"), ("error", "string"))}
    return asked.join(ranked, QUERY).select(
        "chat_id", F.col("query_id").cast("long").alias("seq"), F.lit("retrieve").alias("kind"), at.alias("at"), "query",
        intent(F.col("query")).alias("intent"), "tier", F.create_map("tier", scored).alias("per_tier"),
        F.transform("rows", lambda r: r["id"]).alias("ranking"), F.lit(scorer).alias("scorer"),
        F.lit(cause).cast("string").alias("cause")).withColumns(nothing)


def answer(store: Store, turns: DataFrame, at: Column, k: int = 5, params: Params = DEFAULTS,
           mode: str = "automatic", cause: str | None = None) -> DataFrame | None:
    """Memory blocks ``(chat_id, query_id, block)`` for the latest user turn of each chat.

    The request leaves its marks: both caches, an access per returned entry and
    a trace. ``query_id`` is the turn, which also orders the cache writes. Mode
    ``off`` retrieves nothing.
    """
    if mode == "off":
        return None
    asked = settle(upkeep.last_user_query(turns).select(
        "chat_id", F.col("turn").cast("long").alias("query_id"), "query", F.col("turn").cast("long").alias("written")), "asked")
    chats = asked.select("chat_id").distinct()

    def mine(name):
        return store.load(name).join(chats, "chat_id", "left_semi")

    # settled first: the tables are overwritten below
    entries = settle(mine("entries"), "loaded-entries")
    held = caches.Caches(settle(mine("exact_cache"), "loaded-exact"), settle(mine("fuzzy_cache"), "loaded-fuzzy"))
    buffer = mine("buffer").select("chat_id", "id", (F.col("pos") + 1).cast("int").alias("pos"))
    working = settle(buffer.join(entries.select("chat_id", "id"), ["chat_id", "id"], "left_semi"), "working")
    plain = asked.select(*QUERY, "query")
    resolved = settle(tiers.ladder(entries, mine("edges"), plain, at, k, params, working=working, caches=held), "resolved")
    fresh = resolved.join(working.select("chat_id", "id"), ["chat_id", "id"], "left_anti")
    after = held.updated(asked, fresh, params)
    store.persist("exact_cache", settle(after.exact, "new-exact"))
    store.persist("fuzzy_cache", settle(after.fuzzy, "new-fuzzy"))
    accessed = upkeep.apply_events(entries, upkeep.access_events(resolved, working, at), params)
    store.persist("entries", settle(accessed, "new-entries"))
    traced = mine("traces").unionByName(_traces(resolved, plain, at, "default", cause))
    store.persist("traces", settle(upkeep.ring(traced, params.trace_cap), "new-traces"))
    return upkeep.memory_block(resolved, entries)
