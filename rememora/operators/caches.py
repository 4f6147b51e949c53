"""Query caches as tables: exact by key, fuzzy by token set, bounded by last write."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from rememora.functions.text import exact_key, token_key, token_set
from rememora.operators.dedup import similar_sets
from rememora.operators.ranking import top_k
from rememora.params import DEFAULTS, Params
from rememora.session import settle

QUERY = ["chat_id", "query_id"]


def record(cache: DataFrame, writes: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Store ``writes(chat_id, key, ids, written)``; the newest ``cache_cap`` keys remain.

    A rewrite moves its key to the end; reads do not. Empty keys are not stored.
    """
    latest = cache.unionByName(writes).groupBy("chat_id", "key").agg(
        F.max_by("ids", "written").alias("ids"), F.max("written").alias("written"))
    # empty keys go last and then out, by a column of their own: a filter on the key would make every key of a long text once more
    marked = latest.withColumn("filled", F.coalesce(F.length("key") > 0, F.lit(False)))
    return top_k(marked, ["chat_id"], [F.desc("filled"), *_newest()], params.cache_cap, "age").filter("filled").drop("age", "filled")


def _newest() -> list[Column]:
    return [F.desc("written"), F.desc("key")]


def evict(cache: DataFrame, cap: int) -> DataFrame:
    return top_k(cache, ["chat_id"], _newest(), cap, "age").drop("age")


def invalidate(cache: DataFrame, chats: DataFrame) -> DataFrame:
    """Forget all keys of the given chats (after a long-term write: the exact cache only)."""
    return cache.join(chats.select("chat_id"), "chat_id", "left_anti")


def exact_writes(results: DataFrame) -> DataFrame:
    """Cache rows for ``results(chat_id, query, ids, written)``."""
    return results.select("chat_id", exact_key(F.col("query")).alias("key"), "ids", "written")


def fuzzy_writes(results: DataFrame) -> DataFrame:
    return results.select("chat_id", token_key(F.col("query")).alias("key"), "ids", "written")


def exact_hits(cache: DataFrame, queries: DataFrame) -> DataFrame:
    """``(chat_id, query_id, ids)``; a stored empty list is a miss."""
    # no key is empty in a cache; one that cannot be null is not made once more to look for nulls
    keyed = queries.select(*QUERY, F.coalesce(exact_key(F.col("query")), F.lit("")).alias("key"))
    return keyed.join(cache.filter(F.size("ids") > 0), ["chat_id", "key"]).select(*QUERY, "ids")


def fuzzy_hits(cache: DataFrame, queries: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Most similar cached query at or above the threshold; the oldest write wins ties.

    ``(chat_id, query_id, key, similarity, ids)``.
    """
    asked = settle(queries.select("chat_id", F.col("query_id").alias("a"),
                                  token_set(F.col("query")).alias("toks")), "asked")
    held = settle(cache.filter(F.length("key") > 0).select(
        "chat_id", F.xxhash64("written", "key").alias("b"), "written", "key", "ids", F.split("key", " ").alias("toks")), "held")
    near = similar_sets(asked, held.select("chat_id", "b", "toks"), ["chat_id"], params.fuzzy_threshold)
    # two writes may share a stamp, so a row is named by stamp and key
    found = near.join(held.select("chat_id", "b", "written", "key", "ids"), ["chat_id", "b"])
    best = top_k(found, ["chat_id", "a"], [F.desc("similarity"), F.asc("written"), F.asc("key")], 1)
    return best.select(
        "chat_id", F.col("a").alias("query_id"), "key", "similarity", "ids")


def dereference(hits: DataFrame, entries: DataFrame, tier: str) -> DataFrame:
    """Cached ids to entries in order; ids that no longer exist drop out.

    A hit whose ids are all gone stays a hit: one row with a null id.
    """
    listed = hits.select(*QUERY, F.posexplode("ids").alias("pos", "id"))
    alive = listed.join(entries.select("chat_id", "id"), ["chat_id", "id"], "left_semi")
    found = hits.select(*QUERY).join(alive, QUERY, "left")
    ranked = top_k(found, QUERY, [F.asc("pos")], 2**31 - 1)
    return ranked.select(*QUERY, "id", "rank", F.lit(0.0).alias("bm25"), F.lit(0.0).alias("score"),
                         F.lit(tier).alias("tier"))


@dataclass(frozen=True)
class Caches:
    """Both caches of a snapshot; the exact one answers first."""

    exact: DataFrame
    fuzzy: DataFrame

    def lookup(self, queries: DataFrame, entries: DataFrame, params: Params = DEFAULTS) -> DataFrame:
        first = dereference(exact_hits(self.exact, queries), entries, "0")
        rest = queries.join(first.select(*QUERY).distinct(), QUERY, "left_anti")
        second = dereference(fuzzy_hits(self.fuzzy, rest, params), entries, "1")
        return settle(first.unionByName(second), "cache-hits")

    def updated(self, queries: DataFrame, resolved: DataFrame, params: Params = DEFAULTS) -> "Caches":
        """Caches after a batch: the graph tier writes both, a fuzzy hit the exact one.

        ``queries`` needs a ``written`` column: the order in which they were asked.
        """
        answers = resolved.filter(F.col("tier").isin("1", "3")).groupBy(*QUERY, "tier").agg(
            F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda r: r["id"]).alias("ids"))
        answers = answers.withColumn("ids", F.filter("ids", lambda i: i.isNotNull()))
        rows = settle(queries.join(answers, QUERY).select("chat_id", "query", "ids", "written", "tier"), "cache-writes")
        return Caches(record(self.exact, exact_writes(rows), params),
                      record(self.fuzzy, fuzzy_writes(rows.filter("tier = '3'")), params))
