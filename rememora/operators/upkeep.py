"""Maintenance of a chat's state: bumps, rings, retractions, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rememora.functions.lifecycle import bumped, is_maturity
from rememora.functions.text import strip_space
from rememora.operators.ranking import top_k
from rememora.params import DEFAULTS, EDGE_TYPES, SCOPES, Params


def apply_events(entries: DataFrame, events: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Accrue ``events(chat_id, id, kind, at)`` with kind access or update.

    Bonuses are positive and the clamp is monotone, so the counts decide the
    result whatever the order of the events. Entries without events pass through.
    """
    counted = events.groupBy("chat_id", "id").agg(
        F.count_if(F.col("kind") == "access").alias("accesses"),
        F.count_if(F.col("kind") == "update").alias("updates"),
        F.max(F.when(F.col("kind") == "update", F.col("at"))).alias("last_update"))
    n_access, n_update = F.coalesce("accesses", F.lit(0)), F.coalesce("updates", F.lit(0))
    gained = bumped(bumped(F.col("importance"), n_access, params.access_bonus), n_update, params.update_bonus)
    joined = entries.join(counted, ["chat_id", "id"], "left")
    return (joined.withColumn("importance", gained)
            .withColumn("access_count", F.col("access_count") + n_access)
            .withColumn("update_count", F.col("update_count") + n_update)
            .withColumn("updated_at", F.coalesce("last_update", "updated_at"))
            .drop("accesses", "updates", "last_update"))


def access_events(resolved: DataFrame, working: DataFrame, at: Column) -> DataFrame:
    """One access per returned entry that is not part of the working buffer."""
    returned = resolved.filter(F.col("id").isNotNull()).select("chat_id", "id")
    return returned.join(working.select("chat_id", "id"), ["chat_id", "id"], "left_anti").select(
        "chat_id", "id", F.lit("access").alias("kind"), at.alias("at"))


def ring(traces: DataFrame, cap: int = DEFAULTS.trace_cap, order: str = "seq") -> DataFrame:
    """The newest ``cap`` traces of each chat."""
    return top_k(traces, ["chat_id"], [F.desc(order)], cap, "age").drop("age")


def clear_traces(traces: DataFrame, chats: DataFrame) -> DataFrame:
    return traces.join(chats.select("chat_id"), "chat_id", "left_anti")


def scrub(buffer: DataFrame, retracted: DataFrame) -> DataFrame:
    """Drop buffered entries that stem from a retracted message; facts are not touched."""
    touched = buffer.select("chat_id", "id", F.explode("source_messages").alias("message")).join(
        retracted.select("chat_id", "message"), ["chat_id", "message"], "left_semi")
    return buffer.join(touched.select("chat_id", "id").distinct(), ["chat_id", "id"], "left_anti")


def accepted_messages(messages: DataFrame) -> DataFrame:
    """Messages that enter the working buffer: spoken by a character and not blank."""
    return messages.filter(
        (F.col("role") == "assistant") & ~F.coalesce(F.col("is_first"), F.lit(False))
        & (F.length(strip_space(F.coalesce("text", F.lit("")))) > 0))


def last_user_query(turns: DataFrame) -> DataFrame:
    """The latest non-blank user message of each chat."""
    asked = turns.filter((F.col("role") == "user") & (F.length(strip_space(F.coalesce("text", F.lit("")))) > 0))
    return asked.groupBy("chat_id").agg(F.max_by("text", "turn").alias("query"), F.max("turn").alias("turn"))


def memory_block(ranked: DataFrame, entries: DataFrame) -> DataFrame:
    """The text handed to the host: one line per retrieved memory, in rank order."""
    lines = ranked.join(entries.select("chat_id", "id", "content"), ["chat_id", "id"])
    # a query returns at most k entries plus the bounded buffer
    listed = lines.groupBy("chat_id", "query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "content"))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda r: F.concat(F.lit("- "), r["content"])), "\n")
    return listed.select("chat_id", "query_id", F.concat(F.lit("Retrieved memories:\n"), body).alias("block"))


def valid_entry() -> Column:
    """Whether the entry columns hold a well-formed entry."""
    def whole(c):
        return F.coalesce(c, F.lit(False))

    return whole(
        (F.length("id") > 0) & F.col("scope").isin(*SCOPES) & (F.length("content") > 0)
        & F.forall("tags", lambda t: t.isNotNull())
        & F.forall("relations", lambda r: r["type"].isin(*EDGE_TYPES) & (F.length(r["target"]) > 0))
        & F.col("importance").between(0, 100) & is_maturity(F.col("maturity"))
        & F.col("created_at").isNotNull() & F.col("updated_at").isNotNull()
        & (F.col("access_count") >= 0) & (F.col("update_count") >= 0)
        & F.forall("source_messages", lambda n: n.isNotNull()) & F.col("extractor").isNotNull())


def new_entries(raw: DataFrame, at: Column) -> DataFrame:
    """Entries from raw fields with the starting lifecycle; invalid rows raise."""
    from rememora.functions.identity import entry_id

    none = F.array().cast("array<struct<type:string,target:string>>")
    relations = F.coalesce(F.col("relations"), none) if "relations" in raw.columns else none
    born = raw.withColumn("relations", relations).select(
        "*", entry_id(F.col("scope"), at, F.col("content"), F.col("subject"), F.col("tags"),
                      F.col("source_messages"), F.col("extractor")).alias("id"),
        F.lit(50.0).alias("importance"), F.lit("draft").alias("maturity"), at.alias("created_at"),
        at.alias("updated_at"), F.lit(0).cast("long").alias("access_count"), F.lit(0).cast("long").alias("update_count"))
    checked = F.when(valid_entry(), F.col("id")).otherwise(F.raise_error(F.lit("invalid entry")).cast("string"))
    return born.withColumn("id", checked)


def tagged_share(entries: DataFrame) -> DataFrame:
    """Share of entries with at least one tag, per chat."""
    return entries.groupBy("chat_id").agg(F.avg((F.size("tags") > 0).cast("double")).alias("tagged"))
