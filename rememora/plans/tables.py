"""How the driver tables stand in for chats, entries, queries and turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rememora.functions.text import entities

# the injected clock: no query reads the wall clock
NOW = "2025-01-01T00:00:00Z"


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# a micro-batch takes whole files up to this size, so the rows of a chat that meet in one are bounded
BATCH_BYTES = 4 << 30


def stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table as a file stream; the pattern matches one file as well as a folder of files."""
    schema = load(spark, folder, name).schema
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", BATCH_BYTES).parquet(f"{folder}/{name}.parque[t]")


# fewer splits than this are dealt out anew: at most that many times ``spark.sql.files.maxPartitionBytes`` is moved, on any cluster
FEW_SPLITS = 16


def spread(df: DataFrame) -> DataFrame:
    """Deal out a table that arrives in a handful of splits; what is moved is bounded, results do not depend on it."""
    return df.repartition(FEW_SPLITS) if df.rdd.getNumPartitions() < FEW_SPLITS else df


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as memory entries: one chat per language."""
    importance = ((F.col("doc_id") * 37) % 101).cast("double")
    created_s = F.lit(1704067200) + ((F.col("doc_id") * 7919) % 8760) * 3600
    return spread(load(spark, folder, "documents").select("doc_id", "text", "lang", "source")).select(
        F.col("lang").alias("chat_id"),
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"),
        F.col("doc_id").alias("seq"),
        F.when(F.col("source") == "src0", "working")
        .when(F.col("source") == "src1", "persona").otherwise("episodic").alias("scope"),
        F.col("text").alias("content"),
        F.try_element_at(entities(F.col("text")), F.lit(1)).alias("subject"),
        F.array("source").alias("tags"),
        importance.alias("importance"),
        F.when(importance >= 85, "core").when(importance >= 65, "validated").otherwise("draft").alias("maturity"),
        F.timestamp_seconds(created_s).alias("created_at"),
    )


def queries(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark passages as queries, routed to a chat by their function words."""
    text = F.lower(F.col("text"))
    chat = (
        F.when(text.rlike("(^|[^a-z])(the|of|that)([^a-z]|$)"), "en")
        .when(text.rlike("(^|[^a-z])(der|die|und)([^a-z]|$)"), "de")
        .when(text.rlike("(^|[^a-z])(el|los|las|y)([^a-z]|$)"), "es")
        .otherwise("fr"))
    return load(spark, folder, "benchmark").select(
        chat.alias("chat_id"), F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def turns(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns ``(chat_id, turn, role, text)``."""
    return load(spark, folder, "conversations").select(
        F.col("conv_id").alias("chat_id"), "turn", "role", "text")
