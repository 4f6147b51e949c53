"""Model answers kept as a table: keys, read-through, ingest of batch results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rememora.functions.extraction import prompt_messages
from rememora.functions.identity import cache_key
from rememora.functions.text import strip_reasoning, strip_space
from rememora.operators.consolidate import answer_with, batches
from rememora.params import DEFAULTS, Params

BATCH_LINE = (
    "custom_id string, response struct<status_code:long,choices:array<struct<message:struct<content:string>,"
    "finish_reason:string>>,body:struct<choices:array<struct<message:struct<content:string>,finish_reason:string>>>>")


def key_of(prompt: Column, model: str, max_tokens: int) -> Column:
    return cache_key(F.lit(model), F.to_json(prompt), F.lit(max_tokens))


def enumerate_batches(turns: DataFrame, model: str, params: Params = DEFAULTS) -> DataFrame:
    """Every request a corpus needs: ``(chat_id, batch, key, prompt)``, blank turns left out."""
    steady = params.override(buffer_threshold=params.batch_size)
    prompt = prompt_messages(F.col("messages"))
    return batches(turns, steady).select("chat_id", "batch", "messages", prompt.alias("prompt")).withColumn(
        "key", key_of(F.col("prompt"), model, params.extract_max_tokens))


def split_by_cache(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests the cache ``(key, answer)`` answers, and those it does not."""
    return requests.join(cache.select("key", "answer"), "key"), requests.join(cache, "key", "left_anti")


def read_through(requests: DataFrame, cache: DataFrame, client: Callable[[str, list], str]) -> tuple[DataFrame, DataFrame]:
    """Answers for all requests, and the cache with the new ones added."""
    known, missing = split_by_cache(requests, cache)
    asked = answer_with(missing.select("chat_id", "batch", "messages"), client)
    fresh = missing.join(asked, ["chat_id", "batch"])
    answers = known.select("chat_id", "batch", "answer").unionByName(fresh.select("chat_id", "batch", "answer"))
    return answers, cache.select("key", "answer").unionByName(fresh.select("key", "answer").dropDuplicates(["key"]))


def ingest(lines: DataFrame) -> DataFrame:
    """Batch results, one JSON line in ``value``: ``(key, answer, reason)``.

    ``reason`` is NULL for a usable row. Two provider layouts are read: choices
    in the response or in its body.
    """
    row = lines.filter(F.length(strip_space(F.col("value"))) > 0).select(
        F.try_parse_json("value").alias("v"), F.from_json("value", BATCH_LINE).alias("r"))
    choice = F.coalesce(F.get("r.response.choices", F.lit(0)), F.get("r.response.body.choices", F.lit(0)))
    named = row.select("v", F.col("r.custom_id").alias("id"), F.col("r.response.status_code").alias("status"), choice.alias("c"))
    reason = (
        F.when(F.col("v").isNull(), "not json")
        .when(F.coalesce(F.length("id"), F.lit(0)) == 0, "missing custom_id")
        .when(F.col("id").rlike(r"[/\\]|\.\."), "unsafe custom_id")
        .when(F.col("status").isNotNull() & (F.col("status") != 200), F.concat(F.lit("status "), "status"))
        .when(F.coalesce(F.length("c.message.content"), F.lit(0)) == 0, "no content")
        .when(~F.col("c.finish_reason").eqNullSafe(F.lit("stop")),
              F.concat(F.lit("finish "), F.coalesce("c.finish_reason", F.lit("missing")))))
    judged = named.select(
        F.when(F.col("v").isNull(), "(unparseable)").when(F.coalesce(F.length("id"), F.lit(0)) == 0, "(missing)")
        .otherwise(F.col("id")).alias("key"), F.col("c.message.content").alias("answer"), reason.alias("reason"))
    return judged


def without_reasoning(answers: DataFrame) -> DataFrame:
    """Answers without their leading thinking block; what is empty then is dropped."""
    stripped = answers.withColumn("answer", strip_reasoning(F.col("answer")))
    return stripped.filter(F.length(strip_space(F.col("answer"))) > 0)


def load_results(spark: SparkSession, path: str) -> DataFrame:
    return ingest(spark.read.text(path))
