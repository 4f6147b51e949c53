"""Traced calls: latency, tier and query text out of varying input layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: where the query text has been seen, in order of trust
QUERY_KEYS = ("arg1", "queryStr", "query", "q", "1")
MAX_QUERY_CHARS = 500


def query_text(inputs: Column) -> Column:
    """First non-empty string among the known places of a JSON input object.

    Only when none of the places exists, whatever it holds, the shortest short string value is taken.
    """
    parsed = F.try_parse_json(inputs)
    places = [F.try_variant_get(parsed, path, "variant") for path in (*(f"$['{k}']" for k in QUERY_KEYS), "$.args[1]")]
    string = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    named = F.coalesce(*[F.when(F.length(string(v)) > 0, string(v)) for v in places])
    values = F.filter(F.transform(F.map_values(F.from_json(inputs, "map<string,variant>")), string), lambda v: v.isNotNull())
    short = F.filter(values, lambda v: (F.length(v) > 0) & (F.length(v) < MAX_QUERY_CHARS))
    shortest = F.get(F.array_sort(short, lambda a, b: F.length(a) - F.length(b)), F.lit(0))
    present = F.coalesce(*places)
    return F.when(present.isNotNull(), named).otherwise(shortest)


def bare_operation(name: Column) -> Column:
    """Operation name without the address around it."""
    tail = F.regexp_extract(name, r"/op/([^:]*)", 1)
    return F.when(F.contains(name, F.lit("/op/")), tail).otherwise(name)


def calls(raw: DataFrame, operation: str | None = None, since: Column | None = None) -> DataFrame:
    """``raw(id, op_name, started_at, ended_at, inputs, output)`` as timed calls.

    Calls without both timestamps are dropped.
    """
    rows = raw.filter(F.col("started_at").isNotNull() & F.col("ended_at").isNotNull())
    if operation:
        rows = rows.filter(bare_operation(F.col("op_name")) == operation)
    if since is not None:
        rows = rows.filter(F.col("started_at") >= since)
    micros = F.unix_micros(F.col("ended_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    text = query_text(F.col("inputs"))
    return rows.select("id", "started_at", "ended_at", (micros / 1000).alias("lat_ms"),
                       F.get_json_object("output", "$.tierResolved").alias("tier"), text.alias("query")).withColumn(
        "query_len", F.length("query").cast("long"))
