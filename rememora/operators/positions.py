"""Exact order statistics and ranks without sorting a group in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

BINS = 4096


def value_positions(df: DataFrame, keys: list[str], value: str, levels: int = 2) -> DataFrame:
    """``(keys, value, n_here, before)``: how many rows of the key lie below each distinct value.

    Equal values collapse first. Each level then cuts every cell into at most
    BINS equal ranges of the values it really holds, so the prefix sums see at
    most BINS rows per cell and the last window only one narrow range.
    """
    cells = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n_here"))
    cells = cells.withColumn("before", F.lit(0).cast("long"))
    path = list(keys)
    for level in range(levels):
        cell = f"__cell{level}"
        bounds = cells.groupBy(*path).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
        width = F.col("__hi") - F.col("__lo")
        share = F.when(width > 0, (F.col(value) - F.col("__lo")) / width).otherwise(0.0)
        cells = cells.join(bounds, path).withColumn(
            cell, F.floor(share * (BINS - 1)).cast("int")).drop("__lo", "__hi")
        order = Window.partitionBy(*path).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
        shifts = cells.groupBy(*path, cell).agg(F.sum("n_here").alias("__n")).select(
            *path, cell, F.coalesce(F.sum("__n").over(order), F.lit(0)).alias("__shift"))
        path = path + [cell]
        cells = cells.join(shifts, path).withColumn("before", F.col("before") + F.col("__shift")).drop("__shift")
    order = Window.partitionBy(*path).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn(
        "before", F.col("before") + F.coalesce(F.sum("n_here").over(order), F.lit(0))
    ).select(*keys, value, "n_here", "before")


Rule = Callable[[Column], Column]


def at_floor_n1(p: float) -> Rule:
    """sorted[floor((n - 1) p)]"""
    return lambda n: F.floor((n - 1) * F.lit(p))


def at_floor_n(p: float) -> Rule:
    """sorted[min(n - 1, floor(n p))]"""
    return lambda n: F.least(n - 1, F.floor(n * F.lit(p)))


def at_nearest(p: float) -> Rule:
    """sorted[round((n - 1) p)]"""
    return lambda n: F.floor((n - 1) * F.lit(p) + F.lit(0.5))


def order_statistics(df: DataFrame, keys: list[str], value: str, wanted: dict[str, Rule]) -> DataFrame:
    """One row per key: ``n`` and the value found at each wanted index."""
    positions = value_positions(df, keys, value)
    sizes = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"))
    held = positions.join(sizes, keys)
    picks = []
    for name, rule in wanted.items():
        index = rule(F.col("n"))
        inside = (F.col("before") <= index) & (index < F.col("before") + F.col("n_here"))
        picks.append(F.max(F.when(inside, F.col(value))).alias(name))
    return held.groupBy(*keys).agg(F.first("n").alias("n"), *picks)


def average_ranks(df: DataFrame, keys: list[str], value: str, target: str) -> DataFrame:
    """Add the one-based rank of ``value`` within the key; ties share their mean rank."""
    ranked = value_positions(df, keys, value).select(
        *keys, value, (F.col("before") + (F.col("n_here") + 1) / 2).alias(target))
    return df.join(ranked, [*keys, value], "left")
