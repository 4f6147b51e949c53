"""Row numbers inside a key, without sending a hot key to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def number_rows(df: DataFrame, key: str, order: str, target: str, width: int = 65_536) -> DataFrame:
    """Zero-based position of each row within ``key`` by the integer column ``order``.

    Rows are cut into fixed ranges of ``order``; each range is numbered by its
    own task and shifted by the count of the ranges before it. The prefix sum
    runs over one row per range, so a key with a third of all rows still spreads
    over as many tasks as it has ranges.
    """
    ranged = df.withColumn("__range", F.floor(F.col(order) / F.lit(width)))
    counts = ranged.groupBy(key, "__range").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        key, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(key, "__range").orderBy(order)
    return (
        ranged.withColumn("__row", F.row_number().over(inside) - 1)
        .join(offsets, [key, "__range"])
        .withColumn(target, F.col("__before") + F.col("__row"))
        .drop("__range", "__row", "__before")
    )


def batch_of(position, batch_size: int, threshold: int):
    """Batch number of a non-blank turn when turns arrive one at a time.

    A batch fires when the buffer holds ``threshold`` turns and drains
    ``batch_size`` of them; the rest drains at the end. That is a closed form.
    """
    return F.floor(position / F.lit(min(batch_size, threshold)))
