"""Per-group top-k with an explicit tie order.

``row_number() <= k`` lets Spark cut each task's rows to k per group before
the shuffle, so a hot group never travels whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# scores are rounded before ranking so that equal documents tie whatever the
# order in which their terms were summed
SCORE_DIGITS = 10


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def rounded(score: Column, digits: int = SCORE_DIGITS) -> Column:
    return F.round(score, digits)
