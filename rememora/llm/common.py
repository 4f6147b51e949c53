"""Shared helpers of the operators: tables, Arrow slices, folds, linked components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rememora.session import settle

SLICE_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; remainder 2 is held out."""
    return F.crc32(doc_id.cast("string")) % 4


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == 2, F.lit(False))


def drawn_share(rows: DataFrame, hashed: Column, wanted: int, total: int) -> DataFrame:
    """About ``wanted`` of ``total`` rows, by a hash of 64 bits; all of them if there are no more."""
    if total <= wanted:
        return rows
    return rows.where(F.shiftrightunsigned(hashed, 1) < F.lit((wanted << 63) // total))


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``size`` bytes of ``column`` (one row at least)."""
    length = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    part = np.cumsum(length) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for begin, end in zip(cuts, cuts[1:]):
        if end > begin:
            yield batch.slice(begin, end - begin)


def filled(batch: pa.RecordBatch, column: str) -> pa.Array:
    """The strings of a column; null counts as empty."""
    return pc.fill_null(batch.column(column), "")


_kept: dict[str, Callable[[], None]] = {}


def hand_back() -> None:
    """Give memory that is free in this process back to the system: a worker lives on between tasks and operators."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


@contextmanager
def no_cycles(owner: str = "", forget: Callable[[], None] | None = None):
    """Rest a worker's cycle collector for one task: caches of strings hold no cycles, and scanning them costs a tenth of the time.

    What earlier tasks left in cycles, above all their functions with the models these hold, is collected first.
    A cache that ``owner`` keeps from task to task goes, by its ``forget``, when a task of another operator begins.
    """
    for name in [k for k in _kept if k != owner]:
        _kept.pop(name)()
    if forget:
        _kept[owner] = forget
    gc.collect()
    hand_back()
    gc.disable()
    try:
        yield
    finally:
        gc.enable()
        hand_back()


def buffers(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array end to end, and where each string starts (one more at the end)."""
    strings = strings.cast(pa.large_binary())
    offsets = np.frombuffer(strings.buffers()[1], np.int64, len(strings) + 1, strings.offset * 8)
    raw = strings.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def components(edges: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` to ``(node, root)``: the smallest node reachable, for every node that has a link.

    Large-star and small-star rounds; minima are pre-aggregated and joined back, so a node with many
    links is a skewed join key that adaptive execution splits, never one task's group. The loop ends
    when a round changes nothing.
    """
    def digest(e):
        row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return row["n"], row["h"]

    a, b = F.col("a"), F.col("b")
    e = settle(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    state = digest(e)
    while state[0]:
        both = e.unionAll(e.select(b.alias("a"), a.alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where(b > a).join(low, "a").select(b.alias("a"), F.col("m").alias("b")).where(a != b).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
                 .unionAll(low.select("a", F.col("m").alias("b"))).distinct())
        e = settle(small, "edges")
        before, state = state, digest(e)
        if state == before:
            break
    return e.select(a.alias("node"), b.alias("root")).unionAll(e.select(b.alias("node"), b.alias("root")).distinct())


def text_key(text: Column) -> Column:
    """16 bytes of the SHA-256 of a text; null counts as empty."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


def keep_first(df: DataFrame, placed: DataFrame, id_col: str, key: Column) -> DataFrame:
    """Of each group the one row named by its id and key, with all its columns; rows without an id stay.

    ``placed`` has ``(id, key, first_id, first_key)`` of every row of ``df``, ``key`` tells the texts of ``df`` apart.
    Rows go by id and key together, so an id that occurs with two texts loses only what its group drops.
    """
    is_first = (F.col("id") == F.col("first_id")) & (F.col("key") == F.col("first_key"))
    gone = placed.where(F.col("id").isNotNull() & ~is_first).select(F.col("id").alias("_id"), F.col("key").alias("_key"))
    twice = settle(placed.where(is_first).groupBy("id", "key").agg(F.count("*").alias("n")).where("n > 1")
                   .select(F.col("id").alias("_id"), F.col("key").alias("_key")), "repeated")
    # the row is one struct, so that no column of it clashes with the names used here
    keyed = df.select(F.col(id_col).alias("_id"), key.alias("_key"), F.struct(*(df[f"`{c}`"] for c in df.columns)).alias("_row"))
    on = ["_id", "_key"]
    # the same plan at every size: texts are dealt by id and key once, whatever the number of rows that go
    single = keyed.join(gone.hint("merge"), on, "left_anti").join(twice, on, "left_anti")
    return single.unionByName(keyed.join(twice, on, "left_semi").dropDuplicates(on)).select("_row.*")
