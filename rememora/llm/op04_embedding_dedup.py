"""Embedding near-duplicates: an exact metric range join by pivots, within equal labels.

Unit vectors are compared by angle. A bounded set of pivots, drawn by hash, cuts each label into
cells by nearest pivot. Two linked vectors lie within ``t = arccos(cosine)``, so by the triangle
inequality a vector need only be replicated to a cell whose pivot is at most ``2 t`` farther than its
own, and within ``t`` of the cell's radius; the hyperplane between two pivots bounds it further. Of two
cells the lower one makes the comparison, so a pair meets once. Cells are cut into blocks of bounded
size and every pair of blocks is a task of its own. A task returns link counts and a forest of links,
never pairs, and equal vectors are compared once for all their copies.

Nulls and odd input: rows with a null label, a null or zero vector, or null or non-finite components
link with nothing and are kept as components of their own; so are vectors of a length of their own.
Equal ids count as separate rows that share one component. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from rememora.llm.common import components, table, type_of
from rememora.session import settle

COSINE = 0.93
PIVOTS = 12
BLOCK = 4_096
_ROUNDING = 1e-7


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of one length as rows, and the rows' numbers; null and odd ones are left out."""
    values = column.to_pylist() if column.null_count or column.values.null_count else None
    if values is None:
        size = np.diff(column.offsets.to_numpy())
        if len(size) and (size == size[0]).all() and size[0]:
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
            return flat.reshape(len(size), -1), np.arange(len(size))
        values = column.to_pylist()
    rows = [i for i, v in enumerate(values) if v and None not in v]
    by: dict[int, list[int]] = {}
    for i in rows:
        by.setdefault(len(values[i]), []).append(i)
    widest = max(by, default=0)
    out = np.zeros((len(rows), widest))
    for k, i in enumerate(rows):
        out[k, :len(values[i])] = values[i]
    return out, np.array(rows, np.int64)


def _keyed(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``(id, label, key, unit)``: a digest and the unit vector in double precision; null where nothing may link."""
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            key, unit = [None] * n, [None] * n
            x, rows = _matrix(batch.column("vector"))
            with np.errstate(all="ignore"):
                scale = np.abs(x).max(axis=1, initial=0)
                x = x / scale[:, None]
                x = x / np.sqrt((x * x).sum(axis=1))[:, None]
            fine = np.isfinite(x).all(axis=1) if len(x) else np.zeros(0, bool)
            label, size = batch.column("label"), np.asarray(batch.column("size"))
            for i, row, ok in zip(rows.tolist(), x, fine.tolist()):
                if ok and label[i].is_valid:
                    unit[i] = (row[:size[i]] + 0.0).astype("<f8").tobytes()
                    key[i] = hashlib.sha256(unit[i]).hexdigest()
            yield pa.RecordBatch.from_arrays([batch.column("id"), label, pa.array(key, pa.string()), pa.array(unit, pa.binary())],
                                             ["id", "label", "key", "unit"])

    return df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"),
                     F.coalesce(F.size(vector_col), F.lit(0)).alias("size")).mapInArrow(
        run, f"id {type_of(df, id_col)}, label {type_of(df, label_col)}, key string, unit binary")


def _homes(reps: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Each vector's home cell, its angle to that pivot, and how far it lies across each other cell's border."""
    def run(batches):
        for batch in batches:
            unit = batch.column("unit").to_pylist()
            home, far = np.zeros(len(unit), np.int32), np.zeros(len(unit))
            for i, u in enumerate(unit):
                v = np.frombuffer(u, "<f8")
                angle = np.arccos(np.clip(pivots[:, :len(v)] @ v, -1, 1)) if len(v) == pivots.shape[1] else np.zeros(1)
                home[i] = angle.argmin()
                far[i] = angle[home[i]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home), pa.array(far)], [*batch.schema.names, "home", "far"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in reps.schema.fields)
    return reps.mapInArrow(run, f"{kinds}, home int, far double")


def _dealt(homes: DataFrame, pivots: np.ndarray, radius: np.ndarray, cosine: float) -> DataFrame:
    """A row per cell a vector takes part in: its own, and every lower one whose border or radius it may reach across."""
    theta, chord = np.arccos(cosine) + _ROUNDING, np.sqrt(2 - 2 * cosine) + _ROUNDING
    apart = np.sqrt(np.maximum(((pivots[:, None] - pivots[None]) ** 2).sum(axis=2), 1e-12))

    def run(batches):
        for batch in batches:
            rows, cells, own = [], [], []
            for i, (u, home, far) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("unit", "home", "far")))):
                v = np.frombuffer(u, "<f8")
                near = [home]
                if len(v) == pivots.shape[1]:
                    dots = pivots @ v
                    angle = np.arccos(np.clip(dots, -1, 1))
                    # distance from the bisector of the two pivots, on the chord scale
                    across = (dots[home] - dots) / apart[home]
                    ok = (angle <= far + 2 * theta) & (angle <= radius + theta) & (across <= chord)
                    near += [c for c in np.flatnonzero(ok[:home]).tolist()]
                rows += [i] * len(near)
                cells += near
                own += [c == home for c in near]
            taken = batch.select(["id", "label", "copies", "unit"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cells, pa.int32()), pa.array(own, pa.bool_())], names)

    names = ["id", "label", "copies", "unit", "cell", "own"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in homes.select(*names[:4]).schema.fields)
    return homes.mapInArrow(run, f"{kinds}, cell int, own boolean")


def _block_links(table: pa.Table, cosine: float) -> tuple[list, list, list, list]:
    """Link counts and a forest over the pairs of one task: rows of two blocks, or of one with itself."""
    ids, copies = table["id"].to_pylist(), np.asarray(table["copies"])
    own, side = np.asarray(table["own"]), np.asarray(table["side"])
    units = table["unit"].to_pylist()
    width = max(map(len, units))
    fit = np.array([len(u) == width for u in units])
    x = np.zeros((len(ids), width // 8))
    for i, u in enumerate(units):
        x[i, :len(u) // 8] = np.frombuffer(u, "<f8")
    lengths = np.array([len(u) for u in units])
    count, parent = np.zeros(len(ids), np.int64), np.arange(len(ids))
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    single = not len(right)
    right = left if single else right
    edges: list[tuple[int, int]] = []

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for begin in range(0, len(left), 256):
        rows = left[begin:begin + 256]
        near = x[rows] @ x[right].T >= cosine
        near &= own[rows][:, None] | own[right][None]
        if not fit.all():
            near &= lengths[rows][:, None] == lengths[right][None]
        if single:
            near &= rows[:, None] != right[None]
        count[rows] += near @ copies[right]
        if not single:
            count[right] += copies[rows] @ near
        for r, hits in zip(rows.tolist(), near):
            at = right[hits]
            if len(at):
                roots = np.unique(parent[at])
                for q in {find(k) for k in roots.tolist()}:
                    a = find(r)
                    if a != q:
                        parent[max(a, q)] = min(a, q)
                        edges.append((a, q))
    linked = np.flatnonzero(count)
    return ([ids[i] for i in linked], count[linked].tolist(), [ids[a] for a, _ in edges], [ids[b] for _, b in edges])


def linked(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
           cosine: float = COSINE, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """``(id, n_links, component_id, kept)`` for every row."""
    keyed = settle(_keyed(df, id_col, vector_col, label_col), "vectors")
    classes = (keyed.where(F.col("key").isNotNull()).groupBy("label", "key")
               .agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.any_value("unit").alias("unit")))
    reps = settle(classes, "classes")
    drawn = [np.frombuffer(r["unit"], "<f8") for r in
             reps.orderBy(F.xxhash64("key"), "key").limit(pivots).select("unit").collect()]
    width = max((len(v) for v in drawn), default=1)
    centre = np.array([v for v in drawn if len(v) == width]).reshape(-1, width)
    homes = settle(_homes(reps, centre), "homes") if len(centre) else None
    id_kind = type_of(df, id_col)
    if homes is None:
        alone = keyed.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
        return alone.withColumn("kept", F.lit(True))
    radius = np.zeros(len(centre))
    for r in homes.groupBy("home").agg(F.max("far").alias("far")).collect():
        radius[r["home"]] = r["far"]
    dealt = settle(_dealt(homes, centre, radius, cosine), "dealt")
    sizes = dealt.groupBy("label", "cell").agg((F.ceil(F.count("*") / block)).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    tasks = (dealt.join(sizes, ["label", "cell"]).withColumn("mine", mine)
             .select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
             .select("id", "label", "cell", "copies", "unit", "own", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
                     F.when(F.col("mine") > F.col("other"), 1).otherwise(0).alias("side")))
    id_arrow = {"bigint": pa.int64(), "int": pa.int32()}.get(id_kind, pa.string())

    def compared(group: pa.Table) -> pa.Table:
        found, count, a, b = _block_links(group, cosine) if group.num_rows else ([], [], [], [])
        return pa.table({"id": pa.array(found + a, id_arrow), "n": pa.array(count + [0] * len(a), pa.int64()),
                         "to": pa.array([None] * len(found) + b, id_arrow)})

    out = settle(tasks.groupBy("label", "cell", "i", "j").applyInArrow(
        compared, f"id {id_kind}, n bigint, to {id_kind}"), "links")
    counts = out.where(F.col("to").isNull()).groupBy("id").agg(F.sum("n").alias("n"))
    roots = components(out.where(F.col("to").isNotNull()).select(F.col("id").alias("a"), F.col("to").alias("b")))
    placed = (reps.select("label", "key", "id", "copies").join(counts, "id", "left")
              .join(roots.withColumnRenamed("node", "id"), "id", "left")
              .select("label", "key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                      F.coalesce("root", "id").alias("component_id")))
    return (keyed.select("id", "label", "key").join(placed, ["label", "key"], "left")
            .select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"),
                    F.coalesce("component_id", "id").alias("component_id"))
            .withColumn("kept", F.col(id_col) == F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
         AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b
         ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS x, vec_id AS r FROM v UNION SELECT link.y, reach.r FROM reach JOIN link ON link.x = reach.x),
least AS (SELECT x, min(r) AS component_id FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS n FROM link GROUP BY x)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, least.component_id, v.vec_id = least.component_id AS kept
FROM v JOIN least ON least.x = v.vec_id LEFT JOIN n ON n.x = v.vec_id
"""
