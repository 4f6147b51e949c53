"""Conversation prefix trie: shared beginnings of conversations as nodes, with totals of their subtrees.

Turns are two hashes and a length from the start; texts are not moved. Positions come from one global
sort, so a conversation with a third of all turns spreads over as many tasks as it has rows for.

The trie is cut by depth, each part at half of its own depth, down to single turns. A prefix that a cut
makes is named by the names of the half before it and of the part above it, so the lower forests need
only that name and all parts, at every level of the recursion, are named at once: inside a block of
``CHUNK`` turns in numpy, beyond it by the same recursion over block names. Turns that follow equal names
are one node. Totals are grafted from the deepest cuts upward: what is summed below a cut goes to every
ancestor in the part above it, read from the path of one member, so the rounds are the logarithm of the
greatest depth.

Nulls and odd input: turns without a conversation id belong to none. Null roles and texts are empty, a
null turn comes first, turns of equal number go by role and hash. Repeated rows are turns of their own.
A conversation without turns is a member of the root only. An empty table gives no rows, not even the
root. Only the named columns are read. The members that end at a node are digested as a stream of
bounded pieces; SHA-256 is a chain, so a node's pieces pass one task, but never lie in it together.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rememora.llm.bytewords import mix
from rememora.llm.common import table, type_of
from rememora.session import settle

CHUNK_BITS = 12
GROUP = 100
HEADS = 6
ENDS = 256
_NOTHING = hashlib.sha256(b"").hexdigest()
_KEY = ["depth", "v1", "v2"]


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv, turn, role, t1, t2, chars)``: two hashes stand for role and text."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    return df.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), F.xxhash64(role, text).alias("t1"),
        F.xxhash64(F.lit(12), role, text).alias("t2"), F.char_length(text).cast("long").alias("chars"))


def placed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``turns`` in global order with ``(part, at)``, and ``(conv, part, first, before, n)``.

    The position of a row in its conversation is ``at - first + before``.
    """
    order = ["conv", "turn", "role", "t1", "t2", "row"]
    rows = settle(rows, "turns").withColumn("row", F.monotonically_increasing_id())  # tells equal rows apart, so they may spread
    ordered = rows.repartitionByRange(_partitions(rows), *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    ordered = settle(ordered.select("conv", "t1", "t2", "chars", at.alias("at")), "ordered").withColumn("part", F.shiftright("at", 33))
    runs = ordered.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    by_conv = Window.partitionBy("conv")  # one row for each task that holds turns of the conversation
    before = F.coalesce(F.sum("n").over(by_conv.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ordered, settle(runs.select("conv", "part", "first", before.alias("before"), F.sum("n").over(by_conv).alias("n")), "runs")


def rebuilt(rows: DataFrame, group: int = GROUP, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first turns of their group's first one: ``(conv, p, t1, t2, chars, length)`` and ``(conv, length)``.

    Conversation c takes its first crc32(c) % ``heads`` turns from c - c % ``group``, the rest are its own.
    """
    ordered, runs = placed(rows)
    conv = F.col("conv")
    convs = runs.groupBy("conv").agg(F.max("n").alias("n")).select(
        "conv", "n", (F.crc32(conv.cast("string")) % heads).alias("h"), (conv - conv % group).alias("base"))
    sizes = convs.select(conv.alias("base"), F.col("n").alias("base_n"))
    kept = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = settle(convs.join(sizes, "base", "left").select(
        "conv", "base", "h", kept.alias("kept"), (kept + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "conversations")
    held = runs.drop("n").join(convs, "conv")
    numbered = settle(ordered.join(held, ["conv", "part"]).select(
        "conv", (F.col("at") - F.col("first") + F.col("before")).alias("pos"), "t1", "t2", "chars", "h", "kept", "length"), "numbered")
    own = numbered.where("pos >= h").select("conv", (F.col("pos") - F.col("h") + F.col("kept")).alias("p"), "t1", "t2", "chars", "length")
    first = numbered.where((F.col("pos") < heads - 1) & (conv % group == 0)).select(
        conv.alias("base"), F.col("pos").alias("p"), "t1", "t2", "chars")
    taken = convs.join(first, "base").where(F.col("p") < F.col("h")).select("conv", "p", "t1", "t2", "chars", "length")
    return own.unionByName(taken), convs.select("conv", "length")


def _join(a: tuple, b: tuple) -> tuple:
    """Name of the part named ``a`` followed by the block named ``b``; names are two 64-bit lanes."""
    x = mix(a[0] + b[0] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    y = mix(a[1] * np.uint64(0xC2B2AE3D27D4EB4F) + b[1] + np.uint64(3))
    return mix(x + (y << np.uint64(1))), mix(y ^ (x << np.uint64(32) | x >> np.uint64(32)))


def block_names(tokens: tuple, at: np.ndarray, bits: int) -> list[tuple]:
    """Names of the aligned blocks of 2^k turns, per level k at the row where the block begins; ``at`` is the place in the chunk."""
    levels, n = [tokens], len(at)
    for k in range(1, bits + 1):
        half = 1 << (k - 1)
        begin = np.flatnonzero(at[:max(n - half, 0)] % (2 * half) == 0)
        end = begin + half
        begin = begin[at[end] == at[begin] + half]
        if k > 1:  # the second half must be whole too
            last = begin + 2 * half - 1
            inside = last < n
            begin = begin[inside]
            begin = begin[at[last[inside]] == at[begin] + 2 * half - 1]
        if not len(begin):
            break
        name = tuple(np.zeros(n, np.uint64) for _ in range(2))
        for lane, value in zip(name, _join(*(tuple(x[i] for x in levels[-1]) for i in (begin, begin + half)))):
            lane[begin] = value
        levels.append(name)
    return levels


def prefix_names(levels: list[tuple], at: np.ndarray, length: np.ndarray, start: tuple) -> tuple:
    """Names of the prefixes of ``length`` turns of each row's chunk: cut after cut, from the greatest half down."""
    name = tuple(x.copy() for x in start)
    first = np.arange(len(at)) - at
    for k in reversed(range(len(levels))):
        row = np.flatnonzero(length >> k & 1)
        block = first[row] + ((length[row] >> (k + 1)) << (k + 1))
        for lane, value in zip(name, _join(tuple(x[row] for x in name), tuple(x[block] for x in levels[k]))):
            lane[row] = value
    return name


def _lanes(batch, names) -> tuple:
    return tuple(batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) if isinstance(batch, pa.RecordBatch)
                 else batch[c].to_numpy().view(np.uint64) for c in names)


def _whole_chunks(batches, bits: int):
    """Tables that end where a chunk ends; a chunk holds at most 2^bits rows."""
    held = None
    for batch in batches:
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        begins = np.flatnonzero(held["p"].to_numpy() & ((1 << bits) - 1) == 0)
        if len(begins) and begins[-1]:
            yield held.slice(0, begins[-1])
            held = held.slice(begins[-1])
    if held is not None and held.num_rows:
        yield held


def named(rows: DataFrame, bits: int = CHUNK_BITS) -> DataFrame:
    """``rows`` with ``u1, u2``, the name of the turns before, and ``v1, v2``, the name of these and the turn itself."""
    size = 1 << bits
    longest = rows.agg(F.max("p")).first()[0]
    rows = rows.withColumn("chunk", F.shiftright("p", bits))
    kind = type_of(rows, "conv")
    deal = lambda df: df.repartition(_partitions(df), "conv", "chunk").sortWithinPartitions("conv", "chunk", "p")

    def blocks(batches):
        for t in _whole_chunks(batches, bits):
            at = t["p"].to_numpy() & (size - 1)
            levels = block_names(_lanes(t, ("t1", "t2")), at, bits)
            first = np.flatnonzero(at == 0)
            name = [x[first] if len(levels) > bits else np.zeros(len(first), np.uint64) for x in levels[-1]]
            picked = t.take(pa.array(first))
            yield pa.RecordBatch.from_arrays([picked["conv"].combine_chunks(), picked["chunk"].combine_chunks(),
                                              *(pa.array(x.view(np.int64)) for x in name)], ["conv", "p", "t1", "t2"])

    if longest is not None and longest >= size:  # block names are a shorter sequence of the same kind
        upper = rows.select("conv", "chunk", "p", "t1", "t2")
        upper = settle(deal(upper).mapInArrow(blocks, f"conv {kind}, p bigint, t1 bigint, t2 bigint"), "blocks")
        upper = named(upper, bits).select("conv", F.col("p").alias("chunk"), *(F.col(c).alias("g" + c) for c in ("u1", "u2", "v1", "v2")))
        rows = rows.join(upper, ["conv", "chunk"])
    else:
        rows = rows.select("*", *(F.lit(0).cast("long").alias("g" + c) for c in ("u1", "u2", "v1", "v2")))

    kept = [c for c in rows.columns if c not in ("chunk", "gu1", "gu2", "gv1", "gv2")]

    def names(batches):
        for t in _whole_chunks(batches, bits):
            at = t["p"].to_numpy() & (size - 1)
            levels = block_names(_lanes(t, ("t1", "t2")), at, bits - 1)
            start = _lanes(t, ("gu1", "gu2"))
            before = prefix_names(levels, at, at, start)
            through = prefix_names(levels, at, np.where(at + 1 < size, at + 1, 0), start)
            for lane, whole in zip(through, _lanes(t, ("gv1", "gv2"))):  # a full chunk's name comes from the level above
                lane[at + 1 == size] = whole[at + 1 == size]
            extra = [pa.array(x.view(np.int64)) for x in (*before, *through)]
            yield from pa.table([*(t[c] for c in kept), *extra], names=[*kept, "u1", "u2", "v1", "v2"]).to_batches()

    schema = ", ".join([*(f"{c} {type_of(rows, c)}" for c in kept), *(f"{c} bigint" for c in ("u1", "u2", "v1", "v2"))])
    return deal(rows).mapInArrow(names, schema)


def _digests(ends: DataFrame) -> DataFrame:
    """``(depth, v1, v2, ends_sha256)`` of ``(depth, v1, v2, conv)``: the decimal ids in ascending order, joined by commas."""
    key = ["v1", "v2", "depth"]
    order = [*key, "conv"]

    def joined(batches):
        for batch in batches:
            k = [batch.column(c).to_numpy() for c in key]
            new = np.concatenate([[True], np.logical_or.reduce([x[1:] != x[:-1] for x in k])]) if batch.num_rows else np.zeros(0, bool)
            cuts = np.flatnonzero(new)
            cuts = np.concatenate([np.arange(a, b, ENDS) for a, b in zip(cuts, [*cuts[1:], batch.num_rows])]) if len(cuts) else cuts
            ids = list(map(str, batch.column("conv").to_pylist()))
            blobs = [",".join(ids[a:b]) for a, b in zip(cuts, [*cuts[1:], batch.num_rows])]
            first = batch.take(pa.array(cuts, pa.int64()))
            yield pa.RecordBatch.from_arrays([*map(first.column, order), pa.array(blobs, pa.string())], [*order, "ids"])

    def digested(batches):
        now, chain = None, None
        for batch in batches:
            out = []
            for *k, ids in zip(*(batch.column(c).to_pylist() for c in (*key, "ids"))):
                if k != now:
                    if now is not None:
                        out.append((*now, chain.hexdigest()))
                    now, chain = k, hashlib.sha256(ids.encode())
                else:
                    chain.update(b",")
                    chain.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], [*key, "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, chain.hexdigest())], [*key, "ends_sha256"])

    long = "v1 bigint, v2 bigint, depth bigint"
    n = _partitions(ends)
    pieces = ends.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(
        joined, f"{long}, conv {type_of(ends, 'conv')}, ids string")
    return pieces.repartition(n, *key).sortWithinPartitions(*order).mapInArrow(digested, f"{long}, ends_sha256 string")


def _graft(paths: DataFrame, nodes: DataFrame, deepest: int) -> DataFrame:
    """``(depth, v1, v2, n_leaves, saved_tokens)``: sums over subtrees of ``leaf`` and ``saved`` of the nodes.

    Round k takes the cuts at odd multiples of 2^k: their sums go to the 2^k depths above them.
    """
    sums = [F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved")]
    parts = [nodes.select(*_KEY, "conv", "leaf", "saved")]
    bit = lambda column, k: F.shiftright(column, k)
    for k in range(deepest.bit_length()):
        cuts = [p.where((F.col("depth") > 0) & (F.col("depth") % (2 << k) == 1 << k)) for p in parts]
        whole = cuts[0]
        for c in cuts[1:]:
            whole = whole.unionByName(c)
        cut = whole.groupBy(*_KEY).agg(F.min("conv").alias("conv"), *sums).select("conv", (bit("depth", k) - 1).alias("block"), "leaf", "saved")
        above = paths.where((bit("p", k) % 2 == 0) & (F.col("length") >= F.shiftleft(bit("p", k) + 1, k))).select(
            "conv", bit("p", k).alias("block"), F.col("p").alias("depth"), F.col("u1").alias("v1"), F.col("u2").alias("v2"))
        parts.append(settle(above.join(cut, ["conv", "block"]).groupBy(*_KEY).agg(F.min("conv").alias("conv"), *sums), "grafted"))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy(*_KEY).agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def trie(sequences: DataFrame, convs: DataFrame, bits: int = CHUNK_BITS) -> DataFrame:
    """``(conv, depth, parent_conv, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)`` of every node.

    ``sequences``: ``(conv, p, t1, t2, chars, length)`` with places p from 0 without gaps; ``convs``:
    ``(conv, length)`` of every member of the root, also those without turns.
    """
    paths = settle(named(sequences, bits).withColumn("depth", F.col("p") + 1), "paths")
    root = convs.agg(F.count("*").alias("n"), F.min("conv").alias("conv"), F.max("length").alias("deepest")).first()
    zero = F.lit(0).cast("long")
    top = convs.agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv")).where("n_convs > 0").select(
        zero.alias("depth"), zero.alias("v1"), zero.alias("v2"), "n_convs", "conv", zero.alias("u1"), zero.alias("u2"), zero.alias("chars"))
    below = paths.groupBy(*_KEY).agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv"), F.min("u1").alias("u1"),
                                     F.min("u2").alias("u2"), F.min("chars").alias("chars"))
    kinds = [*_KEY, "n_convs", "conv", "u1", "u2", "chars"]
    nodes = settle(below.select(*kinds).unionByName(top.select(*kinds)), "nodes")
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("u1").alias("v1"), F.col("u2").alias("v2")).agg(
        F.count("*").alias("n_children"))
    nodes = settle(nodes.join(kids, _KEY, "left").withColumn("n_children", F.coalesce("n_children", zero))
                   .withColumn("leaf", (F.col("n_children") == 0).cast("long"))
                   .withColumn("saved", (F.col("n_convs") - 1) * F.col("chars")), "counted")
    totals = _graft(paths, nodes, root["deepest"] or 0)
    ended = paths.where(F.col("depth") == F.col("length")).select(*_KEY, "conv").unionByName(
        convs.where("length = 0").select(zero.alias("depth"), zero.alias("v1"), zero.alias("v2"), "conv"))
    whole = settle(nodes.join(totals, _KEY).join(_digests(ended), _KEY, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NOTHING))), "totals")
    columns = ["conv", "depth", "parent_conv", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    # the root's children know their parent; other parents are joined
    none = F.lit(None).cast(convs.schema["conv"].dataType)
    shallow = whole.where("depth < 2").withColumn(
        "parent_conv", F.when(F.col("depth") == 1, F.lit(root["conv"])).otherwise(none).cast(convs.schema["conv"].dataType))
    parents = whole.select((F.col("depth") + 1).alias("depth"), F.col("v1").alias("u1"), F.col("v2").alias("u2"), F.col("conv").alias("parent_conv"))
    deep = whole.where("depth > 1").join(parents, ["depth", "u1", "u2"])
    return shallow.select(*columns).unionByName(deep.select(*columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trie(*rebuilt(turns(table(spark, sf_dir, "conversations"))))
    return out.withColumnsRenamed({"conv": "conv_id", "parent_conv": "parent_conv_id"})


# crc32 bit by bit: each byte enters with the first of its eight steps
_CRC = ("xor(list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, length(conv_id::VARCHAR) + 1), "
        "lambda i: [ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), "
        "lambda a, v: xor(xor(a, v) >> 1, (xor(a, v) & 1) * 3988292384)), 4294967295)")
SQL = f"""
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS body,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, {_CRC} % {HEADS} AS h, conv_id - conv_id % {GROUP} AS base FROM (SELECT DISTINCT conv_id FROM own)),
rebuilt AS (
  SELECT c.conv_id, 0 AS own, o.pos, o.role, o.body FROM convs c JOIN own o ON o.conv_id = c.base AND o.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, o.pos, o.role, o.body FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.pos > c.h),
seqs AS (
  SELECT conv_id, coalesce(list({{'role': role, 'body': body}} ORDER BY own, pos) FILTER (pos IS NOT NULL), []) AS seq
  FROM convs LEFT JOIN rebuilt USING (conv_id) GROUP BY 1),
prefixes AS (
  SELECT conv_id, d, seq[1:d] AS prefix, len(seq) = d AS ended, CASE WHEN d > 0 THEN length(seq[d].body) ELSE 0 END AS chars
  FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM seqs)),
nodes AS (
  SELECT prefix, d, min(conv_id) AS conv_id, count(*) AS n_convs, min(chars) AS chars,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256 FROM prefixes GROUP BY 1, 2),
kids AS (SELECT prefix[1:d - 1] AS prefix, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1, 2),
counted AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (prefix, d)),
totals AS (
  SELECT prefix[1:e] AS prefix, e AS d, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * chars) AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM counted) GROUP BY 1, 2)
SELECT c.conv_id, c.d AS depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, t.n_leaves::BIGINT AS n_leaves,
       t.saved_tokens::BIGINT AS saved_tokens, c.ends_sha256
FROM counted c JOIN totals t USING (prefix, d) LEFT JOIN nodes p ON c.d > 0 AND p.d = c.d - 1 AND p.prefix = c.prefix[1:c.d - 1]
"""
