"""SimHash near-duplicates: fingerprints linked within a Hamming distance by covering-code anchors.

The fingerprint's bits are cut into three groups. Two fingerprints within ``distance`` differ in at
most a third of it in one group, so that group's covering code finds them: a (15, 11) Hamming code
with covering radius 1 beside six plain bits, 2^17 anchors. A fingerprint is at home at its nearest
anchor and is replicated to every anchor within the home's radius plus the group's threshold; homes
are compared with all members of their anchor's cell. Members are counted per cell first, and a cell of
more than ``BLOCK`` is cut into blocks: every pair of its blocks is a group of its own, so what one group
holds does not grow with the table.

Equal fingerprints are one node. A cell yields a forest of links, never all its pairs, so a crowd of
near copies costs edges in proportion to its size.

Nulls and odd input: null, empty and blank texts have the fingerprint zero and are linked like any
other. Texts of fewer than four words hash the whole sequence. Equal ids count as one node of the
result per row. An empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from rememora.llm.bytewords import mix
from rememora.llm.common import components, filled, keep_first, slices, table, text_key, type_of
from rememora.session import settle

SHINGLE = 4
SEED = 42
DISTANCE = 4
GROUPS, GROUP_BITS, CODE_BITS = 3, 21, 15
SMALL_CELL = 48
BLOCK = 32_768


def fingerprint(text: bytes) -> int:
    """Majority bits over the XXH64 of every shingle, repeats included."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
    raw = np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED))), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for begin in range(0, len(raw), 65_536):
        ones += np.unpackbits(raw[begin:begin + 65_536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(raw)).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """``(id, *also, fp)``; ``fp`` is the fingerprint as a signed 64-bit number."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                fp = np.array([fingerprint(t) for t in filled(part, text_col).cast(pa.binary()).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([*map(part.column, kept), pa.array(fp.view(np.int64))], [*kept, "fp"])

    kept = [id_col, *also]
    return df.select(*kept, text_col).mapInArrow(run, ", ".join([*(f"{c} {type_of(df, c)}" for c in kept), "fp bigint"]))


def _syndromes() -> np.ndarray:
    """Syndrome of every 15-bit word under the Hamming parity check: the exclusive or of its set places, counted from 1."""
    words = np.arange(1 << CODE_BITS)
    out = np.zeros(1 << CODE_BITS, np.int64)
    for place in range(CODE_BITS):
        out ^= np.where(words >> place & 1, place + 1, 0)
    return out


def _offsets(radius: int) -> list[np.ndarray]:
    """For each syndrome, the bit flips of a group that reach an anchor within ``radius``."""
    plain = GROUP_BITS - CODE_BITS
    place = lambda s: 1 << (s - 1) if s else 0
    out = []
    for syndrome in range(CODE_BITS + 1):
        found = set()
        code = {place(syndrome)}
        code |= {(1 << a) ^ place((a + 1) ^ syndrome) for a in range(CODE_BITS)}
        code |= {(1 << a) ^ (1 << b) ^ place((a + 1) ^ (b + 1) ^ syndrome) for a in range(CODE_BITS) for b in range(a)}
        for flips in code:
            for rest in range(1 << plain):
                if flips.bit_count() + rest.bit_count() <= radius:
                    found.add(flips | rest << CODE_BITS)
        out.append(np.array(sorted(found), np.int64))
    return out


def replicas(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell, position in ``fp`` and whether at home, for every anchor that a fingerprint goes to."""
    syndrome_of = _syndromes()
    # a home lies at most 1 from its anchor, so its neighbours lie within 1 plus the threshold
    near = _offsets(1 + distance // GROUPS)
    cells, owner, home = [], [], []
    for g in range(GROUPS):
        bits = (fp >> np.uint64(g * GROUP_BITS)).astype(np.int64) & ((1 << GROUP_BITS) - 1)
        syndrome = syndrome_of[bits & ((1 << CODE_BITS) - 1)]
        for s in range(CODE_BITS + 1):
            rows = np.flatnonzero(syndrome == s)
            if not len(rows):
                continue
            own = 1 << (s - 1) if s else 0
            flips = near[s]
            cells.append(((bits[rows][:, None] ^ flips) | g << GROUP_BITS).ravel())
            owner.append(np.repeat(rows, len(flips)))
            home.append(np.tile(flips == own, len(rows)))
    return np.concatenate(cells), np.concatenate(owner), np.concatenate(home)


def _small(fp: np.ndarray, home: np.ndarray, begin: np.ndarray, end: np.ndarray, distance: int):
    """Links between homes and members, over many small cells at once; ``begin`` and ``end`` are each row's cell."""
    rows = np.flatnonzero(home)
    step = max(1, 2_000_000 // SMALL_CELL)
    for at in range(0, len(rows), step):
        h = rows[at:at + step]
        size = (end - begin)[h]
        left = np.repeat(h, size)
        right = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin[h], size)
        hit = (np.bitwise_count(fp[left] ^ fp[right]) <= distance) & (fp[left] != fp[right])
        yield fp[left[hit]], fp[right[hit]]


def _large(fp: np.ndarray, distance: int):
    """A forest over the links of one cell: what is reached once is not compared again as a target."""
    todo = np.unique(fp)
    while len(todo) > 1:
        frontier, todo = [todo[0]], todo[1:]
        while frontier and len(todo):
            x = frontier.pop()
            near = np.bitwise_count(todo ^ x) <= distance
            if near.any():
                hit, todo = todo[near], todo[~near]
                yield np.full(len(hit), x), hit
                frontier.extend(hit)


def parts(distance: int):
    """Slices of a task's fingerprints with their replicas."""
    def each(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for begin in range(0, len(fp), 5_000):
                part = fp[begin:begin + 5_000]
                yield part, *replicas(part, distance)

    return each


def cell_blocks(nodes: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> dict[int, int]:
    """Blocks of each cell of more than ``block`` members; no more entries than there are anchors."""
    each = parts(distance)

    def run(batches):
        found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for _, cell, _, _ in each(batches):
            for into, new in zip(found, np.unique(cell, return_counts=True)):
                into.append(new)
            if sum(map(len, found[0])) > 2_000_000:
                cells, at = np.unique(np.concatenate(found[0]), return_inverse=True)
                found = [cells], [np.bincount(at, np.concatenate(found[1])).astype(np.int64)]
        cells, at = np.unique(np.concatenate(found[0]), return_inverse=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cells, pa.int64()), pa.array(np.bincount(at, np.concatenate(found[1])).astype(np.int64))], ["cell", "n"])

    big = (nodes.select("fp").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
           .where(F.col("n") > block).select("cell", F.ceil(F.col("n") / block).alias("blocks")))
    return {r["cell"]: r["blocks"] for r in big.collect()}


def links(nodes: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """``(a, b)``: enough links between distinct fingerprints (column ``fp``) to connect all that lie within ``distance``."""
    each, cut = parts(distance), cell_blocks(nodes, distance, block)
    cut_cells = np.array(sorted(cut), np.int64)
    cut_blocks = np.array([cut[c] for c in sorted(cut)], np.int64)

    def blocks_of(cell):
        """Number of blocks of each row's cell."""
        if not len(cut_cells):
            return np.ones(len(cell), np.int64)
        at = np.minimum(np.searchsorted(cut_cells, cell), len(cut_cells) - 1)
        return np.where(cut_cells[at] == cell, cut_blocks[at], 1)

    def dealt(batches):
        for part, cell, owner, home in each(batches):
            fp, blocks = part[owner], blocks_of(cell)
            piece = np.cumsum(blocks) // 500_000
            edges = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(cell)]
            for begin, end in zip(edges, edges[1:]):
                n = blocks[begin:end]
                row = np.repeat(np.arange(begin, end), n)
                other = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                mine = (mix(fp[row]) % blocks[row].astype(np.uint64)).astype(np.int64)
                group = cell[row] << 40 | np.minimum(mine, other) << 20 | np.maximum(mine, other)
                yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(fp[row].view(np.int64)), pa.array(home[row])], ["cell", "fp", "home"])

    def compared(batches):
        def flush(cell, fp, home):
            edge = np.flatnonzero(np.diff(cell, prepend=cell[0] - 1))
            size = np.diff(np.append(edge, len(cell)))
            small = np.repeat(size <= SMALL_CELL, size)
            begin, end = np.repeat(edge, size), np.repeat(edge + size, size)
            yield from _small(fp, home & small, begin, end, distance)
            for e, s in zip(edge[size > SMALL_CELL], size[size > SMALL_CELL]):
                if home[e:e + s].any():
                    yield from _large(fp[e:e + s], distance)

        def out(pairs):
            found = [(np.minimum(a.view(np.int64), b.view(np.int64)), np.maximum(a.view(np.int64), b.view(np.int64))) for a, b in pairs]
            a = np.concatenate([np.zeros(0, np.int64), *(x for x, _ in found)])
            b = np.concatenate([np.zeros(0, np.int64), *(y for _, y in found)])
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        held = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool))
        for batch in batches:
            new = (batch.column("cell").to_numpy(), batch.column("fp").to_numpy().view(np.uint64),
                   batch.column("home").to_numpy(zero_copy_only=False))
            held = tuple(np.concatenate(x) for x in zip(held, new))
            last = np.searchsorted(held[0], held[0][-1])  # the last cell may go on in the next batch
            if last:
                yield out(flush(*(x[:last] for x in held)))
                held = tuple(x[last:] for x in held)
        if len(held[0]):
            yield out(flush(*held))

    rows = nodes.select("fp").mapInArrow(dealt, "cell bigint, fp bigint, home boolean")
    partitions = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (rows.repartition(partitions, "cell").sortWithinPartitions("cell")
            .mapInArrow(compared, "a bigint, b bigint").distinct())


def _rooted(df: DataFrame, id_col: str, text_col: str, distance: int, block: int, also: tuple[str, ...] = ()) -> DataFrame:
    """``(id, *also, fp, root, component_id)``: ``root`` tells components apart that share their smallest id."""
    if distance // GROUPS > 1:
        raise ValueError("the code of radius 1 covers distances up to 5")
    marked = settle(fingerprints(df, id_col, text_col, also), "fingerprints")
    nodes = settle(marked.groupBy("fp").agg(F.min(id_col).alias("first")), "nodes")
    joined = components(links(nodes, distance, block)).select(F.col("node").alias("fp"), "root")
    rooted = nodes.join(joined, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked.join(rooted.join(least, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE,
                    block: int = BLOCK) -> DataFrame:
    """``(id, fp, component_id)``: the smallest id reachable over links of at most ``distance`` differing bits."""
    return _rooted(df, id_col, text_col, distance, block).select(id_col, "fp", "component_id")


def one_per_group(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row of each component, with all its columns: the smallest by id, then text key; rows without an id stay."""
    rows = df.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    placed = settle(_rooted(rows, "id", "text", distance, BLOCK, ("key",)).select("id", "key", "root"), "components")
    first = placed.where(F.col("id").isNotNull()).groupBy("root").agg(F.min(F.struct("id", "key")).alias("first"))
    named = settle(placed.join(first, "root", "left").select("id", "key", F.col("first.id").alias("first_id"), F.col("first.key").alias("first_key")), "groups")
    return keep_first(df, named, id_col, text_key(F.col(text_col)))


def text_links(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """``(a, b)``: the key of every text of a component linked to its least key, once; together they connect the component."""
    rows = df.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    placed = settle(_rooted(rows, "id", "text", distance, BLOCK, ("key",)).select("root", "key").distinct(), "text-components")
    least = placed.groupBy("root").agg(F.min("key").alias("b"))
    return settle(placed.join(least, "root").where(F.col("key") != F.col("b")).select(F.col("key").alias("a"), "b"), "text-links")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
