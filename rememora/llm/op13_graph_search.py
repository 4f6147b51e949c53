"""Nearest neighbours by inner product: robust-pruned directed graphs over shards, queried by beam search.

Equal vectors are one node with its smallest ids, as many as an answer can hold. Nodes are dealt by hash
to shards of bounded size; a shard holds vectors of one length and of norms within a factor of two, so one
coordinate more turns the largest inner product into the least distance without loss of precision.
In a shard, batches of nodes search the graph built so far from its medoid; what a search expands is
pruned to diverse edges (a candidate goes if an edge kept is nearer to it than the node is by the factor
``relax``), edges are returned, and full lists are pruned again. A node that no path reaches gets a link
of its own. Every block of queries searches every shard with a beam; what the beam holds is scored in
double precision, component by component, and the best of all shards are ranked.

Nulls and odd input: vectors that are null, empty, zero or hold null or non-finite components take no
part, nor do rows without an id. Vectors of another length than the query's are no candidates. Equal ids
and vectors are one row; of an id with several vectors each is searched by itself and finds none of its
id. Ties go to the smaller id. With fewer candidates than ``k`` all are returned. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rememora.llm.common import table, type_of
from rememora.session import settle

K = 20
SHARD_ROWS = 8_192
QUERY_ROWS = 16_384
DEGREE = 40
BUILD_BEAM, SEARCH_BEAM, WIDTH = 64, 160, 4
STARTS = 64
RELAX = 1.05
_FLOATS = 8_000_000  # of one gathered array
_SEEN = 16_000_000


class Graph:
    """A directed graph over the rows of ``x``, with ``degree`` edges each and one more for nodes else out of reach."""

    def __init__(self, x: np.ndarray, edges: np.ndarray | None = None, entry: int = 0, degree: int = DEGREE):
        norms = np.sqrt((x * x).sum(axis=1))
        self.scale = norms.max() if len(x) else 1.0
        unit = x / self.scale
        rest = np.sqrt(np.maximum(1.0 - (unit * unit).sum(axis=1), 0.0))
        self.x = np.column_stack([unit, rest]).astype(np.float32)
        self.square = (self.x * self.x).sum(axis=1)
        # while it is built, a list may grow by half before it is pruned; the last column is the spare edge
        self.edges = np.full((len(x), degree * 3 // 2 + 1), -1, np.int32) if edges is None else edges
        self.entry, self.degree = entry, degree
        # searches also begin at nodes spread over the shard, so that no cluster is out of sight of the entry
        self.starts = np.unique(np.append(np.linspace(0, max(len(x) - 1, 0), STARTS).astype(np.int64), entry))

    def lift(self, queries: np.ndarray) -> np.ndarray:
        """Queries in the space of the graph, scaled to length one: the nearest node has the largest inner product."""
        length = np.abs(queries).max(axis=1, keepdims=True)
        unit = queries / length
        unit = unit / np.sqrt((unit * unit).sum(axis=1, keepdims=True))
        return np.column_stack([unit, np.zeros(len(queries))]).astype(np.float32)

    def search(self, queries: np.ndarray, beam: int, starts: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
        """Beams of node numbers by distance (-1: none), and all nodes that each query expanded.

        Distances leave out the query's own square, which orders nothing.
        """
        n, rows = len(self.x), len(queries)
        ids, dist = np.full((rows, beam), -1, np.int64), np.full((rows, beam), np.inf, np.float32)
        closed, seen = np.zeros((rows, beam), bool), np.zeros((rows, n), bool)
        seen[:, starts] = True
        d = self.square[starts] - 2 * queries @ self.x[starts].T
        best = np.argsort(d, axis=1, kind="stable")[:, :beam]
        ids[:, :best.shape[1]], dist[:, :best.shape[1]] = starts[best], np.take_along_axis(d, best, 1)
        path = []
        while True:
            free = ~closed & (ids >= 0)
            r, c = np.nonzero(free & (np.cumsum(free, axis=1) <= width))
            if not len(r):
                break
            nodes = ids[r, c]
            closed[r, c] = True
            step = np.full((rows, width), -1, np.int64)
            step[r, np.arange(len(r)) - np.searchsorted(r, r)] = nodes
            path.append(step)
            near = self.edges[nodes]
            owner = np.repeat(r, near.shape[1])
            near = near.ravel()
            fresh = near >= 0
            owner, near = owner[fresh], near[fresh].astype(np.int64)
            fresh = ~seen[owner, near]
            keys = np.unique(owner[fresh] * n + near[fresh])
            owner, near = keys // n, keys % n
            seen[owner, near] = True
            if not len(keys):
                continue
            d = self.square[near] - 2 * np.einsum("ij,ij->i", self.x[near], queries[owner])
            column = np.arange(len(owner)) - np.searchsorted(owner, owner)
            new_ids = np.full((rows, column.max() + 1), -1, np.int64)
            new_dist = np.full(new_ids.shape, np.inf, np.float32)
            new_ids[owner, column], new_dist[owner, column] = near, d
            every = np.concatenate([dist, new_dist], axis=1)
            best = np.argsort(every, axis=1, kind="stable")[:, :beam]
            dist = np.take_along_axis(every, best, 1)
            ids = np.take_along_axis(np.concatenate([ids, new_ids], axis=1), best, 1)
            closed = np.take_along_axis(np.concatenate([closed, np.zeros(new_ids.shape, bool)], axis=1), best, 1)
        return ids, np.concatenate(path, axis=1) if path else np.zeros((rows, 0), np.int64)

    def searched(self, queries: np.ndarray, beam: int, starts: np.ndarray | None = None):
        """``search`` in runs of bounded size: ``(first row, beams, expanded)``."""
        starts = self.starts if starts is None else starts
        step = int(max(1, min(1024, _SEEN // max(len(self.x), 1))))
        for begin in range(0, len(queries), step):
            yield begin, *self.search(queries[begin:begin + step], beam, starts)

    def prune(self, nodes: np.ndarray, candidates: np.ndarray, relax: float) -> np.ndarray:
        """Diverse edges of each node among its candidates (-1: none)."""
        out = np.full((len(nodes), self.degree), -1, np.int32)
        wide = candidates.shape[1]
        step = max(1, _FLOATS // (wide * max(wide, self.x.shape[1])))
        for begin in range(0, len(nodes), step):
            own, c = nodes[begin:begin + step], np.sort(candidates[begin:begin + step], axis=1)
            c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
            c[c == own[:, None]] = -1
            x = self.x[c]
            d = self.square[own][:, None] + self.square[c] - 2 * np.einsum("bcd,bd->bc", x, self.x[own])
            apart = self.square[c][:, :, None] + self.square[c][:, None] - 2 * (x @ x.transpose(0, 2, 1))
            left, row = np.where(c >= 0, d, np.inf), np.arange(len(own))
            for k in range(self.degree):
                near = left.argmin(axis=1)
                some = left[row, near] < np.inf
                if not some.any():
                    break
                out[begin + row[some], k] = c[row[some], near[some]]
                left[row, near] = np.inf
                left[relax * relax * apart[row, near] <= d] = np.inf
        return out

    def link_back(self, nodes: np.ndarray, relax: float) -> None:
        """Return the edges of ``nodes``; a list that overflows is pruned."""
        room = self.edges.shape[1] - 1
        source, target = np.repeat(nodes, room), self.edges[nodes, :room].ravel().astype(np.int64)
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        hubs, begin, count = np.unique(target, return_index=True, return_counts=True)
        size = 1 << np.ceil(np.log2(count)).astype(np.int64)
        for s in np.unique(size):
            some = np.flatnonzero(size == s)
            at = begin[some][:, None] + np.arange(s)
            inside = np.arange(s) < count[some][:, None]
            came = np.where(inside, source[np.where(inside, at, 0)], -1)
            own = self.edges[hubs[some], :room].astype(np.int64)
            came[(came[:, :, None] == own[:, None]).any(axis=2)] = -1
            every = np.concatenate([own, came], axis=1)
            fits = (every >= 0).sum(axis=1) <= room
            packed = np.take_along_axis(every, np.argsort(every < 0, axis=1, kind="stable"), 1)[:, :room]
            self.edges[hubs[some][fits], :room] = packed[fits]
            if not fits.all():
                self._set(hubs[some][~fits], every[~fits], relax)

    def _set(self, nodes: np.ndarray, candidates: np.ndarray, relax: float) -> None:
        self.edges[nodes, :-1] = -1
        self.edges[nodes, :self.degree] = self.prune(nodes, candidates, relax)

    def build(self, beam: int = BUILD_BEAM, relax: float = RELAX) -> None:
        """Insert all nodes in batches that double, a fiftieth of the shard at most."""
        n = len(self.x)
        centre = self.x.mean(axis=0, dtype=np.float64).astype(np.float32)
        self.entry = int((self.square - 2 * self.x @ centre).argmin())
        order = np.random.default_rng(13).permutation(n)
        order = order[order != self.entry]
        at, most = 0, max(32, min(1024, n // 50))
        while at < len(order):
            batch = order[at:at + min(at + 1, most)]
            for begin, _, path in self.searched(self.x[batch], beam, np.array([self.entry])):
                self._set(batch[begin:begin + len(path)], path, relax)
            self.link_back(batch, relax)
            at += len(batch)
        full = np.flatnonzero((self.edges >= 0).sum(axis=1) > self.degree)
        self._set(full, self.edges[full, :-1].astype(np.int64), relax)
        self.edges = np.concatenate([self.edges[:, :self.degree], self.edges[:, -1:]], axis=1)
        self.reach_all(beam)

    def reached(self) -> np.ndarray:
        seen = np.zeros(len(self.x), bool)
        front = np.array([self.entry])
        seen[front] = True
        while len(front):
            front = np.unique(self.edges[front])
            front = front[front >= 0]
            front = front[~seen[front]]
            seen[front] = True
        return seen

    def reach_all(self, beam: int) -> None:
        """Give a node that no path from the entry reaches the spare edge of a near node that one does."""
        while True:
            seen = self.reached()
            lost = np.flatnonzero(~seen)[:256]
            if not len(lost):
                return
            beams = self.search(self.x[lost], beam, np.array([self.entry]))[0]
            for node, near in zip(lost.tolist(), beams):
                near = near[(near >= 0)]
                free = near[self.edges[near, -1] < 0]
                if not len(free):  # a node reached by a spare edge has its own one left, so there always is one
                    spare = np.flatnonzero(seen & (self.edges[:, -1] < 0))
                    free = spare[(self.square[spare] - 2 * self.x[spare] @ self.x[node]).argmin()][None]
                self.edges[free[0], -1] = node
                seen[node] = True


def products(x: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Inner products ``[query, candidate]`` of ``x[query, candidate, :]``, summed component by component."""
    out = np.zeros(x.shape[:2])
    for k in range(x.shape[2]):
        out += x[:, :, k] * queries[:, None, k]
    return out


def _fine(vector: Column) -> Column:
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda v: v != 0)


def points(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(h1, h2, id, vector)`` of the rows that take part; two hashes stand for the vector."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & _fine(F.col("vector")))
    return rows.select(F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(13), "vector").alias("h2"), "id", "vector")


def _matrix(lists, dim: int) -> np.ndarray:
    return np.asarray(lists.combine_chunks().flatten(), np.float64).reshape(-1, dim)


def index(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, shard_rows: int = SHARD_ROWS,
          degree: int = DEGREE, beam: int = BUILD_BEAM, relax: float = RELAX) -> DataFrame:
    """``(dim, layer, shard, shards, node, entry, vector, ids, edges)``: every vector in the graph of its shard.

    ``ids`` are the smallest ``k + 1`` ids of a vector: an answer of ``k`` rows beside the query's own needs no more.
    """
    rows = points(df, id_col, vector_col).dropDuplicates(["h1", "h2", "id"])
    place = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))
    nodes = (rows.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("h1", "h2")
             .agg(F.first("vector").alias("vector"), F.sort_array(F.collect_list("id")).alias("ids")))
    # the largest component is taken out first, so that squares neither overflow nor vanish
    scaled = F.aggregate("vector", F.lit(0.0), lambda a, v: a + (v / F.col("top")) * (v / F.col("top")))
    nodes = nodes.withColumn("dim", F.size("vector")).withColumn("top", F.array_max(F.transform("vector", F.abs)))
    nodes = settle(nodes.withColumn("layer", F.floor(F.log2("top") + F.log2(scaled) / 2 + 0.5).cast("int")).drop("top"), "vectors")
    sizes = settle(nodes.groupBy("dim", "layer").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards")), "shards")
    dealt = nodes.join(sizes, ["dim", "layer"]).withColumn("shard", F.pmod("h1", "shards").cast("int"))
    kind = type_of(df, id_col)

    def built(key, group):
        group = group.sort_by([("h1", "ascending"), ("h2", "ascending")])
        graph = Graph(_matrix(group["vector"], key[0].as_py()), degree=degree)
        graph.build(beam, relax)
        n = group.num_rows
        edges = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * (degree + 1), pa.array(graph.edges.ravel()))
        return pa.table({"dim": group["dim"], "layer": group["layer"], "shard": group["shard"], "shards": group["shards"],
                         "node": pa.array(np.arange(n, dtype=np.int32)), "entry": pa.array(np.arange(n) == graph.entry),
                         "vector": group["vector"], "ids": group["ids"], "edges": edges})

    return settle(dealt.groupBy("dim", "layer", "shard").applyInArrow(
        built, f"dim int, layer int, shard int, shards int, node int, entry boolean, vector array<double>, ids array<{kind}>, edges array<int>"), "graphs")


def search(graphs: DataFrame, queries: DataFrame, k: int = K, beam: int = SEARCH_BEAM, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``(query_id, h1, h2, rank, id, score)``: the best ``k`` found for each row of ``points`` in ``queries``.

    ``graphs`` comes from ``index`` with the same or a larger ``k``.
    """
    if beam <= k:
        raise ValueError("the beam must be wider than the answer")
    asked = settle(queries.dropDuplicates(["h1", "h2", "id"]).withColumn("dim", F.size("vector")), "queries")
    blocks = max(1, -(-asked.count() // query_rows))
    shards = graphs.select(*(F.col(c).alias(c) for c in ("dim", "layer", "shards"))).distinct()
    sent = asked.withColumn("block", F.pmod(F.xxhash64("h1", "h2", "id"), F.lit(blocks)).cast("int")).join(shards, "dim").select(
        "dim", "layer", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "block", "h1", "h2", "id", "vector")
    read = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    id_type = asked.schema["id"].dataType.simpleString()
    keys = ["dim", "layer", "shard", "block"]

    def found(key, held, asked):
        if not held.num_rows or not asked.num_rows:
            return none
        held, dim = held.sort_by("node"), key[0].as_py()
        x, q = _matrix(held["vector"], dim), _matrix(asked["vector"], dim)
        edges = np.asarray(held["edges"].combine_chunks().flatten()).reshape(held.num_rows, -1)
        graph = Graph(x, edges, int(np.flatnonzero(held["entry"].to_numpy())[0]), edges.shape[1] - 1)
        ids = held["ids"].combine_chunks()
        cut, flat = ids.offsets.to_numpy().astype(np.int64) - ids.offsets[0].as_py(), ids.flatten()
        _, rank = np.unique(np.asarray(flat), return_inverse=True)  # ids by order, whatever their type
        places = {v: i for i, v in enumerate(flat.to_pylist())}
        own = np.array([rank[places[v]] if v in places else -1 for v in asked["id"].to_pylist()], np.int64)
        out = []
        for begin, beams, _ in graph.searched(graph.lift(q), beam):
            step = max(1, _FLOATS // (beam * dim))
            for a in range(0, len(beams), step):
                some = beams[a:a + step]
                score = products(x[some], q[begin + a:begin + a + len(some)])
                score[some < 0] = -np.inf
                floor = -np.sort(-score, axis=1)[:, min(k, beam - 1)]  # ties of the last place stay
                r, c = np.nonzero((some >= 0) & (score >= floor[:, None]))
                node = some[r, c]
                size = cut[node + 1] - cut[node]
                at = np.arange(size.sum()) + np.repeat(cut[node] - np.cumsum(size) + size, size)
                r, s = np.repeat(r, size), np.repeat(score[r, c], size)
                other = rank[at] != own[begin + a + r]
                r, s, at = r[other], s[other], at[other]
                order = np.lexsort((rank[at], -s, r))
                r, s, at = r[order], s[order], at[order]
                best = np.arange(len(r)) - np.searchsorted(r, r) < k
                asker = pa.array(begin + a + r[best])
                out.append(pa.table({"query_id": asked["id"].take(asker), "h1": asked["h1"].take(asker), "h2": asked["h2"].take(asker),
                                     "id": flat.take(pa.array(at[best])), "score": pa.array(s[best])}))
        return pa.concat_tables(out).cast(none.schema)

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(asked.schema["id"].dataType)
    none = pa.schema([("query_id", kind), ("h1", pa.int64()), ("h2", pa.int64()), ("id", kind), ("score", pa.float64())]).empty_table()
    hits = read.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(
        found, f"query_id {id_type}, h1 bigint, h2 bigint, id {id_type}, score double")
    best = Window.partitionBy("query_id", "h1", "h2").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    asked = points(vectors.where(F.col("vec_id") % 20 == 0))
    return search(index(vectors), asked).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
