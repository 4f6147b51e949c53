"""What moves between tasks grows with the rows that matter, and no pair is lost by it."""

import random
from inspect import signature
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from rememora.operators import bm25, caches, dedup, graph, neighbors
from rememora.params import DEFAULTS


def test_token_sets_meet_only_where_signatures_leave_room(spark, monkeypatch):
    """Sets that share rare tokens but are unlike one another never have their tokens brought together."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    sets = [rng.sample(words, 60) for _ in range(120)]
    sets += [[*s[:-6], *(f"x{k}{j}" for j in range(6))] for k, s in enumerate(sets[:20])]
    sets += [[f"short{k}"] for k in range(4)] + [["short1"]]
    rows = spark.createDataFrame([("c", k, s) for k, s in enumerate(sets)], "chat_id string, a long, toks array<string>")
    counts = {}

    def counted(df, label, real=dedup.settle):
        out = real(df, label)
        counts[label] = out.count()
        return out

    monkeypatch.setattr(dedup, "settle", counted)
    alike = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.7
    want = {(a, b) for a, b in combinations(range(len(sets)), 2) if alike(sets[a], sets[b])}
    got = dedup.similar_sets(rows, rows.withColumnRenamed("a", "b"), ["chat_id"], 0.7, ordered=True)
    assert {(r.a, r.b) for r in got.collect()} == want and len(want) >= 21
    assert len(want) <= counts["candidates"] <= 2 * len(want)


def test_signatures_differ_by_no_more_than_the_sets(spark):
    rng = random.Random(6)
    rows = [(rng.sample(range(300), rng.randint(0, 80)), rng.sample(range(300), rng.randint(0, 80))) for _ in range(60)]
    df = spark.createDataFrame([([str(x) for x in a], [str(x) for x in b]) for a, b in rows], "x array<string>, y array<string>")
    bits = sum(F.bit_count(F.col("p")[i].bitwiseXOR(F.col("q")[i])) for i in range(dedup.SIGNATURE_WORDS))
    apart = df.select("x", "y", dedup.signature(F.col("x")).alias("p"), dedup.signature(F.col("y")).alias("q")).select("x", "y", bits.alias("d"))
    for r in apart.collect():
        apart_by = len(set(r.x) ^ set(r.y))
        assert r.d <= apart_by and r.d % 2 == apart_by % 2


def test_neighbour_rows_are_copied_once_per_large_unit(spark, monkeypatch):
    """A cell of many blocks is one unit of work by default; cut into small units it gives the same neighbours."""
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(300, 4))
    vecs /= np.linalg.norm(vecs, axis=1, keepdims=True)
    rows = spark.createDataFrame([("all", k, k, [float(x) for x in v]) for k, v in enumerate(vecs)], "key string, id long, seq long, vec array<double>")
    monkeypatch.setattr(neighbors, "_AT_ONCE", 1_000)  # several slices of queries
    read = lambda df: {(r.qid, r.rank): (r.id, round(r.similarity, 6)) for r in df.collect()}
    whole = read(neighbors.nearest(rows, 3, block=16))
    assert whole == read(neighbors.nearest(rows, 3, block=16, unit=16))
    sims = np.round(vecs @ vecs.T, 9)
    np.fill_diagonal(sims, -2)
    for q in range(300):
        best = np.argsort(-sims[q], kind="stable")[:3]
        assert [whole[q, r + 1][0] for r in range(3)] == [b for b in best if sims[q, b] > 0]


def test_foremost_values_are_those_of_a_whole_sort():
    rng = np.random.default_rng(11)
    sims = rng.integers(0, 9, (40, 200)) / 9 + rng.choice([0, 3e-10, -4e-10], (40, 200))
    rounded = np.round(sims, 9)
    best = np.argsort(-rounded, axis=1, kind="stable")[:, :7]
    rows, cols, values = neighbors._foremost(sims, 7)
    assert (rows == np.repeat(np.arange(40), 7)).all() and (cols == best.ravel()).all()
    assert (values == np.take_along_axis(rounded, best, axis=1).ravel()).all()


def test_a_query_goes_once_to_a_group_of_cells(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vecs = rng.normal(size=(400, 16))
    vecs /= np.linalg.norm(vecs, axis=1, keepdims=True)
    rows = spark.createDataFrame([("all", k, k, [float(x) for x in v]) for k, v in enumerate(vecs)], "key string, id long, seq long, vec array<double>")
    asked = []
    monkeypatch.setattr(neighbors, "_best_in_cells", lambda members, queries, k, real=neighbors._best_in_cells: asked.append(
        queries.count()) or real(members, queries, k))
    whole = {(r.qid, r.rank): r.id for r in neighbors.nearest(rows, 3, block=8).collect()}
    # 50 cells that prune nothing lie in 8 groups
    assert asked[0] == 400 and asked[1] <= 8 * 400
    sims = np.round(vecs @ vecs.T, 9)
    np.fill_diagonal(sims, -2)
    best = np.argsort(-sims, axis=1, kind="stable")[:, :3]
    assert all(whole[q, r + 1] == best[q, r] for q in range(400) for r in range(3))


def test_edges_deal_lists_by_source_once(spark):
    """Pairs of entries are made, told apart and cut where their source lies: none is moved between tasks."""
    rng = random.Random(7)
    names = ["Alba", "Bern", "Cork", "Dorn", "Elba", "Fano", "Gera", "Hilo"]
    rows = [("c", f"e{k}", k, "episodic", " ".join({"Alba", *rng.sample(names, 3)} if k % 3 else rng.sample(names, 2))) for k in range(60)]
    rows += [("c", f"x{k}", None, "episodic", "Fano") for k in range(2)] + rows[4:6] + [("d", "e1", 1, "working", "Alba"), ("d", "e2", 2, "episodic", "Alba")]
    entries = spark.createDataFrame(rows, "chat_id string, id string, seq long, scope string, content string")
    params = DEFAULTS.override(edge_cap=3)
    edges = graph.build_edges(entries, params)
    got = {}
    for r in edges.collect():
        got.setdefault((r.chat_id, r.from_id), {})[r.seq] = r.to_id
    want = {}
    for chat, source, seq, _scope, content in rows:
        held = [sorted({(s, i) for c, i, s, scope, text in rows if c == chat and scope != "working" and name in text.split() and s is not None}) for name in content.split()]
        # entries without a place hold the first places of their names and are no targets
        room = [3 - 2 * (name == "Fano" and chat == "c") for name in content.split()]
        repeats = [[t for t in first for _ in range(1 + (t[1] in ("e4", "e5")))][:n] for first, n in zip(held, room)]
        before = sorted({t for first in repeats for t in first if seq is not None and t[0] < seq})[:3]
        if before:
            want[chat, source] = {k + 1: i for k, (_, i) in enumerate(before)}
    assert got == want
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "to_id" in line]


def test_terms_of_entries_in_no_pair_are_not_listed(spark):
    entries = spark.createDataFrame([("c", f"e{k}", k, f"alpha beta{k}", "", []) for k in range(6)],
                                    "chat_id string, id string, seq long, content string, subject string, tags array<string>")
    index = bm25.build_index(entries, keep=False)
    weights = bm25.weigh_terms(index, spark.createDataFrame([("c", 1, "alpha beta2")], "chat_id string, query_id long, query string"))
    pairs = spark.createDataFrame([("c", 1, "e2"), ("c", 1, "e3"), ("c", 1, "e3"), ("c", 1, "gone")], "chat_id string, query_id long, id string")
    found = bm25.score_pairs(index, weights, pairs)
    whole = {r.id: r.bm25 for r in bm25.score_all(index, weights).collect()}
    assert {r.id: r.bm25 for r in found.collect()} == {"e2": whole["e2"], "e3": whole["e3"]}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.rindex("Join")  # a join lies below the list of terms


def test_a_key_of_a_text_is_made_once(spark):
    asked = spark.createDataFrame([("c", 1, "Où  est?\t"), ("c", 2, "  où  est?"), ("c", 3, None), ("c", 4, "..."), ("c", 5, "x \x85"), ("c", 6, "x\x85")],
                                  "chat_id string, query_id long, query string")
    rows = asked.select("chat_id", "query", F.array(F.col("query_id").cast("string")).alias("ids"), F.col("query_id").alias("written"))
    for writes, kept in ((caches.exact_writes, {2: 2, 4: 4, 6: 6}), (caches.fuzzy_writes, {2: 2})):
        written = writes(rows)
        held = caches.record(written.limit(0), written, DEFAULTS.override(cache_cap=5))
        assert {r.written: int(r.ids[0]) for r in held.collect()} == kept
        plan = held._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("fnv1a32(") + plan.count("array_join") <= 1
        if writes is caches.exact_writes:
            hits = caches.exact_hits(held, asked)
            assert {(r.query_id, r.ids[0]) for r in hits.collect()} == {(1, "2"), (2, "2"), (4, "4"), (5, "6"), (6, "6")}
            assert hits._jdf.queryExecution().optimizedPlan().toString().count("fnv1a32(") <= 2


def test_neighbour_rows_of_a_large_key_are_copied_as_often_as_those_of_a_small_one(spark):
    """A query goes at most once to each group of cells, so their number bounds its copies: 600,000 rows have no more than 60,000."""
    unit = signature(neighbors.nearest).parameters["unit"].default
    groups = {}
    for n in (60_000, 600_000):
        rows = spark.range(n).select(F.lit("all").alias("key"), "id", (F.col("id") % 64).cast("int").alias("cell"),
                                     F.array(F.lit(1.0), F.lit(0.5)).alias("pivot_sims"), F.array_repeat(F.lit(0.0), 64).alias("vec"))
        row = neighbors._layout(rows, neighbors.BLOCK, unit).first()
        groups[n] = 1 + max(c["last"] for c in row.cells.values())
        assert row.unit * 64 * 8 <= 64 << 20
    assert groups[600_000] == groups[60_000] == 8
