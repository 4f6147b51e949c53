"""Filter audits, prefix tries and graph searches against brute force, on odd rows and on hot groups."""

import hashlib
import re
import zlib
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

import check_oracle
from rememora.llm import op11_filter_audit as op11, op12_prefix_trie as op12, op13_graph_search as op13, queries

from .conftest import make_docs, sentence

# filter audit

LABELS = "doc_id long, quality int, toxic int, part string, mask string"


def brute_audit(docs, labels):
    """``docs``: (id, text, part); every order is applied row by row."""
    fails = []
    for i, text, _ in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        fails.append({"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
                      "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": copy})
    good, toxic = ({i for i, *marks in labels if i is not None and marks[k] == 1} for k in (0, 1))
    out = {}
    for part in {p or "" for _, _, p in docs}:
        rows = [(i, f) for (i, _, p), f in zip(docs, fails) if (p or "") == part]
        sums = defaultdict(int)
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for step, name in enumerate(order, 1):
                gone = [r for r in left if r[1][name]]
                left = [r for r in left if not r[1][name]]
                out[part, order, step] = [
                    len(left), len(gone), sum(f[name] for _, f in rows) - len(gone), sum(f[name] and sum(f.values()) == 1 for _, f in rows),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
                sums[name] += len(gone)
        for key in [k for k in out if k[0] == part]:
            out[key].append(sums[key[1][key[2] - 1]])
    return out


def audited(spark, docs, labels):
    made = make_docs(spark, [(i, t) for i, t, _ in docs]).withColumn("source", F.lit(None).cast("string"))
    schema = T.StructType([*made.schema.fields])
    rows = [(i, t, None, p, 0, *["x"] * 6) for i, t, p in docs]
    marked = op11.failures(spark.createDataFrame(rows, schema).repartition(3))
    got = op11.audit(op11.labelled(marked, spark.createDataFrame([(*r, "x", "y") for r in labels], LABELS))).collect()
    return {(r.part, r.filter_order, r.step): [r[c] for c in op11.COUNTS] for r in got}


def test_audit_equals_brute_force(spark, odd_rows):
    many = " ".join(f"w{k}" for k in range(250))
    docs = [(i, t, ("a", "b", None, "")[k % 4]) for k, (i, t) in enumerate(odd_rows)]
    docs += [(20 + k, many, "a") for k in range(8)] + [(40, many + " #", "b"), (41, many.upper(), "b"), (42, "One two " * 200, "c"), (40, many + " #", "b"),
             (None, many, "a"), (50, "é" * 49 + "A", "c"), (51, "é" * 50 + "A", "c")]
    labels = [(20, 1, 0), (21, None, 1), (21, 1, 0), (22, 0, 1), (None, 1, 1), (42, 1, 1), (40, 1, None), (999, 1, 1)]
    assert audited(spark, docs, labels) == brute_audit(docs, labels)
    assert audited(spark, [], labels) == {}


@pytest.mark.parametrize("window", [1, 7, 64, 1 << 20])
def test_words_do_not_depend_on_windows(window):
    for text in ["", "  ", "a", " a  bb a\tc\n" * 9, "x" * 100, sentence(90), "é\x1cü\x85 é\x1cü"]:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        assert op11.count_words(text.encode(), window) == (len(words), len(set(words)))


def test_steps_are_the_first_failing_filter():
    steps, orders = op11.removal_steps(np.arange(32), 5)
    for o, order in enumerate(orders):
        for m in range(32):
            assert steps[o, m] == next((k for k, f in enumerate(order) if m >> f & 1), 5)


# prefix trie

CONVERSATIONS = "conv_id long, turn long, role string, text string, depth string, v1 string, length string"


def brute_sequences(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(x)] for c, x in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = int(np.fix(c / 100)) * 100
        out[c] = own.get(base, [])[:h] + own[c][h:]
    return out


def brute_trie(sequences):
    members = defaultdict(set)
    for c, seq in sequences.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].add(c)
    kids = defaultdict(set)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, own in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(own) - 1) * len(p[-1][1]) if p else 0
    return sorted((min(own), len(p), -1 if not p else min(members[p[:-1]]), len(own), len(kids[p]), leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in sorted(own) if len(sequences[c]) == len(p)).encode()).hexdigest())
                  for p, own in members.items())


def trie_rows(df):
    return sorted((r.conv, r.depth, -1 if r.parent_conv is None else r.parent_conv, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
                  for r in df.collect())


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], CONVERSATIONS)


def test_trie_equals_brute_force(spark):
    rng = np.random.default_rng(12)
    rows = []
    for c in [*range(0, 45), *range(100, 130), *range(205, 230), -1, -60, 999]:
        rows += [(c, k, "user" if k % 2 else None, f"t{rng.integers(2)}" * int(rng.integers(1, 3))) for k in range(int(rng.integers(1, 9)))]
    # null, tied, repeated and empty turns; a null id
    rows += [(300, None, "user", None), (300, None, None, ""), (300, 1, "user", "a"), (300, 1, "user", "a"), (300, 5, "user", "é𝄞"), (None, 0, "user", "x"), (301, 0, "user", "z")]
    got = trie_rows(op12.trie(*op12.rebuilt(op12.turns(conversations(spark, rows).repartition(5)))))
    assert got == brute_trie(brute_sequences(rows))
    assert op12.trie(*op12.rebuilt(op12.turns(conversations(spark, [])))).count() == 0


def test_long_conversations_are_named_in_blocks(spark):
    """Chunks of four turns: sequences of up to 150 turns take three levels of block names, with crowds of copies."""
    rng = np.random.default_rng(3)
    long = [f"t{k}" for k in rng.integers(0, 3, 150)]
    sequences = {k: [("", x) for x in long[:int(rng.integers(0, 151))]] for k in range(40)}
    sequences |= {50 + k: [("", x) for x in [*long[:k * 7], "own", *long[k * 7:]]] for k in range(20)}
    sequences |= {100 + k: sequences[1] for k in range(600)} | {800: [], 801: []}
    rows = [(c, p, "", x, len(s)) for c, s in sequences.items() for p, (_, x) in enumerate(s)]
    made = spark.createDataFrame(rows, "conv long, p long, role string, text string, length long")
    made = op12.turns(made, "conv", "p").join(made.select("conv", F.col("p").alias("turn"), "length"), ["conv", "turn"]).select(
        "conv", F.col("turn").alias("p"), "t1", "t2", "chars", "length")
    convs = spark.createDataFrame([(c, len(s)) for c, s in sequences.items()], "conv long, length long")
    assert trie_rows(op12.trie(made, convs, bits=2)) == brute_trie(sequences)


def test_names_tell_prefixes_apart():
    """Equal prefixes, and only these, have equal names, also across sequences of one batch."""
    rng = np.random.default_rng(4)
    seqs = [rng.integers(0, 2, int(rng.integers(1, 17))) for _ in range(200)]
    at = np.concatenate([np.arange(len(s)) for s in seqs])
    t = np.concatenate(seqs).astype(np.uint64)
    levels = op12.block_names((t, t + np.uint64(7)), at, 4)
    zero = (np.zeros(len(t), np.uint64), np.zeros(len(t), np.uint64))
    before = list(zip(*op12.prefix_names(levels, at, at, zero)))
    prefixes = [tuple(s[:k]) for s in seqs for k in range(len(s))]
    assert len(set(before)) == len(set(prefixes)) == len(set(zip(before, prefixes)))


# graph search

def embeddings(spark, rows):
    kind = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                         T.StructField("label", T.IntegerType()), T.StructField("node", T.StringType()), T.StructField("shard", T.StringType())])
    return spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], kind)


def product(a, b):
    out = 0.0
    for x, y in zip(a, b):  # sum() would compensate
        out += x * y
    return out


def brute_nearest(rows, k):
    """Per query row the list of (id, score): products summed component by component."""
    fine = sorted({(i, tuple(map(float, np.float32(v)))) for i, v in rows
                   if i is not None and v and None not in v and np.isfinite(v).all() and any(v)})
    out = {}
    for i, v in fine:
        if i % 20 == 0:
            found = [(-product(w, v), j) for j, w in fine if j != i and len(w) == len(v)]
            out[i, v] = [(j, -s) for s, j in sorted(found)[:k]]
    return out


def searched(spark, rows, **how):
    df = embeddings(spark, rows).repartition(4)
    asked = op13.points(df.where(F.col("vec_id") % 20 == 0))
    graphs = op13.index(df, **{a: b for a, b in how.items() if a != "query_rows"})
    return op13.search(graphs, asked, **{a: b for a, b in how.items() if a in ("k", "query_rows")}).collect()


def test_small_tables_are_searched_wholly(spark):
    """Fewer vectors than the beam holds: the result is exact, with copies, ties, odd rows and other lengths."""
    rng = np.random.default_rng(9)
    rows = [(k, np.float32(rng.standard_normal(8)).tolist()) for k in range(90)]
    rows += [(200 + k, rows[20][1]) for k in range(60)] + [(300 + k, [1.0, float(k % 3), 0.0]) for k in range(12)] + [(320, [0.0, 1.0, 2.0])]
    rows += [(400, None), (401, []), (402, [0.0] * 8), (403, [None] * 8), (404, [float("nan")] * 8), (405, [float("inf")] * 8), (None, rows[0][1]),
             (40, rows[40][1]), (440, [5.0, 5.0]), (460, [2.0] * 5), (461, [1e18] * 5), (462, [1e-18] * 5)]
    want = brute_nearest(rows, 20)
    got = defaultdict(list)
    for r in sorted(searched(spark, rows, query_rows=3), key=lambda r: r["rank"]):
        got[r.query_id].append((r.id, r.score))
    assert {i: w for (i, _), w in want.items() if w} == dict(got)
    assert searched(spark, []) == [] and searched(spark, [(20, [1.0])]) == []


@pytest.mark.parametrize("kind", ["clusters", "spread", "norms"])
def test_recall_against_brute_force(spark, kind):
    rng = np.random.default_rng(10)
    x = rng.standard_normal((3000, 16))
    if kind == "clusters":
        x = rng.standard_normal((60, 16))[rng.integers(0, 60, 3000)] + 0.1 * x
    if kind == "norms":
        x *= np.exp(rng.uniform(-4, 4, (3000, 1)))
    x = np.float32(x)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    got = defaultdict(set)
    for r in searched(spark, rows, shard_rows=800):
        got[r.query_id].add(r.id)
    y = x.astype(float)
    hits = []
    for q in range(0, 3000, 20):
        score = y @ y[q]
        score[q] = -np.inf
        hits.append(len(got[q] & set(np.argsort(-score)[:20].tolist())) / 20)
    assert all(len(v) == 20 for v in got.values()) and np.mean(hits) >= 0.95


def test_every_node_is_reached():
    rng = np.random.default_rng(11)
    x = np.repeat(rng.standard_normal((30, 6)) * 100, 40, 0) + rng.standard_normal((1200, 6)) * 1e-3
    graph = op13.Graph(x, degree=3)
    graph.build(beam=8)
    assert graph.reached().all() and (graph.edges[:, :3] >= 0).any(axis=1).all()


def test_pruned_edges_are_diverse():
    """No kept edge hides another: along the kept ones, by distance, none is nearer to a later one than the node is."""
    rng = np.random.default_rng(1)
    graph = op13.Graph(rng.standard_normal((80, 5)), degree=6)
    kept = graph.prune(np.array([7]), np.array([[k for k in range(80)]]), 1.2)[0]
    x, kept = graph.x.astype(float), [k for k in kept.tolist() if k >= 0]
    d = lambda a, b: ((x[a] - x[b]) ** 2).sum()
    assert kept and 7 not in kept and kept == sorted(kept, key=lambda k: d(k, 7))
    assert all(1.44 * d(a, b) > d(b, 7) for i, a in enumerate(kept) for b in kept[i + 1:])


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_prefix_trie"])
def test_chain_query_equals_sql(spark, small, name):
    got = queries.QUERIES[name](spark, small).toPandas()
    assert check_oracle.compare(got, check_oracle.connect(small).execute(queries.SQL[name]).df()) == ""
