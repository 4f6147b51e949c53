"""Packing, embeddings, SimHash, WARC, pages and the pipeline."""

import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import types as T

import check_oracle
import corpus_pipeline
from rememora.llm import op01_fingerprint as op1, op03_packing as op3, op04_embedding_dedup as op4, op07_simhash as op7, op08_warc as op8, op09_html as op9, queries

from .conftest import make_docs, sentence

PATH = public_tokenizers.path(op3.TOKENIZER)


def tokens(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [1]


def roots(n, links):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# packing

def check_packed(out, texts, capacity):
    want = []
    for t in texts:
        ids = np.array(tokens(t), "<u4")
        want += [(k, at, len(ids[at:at + capacity]), zlib.crc32(ids[at:at + capacity].tobytes())) for k, at in enumerate(range(0, len(ids), capacity))]
    assert sorted(zip(out.piece, out.start, out.length, out.ids_crc32)) == sorted(want)
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= capacity


def test_packs_every_piece_once(spark, odd, odd_rows, none):
    check_packed(op3.pack(odd, PATH).toPandas(), [t for _, t in odd_rows], 4096)
    assert op3.pack(none, PATH).count() == 0


def test_rounds_merge_underfull_bins(spark):
    texts = [sentence(3 + k % 40, k) for k in range(600)]
    docs = make_docs(spark, list(enumerate(texts))).repartition(8)
    out = op3.pack(docs, PATH, capacity=256, slack=2, group_rows=20).toPandas()
    check_packed(out, texts, 256)
    assert out.sequence_id.nunique() <= 1.02 * -(-out.length.sum() // 256) + 1
    wide = op3.pack(make_docs(spark, [(k, sentence(30, k)) for k in range(60)]).repartition(6), PATH, capacity=70, slack=2, group_rows=5).toPandas()
    check_packed(wide, [sentence(30, k) for k in range(60)], 70)


def test_best_fit_takes_the_tightest_bin():
    bins, offsets, fills = op3.best_fit(np.array([60, 50, 40, 45, 5]), 100)
    assert bins.tolist() == [0, 1, 0, 1, 1] and offsets.tolist() == [0, 0, 60, 50, 95] and fills.tolist() == [100, 100]


# embeddings

def vectors(spark, rows):
    kind = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                         T.StructField("label", T.IntegerType()), T.StructField("key", T.StringType()), T.StructField("n_links", T.StringType())])
    return spark.createDataFrame([(*r, "x", "y") for r in rows], kind)


def brute_vectors(rows):
    fine = []
    for i, v, label in rows:
        ok = label is not None and v and None not in v and np.isfinite(v).all() and any(v)
        fine.append(np.array(v, float) / np.linalg.norm(v) if ok else None)
    links = [(a, b) for a in range(len(rows)) for b in range(a) if fine[a] is not None and fine[b] is not None and rows[a][2] == rows[b][2]
             and len(fine[a]) == len(fine[b]) and fine[a] @ fine[b] >= 0.93]
    root = roots(len(rows), links)
    least = pd.Series([r[0] for r in rows]).groupby(root).min()
    n = np.bincount([x for p in links for x in p], minlength=len(rows))
    return sorted((r[0], int(k), int(least[q]), bool(r[0] == least[q])) for r, k, q in zip(rows, n, root))


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(260):
        base = rng.standard_normal(8) if k % 4 or not rows else np.array(rows[-1][1]) + rng.standard_normal(8) * 0.25
        rows.append((k, np.float32(base).tolist(), int(rng.integers(2))))
    crowd = rng.standard_normal(8)
    rows += [(300 + k, np.float32(crowd + rng.standard_normal(8) * 0.1).tolist(), 1) for k in range(60)]
    rows += [(400 + k, rows[0][1], rows[0][2]) for k in range(5)]
    rows += [(500, None, 1), (501, [], 1), (502, [0.0] * 8, 1), (503, [None] * 8, 1), (504, [float("nan")] * 8, 1), (505, rows[0][1], None),
             (506, [1.0, 2.0], 1), (507, [1.0, 2.0], 1), (508, [2 * x for x in rows[0][1]], rows[0][2]), (509, [float("inf")] * 8, 0)]
    out = op4.linked(vectors(spark, rows), block=50, pivots=7)
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in out.collect()) == brute_vectors(rows)


def test_no_vectors(spark):
    assert op4.linked(vectors(spark, [])).count() == 0
    assert [tuple(r) for r in op4.linked(vectors(spark, [(1, None, 2)])).collect()] == [(1, 0, 1, True)]


# SimHash

def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[k:k + 4]) for k in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_brute_force(spark, odd, odd_rows, none):
    out = op7.near_duplicates(odd).toPandas()
    have = sorted(int(x) & (1 << 64) - 1 for x in out.fp)
    assert have == sorted(brute_fingerprint(t) for _, t in odd_rows)
    assert set(out.component_id[out.doc_id.isin([1, 2, 3])]) == {1} and set(out.component_id[out.doc_id.isin([4, 5])]) == {4}
    assert op7.near_duplicates(none).count() == 0
    kept = op7.one_per_group(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 4, 6, 7, 8, 9]


@pytest.mark.parametrize("block", [op7.BLOCK, 40])  # 40: the crowd's cells are cut into blocks
def test_anchors_lose_no_link(spark, block):
    rng = np.random.default_rng(6)
    fps = []
    for _ in range(150):
        x = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(2))
        for _ in range(4):
            fps.append(x)
            for b in rng.choice(64, int(rng.integers(1, 7)), replace=False):
                x ^= 1 << int(b)
    centre = 0x0123456789ABCDEF
    fps += [centre ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)][:700]  # a crowd in large cells
    fps = list(dict.fromkeys(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    assert bool(op7.cell_blocks(nodes, block=block)) == (block == 40)
    links = op7.links(nodes, block=block).collect()
    at = {f: k for k, f in enumerate(signed)}
    assert all((fps[at[r.a]] ^ fps[at[r.b]]).bit_count() <= 4 for r in links)
    want = roots(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4])
    assert roots(len(fps), [(at[r.a], at[r.b]) for r in links]) == want


# WARC

def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, digest string, payload string")


def test_warc_round_trip(spark):
    long = "<p>é" * 60
    rows = [(4, "http://b.example.com/x?y#z", long), (2, "https://a.example.org", long), (9, None, long), (1, "u\r\nx y", None), (3, "http://b.example.com/x", ""),
            (5, "http://b.example.com/", "short\r\n\r\nWARC/1.1\r\n\r\n"), (6, "http://b.example.com/", "short\r\n\r\nWARC/1.1\r\n\r\n"), (7, "q", "\r\n" * 80)]
    index = op8.archive(pages(spark, rows)).toPandas().sort_values("position")
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]))
    assert check_oracle.compare(index[["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]], con.execute(op8.SQL).df()) == ""
    assert index.url_key.map(str.encode).is_monotonic_increasing
    assert op8.archive(pages(spark, [])).count() == 0
    assert op8.url_key("http://B.example.com/x?y#z") == "com,example,b)/x?y"


@pytest.mark.parametrize("sizes", [[], [0], [3], [2, 0, 5], [1] * 7, [4, 4, 1, 9, 2]])
def test_loser_tree_merges_runs(sizes):
    rng = np.random.default_rng(sum(sizes))
    runs = [sorted(rng.integers(0, 20, n).tolist()) for n in sizes]
    assert list(op8.loser_tree(runs, key=lambda x: x)) == sorted(x for r in runs for x in r)


# pages

def test_blocks_follow_markup():
    page = ("<html><head><title>t</title></head><body><p>a &amp; b<b>c</b>\n d<p>x<br>y<script>'</p>'</script><!-- n --><ul><li>1<li>2</ul>"
            "&lt;p&gt; 5 < 6<div title='a>b'>z&am</div>tail<a href='")
    assert [b[0] for b in op9.blocks(page)] == ["a & bc d", "x y", "1", "2", "<p> 5 < 6", "z&am", "tail"]
    assert op9.blocks("") == [] and op9.blocks("<") == [("<", (), 0)] and op9.blocks("<script>x") == []


def test_gradients_are_right():
    rng = np.random.default_rng(2)
    net = op9.Network(width=5, hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, sizes = rng.standard_normal((2, 4, 5)), np.array([4, 3])
    x[1, 3] = 0
    y = rng.integers(0, 2, (2, 4)).astype(float)
    real = np.arange(4)[None] < sizes[:, None]
    loss = lambda: -(np.where(real, y * np.log(p := net.forward(x, sizes)) + (1 - y) * np.log(1 - p), 0)).sum()
    keep, grad = {}, {}
    dz = np.where(real, net.forward(x, sizes, keep) - y, 0)[:, :, None]
    dboth = dz @ net.p["ox"].T
    net._back("f", x, keep["f"], dboth[:, :, :3], grad)
    net._back("b", keep["back"], keep["b"], np.take_along_axis(dboth[:, :, 3:], keep["turn"], 1), grad)
    for name in ("fx", "fh", "fb", "bx", "bh", "bb"):
        flat, g = net.p[name].reshape(-1), grad[name].reshape(-1)
        for k in range(0, flat.size, max(1, flat.size // 5)):
            flat[k] += 1e-5
            up = loss()
            flat[k] -= 2e-5
            down = loss()
            flat[k] += 1e-5
            assert abs((up - down) / 2e-5 - g[k]) < 1e-3


def test_pages_keep_the_article(spark, small):
    given = spark.read.parquet(f"{small}/pages.parquet")
    net = op9.fit(given)
    rng, wrong, seen = np.random.default_rng(31), 0, 0
    for _ in range(150):
        page, labels = op9.made_up(["One line of words, and more of them.", "Another text that is a little longer than the first one."], rng)
        found = op9.blocks(page)
        if found and len(found) == len(labels):
            wrong += ((net.main([op9.vectors(found)])[0] >= 0.5) != (np.array(labels) == 1)).sum()
            seen += len(labels)
    assert wrong < 0.05 * seen
    html = [r.html for r in given.collect()]
    out = {r.page_id: r for r in op9.extract(given, net).collect()}
    for r in given.collect():
        want = [b[0] for b in op9.blocks(r.html) if "article" in b[1]]
        assert out[r.page_id]["text"] == "\n".join(want) and out[r.page_id]["n_chars"] == len("\n".join(want))
    odd = pages(spark, [(1, "u", None), (2, None, ""), (3, "u", html[0]), (3, "u", html[0]), (None, "u", "<nav>x</nav>")])
    got = op9.extract(odd, net).collect()
    assert len(got) == 5 and sorted(r.n_chars for r in got)[:3] == [0, 0, 0]
    assert op9.extract(pages(spark, []), op9.train([], layouts=20, epochs=1)).count() == 0


# pipeline

def test_pipeline_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, small).cache()
        assert docs.columns == before.columns and 0.5 * before.count() < docs.count() <= before.count(), name
    assert docs.select("doc_id").distinct().count() == docs.count()
    out = corpus_pipeline.run(spark, small)
    assert out.select("doc_id").distinct().count() == docs.count()


def test_pipeline_of_odd_rows(spark, odd, none, small):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, small).count() == 0, name
    out = corpus_pipeline.STAGES[2][1](spark, odd, small)
    assert out.count() == 7


def five_words(text):
    words = (text or "").lower().split()
    return {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return not (a | b) or len(a & b) / len(a | b) >= 0.8


def near_copies():
    """Texts of 120 words, copies of them with one to six words changed, and a crowd of copies whose links are chains."""
    rng = np.random.default_rng(8)
    texts = []
    for k in range(60):
        words = [f"w{x}" for x in rng.integers(0, 900, 120)]
        for changed in range(5):
            copy = list(words)
            for at in rng.choice(120, changed, replace=False):
                copy[at] = f"x{rng.integers(900)}"
            texts.append(" ".join(copy))
    words = [f"c{k}" for k in range(120)]
    for k in range(90):
        copy = list(words)
        for at in rng.choice(120, 2, replace=False):
            copy[at] = f"y{rng.integers(900)}"
        texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("crowd", [op1.CROWD, 20])  # 20: the crowd's buckets are cut into blocks
def test_stage_links_every_verified_pair(spark, small, crowd):
    texts = near_copies()
    docs = make_docs(spark, list(enumerate(texts))).repartition(3)
    sets = [five_words(t) for t in texts]
    want = roots(len(texts), [(a, b) for a in range(len(texts)) for b in range(a) if alike(sets[a], sets[b])])
    got = {r.id: r.first_id for r in op1.grouped(docs, crowd=crowd).collect()}
    assert [got[k] for k in range(len(texts))] == want
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, small)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


@pytest.mark.parametrize("one_per_group", [op1.one_per_group, op7.one_per_group])
def test_groups_keep_rows_not_ids(spark, one_per_group):
    """Of an id with two texts only the one that joins a group goes; two texts alone both stay; repeated rows are one."""
    texts = [" ".join(f"{x}{k}" for k in range(60)) for x in "abcd"]
    rows = [(1, texts[0]), (5, texts[0]), (5, texts[1]), (7, texts[2]), (7, texts[3]), (7, texts[3])]
    kept = one_per_group(make_docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, texts[0]), (5, texts[1]), (7, texts[2]), (7, texts[3])]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, small, name):
    got = queries.QUERIES[name](spark, small).toPandas()
    assert check_oracle.compare(got, check_oracle.connect(small).execute(queries.SQL[name]).df()) == ""
