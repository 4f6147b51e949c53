"""The pipeline over documents with planted cases, held against a plain computation of every stage."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rememora.llm import op02_toxicity as op2, op10_langid as op10

SOURCE = "/root/testdata/sf0.01"
EXACT, NEAR, FOREIGN, TOXIC, CLEAN, SPOKEN = range(900_001, 900_007)


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def one_of_each(texts):
    """Smallest id of each group of texts linked by a Jaccard of 0.8; ``texts`` by id."""
    sets = {i: shingles(t) for i, t in texts.items()}
    held = defaultdict(list)
    for i, s in sets.items():
        for x in s or {()}:
            held[x].append(i)
    parent = {i: i for i in texts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    shared = defaultdict(int)
    for ids in held.values():
        for a in ids:
            for b in ids:
                if a < b:
                    shared[a, b] += 1
    for (a, b), both in shared.items():
        union = len(sets[a] | sets[b])
        if not union or len(sets[a] & sets[b]) / union >= 0.8:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {find(i) for i in texts}


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("planted"))
    docs, labels = spark.read.parquet(f"{SOURCE}/documents.parquet"), spark.read.parquet(f"{SOURCE}/labels.parquet")
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    rows = docs.collect()
    rng = random.Random(4)
    clean = [r for r in rows if toxic.get(r.doc_id) == 0 and 80 <= len((r.text or "").split()) <= 400 and r.lang]
    bad = next(r for r in rows if toxic.get(r.doc_id) == 1 and len((r.text or "").split()) >= 40)
    a, b, c, d = clean[:4]

    def shuffled(text):
        words = text.split()
        rng.shuffle(words)
        return " ".join(words)

    near = b.text.split()
    near[len(near) // 2] = "changed"
    spoken = " ".join(x[:-1] + "$$" if k % 9 == 4 and x.isalpha() else x for k, x in enumerate(shuffled(d.text).split()))
    texts = {EXACT: a.text, NEAR: " ".join(near), FOREIGN: " ".join(["собака", "бежит", "быстро", "по", "дороге", "домой"] * 12),
             TOXIC: shuffled(bad.text), CLEAN: shuffled(c.text), SPOKEN: spoken}
    added = spark.createDataFrame([(i, t, None, "planted", len(t)) for i, t in texts.items()], docs.schema)
    docs.unionByName(added).repartition(5).write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return folder, (a.doc_id, b.doc_id)


def test_planted_cases_meet_their_fate(spark, planted):
    folder, (a, b) = planted
    kept = {r.doc_id for r in corpus_pipeline.run(spark, folder).select("doc_id").distinct().collect()}
    assert {a, b, CLEAN, SPOKEN} <= kept and not kept & {EXACT, NEAR, FOREIGN, TOXIC}
    # the same stages, one row at a time where they decide by row, pair by pair where they decide by pairs
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scorer = op2.learn(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    calm = {i: t for i, t in texts.items() if scorer.scores([t or ""])[0] < op2.THRESHOLD}
    model = op10.learn(docs.where(F.col("doc_id").isin([*calm])).where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    known = {}
    for i, t in calm.items():
        names, _, share = op10.judge(model, [t or ""])
        if t is not None and names[0] != op10.UNKNOWN and share[0] >= op10.COVERED:
            known[i] = t
    assert kept == one_of_each(known)
    wrong = [r.doc_id for r in labels.collect() if r.doc_id in texts and r.toxic == 0 and r.doc_id not in calm]
    assert len(wrong) <= 0.02 * len(texts)
