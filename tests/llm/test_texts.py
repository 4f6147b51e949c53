"""Fingerprints, toxicity, BPE, licenses and language ID against brute force and on odd rows."""

import hashlib
import re

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from rememora.llm import op01_fingerprint as op1, op02_toxicity as op2, op05_bpe as op5, op06_licenses as op6, op10_langid as op10
from rememora.llm.common import fold
from pyspark.sql import functions as F

from .conftest import make_docs, sentence


def as_text(x):
    return x or ""


# fingerprints

def shingle_sets(text):
    words = text.translate({c: c + 32 for c in range(65, 91)}).encode().split()
    return {tuple(words[k:k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def test_edited_texts_follow_the_next_document(spark, odd, odd_rows):
    got = op1.compared_with_next(odd).toPandas()
    rows = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, as_text(r[1])))
    want = []
    for k, (i, t) in enumerate(rows):
        t, nxt = as_text(t), as_text(rows[(k + 1) % len(rows)][1])
        half = len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[:len(t) - half] + nxt[:half]).encode()).hexdigest()))
    have = [(None if pd.isna(a) else int(a), b, c) for a, b, c in zip(got.doc_id, got.n_chars, got.edited_sha256)]
    assert sorted(have, key=str) == sorted(want, key=str)
    assert got.fingerprint[got.doc_id.isin([4, 5])].nunique() == 1
    assert got.near_edited.between(0, 1).all() and got.near_next.between(0, 1).all()


def test_likeness_is_near_jaccard():
    texts = [sentence(300, 1), sentence(150, 1) + " " + sentence(150, 7).replace("the", "qux"), "", "  "]
    sig, some = op1.signatures(pa.array(texts))
    a, b = shingle_sets(texts[0]), shingle_sets(texts[1])
    assert abs(op1.likeness(sig[:1], sig[1:2], some[:1], some[1:2])[0] - len(a & b) / len(a | b)) < 0.15
    assert op1.likeness(sig[2:3], sig[3:4], some[2:3], some[3:4])[0] == 1
    assert op1.likeness(sig[:1], sig[3:4], some[:1], some[3:4])[0] == 0


def test_banded_classes(spark, none):
    long = [f"w{k}" for k in range(400)]
    near = " ".join(["changed", *long[1:]])
    rows = [(1, " ".join(long)), (2, near), (3, " ".join(long)), (4, " ".join(reversed(long))), (5, None), (6, "")]
    got = {r[0]: r[1] for r in op1.near_duplicates(make_docs(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5}
    assert op1.near_duplicates(none).count() == 0 and op1.compared_with_next(none).count() == 0


# BPE

def tiktoken_encoding():
    import base64

    import tiktoken

    with open(public_tokenizers.path(op5.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_public_library(spark, odd, odd_rows, none):
    enc = tiktoken_encoding()
    got = op5.round_trip(odd, public_tokenizers.path(op5.VOCABULARY), public_tokenizers.PATTERN).toPandas()
    have = sorted(zip(got.n_tokens, got.ids_sha256, got.decoded_sha256))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ids = [enc.encode_ordinary(as_text(t)) for _, t in odd_rows]
    assert have == sorted((len(i), sha(" ".join(map(str, i)).encode()), sha(as_text(t).encode())) for i, (_, t) in zip(ids, odd_rows))
    args = (public_tokenizers.path(op5.VOCABULARY), public_tokenizers.PATTERN)
    assert op5.round_trip(none, *args).count() == 0
    back = op5.decode(op5.encode(odd, *args), *args).toPandas()
    assert sorted(bytes(b) for b in back.bytes) == sorted(as_text(t).encode() for _, t in odd_rows)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aeéßtTx 's\n\t.!9 ​一")), max_size=40))
def test_bpe_on_any_text(text):
    codec = op5.codec(public_tokenizers.path(op5.VOCABULARY), public_tokenizers.PATTERN)
    n, ids, raw = codec.encode([text])[0]
    assert ids.split() == [str(i) for i in tiktoken_encoding_cached().encode_ordinary(text)] and n == len(ids.split()) and raw == text.encode()


_kept = []


def tiktoken_encoding_cached():
    if not _kept:
        _kept.append(tiktoken_encoding())
    return _kept[0]


# licenses

def brute_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))
    return len(words), sorted((i, label) for p, label in op6.PHRASES.items() for q in [p.split()]
                              for i in range(len(words) - len(q) + 1) if words[i:i + len(q)] == q)


def test_phrases_and_spans(spark, none):
    header = ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
              "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0")
    rows = [(1, None), (2, ""), (3, "Under the MIT license, under the mit license. CC-BY-NC"), (4, header), (5, sentence(40) + " " + header),
            (6, "under the mit the license cc by by nc"), (7, "permission is hereby granted to any person obtaining a copy"), (8, "ÄUnder the MIT License")]
    got = {r["doc_id"]: r for r in op6.scan(make_docs(spark, rows)).collect()}
    for i, text in rows:
        n, places = brute_places(as_text(text))
        assert got[i]["n_words"] == n and sorted((p["word"], p["label"]) for p in got[i]["places"]) == places
    assert [s["label"] for s in got[4]["spans"]] == ["apache-2"] and got[5]["spans"][0]["first"] == 40
    assert not got[3]["spans"] and not got[7]["spans"] and got[8]["n_words"] == 4
    assert op6.scan(none).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("under the mit license apache version 2 cc by nc of".split()), max_size=30))
def test_automaton_finds_every_phrase(words):
    scanner = op6._scanner((tuple(op6.PHRASES.items()), tuple(op6.TEMPLATES.items()), op6.MIN_MATCH, op6.MAX_GAP, op6.COVERAGE))
    count, places, _ = scanner.scan(pa.array([" ".join(words), "x"]))
    assert (count[0], sorted(places[0])) == brute_places(" ".join(words))


def test_matching_statistics_are_the_longest_matches():
    texts = [[1, 2, 3, 1, 2], [2, 3, 4]]
    a = op6.Automaton(texts)
    subs = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    stream = [1, 2, 3, 4, 2, 3, 1, 2, 5, 2, 3, 4]
    state = length = 0
    for k, w in enumerate(stream):
        while state and w not in a.next[state]:
            state = a.link[state]
            length = a.length[state]
        if w in a.next[state]:
            state, length = a.next[state][w], length + 1
        assert length == max((n for n in range(k + 2) if n == 0 or tuple(stream[k + 1 - n:k + 1]) in subs))
        for t, end in a.places[state]:
            assert texts[t][end + 1 - length:end + 1] == stream[k + 1 - length:k + 1]


# toxicity

def labelled(spark):
    rows, labels = [], []
    for k in range(400):
        bad = k % 5 == 0
        rows.append((k, sentence(40 + k % 7, k) + ((" you vilewretch", " and zorkface")[k // 5 % 2] if bad else "")))
        labels.append((k, 1, int(bad)))
    return make_docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_disguised_words_are_restored_and_scored(spark, odd, none):
    docs, labels = labelled(spark)
    scorer = op2.learn(docs, labels)
    for odd_word in ("v1lewretch", "v i l e w r e t c h", "viiiilewretch", "vilewr3tch", "v.i.l.e.w.r.e.t.c.h"):
        assert scorer.decoder.decode(odd_word).replace(" ", "") == "vilewretch", odd_word
    texts = [sentence(50, 3), sentence(50, 3) + " v1lewretch", sentence(50, 3) + " z0rkfaaaace", ""]
    s = scorer.scores(texts)
    assert s[0] < 0.3 and s[1] >= 0.3 and s[2] >= 0.3 and s[3] < 0.3
    out = op2.score(odd, scorer).toPandas()
    assert len(out) == 11 and out.score.between(0, 1).all()
    assert op2.score(none, scorer).count() == 0
    kept = op2.clean(make_docs(spark, [(1, texts[0]), (2, texts[1]), (3, None)]), scorer)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3] and kept.columns == docs.columns
    chunks = op2.restore(make_docs(spark, [(1, texts[1])]), scorer).first()["chunks"]
    assert [(c["chunk"], c["restored"]) for c in chunks] == [("v1lewretch", "vilewretch")]


def test_held_out_labels_teach_nothing(spark):
    docs, labels = labelled(spark)
    flipped = labels.withColumn("toxic", F.when(fold(F.col("doc_id")) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (op2.score(docs, op2.learn(docs, x)).toPandas().sort_values("doc_id").score.to_numpy() for x in (labels, flipped))
    assert np.allclose(a, b)
    nothing = op2.learn(docs, labels.where("toxic = 0"))
    assert set(nothing.scores(["x", ""])) == {0.0}


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    d = op2.Decoder(rng.dirichlet(np.ones(op2.LETTERS), (op2.LETTERS, op2.LETTERS)))
    import itertools

    def total(choice):
        seq, cost = [0, 0], 0.0
        for char, c in choice:
            cost += c
            if char:
                k = op2._class_of(char)
                cost += d.log[(seq[-2] * op2.LETTERS + seq[-1]) * op2.LETTERS + k]
                seq.append(k)
        return cost + d.log[(seq[-2] * op2.LETTERS + seq[-1]) * op2.LETTERS]

    for chunk in ("1d1ot", "a-b.c", "xaaay", "|1l!", "s t u"):
        best = max(itertools.product(*d.options(chunk)), key=total)
        assert d.decode(chunk) == "".join(c for c, _ in best)


# language

def test_languages(spark, small, odd, none):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = op10.learn(docs.where(fold(F.col("doc_id")) != 2))
    out = op10.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(fold(F.col("doc_id")) == 2).toPandas()
    assert (out.lang == out.lang_pred).mean() > 0.9
    got = op10.predict(odd, model).toPandas()
    by = {None if pd.isna(i) else int(i): x for i, x in zip(got.doc_id, got.lang_pred)}
    assert {k for k, v in by.items() if v == "und"} == {1, 2, 3, 9} and by[8] in model.langs
    assert got.score.between(0, 1).all()
    assert op10.predict(none, model).count() == 0
    assert {r.doc_id for r in op10.in_known_language(odd, model).collect()} >= {4, 5, 6}
    untaught = op10.learn(none)
    assert {r.lang_pred for r in op10.predict(odd, untaught).collect()} == {"und"}


def test_filter_holds_its_ngrams():
    rng = np.random.default_rng(4)
    sets = [rng.integers(0, 1 << 62, 3_000).astype(np.uint64) for _ in range(11)]
    model = op10.Filter([f"l{k}" for k in range(11)], sets)
    for k, s in enumerate(sets):
        counts, n = model.counts(s, np.zeros(len(s), np.int64), 1)
        assert round(counts[0, k]) == len(s) == n[0] and counts[0].argsort()[-2] != k and np.sort(counts[0])[-2] < 50


def test_ngrams_know_their_text():
    grams, doc, some = op10.ngrams(["ab", "", "x\0y", "ab", "1"])
    assert some.tolist() == [True, False, True, True, False]
    assert sorted(grams[doc == 0].tolist()) == sorted(grams[doc == 3].tolist()) and not (doc == 1).any()
