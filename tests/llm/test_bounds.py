"""Findings that once slipped: cuts beside white space, look-alike endings, elements kept, rounds that end early, caches and samples."""

import gc
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from rememora.llm import bytewords, common, op01_fingerprint as op1, op02_toxicity as op2, op03_packing as op3, op05_bpe as op5, op09_html as op9

from .conftest import make_docs, sentence
from .test_texts import tiktoken_encoding_cached

CODEC = (public_tokenizers.path(op5.VOCABULARY), public_tokenizers.PATTERN)
SPACES = "  　​ \x1c\x85\t\n\r "


@pytest.mark.parametrize("text", ["x    ", "\n \n", "\t \t", " a 　 b", "a  b  ", "  ", "  ", "x  y \n z ", "a \x1c b \x85 c"])
def test_bpe_beside_white_space(text):
    n, ids, raw = op5.codec(*CODEC).encode([text])[0]
    assert ids.split() == [str(i) for i in tiktoken_encoding_cached().encode_ordinary(text)] and raw == text.encode() and n == len(ids.split())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aZé1'.s" + SPACES)), max_size=30))
def test_bpe_on_any_white_space(text):
    assert op5.codec(*CODEC).encode([text])[0][1].split() == [str(i) for i in tiktoken_encoding_cached().encode_ordinary(text)]


def test_bpe_cache_is_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(op5, "_CACHE_BYTES", 20_000)
    codec = op5.Codec(*CODEC)
    for k in range(30):
        codec.encode([" ".join(f"w{k}x{j}" for j in range(60))])
        assert codec.held <= 20_000 + 60 * 400 and codec.held == sum(map(codec.weight, codec.ids_of))
    codec.forget()
    assert codec.held == 0 and not codec.ids_of and not codec.bytes_of


def test_caches_go_when_another_operator_begins():
    gone = []
    with common.no_cycles("a", lambda: gone.append("a")):
        assert not gc.isenabled()
    assert gc.isenabled() and gone == []
    with common.no_cycles("a", lambda: gone.append("a")):
        pass
    assert gone == []
    with common.no_cycles():
        pass
    assert gone == ["a"]


def scorer(words):
    evidence = {"=" + w: 4.0 for w in words}
    counts = np.ones((op2.LETTERS,) * 3)
    mixed = 0.5 * op2.probabilities(counts) + 0.5 * op2.probabilities(counts * 1e-3 + 50 * op2.lexicon_counts(dict.fromkeys(words, 4.0)))
    return op2.Scorer(evidence, op2.Decoder(mixed))


@pytest.mark.parametrize("token", ["a$$", "@$$", "sh!+", "$h!t", "b@d", "a$$$$", "n00b", "n0000b", "(n00b)", "a$$!"])
def test_disguised_words_are_restored(token):
    assert scorer(["ass", "shit", "bad", "noob"]).token(token) > 2


@pytest.mark.parametrize("token", ["as", "$$", "99", "wow!", "12.50", "shirt", "(see", "!!!", "100$"])
def test_clean_chunks_are_left_alone(token):
    assert scorer(["ass", "shit", "bad", "noob"]).token(token) == 0


def test_chunks_without_letters_count_half():
    assert scorer(["ass"]).token("455") == 2.0


def test_samples_do_not_vanish(spark):
    rows = spark.range(4000).select(F.col("id"))
    for total in (4000, 10 ** 12):  # as if these were a part of that many rows
        wanted = 1000 * total // 4000
        n = common.drawn_share(rows, F.xxhash64("id"), wanted, total).count()
        assert 850 < n < 1150
    assert common.drawn_share(rows, F.xxhash64("id"), 20_000, 4000).count() == 4000
    assert common.drawn_share(rows, F.xxhash64("id"), 20_000, 10 ** 15).count() <= 4


@pytest.mark.parametrize("page, want", [
    ("<article><p>one</p><svg><g><p>two</p><p>three</p></article>", ["one", "two", "three"]),
    ("<p>a <math><mi>x</mi><mo>=</mo><mn>2</mn></math> b</p>", ["a x=2 b"]),
    ("<p>a <svg><path d='m'/><text>t</text></svg> b</p><p>c", ["a t b", "c"]),
    ("<article>x<svg><text>y</article>after", ["xy", "after"]),
    ("<noscript><p>n</p></noscript><object><p>o</p></object>", ["n", "o"]),
    ("<p>a<select><option>1<option>2</select>b", ["ab"]),
    ("<p>a<iframe src=x><p>b", ["a", "b"]),
    ("<p>a<iframe>zz</iframe> b", ["a b"]),
    ("<div>a<select><option>q</div><p>b", ["a", "b"]),
    ("<template><p>q</p></template><p>b", ["b"]),
    ("<p>a<script>if (x < 1) '<p>'</script>b<style>p{}</style>", ["ab"]),
    ("<svg><foreignObject><p>in</p><p>side</p></foreignObject></svg>", ["in", "side"])])
def test_elements_that_stay(page, want):
    assert [b[0] for b in op9.blocks(page)] == want


HAND_WRITTEN = [
    ("<html><head><title>T</title></head><body><nav><a href='/'>Home</a> <a href='/b'>Blog</a></nav><article><h1>A walk</h1>"
     "<p>The river was high, and the bridge had gone.</p><p>We turned back at dusk; nobody spoke much.</p></article>"
     "<footer>All rights reserved</footer></body></html>",
     "A walk\nThe river was high, and the bridge had gone.\nWe turned back at dusk; nobody spoke much."),
    ("<body><header><a href=x>Menu</a></header><main><p>First &amp; last words of a longer text, with commas.</p>"
     "<ul><li>one thing that matters here</li></ul></main><aside><h3>Related</h3><a href=y>Other</a></aside></body>",
     "First & last words of a longer text, with commas.\none thing that matters here"),
    ("<body><nav><a href='/'>Home</a></nav><footer>Imprint</footer></body>", "")]


def test_pages_against_hand_written_texts(spark, small):
    pages = spark.createDataFrame([(k, "u", html) for k, (html, _) in enumerate(HAND_WRITTEN)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in op9.extract(pages, op9.fit(spark.read.parquet(f"{small}/pages.parquet"))).collect()}
    assert [got[k] for k in range(len(HAND_WRITTEN))] == [want for _, want in HAND_WRITTEN]


def test_packing_ends_when_no_two_bins_fit(spark):
    """Bins of 60 of 100 never pair; light ones lie in other groups and find them in later rounds."""
    path = public_tokenizers.path(op3.TOKENIZER)
    heavy = [" ".join(["the"] * 59)] * 90
    light = [" ".join(["the"] * 29)] * 12
    out = op3.pack(make_docs(spark, list(enumerate(heavy + light))).repartition(6), path, capacity=100, slack=2, group_rows=20).toPandas()
    fill = out.groupby("sequence_id").length.sum()
    assert fill.max() <= 100 and len(fill) == 90 and out.length.sum() == 90 * 60 + 12 * 30


def test_hashes_do_not_depend_on_windows(monkeypatch):
    rng = np.random.default_rng(2)
    data = rng.integers(97, 123, 5000).astype(np.uint8)
    data[rng.random(5000) < 0.1] = 32
    data[1000:1400] = 97
    at = bytewords.spans(data, np.array([0, 5000]), ~bytewords.SPACE)[:2]
    want = bytewords.hashes(data, *at)
    for window in (8, 100, 512):
        monkeypatch.setattr(bytewords, "WINDOW", window)
        bytewords._powers.cache_clear()
        assert (bytewords.hashes(data, *at) == want).all()
    monkeypatch.undo()
    bytewords._powers.cache_clear()


def test_a_long_text_needs_few_times_its_size():
    import tracemalloc

    text = pa.array([("lorem ipsum dolor sit " * 400_000)[:8_000_000]])
    bytewords._powers()
    tracemalloc.start()
    op1.signatures(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25 * 8_000_000


def test_clashing_names_survive_a_group(spark, small):
    docs = make_docs(spark, [(1, sentence(50)), (2, sentence(50)), (3, sentence(50, 9))]).withColumn("_id", F.lit("mine")).withColumn("_key", F.lit("too"))
    kept = op1.one_per_group(docs.withColumn("_row", F.lit("three"))).collect()
    assert sorted((r.doc_id, r._id, r._key, r._row) for r in kept) == [(1, "mine", "too", "three"), (3, "mine", "too", "three")]


ODD_WORDS = ["Alpha", "BETA.", "beta,", "alpha$$$", "<|ENDOFTEXT|>", "<|endoftext|>", "x<|EndOfText|>", "H\u0331", "h\u0331", "I\u0307", "i\u0307", "T\u0331A.",
             "\u00c9t\u00c9,", "\u0130", "don't", "DON'T", "it'S.", "a_b", "A__", "w0rd", "42", "\u03a3\u0391\u03a3", "\u00bbAlpha\u00ab.", "...", "\u00adA", "\x00B", "\u2126", "\u212a", "\u1e9e"]


def test_encoded_texts_are_what_the_tokenizer_gives():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(op3.TOKENIZER)
    plain = Tokenizer.from_file(path)
    rng = random.Random(7)
    texts = ["", *ODD_WORDS, *(" ".join(rng.choices(ODD_WORDS, k=9)) for _ in range(300))]
    for _ in range(2):  # the second time from the cache
        got = op3.encode_texts([t.encode() for t in texts], path)
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_known_word_is_not_encoded_again(monkeypatch):
    """Capitals and punctuation behind a word that the cache holds give no work for the tokenizer but the punctuation's."""
    path = public_tokenizers.path(op3.TOKENIZER)
    asked = []

    class Spy:
        def __init__(self, real):
            self.real, self.model = real, self

        def encode_batch_fast(self, lines, **options):
            asked.extend(lines)
            return self.real.encode_batch_fast(lines, **options)

        def tokenize(self, word):
            asked.append(word)
            return self.real.model.tokenize(word)

    monkeypatch.setattr(op3, "_encoder", None)
    op3._loaded(path)
    monkeypatch.setattr(op3, "_encoder", (path, Spy(op3._encoder[1]), *op3._encoder[2:]))
    first = op3.encode_texts([b"zymurgy quokka"], path)
    assert any("zymurgy" in a for a in asked)
    asked.clear()
    assert op3.encode_texts([b"Zymurgy QUOKKA"], path) == first
    assert op3.encode_texts([b"Zymurgy, quokka;"], path)[0][:4] == first[0][:4]
    assert not [a for a in asked if any(c.isalpha() for c in a)]
