"""Language identification: a bit-sliced Bloom filter from n-grams to the set of languages that hold them.

Training counts the character n-grams (three and four characters of a lower-cased word with its
edges) of every labelled text per language. An n-gram belongs to a language if it makes up at least
``share`` of the language's n-grams and at least ``relative`` of its largest share in any language;
the first bound limits the kept n-grams of a language to ``1 / share``. Every slot of the filter is a
bitmask over languages, so one lookup answers for all. A text's language is the one with most of its
n-grams, each count corrected for the language's rate of false positives.

Nulls and odd input: null texts and texts without a letter are ``und`` with score 0; a text with
letters but no usable evidence gets the language with most training n-grams, score 0. Rows with a null
language or text teach nothing; without any teaching row all is ``und``. Equal rows are predicted
each; an empty table gives no rows. Whole texts count.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from rememora.llm.bytewords import mix
from rememora.llm.common import filled, fold, held_out, slices, table, type_of

SHARE = 1e-5
RELATIVE = 0.1
SLOTS = 1 << 20
HASHES = 3
COVERED = 0.1
UNKNOWN = "und"


@functools.lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code and text number of every n-gram, and whether each text has a letter."""
    low = [t.lower() for t in texts]
    code = np.frombuffer("\0".join(["", *low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    # a text owns its characters and the separator behind them; the first separator goes with the first text
    doc = np.repeat(np.arange(len(low)), [len(t) + 1 + (k == 0) for k, t in enumerate(low)])
    some = np.zeros(len(texts), bool)
    some[doc[letter]] = True
    c = np.where(letter, code, 0).astype(np.uint64)
    codes, owners = [], []
    for n in (3, 4):
        if len(c) < n:
            continue
        last = len(c) - n + 1
        inner = letter[1:1 + last].copy()
        for k in range(2, n - 1):
            inner &= letter[k:k + last]
        at = np.flatnonzero(inner)
        value = np.full(len(at), n, np.uint64)
        for k in range(n):
            value = value * np.uint64(0x110001) + c[at + k]
        codes.append(value)
        owners.append(doc[at + 1])
    if not codes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), some
    return mix(np.concatenate(codes)), np.concatenate(owners), some


def count_ngrams(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """``(lang, gram, n)`` over all rows with a text and a language; counts are merged per task before the shuffle."""
    def run(batches):
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def merged(lang, codes, n):
            before = total.get(lang)
            if before is not None:
                codes, n = np.concatenate([before[0], codes]), np.concatenate([before[1], n])
            codes, where = np.unique(codes, return_inverse=True)
            total[lang] = codes, np.bincount(where, n).astype(np.int64)

        def out():
            for lang, (codes, n) in total.items():
                for begin in range(0, len(codes), 50_000):
                    part = codes[begin:begin + 50_000].view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(part), pa.string()), pa.array(part), pa.array(n[begin:begin + 50_000])], ["lang", "gram", "n"])

        for batch in batches:
            for part in slices(batch, text_col):
                texts, langs = part.column(text_col).to_pylist(), part.column(lang_col).to_pylist()
                for lang in set(langs):
                    codes, _, _ = ngrams([t for t, x in zip(texts, langs) if x == lang])
                    codes, n = np.unique(codes, return_counts=True)
                    merged(lang, codes, n)
            if sum(len(c) for c, _ in total.values()) > 2_000_000:
                yield from out()
                total.clear()
        yield from out()

    rows = df.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(text_col, lang_col)
    return rows.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Filter:
    """Slots of language bits. ``words`` has one 64-bit column per 64 languages (or one narrow column)."""

    def __init__(self, langs: list[str], grams: list[np.ndarray], slots: int = SLOTS, hashes: int = HASHES, default: int = 0):
        self.langs, self.hashes, self.default = langs, hashes, default
        need = max(sum(len(g) for g in grams), 1)
        self.mask = max(slots, 1 << int(np.ceil(np.log2(8 * need)))) - 1
        kind = np.uint8 if len(langs) <= 8 else np.uint64
        self.width = 8 * np.dtype(kind).itemsize
        self.words = np.zeros((-(-max(len(langs), 1) // self.width), self.mask + 1), kind)
        for l, g in enumerate(grams):
            for k in range(hashes):
                self.words[l // self.width][self._slot(g, k)] |= kind(1 << l % self.width)
        self.false = np.array([self._bit(self.words[l // self.width], l).mean() ** hashes for l in range(len(langs))])

    def _slot(self, grams: np.ndarray, k: int) -> np.ndarray:
        return ((grams >> np.uint64(21 * k)) & np.uint64(self.mask)).astype(np.int64)

    def _bit(self, words: np.ndarray, l: int) -> np.ndarray:
        return (words >> words.dtype.type(l % self.width)) & words.dtype.type(1)

    def counts(self, grams: np.ndarray, doc: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """Corrected n-grams per text and language, and n-grams per text."""
        n = np.bincount(doc, minlength=texts).astype(float)
        out = np.zeros((texts, len(self.langs)))
        slots = [self._slot(grams, k) for k in range(self.hashes)]
        for w in range(len(self.words)):
            held = self.words[w][slots[0]]
            for s in slots[1:]:
                held &= self.words[w][s]
            for l in range(w * self.width, min(len(self.langs), (w + 1) * self.width)):
                hits = np.bincount(doc[self._bit(held, l).astype(bool)], minlength=texts)
                out[:, l] = (hits - n * self.false[l]) / (1 - self.false[l])
        return np.maximum(out, 0), n


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang", share: float = SHARE, relative: float = RELATIVE) -> Filter:
    """The filter of all rows given; at most ``1 / share`` n-grams per language reach the driver."""
    from rememora.session import settle

    counted = settle(count_ngrams(df, text_col, lang_col), "ngrams")
    total = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    rated = counted.join(total, "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("rate")).where(F.col("rate") >= share)
    best = rated.groupBy("gram").agg(F.max("rate").alias("best"))
    kept = rated.join(best, "gram").where(F.col("rate") >= relative * F.col("best")).select("lang", "gram").toPandas()
    totals = {r["lang"]: r["total"] for r in total.collect()}
    langs = sorted(totals)
    grams = [kept.gram[kept.lang == x].to_numpy(np.int64).view(np.uint64) for x in langs]
    return Filter(langs, grams, default=max(range(len(langs)), key=lambda l: totals[langs[l]]) if langs else 0)


def judge(model: Filter, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and covered part of each text."""
    grams, doc, some = ngrams(texts)
    counts, n = model.counts(grams, doc, len(texts))
    if not model.langs:
        some[:] = False
        counts = np.zeros((len(texts), 1))
    best = np.where(counts.max(axis=1) > 0, counts.argmax(axis=1), model.default)
    top = counts[np.arange(len(texts)), best]
    score = np.where(some, top / np.maximum(counts.sum(axis=1), 1e-9), 0.0)
    covered = np.where(some, np.minimum(top / np.maximum(n, 1), 1.0), 0.0)
    return [model.langs[b] if s else UNKNOWN for b, s in zip(best, some)], np.clip(score, 0, 1), covered


def predict(df: DataFrame, model: Filter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score, covered)``: score is the language's part of all evidence, covered its part of the n-grams."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                names, score, covered = judge(model, filled(part, text_col).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(names, pa.string()), pa.array(score), pa.array(covered)],
                                                 [id_col, "lang_pred", "score", "covered"])

    return df.select(id_col, text_col).mapInArrow(
        run, f"{id_col} {type_of(df, id_col)}, lang_pred string, score double, covered double")


def in_known_language(df: DataFrame, model: Filter, text_col: str = "text", covered: float = COVERED) -> DataFrame:
    """The rows whose language holds at least ``covered`` of their n-grams, with all their columns; ``und`` rows go."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                names, _, share = judge(model, filled(part, text_col).to_pylist())
                kept = part.filter(pa.array([x != UNKNOWN and s >= covered for x, s in zip(names, share.tolist())], pa.bool_()))
                if kept.num_rows:
                    yield kept

    return df.mapInArrow(run, df.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(fold(F.col("doc_id")) != 2))
    out = predict(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
