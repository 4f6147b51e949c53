"""Toxicity: disguised words are restored by a noisy-channel Viterbi decoder, then texts are scored.

A character model (trigrams of letters and word edges) is counted over all texts. A disguised chunk -
letters mixed with look-alike signs, letters apart, letters repeated three times and more - is a
lattice: a sign may stand for letters or for an edge, a separator or a repeated letter or sign may vanish.
The decoder takes the most probable reading under the character model, mixed with one of the learned
toxic words. Texts are scored by their restored words: words and word beginnings that mark toxic
training texts give evidence, and a logistic model over the strongest evidence gives the score. Marks at
the end of a chunk are punctuation as a rule; a chunk is also read with its look-alikes there as letters,
one without any letter as letters, and either without all its marks; such a reading counts only if it is
a whole learned word, and half if the chunk is a number.

Labels are learned from training rows only: a sample of about ``max_rows`` labelled rows drawn by hash
bounds the word statistics and the fit (the character model counts all texts). A label table without
both classes in the training rows gives the training share of toxic rows as every score (0 without any).

Nulls and odd input: null texts count as empty; an empty text is scored by the same model from no
evidence. Rows with a null label or id teach nothing; repeated labels of an id each count. Equal rows
are scored each; an empty table gives no rows. Whole texts are read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rememora.llm.common import drawn_share, filled, fold, held_out, no_cycles, slices, table, type_of
from rememora.session import settle

THRESHOLD = 0.3
MAX_ROWS = 20_000
MAX_FEATURES = 20_000  # default of ``max_features``: the clearest of the learned words and beginnings
MIN_TOXIC = 3
LETTERS = 64
# Signs that stand for letters.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
              "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
SIGN_COST, EDGE_COST, GAP_COST, REPEAT_COST = -0.7, -3.0, -0.1, -0.2
LEXICON_PART = 0.3
_SEEN_BYTES = 48_000_000
_COUNTED_BYTES = 500_000  # of texts counted at once, which take some thirty times that
_TRAILING = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¡¿«»„“”‘’…–—"
_LEADING = "".join(c for c in _TRAILING if c not in LOOKALIKES)
_APART = re.compile(r"(?<!\S)(?:\S[ \t\-_.*]){2,}\S(?!\S)")
_REPEATED = re.compile(r"([^\W\d_])\1\1")
_FEW_WORDS = 30  # shorter texts count as this long, so that length alone says nothing of them


def _class_of(char: str) -> int:
    """0 for an edge, 1-26 for a-z, a shared class for each other letter."""
    if "a" <= char <= "z":
        return ord(char) - 96
    return 27 + ord(char) % (LETTERS - 27) if char.isalpha() else 0


_classes: np.ndarray | None = None


def character_counts(df: DataFrame, text_col: str) -> np.ndarray:
    """Trigram counts of letter classes over every text; a task sends at most LETTERS^3 rows."""
    def run(batches):
        global _classes
        if _classes is None:
            _classes = np.fromiter((_class_of(chr(c)) for c in range(0x110000)), np.uint8, 0x110000)
        total = np.zeros(LETTERS ** 3, np.int64)
        with no_cycles():
            for batch in batches:
                for part in slices(batch, text_col, _COUNTED_BYTES):
                    joined = "\n\n".join(["", *filled(part, text_col).to_pylist(), ""]).lower()
                    c = _classes[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int32)
                    total += np.bincount((c[:-2] * LETTERS + c[1:-1]) * LETTERS + c[2:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["gram", "n"])

    rows = df.select(text_col).mapInArrow(run, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(LETTERS ** 3)
    out[rows.gram.to_numpy(np.int64)] = rows.n.to_numpy(float)
    return out.reshape(LETTERS, LETTERS, LETTERS)


def probabilities(counts: np.ndarray) -> np.ndarray:
    """Trigram probabilities, smoothed by bigrams and these by single letters."""
    one = counts.sum(axis=(0, 1)) + 1
    one = one / one.sum()
    two = counts.sum(axis=0)
    two = (two + 5 * one) / (two.sum(axis=1, keepdims=True) + 5)
    return (counts + 5 * two) / (counts.sum(axis=2, keepdims=True) + 5)


def lexicon_counts(words: dict[str, float]) -> np.ndarray:
    counts = np.zeros((LETTERS, LETTERS, LETTERS))
    for word in words:
        c = [0, 0, *map(_class_of, word), 0]
        for a, b, d in zip(c, c[1:], c[2:]):
            counts[a, b, d] += 1
    return counts


class Decoder:
    """Viterbi over the lattice of a chunk; a state is the last two emitted classes."""

    def __init__(self, probability: np.ndarray):
        self.log = np.log(probability).ravel().tolist()

    def options(self, chunk: str) -> list[list[tuple[str, float]]]:
        """Readings of each character: ("", cost) vanishes, (" ", cost) is an edge."""
        out: list[list[tuple[str, float]]] = []
        for i, c in enumerate(chunk):
            if c.isalpha():
                repeated = i and c == chunk[i - 1] and (c * 3) in chunk[max(0, i - 2):i + 3]
                out.append([(c, 0.0), ("", REPEAT_COST)] if repeated else [(c, 0.0)])
            elif c in LOOKALIKES:
                repeated = i and c == chunk[i - 1] and (c * 3) in chunk[max(0, i - 2):i + 3]
                out.append([*((x, SIGN_COST) for x in LOOKALIKES[c]), (" ", EDGE_COST), *([("", REPEAT_COST)] if repeated else [])])
            else:
                out.append([("", GAP_COST), (" ", 0.0)])
        return out

    def decode(self, chunk: str) -> str:
        log, states = self.log, {(0, 0): (0.0, None)}
        for options in self.options(chunk):
            after: dict[tuple[int, int], tuple] = {}
            for (a, b), (score, path) in states.items():
                for char, cost in options:
                    if char == "":
                        key, value, step = (a, b), score + cost, path
                    else:
                        c = _class_of(char)
                        key, value, step = (b, c), score + cost + log[(a * LETTERS + b) * LETTERS + c], (path, char)
                    if key not in after or value > after[key][0]:
                        after[key] = (value, step)
            states = after
        ended = ((score + log[(a * LETTERS + b) * LETTERS], path) for (a, b), (score, path) in states.items())
        path, out = max(ended, key=lambda x: x[0])[1], []
        while path is not None:
            path, char = path
            out.append(char)
        return "".join(reversed(out))


def apart(low: str) -> list[str]:
    """Chunks of a lower-cased text whose letters stand apart."""
    return _APART.findall(low)


def core(token: str) -> str:
    """A chunk between white space without its marks; signs that may open a word stay."""
    return token.rstrip(_TRAILING).lstrip(_LEADING)


def is_disguised(word: str) -> bool:
    return bool(_REPEATED.search(word)) if word.isalpha() else any(c.isalpha() for c in word)


def features(word: str):
    """The whole word and its beginnings of four to eight letters."""
    yield "=" + word
    for k in range(4, min(len(word), 8) + 1):
        yield word[:k]


def plain_words(low: str) -> set[str]:
    return {w for w in (t.strip(_TRAILING) for t in set(low.split())) if len(w) > 1 and w.isalpha()}


class Scorer:
    """Evidence of words, and the logistic model over a text's strongest evidence."""

    def __init__(self, evidence: dict[str, float], decoder: Decoder, weights: np.ndarray | None = None, constant: float = 0.0):
        self.evidence, self.decoder, self.weights, self.constant = evidence, decoder, weights, constant
        self.starts = {f.removeprefix("=")[:4] for f in evidence}
        self.seen: set[str] = set()
        self.hot: dict[str, float] = {}
        self.held = 0

    def __getstate__(self):
        return self.__dict__ | {"seen": set(), "hot": {}, "held": 0}

    def word(self, word: str) -> float:
        if word[:4] not in self.starts or len(word) < 2:
            return 0.0
        return max(self.evidence.get(f, 0.0) for f in features(word))

    def token(self, token: str) -> float:
        """Evidence of a chunk between white space, also of its restored reading if it is disguised."""
        word = core(token)
        read = self.decoder.decode(word).split() if is_disguised(word) else []
        found = max(map(self.word, [word, *read]))
        for other in {token.strip(_LEADING), token.strip(_TRAILING)} - {""}:
            if other != word or not any(map(str.isalpha, other)):
                part = 0.5 if other.isdigit() else 1.0
                for reading in [other] if other.isalpha() else self.decoder.decode(other).split():
                    found = max(found, part * self.evidence.get("=" + reading, 0.0))
        return found

    def values(self, text: str) -> list[float]:
        low = unicodedata.normalize("NFC", text).lower()
        tokens = set(low.split())
        for t in tokens - self.seen:
            self.seen.add(t)
            self.held += 110 + len(t)
            if (e := self.token(t)) > 0:
                self.hot[t] = e
        found = [self.hot[t] for t in tokens & self.hot.keys()]
        for chunk in apart(low):
            found += [e for w in self.decoder.decode(chunk.strip()).split() if (e := self.word(w)) > 0]
        found = sorted(found, reverse=True)
        if self.held > _SEEN_BYTES:
            self.forget()
        top = [*found[:3], 0.0, 0.0, 0.0][:3]
        strong, words = sum(e > 2.0 for e in found), max(len(tokens), _FEW_WORDS)
        return [*top, math.log1p(strong), math.log1p(len(found)), math.log1p(words), strong / (1 + words) * 10, 1.0]

    def forget(self) -> None:
        self.seen.clear()
        self.hot.clear()
        self.held = 0

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.constant)
        x = np.array([self.values(t) for t in texts]).reshape(len(texts), -1)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last column is the intercept."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.ones(x.shape[1])
    penalty[-1] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sampled(labels: DataFrame, id_col: str, label_col: str, max_rows: int) -> DataFrame:
    """About ``max_rows`` labelled training rows, drawn by hash: ``(id, toxic, part)``; part 1 fits the logistic model.

    The threshold has 63 bits, so as many rows are drawn from any number of labels.
    """
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (fold(F.col(id_col)) != 2)).select(
        F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic"), (fold(F.col(id_col)) == 3).cast("int").alias("part"))
    return drawn_share(rows, F.xxhash64("id"), max_rows, rows.count())


def _feature_counts(texts: DataFrame, wanted: set[str] | None) -> DataFrame:
    """``(feature, part, n)``: texts that hold the feature."""
    def run(batches):
        counts: dict[tuple[str, int], int] = {}
        with no_cycles():
            for batch in batches:
                for some in slices(batch, "text"):
                    for text, part in zip(filled(some, "text").to_pylist(), some.column("part").to_pylist()):
                        found = set(chain.from_iterable(map(features, plain_words(text.lower()))))
                        for f in found if wanted is None else found & wanted:
                            counts[f, part] = counts.get((f, part), 0) + 1
        keys = list(counts)
        for begin in range(0, len(keys), 50_000):
            some = keys[begin:begin + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in some], pa.string()), pa.array([k[1] for k in some], pa.int32()),
                                              pa.array([counts[k] for k in some], pa.int64())], ["feature", "part", "n"])

    return (texts.select("text", "part").mapInArrow(run, "feature string, part int, n bigint")
            .groupBy("feature", "part").agg(F.sum("n").alias("n")))


def _evidence(toxic: dict[str, int], clean: dict[str, int], n1: int, n0: int, max_features: int) -> dict[str, float]:
    """Log-odds of features that mark toxic texts beyond chance, the clearest ``max_features`` at most."""
    kept = []
    for f, c1 in toxic.items():
        c0 = clean.get(f, 0)
        p = (c1 + c0) / (n1 + n0)
        z = (c1 / n1 - c0 / n0) / math.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12)
        odds = math.log((c1 + 0.5) / (n1 + 1)) - math.log((c0 + 0.5) / (n0 + 1))
        if c1 >= MIN_TOXIC and z > 3 and odds > 0.7:
            kept.append((z, f, odds))
    return {f: odds for _, f, odds in sorted(kept, reverse=True)[:max_features]}


def learn(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          max_rows: int = MAX_ROWS, corpus: DataFrame | None = None, max_features: int = MAX_FEATURES) -> Scorer:
    """Fit on the training rows of ``labels``; the character model counts ``corpus`` (default ``df``).

    A bounded sample of ``max_rows`` rows has a bounded number of words, of which ``max_features`` are kept.
    """
    counts = character_counts(df if corpus is None else corpus, text_col)
    # bounded by max_rows, so it may be sent to every task
    drawn = F.broadcast(sampled(labels, id_col, label_col, max_rows))
    rows = settle(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(drawn, "id"), "labelled")
    sizes = {(r["part"], r["toxic"]): r["n"] for r in rows.groupBy("part", "toxic").agg(F.count("*").alias("n")).collect()}
    n = lambda part, toxic: sizes.get((part, toxic), 0)
    n1, n0 = n(0, 1) + n(1, 1), n(0, 0) + n(1, 0)
    plain = Decoder(probabilities(counts))
    if not n1 or not n0:
        return Scorer({}, plain, None, n1 / max(n1 + n0, 1))
    held = _feature_counts(rows.where("toxic = 1"), None)
    often = held.groupBy("feature").agg(F.sum("n").alias("all")).where(F.col("all") >= MIN_TOXIC).select("feature")
    toxic = held.join(often, "feature").toPandas()
    clean = _feature_counts(rows.where("toxic = 0"), set(toxic.feature)).toPandas()

    def by(frame, parts):
        some = frame[frame.part.isin(parts)]
        return some.groupby("feature").n.sum().to_dict()

    def scorer(evidence):
        words = {f[1:]: e for f, e in evidence.items() if f[0] == "=" and e > 2.0}
        mixed = (1 - LEXICON_PART) * probabilities(counts) + LEXICON_PART * probabilities(counts * 1e-3 + 50 * lexicon_counts(words))
        return Scorer(evidence, Decoder(mixed if words else probabilities(counts)))

    fit = scorer(_evidence(by(toxic, [0]), by(clean, [0]), n(0, 1), n(0, 0), max_features)) if n(0, 1) and n(0, 0) and n(1, 1) and n(1, 0) else None
    whole = scorer(_evidence(by(toxic, [0, 1]), by(clean, [0, 1]), n1, n0, max_features))
    fitted = rows.where("part = 1") if fit else rows
    values = (fit or whole)

    def run(batches):
        for batch in batches:
            x = [values.values(t) for t in filled(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("toxic")], ["x", "toxic"])

    seen = fitted.select("text", "toxic").mapInArrow(run, "x array<double>, toxic int").toPandas()
    order = np.lexsort((*np.stack(seen.x.to_list()).T, seen.toxic.to_numpy()))
    whole.weights = fit_logistic(np.stack(seen.x.to_list())[order], seen.toxic.to_numpy(float)[order])
    return whole


def score(df: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)``."""
    def run(batches):
        with no_cycles():
            for batch in batches:
                for part in slices(batch, text_col):
                    yield pa.RecordBatch.from_arrays(
                        [part.column(id_col), pa.array(scorer.scores(filled(part, text_col).to_pylist()))], [id_col, "score"])
        scorer.forget()

    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {type_of(df, id_col)}, score double")


def clean(df: DataFrame, scorer: Scorer, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score below ``threshold``, with all their columns; no shuffle."""
    def run(batches):
        with no_cycles():
            for batch in batches:
                for part in slices(batch, text_col):
                    kept = part.filter(pa.array(scorer.scores(filled(part, text_col).to_pylist()) < threshold))
                    if kept.num_rows:
                        yield kept
        scorer.forget()

    return df.mapInArrow(run, df.schema)


def restore(df: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, chunks)``: every disguised chunk of a text with its restored reading."""
    def run(batches):
        for batch in batches:
            out = []
            for text in filled(batch, text_col).to_pylist():
                low = unicodedata.normalize("NFC", text).lower()
                odd = {c for c in map(core, set(low.split())) if is_disguised(c)} | {c.strip() for c in apart(low)}
                out.append([{"chunk": c, "restored": scorer.decoder.decode(c)} for c in sorted(odd)])
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(out, kind)], [id_col, "chunks"])

    kind = pa.list_(pa.struct([("chunk", pa.string()), ("restored", pa.string())]))
    return df.select(id_col, text_col).mapInArrow(
        run, f"{id_col} {type_of(df, id_col)}, chunks array<struct<chunk: string, restored: string>>")


def predicted(column: Column, threshold: float = THRESHOLD) -> Column:
    return (column >= threshold).cast("int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted(F.col("score")).alias("predicted"))
