"""Byte-level BPE: encoding by numpy matrices over length-bucketed pieces, decoding by the vocabulary.

Text is cut by the tokenizer's pattern, each distinct piece is encoded once per batch. Pieces of like
length form one padded matrix of ids; in each round every row looks up its neighbouring pairs in a
hashed pair table, merges the leftmost pair of lowest rank and is compacted; finished rows leave.
Results are kept per chunk in a cache bounded in bytes, which goes when a worker turns to another operator. A chunk ends where one
space stands between other characters than white space: no match of the pattern reaches across it.

Nulls and odd input: null and empty texts have 0 tokens and the digests of nothing. Repeated rows are
encoded each. An empty table gives no rows. Very long texts are streamed chunk by chunk.
"""

from __future__ import annotations

import base64
import hashlib
import re
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from rememora.llm.common import filled, no_cycles, slices, table, type_of

VOCABULARY = "byte_bpe_50k.tiktoken"
_CACHE_BYTES = 80_000_000
_ENTRY_BYTES = 260  # of the two tables for each chunk, beside its own bytes
_SLICE_BYTES = 4_000_000
# one word of Latin letters with ASCII punctuation behind it: two pieces at most, whatever the pattern's version of Unicode
_PLAIN = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
# re counts more characters as white space than the pattern does, so a cut is never one too many
_BESIDE_SPACE = re.compile(r" \s|\s ")
_CUT = re.compile(r"(?<=\S) (?=\S)")
_NONE = np.int64(1 << 40)
_codec: tuple | None = None


class PairTable:
    """Open-addressing table (left id, right id) -> merged id, which is also the rank."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length() + 1)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE, np.int64)
        slot, wait, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(wait):
            at = slot[wait]
            free = self.keys[at] == -1
            first = np.zeros(len(wait), bool)
            first[np.unique(at, return_index=True)[1]] = True
            take = wait[free & first]
            self.keys[slot[take]], self.values[slot[take]] = keys[take], values[take]
            wait = wait[~(free & first)]
            slot[wait] = (slot[wait] + 1) & self.mask
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out, slot, wait = np.full(len(keys), _NONE, np.int64), self._slot(keys), np.arange(len(keys))
        for _ in range(self.probes):
            found = self.keys[slot]
            hit = found == keys
            out[wait[hit]] = self.values[slot[hit]]
            go = ~hit & (found != -1)
            if not go.any():
                break
            wait, keys, slot = wait[go], keys[go], (slot[go] + 1) & self.mask
        return out


class Codec:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.vocabulary = {i: t for t, i in ranks.items()}
        self.size = max(self.vocabulary) + 1
        self.single = np.full(256, -1, np.int64)
        for t, i in ranks.items():
            if len(t) == 1:
                self.single[t[0]] = i
        keys, values = [], []
        for t, i in ranks.items():
            for k in range(1, len(t)):
                a, b = ranks.get(t[:k]), ranks.get(t[k:])
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    values.append(i)
        self.pairs = PairTable(np.array(keys, np.int64), np.array(values, np.int64))
        self.pattern = regex.compile(pattern)
        self.decimal = {i: str(i) for i in self.vocabulary}
        self.ids_of: dict[str, str] = {}
        self.bytes_of: dict[str, bytes] = {}
        self.held = 0

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece; buckets are powers of two of the length."""
        out: list[list[int]] = [[] for _ in pieces]
        length = np.array([len(p) for p in pieces], np.int64)
        bucket = np.where(length > 0, np.ceil(np.log2(np.maximum(length, 1))), -1).astype(int)
        for b in np.unique(bucket[bucket >= 0]):
            rows = np.flatnonzero(bucket == b)
            width = 1 << int(b)
            step = max(1, 400_000 // width)
            for begin in range(0, len(rows), step):
                part = rows[begin:begin + step]
                raw = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in part), np.uint8).reshape(-1, width)
                n = length[part].copy()
                ids = np.where(np.arange(width) < n[:, None], self.single[raw], -1)
                for i, row in zip(part.tolist(), self._merge(ids, n)):
                    out[i] = row
        return out

    def _merge(self, ids: np.ndarray, n: np.ndarray) -> list[list[int]]:
        done: list[list[int]] = [[] for _ in range(len(ids))]
        alive = np.arange(len(ids))
        rank = None
        while len(alive):
            width = ids.shape[1]
            if rank is None:
                rank = np.full((len(ids), max(width - 1, 1)), _NONE)
                if width > 1:
                    live = ids[:, 1:] >= 0
                    rank[live] = self.pairs.find(ids[:, :-1][live] * self.size + ids[:, 1:][live])
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(ids)), at]
            ended = best == _NONE
            if ended.any():
                for i, row, k in zip(alive[ended].tolist(), ids[ended].tolist(), n[ended].tolist()):
                    done[i] = row[:k]
                ids, n, alive, rank, at, best = (x[~ended] for x in (ids, n, alive, rank, at, best))
                if not len(alive):
                    break
            # drop the column right of the merge in every row: one gather each
            source = np.arange(width - 1) + (np.arange(width - 1) > at[:, None])
            r = np.arange(len(ids))
            ids = np.take_along_axis(ids, source, 1)
            ids[r, at] = best
            n = n - 1
            if width == 2:
                rank = np.full((len(ids), 1), _NONE)
                continue
            keep = np.arange(width - 2) + (np.arange(width - 2) >= at[:, None])
            rank = np.take_along_axis(rank, keep, 1)
            for side in (-1, 0):  # only the two pairs beside the merged id are new
                left = at + side
                ok = (left >= 0) & (left + 1 < n)
                rank[r[ok], left[ok]] = self.pairs.find(ids[r[ok], left[ok]] * self.size + ids[r[ok], left[ok] + 1])
                gone = (left >= 0) & (left + 1 >= n) & (left < width - 2)
                rank[r[gone], left[gone]] = _NONE
            if (widest := int(n.max())) <= (width - 1) // 2:
                ids, rank = ids[:, :max(widest, 1)], rank[:, :max(widest - 1, 1)]
        return done

    def learn(self, chunks: list[str]) -> None:
        """Encode chunks that the cache lacks; their distinct pieces go through the matrices together."""
        plain, findall = _PLAIN.fullmatch, self.pattern.findall
        cut = [(m[1], m[2]) if (m := plain(c)) else findall(c) for c in chunks]
        distinct = list(set(chain.from_iterable(cut)))
        ids = self.encode_pieces([p.encode() for p in distinct])
        text = {p: " ".join(map(self.decimal.__getitem__, i)) for p, i in zip(distinct, ids)}
        raw = {p: self.decode(i) for p, i in zip(distinct, ids)}
        for chunk, ps in zip(chunks, cut):
            if len(ps) == 1 or not ps[1]:
                self.ids_of[chunk], self.bytes_of[chunk] = text[ps[0]], raw[ps[0]]
            else:
                self.ids_of[chunk] = " ".join(map(text.__getitem__, ps))
                self.bytes_of[chunk] = b"".join(map(raw.__getitem__, ps))
            self.held += self.weight(chunk)

    def weight(self, chunk: str) -> int:
        return _ENTRY_BYTES + 4 * len(chunk) + len(self.ids_of[chunk]) + len(self.bytes_of[chunk])

    def forget(self, chunks=None) -> None:
        """Drop some chunks, or all."""
        if chunks is None:
            self.ids_of.clear()
            self.bytes_of.clear()
            self.held = 0
            return
        for c in chunks:
            self.held -= self.weight(c)
            del self.ids_of[c], self.bytes_of[c]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))

    def chunks(self, text: str) -> list[str]:
        """Cut before every space that has no white space beside it: the pattern takes such a space with what follows."""
        parts = _CUT.split(text) if _BESIDE_SPACE.search(text) else text.split(" ")
        return [p for p in (parts[0], *(" " + p for p in parts[1:])) if p]

    def encode(self, texts: list[str]) -> list[tuple[int, str, bytes]]:
        """Number of ids, the decimal ids joined by spaces, and the bytes they decode to."""
        cut = [self.chunks(t) for t in texts]
        seen = set(chain.from_iterable(cut))
        new = list(seen.difference(self.ids_of))
        if new:
            self.learn(new)
        out = []
        for cs in cut:
            ids = " ".join(map(self.ids_of.__getitem__, cs))
            out.append((ids.count(" ") + 1 if ids else 0, ids, b"".join(map(self.bytes_of.__getitem__, cs))))
        if self.held > _CACHE_BYTES:
            # what came first is kept, as common words do; a cache that no longer fits the text is dropped
            self.forget(new if 2 * len(new) < len(seen) else None)
        return out


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec, built once."""
    global _codec
    if _codec is None or _codec[0] != (path, pattern):
        _codec = ((path, pattern), Codec(path, pattern))
    return _codec[1]


@contextmanager
def working(path: str, pattern: str):
    """The worker's codec for one task; its cache serves the next tasks of this operator."""
    with no_cycles("bpe", lambda: _codec and _codec[1].forget()):
        yield codec(path, pattern)


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids)``: the token ids of every text."""
    def run(batches):
        with working(path, pattern) as c:
            for batch in batches:
                for part in slices(batch, text_col, _SLICE_BYTES):
                    ids = [[int(x) for x in s.split()] for _, s, _ in c.encode(filled(part, text_col).to_pylist())]
                    yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {type_of(df, id_col)}, ids array<int>")


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id, bytes)``: the bytes that the ids stand for; null ids give no bytes."""
    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            out = [c.decode(x or []) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(out, pa.binary())], [id_col, "bytes"])

    return df.select(id_col, ids_col).mapInArrow(run, f"{id_col} {type_of(df, id_col)}, bytes binary")


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)``."""
    def run(batches):
        with working(path, pattern) as c:
            for batch in batches:
                for part in slices(batch, text_col, _SLICE_BYTES):
                    got = c.encode(filled(part, text_col).to_pylist())
                    yield pa.RecordBatch.from_arrays([
                        part.column(id_col), pa.array([g[0] for g in got], pa.int64()),
                        pa.array([hashlib.sha256(g[1].encode()).hexdigest() for g in got], pa.string()),
                        pa.array([hashlib.sha256(g[2]).hexdigest() for g in got], pa.string())], names)

    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
    return df.select(id_col, text_col).mapInArrow(
        run, f"{id_col} {type_of(df, id_col)}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
