"""Best-fit packing: local best fit, nearly full bins leave, underfull bins merge up a tree.

Each task cuts its documents' token ids into pieces of at most ``capacity`` and packs the pieces by
decreasing best fit. Bins filled to ``capacity - slack`` are final. The others become items of the
next round: they are dealt anew to groups of bounded size, packed again as wholes, and so on. A bin that
cannot take the least filled one left fits none and is final; a round that leaves more than one group has
at most one half-empty bin a group, so the rounds end when one group is left or no two bins fit. Pieces
carry only lengths and checksums, so what the rounds move is a small share of the text.

Nulls and odd input: a null or empty text is the end token alone. Equal ids are packed row by row
(``piece`` restarts for each row). An empty table gives no rows. Very long texts are cut, nothing else is.
"""

from __future__ import annotations

import os
import re
import string
import zlib
from bisect import bisect_left, insort
from itertools import filterfalse
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from rememora.llm.common import filled, no_cycles, slices, table, type_of
from rememora.session import settle

CAPACITY = 4096
END_ID = 1
SLACK = 32
GROUP_ROWS = 50_000
TOKENIZER = "word_bpe_49k.json"
_CACHE_BYTES = 80_000_000
_ENTRY_BYTES = 200  # of the table for each chunk, beside its own bytes
_SLICE_BYTES = 4_000_000
_JOINED = 500
# one word of Latin letters with ASCII punctuation behind it: two tokens of the pre-tokenizer at most
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
_MARKS = string.punctuation.encode()
_encoder: tuple | None = None


class Chunks(dict):
    """Ids of chunks, and the bytes that the table takes."""

    held = 0

    def keep(self, found: dict[bytes, bytes]) -> None:
        self.update(found)
        self.held += sum(_ENTRY_BYTES + len(c) + len(i) for c, i in found.items())

    def forget(self, chunks) -> None:
        for c in chunks:
            self.held -= _ENTRY_BYTES + len(c) + len(self.pop(c))


def _loaded(path: str):
    """The worker's tokenizer, its cache of chunks, its special tokens; a chunk is text between ASCII white space."""
    global _encoder
    if _encoder is None or _encoder[0] != path:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        last = np.zeros(tokenizer.get_vocab_size(), bool)  # ids that end a word
        for token, i in tokenizer.get_vocab().items():
            last[i] = token.endswith("</w>")
        special = [t.content.lower().encode() for t in tokenizer.get_added_tokens_decoder().values()]
        # whether the model alone gives the ids of a word of ASCII letters
        direct = all([t.id for t in tokenizer.model.tokenize(w)] == tokenizer.encode(w, add_special_tokens=False).ids
                     for w in (string.ascii_lowercase, "tokenizers", "a"))
        _encoder = (path, tokenizer, last, Chunks(), special, direct)
    return _encoder[1:]


def _lowered(text: bytes, special: list[bytes]) -> bytes:
    """The text with A-Z lowered, as the tokenizer does after NFC, where that changes neither NFC nor a special token."""
    if b"\xcc" in text or b"\xcd" in text:  # a combining mark may meet a letter that composes in one case only
        return text
    low = text.lower()
    return text if any(s in low for s in special) else low


def _learn(new: set[bytes], tokenizer, last: np.ndarray, cache: Chunks, direct: bool) -> None:
    """Encode chunks the cache lacks. Words of ASCII letters go straight to the model; other plain words in lines of many, as each ends in an end-of-word id."""
    bare, plain, other = [], [], []
    for chunk in new:
        if chunk.isalpha() and chunk.islower():
            bare.append(chunk)
            continue
        word = chunk.rstrip(_MARKS)
        if word.isalpha() and word.islower():
            plain.append((chunk, word, chunk[len(word):]))
        elif m := _PLAIN.fullmatch(chunk.decode()):
            plain.append((chunk, m[1].lower().encode(), m[2].encode()))
        else:
            other.append(chunk)
    n_bare = len(bare)
    # a word that the cache holds as a chunk is not encoded again
    words = {w for _, w, _ in plain if w not in cache}.difference(bare)
    ids: dict[bytes, bytes] = {b"": b""}
    if direct:
        bare += filter(bytes.isascii, words)
        words = list(filterfalse(bytes.isascii, words))
        tokenize = tokenizer.model.tokenize
        for w in bare:
            found = [t.id for t in tokenize(w.decode())]
            ids[w] = pack_ids(f"<{len(found)}I", *found)
    else:
        words = [*bare, *words]
    for begin in range(0, len(words), 100 * _JOINED):
        some = words[begin:begin + 100 * _JOINED]
        lines = [b" ".join(some[k:k + _JOINED]).decode() for k in range(0, len(some), _JOINED)]
        flat = np.concatenate([np.array(x.ids, "<u4") for x in tokenizer.encode_batch_fast(lines, add_special_tokens=False)])
        ends = np.flatnonzero(last[flat]) + 1
        blob = flat.tobytes()
        if len(ends) == len(some):
            edge = [0, *(4 * ends).tolist()]
            ids.update((w, blob[x:y]) for w, x, y in zip(some, edge, edge[1:]))
        else:  # a vocabulary without end-of-word tokens
            for w, got in zip(some, tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)):
                ids[w] = np.array(got.ids, "<u4").tobytes()
    marks = list({p for _, _, p in plain} - {b""})
    for text, got in zip(marks, tokenizer.encode_batch_fast([p.decode() for p in marks], add_special_tokens=False)):
        ids[text] = np.array(got.ids, "<u4").tobytes()
    cache.keep({chunk: ids[chunk] for chunk in bare[:n_bare]})
    cache.keep({chunk: (ids[w] if w in ids else cache[w]) + ids[p] for chunk, w, p in plain})
    cache.keep({chunk: np.array(got.ids, "<u4").tobytes() for chunk, got in zip(
        other, tokenizer.encode_batch_fast([c.decode() for c in other], add_special_tokens=False))})


def encode_texts(texts: list[bytes], path: str) -> list[bytes]:
    """Little-endian unsigned 32-bit ids of each UTF-8 text, without special tokens.

    No token of this vocabulary spans white space, so chunks are encoded once and looked up after.
    """
    tokenizer, last, cache, special, direct = _loaded(path)
    found, gaps, total = [], [], 0
    for text in texts:
        chunks = _lowered(text, special).split()
        ids = list(map(cache.get, chunks))
        found.append(ids)
        gaps.append([(k, chunks[k]) for k, i in enumerate(ids) if i is None])
        total += len(chunks)
    new = {chunk for missing in gaps for _, chunk in missing}
    if new:
        _learn(new, tokenizer, last, cache, direct)
        for ids, missing in zip(found, gaps):
            for k, chunk in missing:
                ids[k] = cache[chunk]
    out = [b"".join(ids) for ids in found]
    if cache.held > _CACHE_BYTES:
        # what came first is kept, as common words do; a cache that no longer fits the text is dropped
        cache.forget(new if 2 * sum(map(len, gaps)) < total else list(cache))
    return out


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Decreasing best fit: bin and offset of each item, fill of each bin; equal lengths keep their order."""
    bins, offsets, fills = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    open_at: dict[int, list[int]] = {}
    rooms: list[int] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        at = bisect_left(rooms, size)
        if at == len(rooms):
            which, room = len(fills), capacity
            fills.append(0)
        else:
            room = rooms[at]
            which = open_at[room].pop()
            if not open_at[room]:
                del open_at[room], rooms[at]
        bins[i], offsets[i] = which, fills[which]
        fills[which] += size
        if room > size:
            if room - size not in open_at:
                open_at[room - size] = []
                insort(rooms, room - size)
            open_at[room - size].append(which)
    return bins, offsets, np.array(fills, np.int64)


def pieces(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces with their place in the task's own bins: ``(id, piece, start, length, ids_crc32, bin, offset, fill)``."""
    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        ids, rows = [], [np.zeros((0, 4), np.int64)]
        kind = None
        made = 0

        def packed():
            nonlocal ids, rows, made
            a = np.concatenate(rows)
            bins, offsets, fills = best_fit(a[:, 2], capacity)
            out = pa.RecordBatch.from_arrays(
                [pa.array(ids, kind), *(pa.array(a[:, k]) for k in range(4)),
                 pa.array(base + made + bins), pa.array(offsets), pa.array(fills[bins])], names)
            made += len(fills)
            ids, rows = [], [np.zeros((0, 4), np.int64)]
            return out

        with no_cycles("packing", lambda: _encoder and _encoder[3].forget(list(_encoder[3]))):
            for batch in batches:
                kind = batch.schema.field(id_col).type
                for part in slices(batch, text_col, _SLICE_BYTES):
                    found = []
                    for key, blob in zip(part.column(id_col).to_pylist(), encode_texts(filled(part, text_col).cast(pa.binary()).to_pylist(), path)):
                        blob += END_ID.to_bytes(4, "little")
                        for k, at in enumerate(range(0, len(blob), 4 * capacity)):
                            cut = blob[at:at + 4 * capacity]
                            ids.append(key)
                            found.append((k, at // 4, len(cut) // 4, zlib.crc32(cut)))
                    rows.append(np.array(found, np.int64).reshape(-1, 4))
                    if len(ids) > 200_000:  # a task's pieces are packed in runs of bounded size
                        yield packed()
        if ids:
            yield packed()

    names = [id_col, "piece", "start", "length", "ids_crc32", "bin", "offset", "fill"]
    return df.select(id_col, text_col).mapInArrow(run, f"""{id_col} {type_of(df, id_col)}, piece bigint, start bigint,
        length bigint, ids_crc32 bigint, bin bigint, offset bigint, fill bigint""")


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         slack: int = SLACK, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``(id, piece, start, length, ids_crc32, sequence_id, offset)``: every piece placed once."""
    placed = settle(pieces(df, path, id_col, text_col, capacity), "pieces")
    spark = df.sparkSession

    def merged(table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return empty
        table = table.sort_by([("fill", "descending"), ("bin", "ascending")])
        bins, fill = table["bin"].to_numpy(), table["fill"].to_numpy()
        to, offset, fills = best_fit(fill, capacity)
        root = np.zeros(len(fills), np.int64)
        lead = offset == 0
        root[to[lead]] = bins[lead]
        return pa.table({"bin": bins, "root": root[to], "shift": offset, "root_fill": fills[to]}, schema=empty.schema)

    empty = pa.schema([("bin", pa.int64()), ("root", pa.int64()), ("shift", pa.int64()), ("root_fill", pa.int64())]).empty_table()
    under = F.col("fill") < capacity - slack
    # a bin's first piece stands for the bin
    items = placed.where((F.col("offset") == 0) & under).select("bin", "fill")
    moves = None
    turn = 0
    while (least := items.agg(F.min("fill")).first()[0]) is not None:
        # what cannot take the least filled bin fits no other
        items = items.where(F.col("fill") <= capacity - least)
        left = items.count()
        if left < 2:
            break
        groups = -(-left // group_rows)
        grouped = items.withColumn("node", F.pmod(F.xxhash64("bin", F.lit(turn)), F.lit(groups)))
        step = settle(grouped.groupBy("node").applyInArrow(
            lambda t: merged(t), "bin bigint, root bigint, shift bigint, root_fill bigint"), "merge")
        if moves is None:
            moves = step.select("bin", "root", "shift")
        else:
            later = step.select(F.col("bin").alias("root"), F.col("root").alias("to"), F.col("shift").alias("more"))
            moves = settle(moves.join(later, "root", "left").select(
                "bin", F.coalesce("to", "root").alias("root"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")), "moves")
        items = (step.where((F.col("shift") == 0) & (F.col("root_fill") < capacity - slack))
                 .select(F.col("root").alias("bin"), F.col("root_fill").alias("fill")))
        turn += 1
        if groups == 1:
            break
    out = placed.select(id_col, "piece", "start", "length", "ids_crc32", "bin", "offset")
    if moves is None:
        return out.withColumnRenamed("bin", "sequence_id")
    return out.join(moves, "bin", "left").select(
        id_col, "piece", "start", "length", "ids_crc32", F.coalesce("root", "bin").alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
