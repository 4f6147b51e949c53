"""Reference rankers that the ladder is measured against."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from rememora.operators.bm25 import build_index, search
from rememora.operators.numbering import number_rows
from rememora.operators.ranking import top_k
from rememora.params import DEFAULTS, Params
from rememora.session import settle


def lexical_only(entries: DataFrame, queries: DataFrame, k: int, params: Params = DEFAULTS) -> DataFrame:
    """BM25+ over every entry, the working scope included."""
    return search(build_index(entries, params), queries, k, params)


def most_recent(entries: DataFrame, queries: DataFrame, k: int, updated: str = "updated_at") -> DataFrame:
    """The k latest updated entries of the chat, for every query; undated entries last."""
    best = top_k(entries.select("chat_id", "id", "seq", updated), ["chat_id"],
                 [F.desc_nulls_last(updated), F.asc("seq")], k)
    return queries.select("chat_id", "query_id").join(best, "chat_id")


def _mulberry(seed: np.ndarray) -> np.ndarray:
    """Outputs in [0, 1) of the counter-based generator for its raw states."""
    with np.errstate(over="ignore"):
        t = seed.astype(np.uint32)
        r = (t ^ (t >> np.uint32(15))) * (np.uint32(1) | t)
        r ^= r + (r ^ (r >> np.uint32(7))) * (np.uint32(61) | r)
        return (r ^ (r >> np.uint32(14))) / 4294967296.0


def shuffled_head(query: str, n: int, k: int, chunk: int = 1 << 20) -> list[int]:
    """First ``k`` indices of the seeded Fisher-Yates shuffle of ``range(n)``.

    The generator is counter-based, so the swaps are replayed backwards and
    only the ``k`` wanted places are followed: memory does not grow with n.
    """
    seed = int.from_bytes(hashlib.sha256(query.encode("utf-8")).digest()[:4], "big")
    k = min(k, n)
    held = list(range(k))
    for low in range(1, n, chunk):
        steps = np.arange(low, min(low + chunk, n), dtype=np.uint64)
        # the swap at position i was draw number n - i of the stream
        state = (np.uint64(seed) + (np.uint64(n) - steps) * np.uint64(0x6D2B79F5)) & np.uint64(0xFFFFFFFF)
        partner = np.floor(_mulberry(state) * (steps + np.uint64(1)).astype(np.float64)).astype(np.int64)
        places = steps.astype(np.int64)
        position = 0
        while position < len(places):
            # next swap that moves one of the followed places
            touches = np.isin(partner[position:], held) | np.isin(places[position:], held)
            if not touches.any():
                break
            position += int(touches.argmax())
            a, b = int(places[position]), int(partner[position])
            held = [b if h == a else a if h == b else h for h in held]
            position += 1
    return held


def seeded_random(entries: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """k entries per query by a shuffle seeded from the query text."""
    sizes = entries.groupBy("chat_id").agg(F.count("*").alias("n"))

    def draw(batches):
        for batch in batches:
            rows = [
                (c, q, rank, place)
                for c, q, text, n in batch.itertuples(index=False)
                for rank, place in enumerate(shuffled_head(text, int(n), k), start=1)
            ]
            yield pd.DataFrame(rows, columns=["chat_id", "query_id", "rank", "place"])

    asked = queries.select("chat_id", "query_id", "query").join(sizes, "chat_id")
    kinds = {f.name: f.dataType.simpleString() for f in queries.schema}
    drawn = asked.mapInPandas(
        draw, f"chat_id {kinds['chat_id']}, query_id {kinds['query_id']}, rank long, place long")
    numbered = number_rows(entries.select("chat_id", "id", "seq"), "chat_id", "seq", "place")
    return settle(drawn, "draws").join(numbered, ["chat_id", "place"]).select(
        "chat_id", "query_id", "rank", "id")
