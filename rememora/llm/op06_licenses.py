"""License scans: matching statistics against a generalised suffix automaton of license texts.

Templates are sequences of words; one automaton holds all their substrings, with the places where
each occurs. Texts are streamed as words: runs of known words walk the automaton, which yields at
every word the longest match that ends there. Maximal matches of ``min_match`` words are chained per
template while both sides advance with small gaps; a chain that covers enough of its template is a span.

Words: A-Z lower-cased, then ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. Nulls and odd input: null and empty
texts have no words, null first and last places, empty labels and score 0. Repeated rows are scanned
each. An empty table gives no rows. Whole texts are read, whatever their length.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from rememora.llm import bytewords
from rememora.llm.common import buffers, filled, slices, table, type_of

# Phrases whose every place is reported, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Wording of public licenses, in lower case without marks.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
           "documentation files the software to deal in the software without restriction including without limitation the "
           "rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "apache-2": "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
                "with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the "
           "following conditions are met redistributions of source code must retain the above copyright notice",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
           "granted provided that the above copyright notice and this permission notice appear in all copies",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
           "license as published by the free software foundation",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by-nc": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc-by-sa": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify "
                 "publish use compile sell or distribute this software",
}
MIN_MATCH = 4
MAX_GAP = 8
COVERAGE = 0.5


class Automaton:
    """Suffix automaton of several word sequences; states know their places ``(template, end)``."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.places = [-1], [0], [[]]
        for t, words in enumerate(sequences):
            last = 0
            for end, word in enumerate(words):
                last = self._extend(last, word)
                self.places[last].append((t, end))
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            self.places[self.link[state]].extend(self.places[state])
        self.places[0] = []

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.places.append([])
        return len(self.link) - 1

    def _split(self, state: int, word: int) -> int:
        """The state after ``word``, split off if it also holds longer strings."""
        target = self.next[state][word]
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._state(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        new = self._state(self.length[last] + 1, 0, {})
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        self.link[new] = self._split(last, word) if last >= 0 else 0
        return new


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: dict[str, str], min_match: int, max_gap: int, coverage: float):
        self.min_match, self.max_gap, self.coverage = min_match, max_gap, coverage
        texts = [p.split() for p in phrases] + [t.split() for t in templates.values()]
        self.labels = [*phrases.values(), *templates]
        self.sizes, self.phrases = [len(t) for t in texts], len(phrases)
        vocabulary = sorted({w for t in texts for w in t})
        number = {w: k for k, w in enumerate(vocabulary)}
        self.automaton = Automaton([[number[w] for w in t] for t in texts])
        data, offsets = buffers(pa.array(vocabulary))
        h = bytewords.hashes(data, offsets[:-1], offsets[1:])
        self.order = np.argsort(h)
        self.hashes, self.words = h[self.order], [vocabulary[k].encode() for k in self.order]
        self.shortest = min(min_match, *(len(p.split()) for p in phrases)) if phrases else min_match
        # a phrase ends at a match if its own state is the match's state or one of its suffixes
        a = self.automaton
        own: dict[int, list[int]] = {}
        for t, text in enumerate(texts[:len(phrases)]):
            state = 0
            for w in text:
                state = a.next[state][number[w]]
            own.setdefault(state, []).append(t)
        self.ending: list[list[int]] = [[] for _ in a.link]
        for state in sorted(range(1, len(a.link)), key=lambda s: a.length[s]):
            self.ending[state] = own.get(state, []) + self.ending[a.link[state]]

    def walk(self, ids: list[int], first: int, places: list, matches: list) -> None:
        """Matching statistics over one run of known words that starts at word ``first``."""
        a, state, length = self.automaton, 0, 0
        before = (0, 0)
        for k, word in enumerate(ids):
            while state and word not in a.next[state]:
                state = a.link[state]
                length = a.length[state]
            if word in a.next[state]:
                state, length = a.next[state][word], length + 1
            if before[1] >= self.min_match and length <= before[1]:
                matches.append((first + k - 1, before[1], before[0]))
            before = (state, length)
            for t in self.ending[state]:
                if length >= self.sizes[t]:
                    places.append((first + k + 1 - self.sizes[t], self.labels[t]))
        if before[1] >= self.min_match:
            matches.append((first + len(ids) - 1, before[1], before[0]))

    def chain(self, matches: list) -> list[tuple[str, int, int, float]]:
        """Covered template spans ``(label, first word, last word, coverage)``."""
        by: dict[int, list[list[int]]] = {}
        for end, length, state in matches:
            for t, at in self.automaton.places[state]:
                if t < self.phrases:
                    continue
                chains = by.setdefault(t, [])
                last = chains[-1] if chains else None
                # [first word, last word, last place in the template, words covered]
                if last and 0 < end - last[1] <= self.max_gap + length and 0 < at - last[2] <= self.max_gap + length:
                    last[3] += min(length, end - last[1], at - last[2])
                    last[1], last[2] = end, at
                else:
                    chains.append([end - length + 1, end, at, length])
        found = {(self.labels[t], c[0], c[1], min(1.0, c[3] / self.sizes[t])) for t, chains in by.items() for c in chains}
        return sorted(x for x in found if x[3] >= self.coverage)

    def scan(self, strings: pa.Array) -> tuple[np.ndarray, list[list], list[list]]:
        data, offsets = buffers(strings)
        data = bytewords.LOWER[data]
        starts, ends, doc = bytewords.spans(data, offsets, bytewords.ALNUM)
        count = np.bincount(doc, minlength=len(strings)) if len(doc) else np.zeros(len(strings), np.int64)
        places, matches = [[] for _ in range(len(strings))], [[] for _ in range(len(strings))]
        if len(starts):
            h = bytewords.hashes(data, starts, ends)
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            known = self.hashes[at] == h
            base = np.cumsum(count) - count
            cut = np.diff(doc, prepend=-1) != 0
            begin = np.flatnonzero(known & (cut | ~np.append(False, known[:-1])))
            stop = np.flatnonzero(known & ~np.append(known[1:] & ~cut[1:], False)) + 1
            for x, y in zip(begin.tolist(), stop.tolist()):
                if y - x >= self.shortest:
                    words = [data[starts[k]:ends[k]].tobytes() for k in range(x, y)]
                    ids = [int(self.order[i]) if self.words[i] == w else -1 for i, w in zip(at[x:y].tolist(), words)]
                    d = int(doc[x])
                    self.walk(ids, x - int(base[d]), places[d], matches[d])
        return count, places, [self.chain(m) if m else [] for m in matches]


@functools.lru_cache(2)
def _scanner(key) -> Scanner:
    phrases, templates, *rest = key
    return Scanner(dict(phrases), dict(templates), *rest)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None,
         templates: dict[str, str] | None = None, min_match: int = MIN_MATCH, max_gap: int = MAX_GAP,
         coverage: float = COVERAGE) -> DataFrame:
    """``(id, n_words, places, spans)``: every place of a phrase, and every span that covers a template."""
    key = (tuple((PHRASES if phrases is None else phrases).items()),
           tuple((TEMPLATES if templates is None else templates).items()), min_match, max_gap, coverage)

    def run(batches):
        scanner = _scanner(key)
        for batch in batches:
            for part in slices(batch, text_col):
                count, places, spans = scanner.scan(filled(part, text_col))
                yield pa.RecordBatch.from_arrays([
                    part.column(id_col), pa.array(count, pa.int64()),
                    pa.array([[{"word": w, "label": x} for w, x in p] for p in places], place_type),
                    pa.array([[dict(zip(("label", "first", "last", "coverage"), s)) for s in x] for x in spans], span_type)],
                    [id_col, "n_words", "places", "spans"])

    place_type = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
    span_type = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("coverage", pa.float64())]))
    return df.select(id_col, text_col).mapInArrow(run, f"""{id_col} {type_of(df, id_col)}, n_words bigint,
        places array<struct<word: bigint, label: string>>,
        spans array<struct<label: string, first: bigint, last: bigint, coverage: double>>""")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    places, spans = F.col("places"), F.col("spans")
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    best = F.aggregate(spans, F.lit(0.0), lambda m, s: F.greatest(m, s["coverage"]))
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", F.size(places).cast("long").alias("n_base"),
        F.array_min(places["word"]).alias("first_word"), F.array_max(places["word"]).alias("last_word"),
        joined(places["label"]).alias("base_labels"), joined(F.concat(places["label"], spans["label"])).alias("labels"),
        F.when(F.size(places) > 0, F.lit(1.0)).otherwise(best).alias("score"))
