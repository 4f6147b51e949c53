"""Text functions as Column expressions; only FNV-1a, a chain over code units, runs in Python, on whole Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F
from pyspark.sql.types import LongType

from rememora.params import ENTITY_STOP_WORDS

# --- fixed values: patterns (word edges are ASCII, hence the look-arounds) ---
_NOT_AFTER_WORD = r"(?<![A-Za-z0-9_])"
_NOT_BEFORE_WORD = r"(?![A-Za-z0-9_])"
_WIDE_SPACES = (0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)
SPACE = "[\\s\\x0B" + "".join("\\u%04X" % c for c in _WIDE_SPACES) + "]"
_SPACES = " \t\n\x0b\f\r" + "".join(map(chr, _WIDE_SPACES))
ENTITY = _NOT_AFTER_WORD + r"[A-Z][a-z]{2,}" + _NOT_BEFORE_WORD
TEMPORAL = (
    r"(?i)" + _NOT_AFTER_WORD + r"when" + _NOT_BEFORE_WORD,
    r"(?i)" + _NOT_AFTER_WORD + r"(before|after|during|recently|yesterday|today)" + _NOT_BEFORE_WORD,
    r"(?i)" + _NOT_AFTER_WORD + r"last" + SPACE + r"+(week|month|year|time)" + _NOT_BEFORE_WORD,
    _NOT_AFTER_WORD + r"(19|20|21)[0-9]{2}" + _NOT_BEFORE_WORD,
    r"(?i)" + _NOT_AFTER_WORD + r"ago" + _NOT_BEFORE_WORD,
)
RELATIONAL = (
    r"(?i)" + _NOT_AFTER_WORD + r"who" + _NOT_BEFORE_WORD,
    r"(?i)" + _NOT_AFTER_WORD + r"with" + SPACE + r"+whom" + _NOT_BEFORE_WORD,
    r"(?i)" + _NOT_AFTER_WORD + r"together" + _NOT_BEFORE_WORD,
    r"(?i)" + _NOT_AFTER_WORD + r"related" + _NOT_BEFORE_WORD,
    r"(?i)" + _NOT_AFTER_WORD + r"connection" + _NOT_BEFORE_WORD,
    r"(?i)" + _NOT_AFTER_WORD + r"between" + SPACE + r"+[A-Za-z0-9_]+" + SPACE + r"+and" + SPACE + r"+[A-Za-z0-9_]+",
    r"(?i)" + _NOT_AFTER_WORD + r"relate(s|d)?" + _NOT_BEFORE_WORD,
    _NOT_AFTER_WORD + r"[A-Z][a-z]+" + SPACE + r"+(and|&|,)" + SPACE + r"+[A-Z][a-z]+",
)
FNV_OFFSET = 0x811C9DC5
FNV_PRIME = 0x01000193
# --- end of fixed values -----------------------------------------------------
# bytes of texts hashed together, and how many long texts at the end are cheaper one by one
_FNV_BYTES = 8_000_000
_FNV_ALONE = 64


def tokens(text: Column) -> Column:
    """Lower-cased ASCII alphanumeric runs of two characters or more, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]{2,}"), F.lit(0))


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def token_key(text: Column) -> Column:
    """Distinct tokens in order, joined by one space; '' when there are none."""
    return F.array_join(F.sort_array(token_set(text)), " ")


def strip_space(text: Column) -> Column:
    """Trim every Unicode space, not only U+0020; of a closing U+0085, a line end but no space, the spaces before it go too."""
    searched = F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")
    return F.when(F.endswith(text, F.lit("\x85")), searched).otherwise(F.trim(text, F.lit(_SPACES)))


def normalized_query(text: Column) -> Column:
    return F.lower(strip_space(text))


def _fnv_rows(texts: list[bytes]) -> np.ndarray:
    """FNV-1a over the UTF-16 code units of each UTF-8 text; all texts take a step at a time, the last few go alone."""
    units = [np.frombuffer(t.decode("utf-8", "replace").encode("utf-16-le"), "<u2") for t in texts]
    lengths = np.fromiter(map(len, units), np.int64, len(units))
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    joined = np.concatenate([units[i] for i in order]) if units else np.zeros(0, "<u2")
    starts = np.cumsum(lengths) - lengths
    hashes, prime, at = np.full(len(units), FNV_OFFSET, np.uint32), np.uint32(FNV_PRIME), 0
    together = int(lengths[_FNV_ALONE]) if len(units) > _FNV_ALONE else 0
    for n in np.searchsorted(-lengths, -np.arange(together), side="left").tolist():
        hashes[:n] = (hashes[:n] ^ joined[starts[:n] + at]) * prime
        at += 1
    for row in range(int(np.searchsorted(-lengths, -at, side="left"))):
        h = int(hashes[row])
        for unit in joined[starts[row] + at:starts[row] + lengths[row]].tolist():
            h = (h ^ unit) * FNV_PRIME & 0xFFFFFFFF
        hashes[row] = h
    out = np.empty(len(units), np.int64)
    out[order] = hashes
    return out


@F.arrow_udf(LongType())
def fnv1a32(text: pa.Array) -> pa.Array:
    """FNV-1a over UTF-16 code units, as an unsigned 32-bit value in a long; NULL stays NULL."""
    missing = np.asarray(text.is_null())
    rows = text.cast(pa.large_binary()).fill_null(b"")
    out, begin = np.empty(len(rows), np.int64), 0
    reach = np.cumsum(np.asarray(pc.binary_length(rows)).astype(np.int64))
    while begin < len(rows):
        before = reach[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(reach, before + _FNV_BYTES, side="right")))
        out[begin:end] = _fnv_rows(rows.slice(begin, end - begin).to_pylist())
        begin = end
    return pa.array(out, mask=missing)


def exact_key(text: Column) -> Column:
    """Eight hex digits that identify a normalised query."""
    return F.lpad(F.lower(F.hex(fnv1a32(normalized_query(text)))), 8, "0")


def entities(text: Column) -> Column:
    """Distinct capitalised words of three letters or more, in order of appearance."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ENTITY), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(*ENTITY_STOP_WORDS)))


def intent(query: Column) -> Column:
    """temporal, then relational, then factual; blank counts as factual."""
    def any_of(patterns):
        hit = F.lit(False)
        for p in patterns:
            hit = hit | query.rlike(p)
        return hit

    return (
        F.when(F.length(strip_space(query)) == 0, "factual")
        .when(any_of(TEMPORAL), "temporal")
        .when(any_of(RELATIONAL), "relational")
        .otherwise("factual")
    )


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """Set similarity of two token arrays (duplicates ignored)."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(
        F.size(F.array_intersect(a, b)) / union)


def strip_reasoning(text: Column) -> Column:
    """Drop a leading ``<think>`` block from a model answer."""
    return F.regexp_replace(text, r"(?s)^\s*<think>.*?</think>\s*", "")


def repeat_array(values: Column, times: float) -> Column:
    n = max(0, int(times // 1))
    return F.flatten(F.array_repeat(values, n))


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A plain alias would be inlined into every lambda that mentions it and be
    computed again for each array element.
    """
    return F.transform(F.array(value), body)[0]


def term_frequencies(token_array: Column) -> Column:
    """Array of (term, tf) of a token array, in term order.

    Sorting and cutting runs inside the row needs no shuffle, where an explode
    followed by a group-by would move every token.
    """
    def count_runs(ordered):
        starts = F.filter(
            F.sequence(F.lit(0), F.size(ordered) - 1),
            lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))
        return bind(starts, lambda begin_at: F.transform(
            begin_at,
            lambda begin, j: F.struct(
                F.get(ordered, begin).alias("term"),
                (F.coalesce(F.get(begin_at, j + 1), F.size(ordered)) - begin).cast("long").alias("tf"))))

    empty = F.array().cast("array<struct<term:string,tf:bigint>>")
    return bind(token_array, lambda t: F.when(F.size(t) > 0, bind(F.sort_array(t), count_runs)).otherwise(empty))
