"""Filter interaction audit: what every filter of a chain removes, in every order of the chain.

A task marks which filters each text fails and forgets the text. Rows of one part and one set of
failures are alike, so counts per part and set are all that is left. In each order a set is removed at
the least position of its filters: the min-plus product of the mask matrix (0 where a filter fails, else
infinite) and the matrix of inverse permutations. Counts are scattered to that step, weighted by rows
and labels; redundancies, sole failures and sums over all orders follow from the same steps.

Identical texts are told by 16 bytes of SHA-256 and the smallest id of a text by one aggregate; rows are
joined with it by id and text together, so a crowd of copies never meets in one task.

Nulls and odd input: a null text or part counts as empty. A row without an id copies no other and has no
labels; rows of equal id and text copy each other's smaller ids only, so equal rows share their fate.
Repeated labels of an id count if any of them does. Texts are read whole, long ones in windows. An empty
table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from rememora.llm.common import filled, slices, table, type_of
from rememora.session import settle

FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITALS_PERCENT = 2
SIGNS = b"#$%&*|"
WINDOW = 1 << 20
_CAPITALS = bytes(range(65, 91))
_INNER = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that do not begin a character
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_PARTS = 256


def count_words(text: bytes, window: int = WINDOW) -> tuple[int, int]:
    """Words and distinct words; what is held beside the text is one window and the distinct words."""
    total, seen, at = 0, set(), 0
    while at < len(text):
        end = at + window
        if end < len(text):  # a window ends at white space
            found = _SPACE.search(text, end)
            end = found.start() if found else len(text)
        words = text[at:end].split()  # bytes: ASCII white space only
        total += len(words)
        seen.update(words)
        at = end
    return total, len(seen)


def text_failures(text: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    words, distinct = count_words(text)
    chars = len(text) if text.isascii() else len(text.translate(None, _INNER))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    signs = len(text) - len(text.translate(None, SIGNS))
    return ((words < MIN_WORDS) | (100 * distinct < MIN_DISTINCT_PERCENT * words) << 1
            | (100 * capitals > MAX_CAPITALS_PERCENT * chars) << 2 | (signs > 0) << 3)


def failures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``(id, part, mask)`` of every row: bit k is set if the row fails filter k of ``FILTERS``."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                texts = filled(part, text_col).cast(pa.large_binary()).to_pylist()
                yield pa.RecordBatch.from_arrays([
                    part.column(id_col), part.column(part_col), pa.array(map(text_failures, texts), pa.int32()),
                    pa.array([hashlib.sha256(t).digest()[:16] for t in texts], pa.binary())], ["id", "part", "mask", "key"])

    rows = df.select(id_col, text_col, F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias(part_col))
    marked = settle(rows.mapInArrow(run, f"id {type_of(df, id_col)}, part string, mask int, key binary"), "marked")
    first = marked.where(F.col("id").isNotNull()).groupBy("key").agg(F.min("id").alias("id"), F.lit(True).alias("first"))
    copies = F.col("id").isNotNull() & F.col("first").isNull()
    return marked.join(first, ["id", "key"], "left").select(
        "id", "part", F.col("mask").bitwiseOR(F.when(copies, 1 << 4).otherwise(0)).alias("mask"))


def removal_steps(masks: np.ndarray, n_filters: int) -> tuple[np.ndarray, np.ndarray]:
    """Step (from 0; ``n_filters``: never) at which each set of failures is removed in each order, and the orders.

    ``steps[o, m]`` is the min-plus product over filters of the masks and the orders' inverse permutations.
    """
    orders = np.array(list(permutations(range(n_filters))), np.int64).reshape(-1, n_filters)
    position = np.argsort(orders, axis=1)
    fails = np.where(masks[:, None] >> np.arange(n_filters) & 1, 0, n_filters)
    steps = np.full((len(orders), len(masks)), n_filters, np.int64)
    for f in range(n_filters):
        np.minimum(steps, position[:, f, None] + fails[None, :, f], out=steps)
    return steps, orders


def scattered(weights: np.ndarray, n_filters: int) -> dict[str, np.ndarray]:
    """Counts ``[part, order, step]`` from ``weights[part, mask, (rows, good, toxic)]``."""
    masks = np.arange(1 << n_filters)
    steps, orders = removal_steps(masks, n_filters)
    at = np.zeros((len(weights), len(orders), n_filters + 1, weights.shape[2]), np.int64)
    row = np.arange(len(orders))
    for m in masks:  # one step per order, so no place is written twice
        at[:, row, steps[:, m]] += weights[:, m, None]
    removed = at[:, :, :n_filters]
    bit = masks[:, None] >> np.arange(n_filters) & 1
    failing = np.einsum("pm,mf->pf", weights[:, :, 0], bit)
    by_filter = np.zeros((len(weights), n_filters), np.int64)
    for f in range(n_filters):
        by_filter[:, f] = removed[:, orders == f, 0].sum(axis=1)
    return {
        "kept": weights[:, :, 0].sum(axis=1)[:, None, None] - np.cumsum(removed[..., 0], axis=2), "removed": removed[..., 0],
        "redundant": failing[:, orders] - removed[..., 0], "unique_fails": weights[:, 1 << np.arange(n_filters), 0][:, orders],
        "good_lost": removed[..., 1], "toxic_lost": removed[..., 2], "shapley": by_filter[:, orders]}


COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audit(marked: DataFrame, filters: str = FILTERS) -> DataFrame:
    """``(part, filter_order, step, *COUNTS)`` from rows ``(part, mask, good, toxic)``; filters are named by single letters.

    All orders are listed, so ``filters`` must be few; a part sends one row per set of failures it holds.
    """
    n_filters = len(filters)
    names = ["".join(o) for o in permutations(filters)]

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, _PARTS):
                rows = batch.slice(begin, _PARTS)
                weights = np.zeros((rows.num_rows, 1 << n_filters, 3), np.int64)
                cut, flat = rows.column("sets").offsets.to_numpy(), rows.column("sets").values
                owner = np.repeat(np.arange(rows.num_rows), np.diff(cut))
                inner = slice(cut[0], cut[-1])
                for k, c in enumerate(["n", "good", "toxic"]):
                    weights[owner, flat.field("mask").to_numpy()[inner], k] = flat.field(c).to_numpy()[inner]
                got, each = scattered(weights, n_filters), len(names) * n_filters
                yield pa.RecordBatch.from_arrays([
                    rows.column("part").take(pa.array(np.repeat(np.arange(rows.num_rows), each))),
                    pa.array(np.repeat(names, n_filters).tolist() * rows.num_rows, pa.string()),
                    pa.array(np.tile(np.arange(1, n_filters + 1, dtype=np.int32), rows.num_rows * len(names))),
                    *(pa.array(got[c].ravel()) for c in COUNTS)], ["part", "filter_order", "step", *COUNTS])

    sets = marked.groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("good"), F.sum(F.col("toxic").cast("long")).alias("toxic"))
    # at most one entry for each set of failures
    per_part = sets.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("sets"))
    return per_part.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in COUNTS))


def labelled(marked: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``failures`` with ``good`` and ``toxic``: whether any label of the id says so."""
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    return marked.join(marks, "id", "left").select(
        "part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(labelled(failures(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")))


_POSITIONS = ", ".join(f"CASE WHEN fails_{f.lower()} THEN strpos(filter_order, '{f}') ELSE 9 END" for f in FILTERS)
_OWN = " ".join(f"WHEN '{f}' THEN fails_{f.lower()}" for f in FILTERS)
_COUNT = " + ".join(f"fails_{f.lower()}::INT" for f in FILTERS)
SQL = f"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
failing AS (
  SELECT doc_id, part, len(words) < {MIN_WORDS} AS fails_a,
         100 * len(list_distinct(words)) < {MIN_DISTINCT_PERCENT} * len(words) AS fails_b,
         100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > {MAX_CAPITALS_PERCENT} * length(body) AS fails_c,
         regexp_matches(body, '[{SIGNS.decode()}]') AS fails_d,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY body), false) AS fails_e FROM docs),
marks AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS bad FROM labels GROUP BY 1),
sets AS (
  SELECT part, {", ".join(f"fails_{f.lower()}" for f in FILTERS)}, count(*) AS n,
         sum(coalesce(good, false)::INT) AS good, sum(coalesce(bad, false)::INT) AS bad
  FROM failing LEFT JOIN marks USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(['{"', '".join(FILTERS)}']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = {len(FILTERS)}),
placed AS (SELECT *, least({_POSITIONS}) AS gone FROM sets, orders),
stepped AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS own,
         sum(n) FILTER (gone > step) AS kept, sum(n) FILTER (gone = step) AS removed,
         sum(n) FILTER (gone < step AND CASE substr(filter_order, step, 1) {_OWN} END) AS redundant,
         sum(n) FILTER ({_COUNT} = 1 AND CASE substr(filter_order, step, 1) {_OWN} END) AS unique_fails,
         sum(good) FILTER (gone = step) AS good_lost, sum(bad) FILTER (gone = step) AS toxic_lost
  FROM placed, (SELECT unnest(range(1, {len(FILTERS) + 1})) AS step) GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, {", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in COUNTS[:-1])},
       coalesce(sum(removed) OVER (PARTITION BY part, own), 0)::BIGINT AS shapley
FROM stepped
"""
