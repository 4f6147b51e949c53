"""Document fingerprints: MinHash over word shingles, banded candidates, verified Jaccard.

Words are runs of bytes other than ASCII white space, A-Z lower-cased; a shingle is five words, or
the whole sequence of a shorter text. Each permutation is a universal multiply-shift hash of the
shingle, taken in numpy over many texts at once. A component keeps 16 bits, so a chance match has
odds of 1 in 65,536.

Nulls and odd input: a null text counts as empty; a text without words has the fingerprint ``ffff...``,
like other such texts (1.0) and unlike all else (0.0). Rows with equal ids count singly, ordered by
id, then text; null ids come first. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from rememora.llm import bytewords
from rememora.llm.common import buffers, components, filled, keep_first, slices, table, text_key, type_of
from rememora.session import settle

PERMUTATIONS = 128
SHINGLE = 5
BANDS, ROWS = 25, 5
SIMILARITY = 0.8
CROWD = 1_024
_BLOCK = 1 << 15
_rng = np.random.default_rng(64)
_A = _rng.integers(0, 1 << 63, PERMUTATIONS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, PERMUTATIONS).astype(np.uint64)
_PLACE = _rng.integers(0, 1 << 63, SHINGLE).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every shingle, in text order."""
    data, offsets = buffers(strings)
    data = bytewords.LOWER[data]
    starts, ends, doc = bytewords.spans(data, offsets, ~bytewords.SPACE)
    h = bytewords.hashes(data, starts, ends)
    count = np.bincount(doc, minlength=len(strings)) if len(doc) else np.zeros(len(strings), np.int64)
    out, owner = [], []
    if len(h) >= SHINGLE:
        last = len(h) - SHINGLE + 1
        whole = np.flatnonzero(doc[:last] == doc[SHINGLE - 1:])
        value = np.zeros(len(whole), np.uint64)
        for k in range(SHINGLE):
            value += h[whole + k] * _PLACE[k]
        out.append(value)
        owner.append(doc[whole])
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    if len(short):
        first = np.searchsorted(doc, short)
        value = np.zeros(len(short), np.uint64)
        for k in range(SHINGLE):
            has = count[short] > k
            value[has] += h[first[has] + k] * _PLACE[k]
        out.append(value + count[short].astype(np.uint64))
        owner.append(short)
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value, owner = bytewords.mix(np.concatenate(out)), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return value[order], owner[order]


def signatures(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One row of 16-bit components per text, and whether it has any word."""
    value, owner = shingles(strings)
    low = value & np.uint64(0xFFFFFFFF)
    best = np.full((PERMUTATIONS, len(strings)), np.iinfo(np.uint64).max, np.uint64)
    for begin in range(0, len(low), _BLOCK):
        x, d = low[begin:begin + _BLOCK], owner[begin:begin + _BLOCK]
        cut = np.flatnonzero(np.diff(d, prepend=-1))
        rows = d[cut]
        scratch = np.empty(len(x), np.uint64)
        for k in range(PERMUTATIONS):
            np.multiply(x, _A[k], out=scratch)
            scratch += _B[k]
            best[k, rows] = np.minimum(best[k, rows], np.minimum.reduceat(scratch, cut))
    some = np.zeros(len(strings), bool)
    some[owner] = True
    parts = ((best >> np.uint64(32)) * np.uint64(0x9E3779B1) >> np.uint64(16) & np.uint64(0xFFFF)).astype(">u2").T.copy()
    parts[~some] = 0xFFFF
    return parts, some


def likeness(a: np.ndarray, b: np.ndarray, a_some: np.ndarray, b_some: np.ndarray) -> np.ndarray:
    same = (a == b).mean(axis=1)
    return np.where(a_some & b_some, same, (a_some == b_some).astype(float))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fingerprint)``; no shuffle."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                sig, _ = signatures(filled(part, text_col))
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_col), pa.array([row.tobytes().hex() for row in sig], pa.string())], [id_col, "fingerprint"])

    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {type_of(df, id_col)}, fingerprint string")


def _band_hashes(sig: np.ndarray, some: np.ndarray) -> np.ndarray:
    """One 64-bit bucket per text and band; all bands of a text without words are the bucket zero."""
    parts = sig[:, :BANDS * ROWS].astype(np.uint64).reshape(len(sig), BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)[None].repeat(len(sig), 0)
    for k in range(ROWS):
        h = bytewords.mix(h * _A[k] + parts[:, :, k] + np.uint64(1))
    h[~some] = 0
    return h.view(np.int64)


def _forest(values: np.ndarray, sizes: np.ndarray, comp: np.ndarray, similarity: float):
    """Links ``(i, j)`` that join the sets of one bucket beyond what ``comp`` joins already; no pair is left out.

    A set is compared with all others at once over the postings of its values.
    """
    n, offsets = len(sizes), np.concatenate([[0], np.cumsum(sizes)])
    order = np.argsort(values, kind="stable")
    _, begin, rank, count = np.unique(values[order], return_index=True, return_inverse=True, return_counts=True)
    posting = np.repeat(np.arange(n), sizes)[order]
    of = np.empty(len(values), np.int64)
    of[order] = rank
    comp = comp.copy()
    for x in range(n):
        if (comp == comp[0]).all():
            break
        g = of[offsets[x]:offsets[x + 1]]
        c = count[g]
        at = np.arange(c.sum()) + np.repeat(begin[g] - np.cumsum(c) + c, c)
        both = np.bincount(posting[at], minlength=n)
        union = sizes + sizes[x] - both
        hit = np.flatnonzero((np.where(union > 0, both / np.maximum(union, 1), 1.0) >= similarity) & (comp != comp[x]))
        others, first = np.unique(comp[hit], return_index=True)
        for y in hit[first]:
            yield x, int(y)
        comp[np.isin(comp, others)] = comp[x]


def grouped(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY,
            crowd: int = CROWD, linked: DataFrame | None = None) -> DataFrame:
    """``(id, key, first_id, first_key)`` of every row: its text's key, and the smallest id and key of its group.

    Groups are texts linked by a verified Jaccard of ``similarity`` or more, with candidates per band bucket; a
    pair at 0.8 shares no band once in 20,000. Equal texts are one node. In a bucket every text is verified against
    the first one; a bucket that this leaves in several groups is compared whole, so no link between candidates is lost.
    Such a bucket yields a forest of links, never all its pairs, and one of more than ``crowd`` texts is cut into blocks
    of which every pair is a task's group of its own. Shingles are made for texts that share a bucket only.
    ``linked(a, b)`` adds candidates, pairs of keys, that another method found: the texts linked to one ``b`` share a
    bucket with it and are verified alike, against each other too where the first one is unlike them.
    """
    rows = df.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))

    def banded(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                bands = _band_hashes(*signatures(filled(part, "text")))
                lists = pa.ListArray.from_arrays(np.arange(len(bands) + 1, dtype=np.int32) * BANDS, pa.array(bands.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("key"), lists], ["id", "key", "bands"])

    def shingled(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                value, owner = shingles(filled(part, "text"))
                cut = np.searchsorted(owner, np.arange(part.num_rows + 1))
                sets = [np.unique(value[x:y]).view(np.int64) for x, y in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(sets, pa.list_(pa.int64()))], ["key", "shingles"])

    marked = settle(rows.mapInArrow(banded, f"id {type_of(rows, 'id')}, key binary, bands array<bigint>"), "banded")
    nodes = settle(marked.groupBy("key").agg(F.min("id").alias("first"), F.first("bands").alias("bands")), "nodes")
    buckets = nodes.select("key", F.explode(F.array_distinct("bands")).alias("bucket"))
    if linked is not None:
        ends = linked.select("b", F.explode(F.array("a", "b")).alias("key")).distinct()
        buckets = buckets.unionAll(ends.select("key", F.xxhash64("b").alias("bucket")))
    shared = buckets.groupBy("bucket").agg(F.min("key").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = settle(buckets.join(shared.hint("merge"), "bucket"), "members")
    # one row of each text that shares a bucket; a text of rows without id has the first null
    wanted = nodes.join(members.select("key").distinct(), "key", "left_semi").select("key", "first")
    picked = rows.join(wanted.hint("merge"), (rows["key"] == wanted["key"]) & rows["id"].eqNullSafe(wanted["first"]), "left_semi")
    sets = settle(picked.select("key", "text").mapInArrow(shingled, "key binary, shingles array<bigint>")
                  .groupBy("key").agg(F.first("shingles").alias("shingles")), "shingles")

    def compared(batches):
        def out(rows):
            edge = np.flatnonzero([k == 0 or rows[k][0] != rows[k - 1][0] for k in range(len(rows))])
            for e, f in zip(edge, [*edge[1:], len(rows)]):
                names = [r[1] for r in rows[e:f]]
                _, comp = np.unique(np.array([r[2] for r in rows[e:f]], object), return_inverse=True)
                found = list(_forest(np.concatenate([r[3] for r in rows[e:f]]), np.array([len(r[3]) for r in rows[e:f]]), comp, similarity))
                if found:
                    ends = [(min(names[x], names[y]), max(names[x], names[y])) for x, y in found]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*ends)], ["a", "b"])

        held = []
        for batch in batches:
            flat = batch.column("shingles")
            cut, values = flat.offsets.to_numpy(), flat.values.to_numpy()
            held += zip(batch.column("cell").to_pylist(), batch.column("key").to_pylist(), batch.column("root").to_pylist(),
                        (values[x:y] for x, y in zip(cut, cut[1:])))
            last = next((k for k in range(len(held) - 1, 0, -1) if held[k][0] != held[k - 1][0]), 0)  # the last cell may go on
            yield from out(held[:last])
            held = held[last:]
        yield from out(held)

    left = sets.select(F.col("key").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("key").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb")).cast("double")
    union = F.size("sa") + F.size("sb") - both
    led = members.where(F.col("key") != F.col("leader")).select(F.col("key").alias("a"), F.col("leader").alias("b")).distinct()
    links = settle(led.join(left, "a").join(right, "b").where(F.when(union > 0, both / union).otherwise(F.lit(1.0)) >= similarity)
                   .select("a", "b"), "links")
    joined = components(links).select(F.col("node").alias("key"), "root")
    rooted = settle(members.join(joined, "key", "left").select("bucket", "key", F.coalesce("root", "key").alias("root")), "rooted")
    mixed = (rooted.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("n")).where("x < y")
             .select("bucket", F.ceil(F.col("n") / crowd).cast("int").alias("blocks")))
    mine = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    cells = (rooted.join(mixed.hint("merge"), "bucket")
             .select("bucket", "key", "root", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
             .select(F.concat_ws(":", "bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"), "key", "root"))
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    more = settle(cells.join(sets, "key").select("cell", "key", "root", "shingles").repartition(partitions, "cell")
                  .sortWithinPartitions("cell").mapInArrow(compared, "a binary, b binary"), "more_links")
    links = links.unionAll(more)
    joined = components(links).select(F.col("node").alias("key"), "root")
    rooted = settle(nodes.select("key", "first").join(joined, "key", "left").withColumn("root", F.coalesce("root", "key")), "rooted")
    # a text of rows without id is never the first
    least = rooted.where(F.col("first").isNotNull()).groupBy("root").agg(F.min(F.struct("first", "key")).alias("least"))
    place = rooted.join(least, "root", "left").select("key", F.col("least.first").alias("first_id"), F.col("least.key").alias("first_key"))
    return marked.select("id", "key").join(place, "key").select("id", "key", "first_id", "first_key")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    similarity: float = SIMILARITY) -> DataFrame:
    """``(id, class_id)``: the smallest id of the row's group (see ``grouped``)."""
    return grouped(df, id_col, text_col, similarity).select(F.col("id").alias(id_col), F.col("first_id").alias("class_id"))


def one_per_group(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY,
                  linked: DataFrame | None = None) -> DataFrame:
    """One row of each group, with all its columns: the smallest by id, then text key; rows without an id stay."""
    return keep_first(df, settle(grouped(df, id_col, text_col, similarity, linked=linked), "groups"), id_col, text_key(F.col(text_col)))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(bucket, tail, id, text)``, sorted within their bucket, each bucket followed by a copy of the next one's first row.

    Buckets are id ranges from approximate quantiles; only their bounds and first ids, a few per
    partition, pass through the driver. The copy that closes the last bucket is the table's first row.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = 4 * partitions
    bounds = sorted(set(rows.select(F.col("id").cast("double").alias("x"))
                        .approxQuantile("x", [k / wanted for k in range(1, wanted)], 0.1 / wanted)))
    edges = F.from_json(F.lit(json.dumps(bounds)), "array<double>")  # folds to one constant
    rows = rows.withColumn("bucket", F.coalesce(F.size(F.filter(edges, lambda x: x <= F.col("id").cast("double"))), F.lit(0)))
    firsts = sorted((r["bucket"], r["first"]["has"], r["first"]["id"]) for r in rows.groupBy("bucket").agg(
        F.min(F.struct(F.col("id").isNotNull().alias("has"), "id")).alias("first")).collect())
    copies = spark.createDataFrame([(x[2], before[0]) for before, x in zip([firsts[-1], *firsts], firsts)] if firsts else [],
                                   f"first {type_of(rows, 'id')}, before int")
    # at most one row for each bucket: a proven bound
    led = rows.join(F.broadcast(copies), F.col("id").eqNullSafe(F.col("first")), "left")
    dealt = led.select("id", "text", F.explode(F.array_compact(F.array(
        F.struct(F.col("bucket"), F.lit(False).alias("tail")),
        F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("bucket"), F.lit(True).alias("tail")))))).alias("at"))
    return (dealt.select("at.bucket", "at.tail", "id", "text").repartition(partitions, "bucket")
            .sortWithinPartitions("bucket", "tail", "id", "text"))


def compared_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of each text and of its edited form, whose second half comes from the next document."""
    def run(batches):
        held: tuple | None = None

        def work(rows, closing):
            """``rows``: (bucket, tail, id, text); the last one waits for its successor unless closing."""
            texts = [r[3] for r in rows]
            sig, some = signatures(pa.array(texts, pa.string()))
            at = [i for i in range(len(rows)) if not rows[i][1] and (i + 1 < len(rows) or closing)]
            if not at:
                return None
            after = [i + 1 if i + 1 < len(rows) and rows[i + 1][0] == rows[i][0] else i for i in at]
            edited = []
            for i, j in zip(at, after):
                half = len(texts[i]) // 2
                edited.append(texts[i][:len(texts[i]) - half] + texts[j][:half])
            sig2, some2 = signatures(pa.array(edited, pa.string()))
            return pa.RecordBatch.from_arrays([
                pa.array([rows[i][2] for i in at], id_arrow), pa.array([len(texts[i]) for i in at], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
                pa.array([sig[i].tobytes().hex() for i in at], pa.string()),
                pa.array([x.tobytes().hex() for x in sig2], pa.string()),
                pa.array(likeness(sig[at], sig2, some[at], some2)),
                pa.array(likeness(sig[at], sig[after], some[at], some[after]))], names)

        for batch in batches:
            id_arrow = batch.schema.field("id").type
            for part in slices(batch, "text"):
                rows = list(zip(*(part.column(c).to_pylist() for c in ("bucket", "tail", "id", "text"))))
                rows = [held, *rows] if held else rows
                if (out := work(rows, False)) is not None:
                    yield out
                held = rows[-1]
        if held and (out := work([held], True)) is not None:
            yield out

    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return with_next(docs, id_col, text_col).mapInArrow(run, f"""{id_col} {type_of(docs, id_col)}, n_chars bigint,
        edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double""")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared_with_next(table(spark, sf_dir, "documents"))
