"""WARC archives: records written and read back by Spark, their index merged from sorted runs.

Each page is one record of WARC/1.1 text; Spark's text writer ends it with the blank line that the
format asks for, so archives land wherever Spark can write. Reading walks the records by their
Content-Length. Every archive gives a run of index entries sorted by URL key and timestamp; the runs
are range-partitioned by that order and each range is merged by a loser tree over its runs, so the
partitions in order are the global capture history.

Of equal payloads of at least ``min_revisit`` bytes the smallest page id holds the response and the
others revisit it. Nulls and odd input: a null html is an empty payload, a null url an empty target;
rows with the smallest id are all responses if that id repeats; a null id is never referred to. An
empty table gives no rows. Pages carry no time, so ``timestamp`` defaults to a date derived from the id.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rememora.llm.common import table, type_of
from rememora.session import scratch_path, settle

MIN_REVISIT = 100
RECORDS_PER_FILE = 4_000
BREAK = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EPOCH_2024 = 1704067200


def _record(kind: Column, page_id: Column, refers: Column, url: Column, at: Column, digest: Column, payload: Column) -> Column:
    size = F.octet_length(payload).cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=UTF-8{BREAK}Content-Length: "),
                    size, F.lit(BREAK + BREAK))
    block = F.when(kind == "response", F.concat(http, payload)).otherwise(http)
    urn = lambda x: F.concat(F.lit("<urn:page:"), x.cast("string"), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(BREAK))
    return F.concat(
        F.lit(f"WARC/1.1{BREAK}"), line("WARC-Type", kind), line("WARC-Record-ID", F.coalesce(urn(page_id), F.lit("<urn:page:>"))),
        line("WARC-Date", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")), line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        F.coalesce(F.concat(line("WARC-Refers-To", urn(refers)), line("WARC-Profile", F.lit(PROFILE))), F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit(BREAK), block)


def write_archives(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   timestamp: Column | None = None, min_revisit: int = MIN_REVISIT) -> None:
    """Write one record per row below ``path``. Only digests are grouped; payloads meet just the list of repeated digests."""
    at = F.timestamp_seconds(F.lit(_EPOCH_2024) + F.coalesce(F.pmod(F.col(id_col), F.lit(31_536_000)), F.lit(0))) if timestamp is None else timestamp
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = df.select(
        F.col(id_col).alias("id"), payload.alias("payload"), at.alias("at"), F.sha2(payload, 256).alias("digest"),
        F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\x00-\x20\x7f]", "%20").alias("url"))
    shared = settle(rows.where(F.octet_length("payload") >= min_revisit).groupBy("digest")
                    .agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "digests")
    told = rows.join(shared, "digest", "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    kind = F.when(refers.isNotNull(), "revisit").otherwise("response")
    (told.select(_record(kind, F.col("id"), refers, F.col("url"), F.col("at"), F.col("digest"), F.col("payload")))
     .write.option("lineSep", BREAK + BREAK).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))


def url_key(url: str) -> str:
    """Host labels from the right, then the rest of the address, without scheme and fragment."""
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)([^#]*)", url)
    return ",".join(reversed(m[1].lower().split("."))) + ")" + (m[2] or "/")


def records(archive: bytes):
    """``(offset, headers, block)`` of every record of an uncompressed archive."""
    at, end = 0, (BREAK + BREAK).encode()
    while at < len(archive):
        head = archive.index(end, at)
        headers = dict(line.split(b": ", 1) for line in archive[at:head].split(b"\r\n")[1:])
        begin = head + 4
        size = int(headers[b"Content-Length"])
        if archive[begin + size:begin + size + 4] != end:
            raise ValueError(f"record at {at} does not end where its length says")
        yield at, headers, archive[begin:begin + size]
        at = begin + size + 4


INDEX = """run string, url_key string, at string, page_id bigint, offset bigint, record_type string, payload_bytes bigint,
    payload_digest string, refers_to bigint"""


def index_runs(spark: SparkSession, path: str) -> DataFrame:
    """One sorted run of index entries per archive file; payloads of responses are hashed anew."""
    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                archive = zlib.decompress(content, 47) if content[:2] == b"\x1f\x8b" else content
                page = lambda x: int(x[10:-1]) if x and x[10:-1] else None
                rows = []
                for offset, h, block in records(archive):
                    kind = h[b"WARC-Type"].decode()
                    head = block.index(b"\r\n\r\n") + 4
                    if kind == "response":
                        size, digest = len(block) - head, hashlib.sha256(block[head:]).hexdigest()
                    else:
                        size = int(re.search(rb"Content-Length: (\d+)", block[:head])[1])
                        digest = h[b"WARC-Payload-Digest"].decode().removeprefix("sha256:")
                    rows.append((name, url_key(h.get(b"WARC-Target-URI", b"").decode()), h[b"WARC-Date"].decode(),
                                 page(h[b"WARC-Record-ID"].decode()), offset, kind, size, digest,
                                 page(h.get(b"WARC-Refers-To", b"").decode())))
                rows.sort(key=_order)
                for begin in range(0, len(rows), 10_000):
                    yield _batch(rows[begin:begin + 10_000])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, INDEX)


_FIELDS = [("run", pa.string()), ("url_key", pa.string()), ("at", pa.string()), ("page_id", pa.int64()), ("offset", pa.int64()),
           ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in _FIELDS]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS)], [n for n, _ in _FIELDS])


def _order(row: tuple):
    return row[1].encode(), row[2], -1 if row[3] is None else row[3], row[0], row[4]


def loser_tree(runs: list[list[tuple]], key=_order):
    """Merge sorted runs: inner nodes hold the losers, each step replays one path from leaf to root."""
    k = len(runs)
    if not k:
        return
    ended = (1,)
    at = [0] * k
    head = [(0, key(r[0])) if r else ended for r in runs]
    tree = [-1] * k

    def replay(leaf: int) -> int:
        winner, node = leaf, (leaf + k) // 2
        while node:
            if tree[node] < 0:
                tree[node] = winner
                return -1
            if head[tree[node]] < head[winner]:
                tree[node], winner = winner, tree[node]
            node //= 2
        return winner

    winner = -1
    for leaf in range(k):
        winner = max(winner, replay(leaf)) if k > 1 else 0
    while head[winner] != ended:
        yield runs[winner][at[winner]]
        at[winner] += 1
        head[winner] = (0, key(runs[winner][at[winner]])) if at[winner] < len(runs[winner]) else ended
        winner = replay(winner) if k > 1 else 0


def merge_index(runs: DataFrame) -> DataFrame:
    """All entries, ordered by URL key, time and id within and across partitions, with their ``position``."""
    def run(batches):
        from pyspark import TaskContext

        found: list[list[tuple]] = []
        last = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                order = _order(row)
                # rows of one run arrive in its order; a step back opens the next stretch
                if last is None or order < last or row[0] != found[-1][-1][0]:
                    found.append([])
                found[-1].append(row)
                last = order
        position, held = TaskContext.get().partitionId() << 40, []
        for row in loser_tree(found):
            held.append(row)
            if len(held) == 10_000:
                yield numbered(held, position)
                position, held = position + len(held), []
        if held:
            yield numbered(held, position)

    def numbered(rows, position):
        batch = _batch(rows)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(range(position, position + len(rows)), pa.int64())],
                                          [*batch.schema.names, "position"])

    partitions = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (runs.repartitionByRange(partitions, "url_key", "at", F.coalesce("page_id", F.lit(-1)), "run", "offset")
            .mapInArrow(run, INDEX + ", position bigint"))


def archive(df: DataFrame, **columns) -> DataFrame:
    """Write the rows as archives in the scratch folder and return their merged index."""
    spark = df.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(df, path, **columns)
    return merge_index(settle(index_runs(spark, path), "runs"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) END AS first FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""
