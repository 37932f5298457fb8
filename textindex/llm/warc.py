"""Pages in WARC files, with an index and reads by byte range.

Writing: every task writes one archive of records, each a gzip member of its own, and returns a
row for each record: file, offset, length, URL and digest. That index is a table. Reading: the
index rows wanted are sorted by file and offset and cut into spans; a task reads a span's
ranges, neighbours together, and parses the records.

Equal payloads of at least `least` bytes are stored once: the record of the smallest page id
is the response, the others are revisit records that refer to it.
"""

from __future__ import annotations

import hashlib
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import open_store, shared_dir, shared_table, table

LEAST = 100
SPAN = 4 << 20
GAP = 64 << 10
DATE = "2024-01-01T00:00:00Z"
INDEX = "page_id bigint, url string, payload_digest string, record_type string, refers_to bigint, file string, offset bigint, length bigint"


def _urn(page_id: int | None, which: str) -> str:
    """A response is told by its page and digest, so that revisits can name it; a revisit's is its own."""
    return f"<urn:x-page:{'null' if page_id is None else page_id}:{which}>"


def _page(urn: str) -> int | None:
    return None if (x := urn.strip("<>").split(":")[2]) == "null" else int(x)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One record, compressed. A revisit keeps the HTTP head, which has the payload's length, and not the payload."""
    revisit = refers_to is not None
    target = urllib.parse.quote(url or "about:blank", safe="%:/?#[]@!$&'()*+,;=-._~")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page_id, uuid.uuid4().hex if revisit else digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
        *([f"WARC-Refers-To: {_urn(refers_to, digest)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    squeeze = zlib.compressobj(3, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def parse(member: bytes) -> dict:
    """The fields of a record; the payload and its digest are checked where the record has them."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)\r\ncontent-length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].partition(":")[2]
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    refers = fields.get("WARC-Refers-To")
    return {"page_id": _page(fields["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": _page(refers) if refers else None, "payload": payload if kind == "response" else None}


def write_archives(pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html); returns the index, read from a shared table.

    File names are unique to the attempt and only finished tasks' rows are in the index, so
    what a lost executor wrote is never read. A null html is an empty payload, a null url about:blank;
    null ids never hold the response of others, and where all of a payload are null, each is a response; rows that repeat an id
    and a payload are all responses if the id is the smallest. Payloads are written whole, however long. An empty table
    gives an empty index; other columns, clashing names too, aren't read.
    """
    spark = pages.sparkSession
    p = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("n", F.octet_length("html"))
    # map-side sums first: a payload that a third of the pages share meets as one row a task
    shared = p.where(F.col("n") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    shared = shared_table(shared.where("copies > 1 and first is not null").select(F.col("digest").alias("d"), "first"), "warc-shared", spark)
    p = p.join(shared, F.col("digest") == F.col("d"), "left")  # by a sort-merge join with split skew, or a broadcast if the table is below Spark's own limit
    p = p.withColumn("refers_to", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first")))
    p = p.select("page_id", "url", "html", "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = open_store(folder)
        out, name, offset = None, "", 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                name = f"{uuid.uuid4().hex}.warc.gz"
                fs.create_dir(at, recursive=True)
                out = fs.open_output_stream(f"{at}/{name}", compression=None)
            page, url, _, digest, refers = (batch.column(i).to_pylist() for i in range(5))
            offsets, lengths = [], []
            for i, html in enumerate(batch.column(2)):
                raw = record(page[i], url[i], html.as_py().encode("utf-8", "surrogatepass"), digest[i], refers[i])
                out.write(raw)
                offsets.append(offset)
                lengths.append(len(raw))
                offset += len(raw)
            yield pa.RecordBatch.from_pydict({"page_id": pa.array(page, pa.int64()), "url": pa.array(url, pa.string()), "payload_digest": pa.array(digest, pa.string()), "record_type": pa.array(["response" if r is None else "revisit" for r in refers], pa.string()), "refers_to": pa.array(refers, pa.int64()), "file": pa.array([name] * len(page), pa.string()), "offset": pa.array(offsets, pa.int64()), "length": pa.array(lengths, pa.int64())})
        if out is not None:
            out.close()

    return shared_table(p.mapInArrow(run, INDEX), "warc-index", spark)


def read_records(index: DataFrame, folder: str, span: int = SPAN, gap: int = GAP) -> DataFrame:
    """Read the records of these index rows (all, or any selection) and parse them.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits).
    A file is cut into spans of offsets; ranges of a span that lie less than `gap` apart are read at once.
    """
    todo = index.select("file", F.floor(F.col("offset") / span).alias("span"), "offset", "length")
    # as many tasks as spans: the index rows are small, what they stand for is not
    tasks = (index.agg(F.sum("length")).first()[0] or 0) // span + 1
    todo = todo.repartition(tasks, "file", "span").sortWithinPartitions("file", "offset")

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[tuple[int, int]]]]:
        """(file, end, ranges) of neighbours."""
        file, end, held = None, 0, []
        for batch in batches:
            for f, o, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if held and (f != file or o - end > gap or o + n - held[0][0] > span):
                    yield file, end, held
                    held = []
                file, end = f, o + n
                held.append((o, n))
        if held:
            yield file, end, held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = open_store(folder)
        for file, end, ranges in spans(batches):
            with fs.open_input_file(f"{at}/{file}") as f:
                first = ranges[0][0]
                raw = f.read_at(end - first, first)
            for k in range(0, len(ranges), 500):
                got = [parse(raw[o - first : o - first + n]) for o, n in ranges[k : k + 500]]
                yield pa.RecordBatch.from_pylist(got, schema=pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]))

    return todo.mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "warc")
    index = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_records(index, folder).drop("payload")


OP4_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""
