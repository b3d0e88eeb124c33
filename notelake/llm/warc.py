"""WARC archives, written and read as chunked records.

``write_archives`` writes one record for each page: a response with its payload, or a revisit that refers to
the response with the equal payload. Every task writes a file of its own, named by its attempt; the manifest
that Spark commits names the files of the attempts that count, so a repeated task does no harm. It has one row
for each segment of a file, of ``segment_bytes`` or one record, and segments are what later tasks read.

``read_archives`` gives the chunked record table: a row for each ``chunk_bytes`` of a payload with the record's
identifier, the chunk's number, and the SHA-1 and length of all payload up to the chunk's end. A payload is
read, digested and handed on chunk by chunk; no record is held whole. The last chunk has the full digest.

Files are reached through ``pyarrow.fs``, by the address of the shared folder (file, hdfs, s3, gs). Batches on their way to
a file are bounded by bytes (``BYTES_PER_BATCH``) as well as rows.

Payloads stay where they are read, but for what is written twice: bitmaps of fixed size tell tasks which digests are
shared and which rows hold their response. Only those rows are joined, the others among them without their payload.

Record identifiers are unique, whatever ids repeat: (record_id, chunk_no) is a key. A revisit names the page of its
response in X-Refers-To-Page, and the digest that both have.

Null payloads count as empty. A page without an id is written and never referred to. Rows that repeat an id
and payload are responses together if they hold the largest id; so are pages that tie for it. Very long payloads are
written and read in chunks. An empty table gives an empty archive. Columns of the input other than page_id, url, html are
ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm.common import bitmap_of, materialise, shared_folder, table

#: Shorter payloads are written again rather than referred to.
LEAST_SHARED = 1000
WARC_DATE = "2024-01-01T00:00:00Z"
CHUNKS = "page_id long, record_id string, url string, record_type string, refers_to long, chunk_no long, chunk_bytes long, payload_bytes long, payload_digest string, last boolean, data binary"
_CHUNK_ARROW = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk_no", pa.int64()), ("chunk_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("last", pa.bool_()), ("data", pa.binary())])
_MANIFEST_ARROW = pa.schema([("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("records", pa.int64())])


def filesystem(address: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(address)


def line_safe(value: str) -> str:
    """A header's value must stay on its line."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def line_value(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record_head(record_id: str, page_id: int | None, url: str | None, kind: str, refers_to: int | None, digest: str, length: int) -> bytes:
    """The WARC header and the start of the block: the HTTP header, after which a response's payload follows."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = len(http) + (length if kind == "response" else 0)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {WARC_DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {line_safe(url)}")
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {block}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + http


def with_record_types(pages: DataFrame, least_shared: int = LEAST_SHARED) -> DataFrame:
    """page_id, url, payload (null for a revisit), size, digest, record_type, refers_to: the largest page_id of equal payloads is the response."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", html.alias("payload")).select("*", F.octet_length("payload").cast("long").alias("size"), F.sha1("payload").alias("digest"))
    sized = pages.select("page_id", html.alias("payload")).where(F.octet_length("payload") >= least_shared)
    heads = sized.groupBy(F.sha1("payload").alias("digest")).agg(F.max("page_id").alias("head"), F.count("*").alias("n")).where("n > 1 and head is not null").drop("n")
    heads = materialise(heads, "warc-heads")  # a join of two shuffles is split where a digest is frequent
    shared_digests, responses = bitmap_of(heads.select(F.xxhash64("digest").alias("h")), "h"), bitmap_of(heads.select(F.xxhash64("digest", "head").alias("h")), "h")
    bits = len(responses)
    known = pages.sparkSession.sparkContext.broadcast((np.packbits(shared_digests), np.packbits(responses)))

    @F.pandas_udf("struct<shared: boolean, response: boolean>")
    def may_be(of_digest: pd.Series, of_row: pd.Series) -> pd.DataFrame:
        both = [np.unpackbits(x).astype(bool) for x in known.value]
        return pd.DataFrame({"shared": both[0][of_digest.to_numpy() % bits], "response": both[1][of_row.to_numpy() % bits]})

    rows = rows.withColumn("may", may_be(F.xxhash64("digest"), F.xxhash64("digest", "page_id")))
    again = F.col("head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("head"))
    kind = F.when(again, "revisit").otherwise("response").alias("record_type")
    columns = ["page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "size", "digest", kind, F.when(again, F.col("head")).alias("refers_to")]
    alone = rows.where("not may.shared").withColumn("head", F.lit(None).cast("long")).select(*columns)
    # A row that is no response of a shared digest needs no payload, unless its digest passed the bitmap by chance.
    candidates = rows.where("may.shared")
    light = candidates.where("not may.response").drop("payload").join(heads, "digest").withColumn("payload", F.lit(None).cast("binary")).select(*columns)
    full = candidates.where("may.response").join(heads, "digest", "left").select(*columns)
    chance = candidates.where("not may.response").join(heads, "digest", "left_anti").withColumn("head", F.lit(None).cast("long")).select(*columns)
    return alone.unionByName(light).unionByName(full).unionByName(chance)


def write_archives(records: DataFrame, folder: str, segment_bytes: int = 8 << 20) -> DataFrame:
    """Writes what ``with_record_types`` gives below ``folder``; returns the manifest: path, start, end, records."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = filesystem(folder)
        path, out, rows, start, at, nth, total = f"{root}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc", None, [], 0, 0, 0, 0
        for batch in batches:
            if out is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(path, buffer_size=1 << 20)
            payloads = batch.column("payload")
            for i, (page_id, url, size, digest, kind, refers_to) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "size", "digest", "record_type", "refers_to")), strict=True)):
                head = record_head(f"urn:record:{task.partitionId()}:{task.taskAttemptId()}:{total}", page_id, url, kind, refers_to, digest, size)
                out.write(head)
                if kind == "response":
                    out.write(payloads[i].as_buffer())
                out.write(b"\r\n\r\n")
                at += len(head) + (size if kind == "response" else 0) + 4
                nth += 1
                total += 1
                if at - start >= segment_bytes:
                    rows.append((path, start, at, nth))
                    start, nth = at, 0
        if out is not None:
            out.close()
            if nth:
                rows.append((path, start, at, nth))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _MANIFEST_ARROW, strict=True)], schema=_MANIFEST_ARROW)

    return materialise(records.mapInArrow(written, "path string, start long, end long, records long"), "warc-manifest")


def header_lines(stream) -> dict[str, str]:
    found = {}
    while (line := stream.readline()) not in (b"\r\n", b""):
        name, _, value = line.decode("utf-8").rstrip("\r\n").partition(": ")
        found[name.lower()] = value
    return found


def record_chunks(stream, chunk_bytes: int, with_data: bool) -> Iterator[tuple]:
    """The rows of the record that begins where ``stream`` stands, which then stands behind it."""
    head = header_lines(stream)
    left = int(head["content-length"])
    begun = stream.tell()
    http = header_lines(stream)
    left -= stream.tell() - begun
    page_id = int(head["x-page-id"]) if "x-page-id" in head else None
    url = line_value(head["warc-target-uri"]) if "warc-target-uri" in head else None
    same = (page_id, head["warc-record-id"].strip("<>"), url, head["warc-type"])
    if head["warc-type"] == "revisit":
        yield (*same, int(head["x-refers-to-page"]), 0, 0, int(http["content-length"]), head["warc-payload-digest"].partition(":")[2], True, b"" if with_data else None)
    else:
        digest, nth, upto = hashlib.sha1(usedforsecurity=False), 0, 0
        while left or not nth:
            piece = stream.read(min(left, chunk_bytes)) if left else b""
            if left and not piece:
                raise EOFError(f"record {same[1]} is cut off")
            digest.update(piece)
            upto += len(piece)
            left -= len(piece)
            yield (*same, None, nth, len(piece), upto, digest.copy().hexdigest(), not left, piece if with_data else None)
            nth += 1
        if digest.hexdigest() != head["warc-payload-digest"].partition(":")[2]:
            raise ValueError(f"record {same[1]} has another digest than its header says")
    if stream.read(4) != b"\r\n\r\n":
        raise ValueError(f"record {same[1]} has another length than its header says")


def read_archives(manifest: DataFrame, folder: str, chunk_bytes: int = 256 << 10, with_data: bool = True, tasks: int | None = None) -> DataFrame:
    """The chunked record table of the archives that ``manifest`` names."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(folder)
        rows, held = [], 0

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _CHUNK_ARROW, strict=True)], schema=_CHUNK_ARROW)

        for batch in batches:
            for path, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end")), strict=True):
                with store.open_input_file(path) as file:
                    reader = _Lines(file, start)
                    while reader.tell() < end:
                        for row in record_chunks(reader, chunk_bytes, with_data):
                            rows.append(row)
                            held += row[6] + 200
                            if held >= 4 << 20:
                                yield batch_of(rows)
                                rows, held = [], 0
        if rows:
            yield batch_of(rows)

    spark = manifest.sparkSession
    tasks = tasks or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return manifest.repartition(tasks).mapInArrow(chunks, CHUNKS)


class _Lines:
    """readline, read and tell over a random-access file from ``start`` on, through a buffer of 1 MB."""

    def __init__(self, file, start: int, size: int = 1 << 20) -> None:
        self.file, self.size, self.buffer, self.at, self.pos = file, size, b"", 0, start
        file.seek(start)

    def tell(self) -> int:
        return self.pos

    def more(self) -> bool:
        self.buffer, self.at = self.buffer[self.at :] + self.file.read(self.size), 0
        return bool(self.buffer)

    def read(self, n: int) -> bytes:
        while len(self.buffer) - self.at < n:
            had = len(self.buffer) - self.at
            self.more()
            if len(self.buffer) == had:
                break
        out = self.buffer[self.at : self.at + n]
        self.at += len(out)
        self.pos += len(out)
        return out

    def readline(self) -> bytes:
        while (end := self.buffer.find(b"\n", self.at)) < 0:
            had = len(self.buffer) - self.at
            self.more()
            if len(self.buffer) == had:
                return self.read(had)
        return self.read(end + 1 - self.at)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "warc")
    manifest = write_archives(with_record_types(table(spark, sf_dir, "pages")), folder)
    chunks = read_archives(manifest, folder, with_data=False)
    return chunks.where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = f"""
WITH p AS (SELECT page_id, CAST(strlen(COALESCE(html, '')) AS BIGINT) AS payload_bytes, sha1(COALESCE(html, '')) AS payload_digest FROM pages),
h AS (SELECT payload_digest, MAX(page_id) AS head FROM p WHERE payload_bytes >= {LEAST_SHARED} GROUP BY 1 HAVING COUNT(*) > 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN head IS NOT NULL AND page_id IS DISTINCT FROM head THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN head IS NOT NULL AND page_id IS DISTINCT FROM head THEN head END AS refers_to
FROM p LEFT JOIN h USING (payload_digest)
"""
