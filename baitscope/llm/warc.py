"""Operator 4: WARC archives written and read as a chunked record table.

A payload is cut into rows (record id, chunk number, bytes).  Each chunk is one
WARC 1.1 record: the first a response, the others continuation records with
segment numbers.  Records with equal payloads of at least ``least`` bytes are
written once; the rest become revisit records.  Reading streams an archive through
a decompressor, holds one chunk at a time, and carries a running SHA-256 from one
chunk of a payload to the next.

Edge cases: a null payload counts as empty and gives one empty chunk; a null
record key is always a response; a repeated row of the smallest key is a response
as well; line breaks in a URL are percent-encoded.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from baitscope.llm.common import scratch, workers_import

#: Bytes of a chunk; least payload that is revisited; bytes decompressed at a time.
CHUNK_BYTES, LEAST_BYTES, STEP = 64 << 10, 100, 1 << 20
PROFILE = "http://netpreservefoundation.org/warc/1.1/revisit/identical-payload-digest"
CHUNK_SCHEMA = ("page_id long, chunk_no long, n_bytes long, data binary, payload_bytes long, running_sha256 string, "
                "last boolean, record_type string, refers_to long, declared_sha256 string")


def chunk_table(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES, least: int = LEAST_BYTES) -> DataFrame:
    """One row for each chunk of each payload that is written: page_id, chunk_no, chunks, data and the record's fields."""
    rows = pages.select(
        F.col("page_id").cast("long"), F.col("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    firsts = (rows.where(F.col("payload_bytes") >= least).groupBy("digest")
              .agg(F.min("page_id").alias("first"), F.max("page_id").alias("other"))
              .where("first < other").select("digest", "first"))
    rows = rows.join(firsts, "digest", "left")
    again = F.coalesce((F.col("payload_bytes") >= least) & (F.col("page_id") > F.col("first")), F.lit(False))
    rows = rows.withColumn("refers_to", F.when(again, F.col("first")))
    count = F.greatest(F.lit(1), F.ceil(F.col("payload_bytes") / chunk_bytes)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1),
                      lambda k: F.substring(F.col("payload"), k * chunk_bytes + 1, F.lit(chunk_bytes)))
    rows = rows.select("page_id", "url", "payload_bytes", "digest", "refers_to",
                       F.when(again, F.array(F.lit(b""))).otherwise(cut).alias("parts"))
    return rows.select("page_id", "url", "payload_bytes", "digest", "refers_to", F.size("parts").alias("chunks"),
                       F.posexplode("parts").alias("chunk_no", "data"))


def write_archives(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", chunk_bytes: int = CHUNK_BYTES,
                   least: int = LEAST_BYTES) -> None:
    """Write gzip-compressed WARC files, one for each task; the chunks of a payload follow each other in one file."""
    c = F.col
    urn = lambda key, k: F.concat(F.lit("<urn:page:"), F.coalesce(key.cast("string"), F.lit("null")), F.lit(":"), k.cast("string"), F.lit(">"))
    kind = F.when(c("refers_to").isNotNull(), "revisit").when(c("chunk_no") > 0, "continuation").otherwise("response")
    line = lambda name, value, when=F.lit(True): F.when(when, F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")
    url = F.replace(F.replace(c("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    many = c("chunks") > 1
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", kind), line("WARC-Record-ID", urn(c("page_id"), c("chunk_no"))),
        line("WARC-Date", F.lit(date)), line("WARC-Target-URI", url, c("url").isNotNull()),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), c("digest"))),
        line("WARC-Refers-To", urn(c("refers_to"), F.lit(0)), c("refers_to").isNotNull()),
        line("WARC-Profile", F.lit(PROFILE), c("refers_to").isNotNull()),
        line("WARC-Segment-Number", (c("chunk_no") + 1).cast("string"), many),
        line("WARC-Segment-Origin-ID", urn(c("page_id"), F.lit(0)), c("chunk_no") > 0),
        line("WARC-Segment-Total-Length", c("payload_bytes").cast("string"), many & (c("chunk_no") == c("chunks") - 1)),
        line("X-Payload-Length", c("payload_bytes").cast("string")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.octet_length("data").cast("string")), F.lit("\r\n"))
    records = chunk_table(pages, chunk_bytes, least).select(F.concat(F.encode(head, "UTF-8"), c("data")).cast("string"))
    # A record ends with two line breaks, which the writer of text files puts after each value.
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


class ArchiveReader:
    """Reads records one after the other from a compressed archive, a step of bytes at a time."""

    def __init__(self, content: bytes) -> None:
        self.view, self.at = memoryview(content), 0
        self.packed = content[:2] == b"\x1f\x8b"
        self.inflate = zlib.decompressobj(31)
        self.held = bytearray()

    def _more(self) -> bool:
        if self.packed and self.inflate.eof:
            rest = self.inflate.unused_data
            self.at -= len(rest)
            self.inflate = zlib.decompressobj(31)
        tail = self.inflate.unconsumed_tail if self.packed else b""
        if not tail and self.at >= len(self.view):
            return False
        if not tail:
            tail = bytes(self.view[self.at:self.at + STEP])
            self.at += len(tail)
        self.held += self.inflate.decompress(tail, STEP) if self.packed else tail
        return True

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        while True:
            while (end := self.held.find(b"\r\n\r\n")) < 0:
                if not self._more():
                    if self.held.strip():
                        raise ValueError("the archive ends within a record's head")
                    return
            lines = bytes(self.held[:end]).decode("utf-8").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("no WARC record")
            fields = dict(x.split(": ", 1) for x in lines[1:])
            size = int(fields["Content-Length"])
            while len(self.held) < end + 8 + size:
                if not self._more():
                    raise ValueError("the archive ends within a record")
            yield fields, bytes(self.held[end + 4:end + 4 + size])
            del self.held[:end + 8 + size]


def chunk_rows(content: bytes) -> Iterator[tuple]:
    """The rows of ``CHUNK_SCHEMA`` of one archive."""
    digest, done = hashlib.sha256(), 0
    key = lambda urn: None if urn == "null" else int(urn)
    for fields, data in ArchiveReader(content).records():
        page, k = fields["WARC-Record-ID"][len("<urn:page:"):-1].rsplit(":", 1)
        declared = fields["WARC-Payload-Digest"].removeprefix("sha256:")
        if fields["WARC-Type"] == "revisit":
            origin = fields["WARC-Refers-To"][len("<urn:page:"):-1].rsplit(":", 1)[0]
            yield key(page), 0, 0, b"", int(fields["X-Payload-Length"]), declared, True, "revisit", key(origin), declared
            continue
        if k == "0":
            digest, done = hashlib.sha256(), 0
        digest.update(data)
        done += len(data)
        last = "WARC-Segment-Number" not in fields or "WARC-Segment-Total-Length" in fields
        yield key(page), int(k), len(data), data, done, digest.copy().hexdigest(), last, "response", None, declared


def read_chunks(spark: SparkSession, path: str, with_data: bool = True) -> DataFrame:
    """The chunked record table of all archives of a folder; ``payload_bytes`` and ``running_sha256`` run up to each chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in CHUNK_SCHEMA.split(", ")]
        kinds = [{"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}[f.split()[1]]
                 for f in CHUNK_SCHEMA.split(", ")]
        held, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*held, strict=True), kinds, strict=True)], names)

        for got in batches:
            for i in range(got.num_rows):
                for row in chunk_rows(got.column("content")[i].as_py()):
                    held.append(row if with_data else (*row[:3], None, *row[4:]))
                    size += row[2] * with_data + 200
                    if size > 8 << 20:
                        yield batch()
                        held, size = [], 0
        if held:
            yield batch()

    workers_import(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, CHUNK_SCHEMA)


def archive_digests(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the pages' archives, read them back, and return one row for each record from its last chunk.

    The digest of a response is the one computed while reading.
    """
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    write_archives(pages, path, **options)
    rows = read_chunks(spark, path, with_data=False).where("last")
    return rows.select("page_id", "payload_bytes", F.col("running_sha256").alias("payload_digest"), "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, octet_length(encode(h)) AS n, sha256(h) AS d FROM p),
f AS (SELECT d, min(page_id) AS first FROM q WHERE n >= 100 GROUP BY d)
SELECT q.page_id, CAST(q.n AS BIGINT) AS payload_bytes, q.d AS payload_digest,
  CASE WHEN f.first < q.page_id AND q.n >= 100 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first < q.page_id AND q.n >= 100 THEN f.first END AS refers_to
FROM q LEFT JOIN f ON q.d = f.d
"""
