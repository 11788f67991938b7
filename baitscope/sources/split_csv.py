"""SRC-01 for one huge CSV: quoted fields with line breaks, read by many tasks.

Spark reads such a file whole in one task.  Here the lines of each byte range
(a file split) are read as text.  A first pass counts the quotes of each range; the
sums before a range tell whether it starts inside a quoted field.  A second pass joins the lines
of each record, range by range, and what a range cuts is put together afterwards, two
pieces a range at most.  Only the two passes read the file; no text is shuffled but
these pieces.

The files are as RFC 4180 has them: a quote within a field is doubled and its field
quoted, and lines end with ``\\n`` or ``\\r\\n``.  (A stray quote in an unquoted field
would turn inside and outside round.)  Blank lines are skipped.  A quote that is never
closed makes the rest of its file one record, as in the whole reader (but for the
file's last line break, which is lost).  An empty file
has no rows.  Bad bytes are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from baitscope.sources.files import read_csv, sniff_separator

c = F.col
RANGE = ["file", "start"]
#: A record of one range; the end of one that began before it; the beginning of one that ends later; neither end.
WHOLE, END, BEGINNING, MIDDLE = range(4)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, start (of the byte range), line; in the file's order within a range."""
    return (spark.read.option("lineSep", "\n").text(path)
            .select(c("_metadata.file_path").alias("file"), c("_metadata.file_block_start").alias("start"), c("value").alias("line")))


def ranges(rows: DataFrame) -> DataFrame:
    """file, start, opened (the range begins inside a quoted field), crlf (the file's first line ends with ``\\r\\n``)."""
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    counted = rows.withColumn("n", F.monotonically_increasing_id()).groupBy(*RANGE).agg(
        F.sum(quotes).alias("quotes"), F.min_by(F.endswith("line", F.lit("\r")), "n").alias("crlf"))
    order = Window.partitionBy("file").orderBy("start")
    before = F.sum("quotes").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return counted.select(*RANGE, F.coalesce(before % 2 == 1, F.lit(False)).alias("opened"),
                          F.first("crlf").over(order).alias("crlf"))


class _Range:
    """Joins the lines of one range; ``inside``: whether it begins in a quoted field."""

    def __init__(self, inside: bool) -> None:
        self.inside = self.cut = inside
        self.pending: list[bytes] = []
        self.seq = 0

    def add(self, batch: pa.Array) -> tuple[list[int], list[int], list[bytes]]:
        """seq, kind and text of the records that end in these lines."""
        odd = pc.count_substring(batch, '"').to_numpy(zero_copy_only=False) % 2
        ends = np.flatnonzero((np.cumsum(odd) + self.inside) % 2 == 0)
        own = batch.to_pylist()
        seqs, kinds, texts, at = [], [], [], 0
        for end in (ends + 1).tolist():
            text = b"\n".join([*self.pending, *own[at:end]]) if self.pending or end - at > 1 else own[at]
            self.pending, at = [], end
            kind, self.cut = (END if self.cut else WHOLE), False
            if kind == END or text not in (b"", b"\r"):
                seqs.append(self.seq)
                kinds.append(kind)
                texts.append(text)
                self.seq += 1
        self.pending.extend(own[at:])
        self.inside = bool((int(odd.sum()) + self.inside) % 2)
        return seqs, kinds, texts

    def rest(self) -> tuple[list[int], list[int], list[bytes]]:
        if not self.pending:
            return [], [], []
        return [self.seq], [MIDDLE if self.cut else BEGINNING], [b"\n".join(self.pending)]


def pieces(rows: DataFrame, opened: dict[str, np.ndarray], crlf: set[str]) -> DataFrame:
    """file, start, seq, kind, text, crlf of the records and cut records of each range."""
    shared = rows.sparkSession.sparkContext.broadcast((opened, crlf))

    def out(at: tuple[str, int], found: tuple[list[int], list[int], list[bytes]]) -> Iterator[pa.RecordBatch]:
        seqs, kinds, texts = found
        if seqs:
            yield pa.RecordBatch.from_arrays(
                [pa.array([at[0]] * len(seqs)), pa.array([at[1]] * len(seqs), pa.int64()), pa.array(seqs, pa.int64()),
                 pa.array(kinds, pa.int32()), pa.array(texts, pa.binary()), pa.array([at[0] in shared.value[1]] * len(seqs))],
                [*RANGE, "seq", "kind", "text", "crlf"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now = None, None
        for batch in batches:
            starts, files = batch.column("start").to_numpy(), batch.column("file").to_pylist()
            turns = [i for i in range(1, len(files)) if starts[i] != starts[i - 1] or files[i] != files[i - 1]]
            for low, high in zip([0, *turns], [*turns, len(files)], strict=True):
                if high > low:
                    here = (files[low], int(starts[low]))
                    if here != at:
                        if now is not None:
                            yield from out(at, now.rest())
                        at, now = here, _Range(bool(np.isin(here[1], shared.value[0].get(here[0], []))))
                    yield from out(at, now.add(batch.column("line").slice(low, high - low)))
        if now is not None:
            yield from out(at, now.rest())

    return rows.withColumn("line", c("line").cast("binary")).mapInArrow(
        run, "file string, start long, seq long, kind int, text binary, crlf boolean")


def records(spark: SparkSession, path: str) -> DataFrame:
    """file, start, seq, text, crlf of every record (bytes, line breaks within it kept)."""
    rows = lines(spark, path)
    # Some bytes for each range that begins in a quoted field or file with \r\n: a few MB for 100 TB in ranges of 128 MB.
    known = ranges(rows).where("opened OR (crlf AND start = 0)").toArrow().to_pandas()
    opened = {f: g.to_numpy() for f, g in known[known.opened].groupby("file")["start"]}
    made = pieces(rows, opened, set(known[known.crlf].file))
    cut = made.where(c("kind") != WHOLE)
    # A record that no range holds whole begins a new number; its later pieces follow it.
    number = F.sum((c("kind") == BEGINNING).cast("long")).over(Window.partitionBy("file").orderBy("start", "seq"))
    joined = cut.withColumn("number", number).groupBy("file", "number", "crlf").agg(
        F.array_sort(F.collect_list(F.struct("start", "seq", c("text").cast("string").alias("text")))).alias("parts"))
    mended = joined.select("file", c("parts")[0]["start"].alias("start"), c("parts")[0]["seq"].alias("seq"),
                           F.array_join(F.transform("parts", lambda p: p["text"]), "\n").cast("binary").alias("text"), "crlf")
    return made.where(c("kind") == WHOLE).select(*RANGE, "seq", "text", "crlf").unionByName(mended)


def read_split_csv(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """The rows of ``read_csv`` for UTF-8 files, whatever their size; builds with one pass over the quotes."""
    sep = sep or sniff_separator(spark, path)
    schema = read_csv(spark, path, sep).schema
    text = F.make_valid_utf8(c("text").cast("string"))
    # As in the whole reader, a file that ends its first line with \r\n has it read as \n everywhere.
    text = F.when(c("crlf"), F.replace(text, F.lit("\r\n"), F.lit("\n"))).otherwise(text)
    text = F.regexp_replace(text, "\r$", "")
    # The first record of a file is its header.
    body = records(spark, path).where((c("start") > 0) | (c("seq") > 0))
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
    return body.select(F.from_csv(text, _ddl(schema), options).alias("r")).select("r.*")


def _ddl(schema) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` string" for f in schema.fields)
