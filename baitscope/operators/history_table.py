"""Scan history as a table of files clustered by id (SNK-01, WIN-06, ORD-01..03, AGG-18).

Rows get surrogate ids when they are appended: consecutive numbers above the
highest one given so far, in the order of time and email.  They come from counts
per sorted partition, so no task sees more than its own rows.  Files hold ranges
of ids; a manifest lists each file with its range, and a lookup opens only the
file whose range holds the id.  A delete writes that one file anew.

The manifest is versioned: every change publishes a whole new version, and
readers take the highest one, so they never meet half a change.  An append that
is repeated with its batch number (after a failure) replaces what it wrote
before and gives the same ids, as long as no later batch was appended.  Ids of
deleted rows are never given again.  There is one writer at a time.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

c = F.col
MANIFEST = "batch long, file string, first_id long, last_id long, n_rows long, seconds double"


class HistoryTable:
    """The history under ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    # manifest

    def versions(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(f"{MANIFEST}, v long").parquet(f"{self.path}/manifest")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    def _version(self) -> int:
        held = self.versions()
        return (held.agg(F.max("v")).first()[0] or 0) if held is not None else 0

    def manifest(self) -> DataFrame:
        """batch, file, first_id, last_id, n_rows, seconds of the current version."""
        v = self._version()
        if not v:
            return self.spark.createDataFrame([], MANIFEST)
        return self.versions().where(c("v") == v).drop("v")

    def _publish(self, rows: DataFrame) -> None:
        # One file a version; a version that is written again replaces itself.
        (rows.withColumn("v", F.lit(self._version() + 1).cast("long")).coalesce(1).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("v").parquet(f"{self.path}/manifest"))

    def _ranges(self, folder: str, batch: int, seconds: float | None) -> DataFrame:
        files = self.spark.read.parquet(folder).groupBy(c("_metadata.file_path").alias("file")).agg(
            F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count(F.lit(1)).alias("n_rows"))
        return files.select(F.lit(batch).cast("long").alias("batch"), "file", "first_id", "last_id", "n_rows", F.lit(seconds).cast("double").alias("seconds"))

    # writing

    def append(self, records: DataFrame, batch: int, time_col: str = "timestamp", key: str = "email_id") -> None:
        """SNK-01, WIN-06: add ``records`` as batch number ``batch`` (greater than all but its own earlier attempt).

        ``analysis_time_seconds`` becomes the seconds that making the batch took, by row (AGG-18).
        """
        held = self.manifest().where(c("batch") != batch)
        last = held.agg(F.max("batch"), F.max("last_id")).first()
        if last[0] is not None and last[0] > batch:
            raise ValueError(f"batch {last[0]} was appended after batch {batch}")
        base = last[1] or 0
        started = time.monotonic()
        staged = f"{self.path}/staged/{batch}-{uuid.uuid4().hex}"
        order = [c(time_col).asc_nulls_first(), c(key).asc_nulls_first()]
        part = F.spark_partition_id().cast("long")
        rows = records.drop("id").repartitionByRange(*order).sortWithinPartitions(*order)
        # The generated number holds the partition in its upper 31 bits, and the row's place in it below.
        rows.withColumns({"_part": part, "_place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}).write.parquet(staged)
        rows = self.spark.read.parquet(staged)
        seconds = time.monotonic() - started
        counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
        before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition written
        starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
        n = rows.count()
        rows = rows.join(starts, "_part").withColumn("id", c("_start") + c("_place") + 1 + base)
        if "analysis_time_seconds" in rows.columns:
            rows = rows.withColumn("analysis_time_seconds", F.lit(seconds / max(n, 1)))
        folder = f"{self.path}/files/{batch}-{uuid.uuid4().hex}"
        rows.drop("_part", "_place", "_start").repartitionByRange("id").sortWithinPartitions("id").write.parquet(folder)
        self._publish(held.unionByName(self._ranges(folder, batch, seconds)))

    def delete(self, scan_id: int) -> bool:
        """ORD-03: write the file that holds an id anew without it; false if there is none."""
        at = [r for r in self._holding(scan_id) if r["file"]]
        if not any(not self.spark.read.parquet(r["file"]).where(c("id") == scan_id).isEmpty() for r in at):
            return False
        held = self.manifest()
        for r in at:
            folder = f"{self.path}/files/{r['batch']}-{uuid.uuid4().hex}"
            left = self.spark.read.parquet(r["file"]).where(c("id") != scan_id)
            left.coalesce(1).write.parquet(folder)
            new = self._ranges(folder, r["batch"], r["seconds"]).select(c("file").alias("_file"), c("n_rows").alias("_n")).first()
            # The range stays, so that its numbers are not given again.
            this = c("file") == r["file"]
            held = held.withColumns({"n_rows": F.when(this, F.lit(new["_n"] if new else 0)).otherwise(c("n_rows")),
                                     "file": F.when(this, F.lit(new["_file"] if new else None)).otherwise(c("file"))})
        self._publish(held)
        return True

    # reading

    def _holding(self, scan_id: int) -> list:
        return self.manifest().where((c("first_id") <= scan_id) & (c("last_id") >= scan_id)).collect()

    def _files(self, files: list[str]) -> DataFrame | None:
        return self.spark.read.parquet(*files) if files else None

    def read(self) -> DataFrame:
        """All rows of the current version."""
        files = [r["file"] for r in self.manifest().where("file IS NOT NULL").select("file").collect()]
        rows = self._files(files)
        if rows is None:
            raise ValueError("nothing was appended, or all of it was deleted")
        return rows

    def lookup(self, scan_id: int) -> DataFrame:
        """ORD-02: the row of one id, from the file whose range holds it."""
        rows = self._files([r["file"] for r in self._holding(scan_id) if r["file"]])
        return self.read().where(F.lit(False)) if rows is None else rows.where(c("id") == scan_id)

    def page(self, limit: int = 20, offset: int = 0) -> DataFrame:
        """ORD-01: newest first; only the files with the highest ids are read."""
        files, rows = [], 0
        for r in self.manifest().where("file IS NOT NULL").orderBy(c("last_id").desc()).collect():
            if rows >= limit + offset:
                break
            files.append(r["file"])
            rows += r["n_rows"]
        return (self._files(files) if files else self.read()).orderBy(c("id").desc()).offset(offset).limit(limit)

    def throughput(self) -> DataFrame:
        """AGG-18: rows, seconds, mean seconds a row and rows a second of each batch."""
        by = self.manifest().groupBy("batch").agg((F.max("last_id") - F.min("first_id") + 1).alias("n_rows"), F.max("seconds").alias("seconds"))
        return by.select("batch", "n_rows", "seconds", F.round(c("seconds") / c("n_rows"), 6).alias("avg_seconds"),
                         F.round(c("n_rows") / c("seconds"), 2).alias("rows_per_second"))
