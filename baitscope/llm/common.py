"""Shared helpers of the training-data operators: scratch tables, text keys, Arrow batches."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from baitscope.session import ensure_checkpoint_dir

#: Texts of one Arrow batch are handled in pieces of at most this many characters (one longer text is a piece of its own).
PIECE_CHARS = 2_000_000


def workers_import(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver found it (a cluster has it installed there too)."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder path under the shared ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks it ran, never the
    steps before the table.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def bytes_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The column's strings as UTF-8 bytes; null counts as empty."""
    return [b"" if v is None else v.encode("utf-8") for v in batch.column(column).to_pylist()]


def pieces(batches: Iterable[pa.RecordBatch], text: str, most: int = PIECE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that no piece holds much more than ``most`` characters of ``text``."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(text)).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            n = n or 0
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def arrow_map(df: DataFrame, text: str, schema: str, make: Callable[[pa.RecordBatch], dict]) -> DataFrame:
    """``mapInArrow`` over bounded pieces; ``make`` returns the columns of ``schema`` in order."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    struct = _parse_datatype_string(schema)
    workers_import(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(struct)
        for piece in pieces(batches, text):
            made = make(piece)
            yield pa.RecordBatch.from_arrays(
                [made[f.name] if isinstance(made[f.name], pa.Array) else pa.array(made[f.name], f.type) for f in target],
                schema=target)

    return df.mapInArrow(run, struct)


#: Keys over this many characters are cached for one batch only: a text without spaces may be one key.
LONG_KEY = 32


class RecentCache(dict):
    """Two-generation cache: at ``most`` entries the young generation becomes the old one.

    Memory is bounded by ``2 * most`` entries however long the worker lives.
    With a ``size`` of keys, those over ``LONG_KEY`` are held for one batch.
    """

    def __init__(self, most: int, size: Callable[..., int] | None = None) -> None:
        super().__init__()
        self.most, self.size, self.old, self.brief = most, size, {}, []

    def __missing__(self, key):
        value = self.old[key]
        self[key] = value
        return value

    def absent(self, keys: Iterable) -> list:
        """The distinct ``keys`` held by neither generation; held ones are made young.

        The generations change here, between two uses, so that every key of one
        batch stays readable until the next call; long keys of the last batch go.
        """
        for key in self.brief:
            self.pop(key, None)
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        old, found = self.old, []
        for key in set(keys).difference(self):
            if key in old:
                self[key] = old[key]
            else:
                found.append(key)
        self.brief = [key for key in found if self.size(key) > LONG_KEY] if self.size else []
        return found
