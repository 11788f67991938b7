"""Conversations as ordered blocks of turns: shared by the operators on conversations.

Rows are dealt out by ranges of (conversation, turn), so that a conversation
with a third of all rows lies in many tasks.  A task cuts what it reads into
blocks of bounded size.  A conversation that begins and ends inside one task
and fits one block is *whole*; the others (two a task, and the long ones) are
put together again from their blocks, in the order of ``block``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baitscope.llm.common import workers_import

#: A block ends after this many turns or characters; one longer turn is a block of its own.
BLOCK_TURNS, BLOCK_CHARS = 4096, 1 << 20
#: Arrow batches that are yielded hold about this many characters.
OUT_CHARS = 2_000_000


def in_order(rows: DataFrame, *then: Column) -> DataFrame:
    """Rows by conversation and turn (nulls first), then by role and MD5 of the text; equal rows stay as they come.

    ``then`` may order rows further, before equal rows are numbered.
    """
    rows = rows.withColumn("text_order", F.md5(F.col("text").cast("binary"))).withColumn("row_order", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text_order")] + [*then, F.col("row_order").asc()]
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys)


def blocks(batches: Iterable[pa.RecordBatch], columns: list[str], text: str = "text") -> Iterator[tuple[int | None, int, bool, list[tuple]]]:
    """Cut one task's sorted rows into (conv_id, block, whole, rows of ``columns``)."""
    at = columns.index(text)
    context = TaskContext.get()
    number = (context.partitionId() if context else 0) << 32
    key, held, chars, seen, cut = None, [], 0, 0, False
    for batch in batches:
        for conv, *row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", *columns)), strict=True):
            if seen == 0:
                key, seen = conv, 1
            elif conv != key or len(held) >= BLOCK_TURNS or chars >= BLOCK_CHARS:
                over = conv != key
                yield key, number, over and not cut and seen > 1, held
                number += 1
                held, chars, cut = [], 0, not over
                if over:
                    key, seen = conv, seen + 1
            held.append(row)
            chars += len(row[at] or "")
    if seen:
        yield key, number, False, held


def batched(rows: DataFrame, schema: str, make: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[tuple, int]]]) -> DataFrame:
    """``mapInArrow`` whose ``make`` yields (row, size in characters); rows leave in batches of bounded size."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    struct = _parse_datatype_string(schema)
    workers_import(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(struct)

        def packed(held: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*held, strict=True), target, strict=True)], schema=target)

        held, size = [], 0
        for row, n in make(batches):
            held.append(row)
            size += n + 100
            if size >= OUT_CHARS:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    return rows.mapInArrow(run, struct)


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of Arrow batches as dictionaries, some hundred at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            yield from batch.slice(i, 256).to_pylist()


def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[bool, bool, dict]]:
    """Rows that come sorted by conversation, with marks: (first of its conversation, last of it, row)."""
    held, first = None, True
    for row in rows_of(batches):
        if held is not None:
            last = row["conv_id"] != held["conv_id"]
            yield first, last, held
            first = last
        held = row
    if held is not None:
        yield first, True, held
