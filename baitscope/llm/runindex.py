"""Operator 2: removal of long repeated byte strings with a run-length index.

Every byte that a string of ``length`` bytes covers is removed if that string also
starts anywhere else, in the same text or another.  Texts are UTF-8 bytes, strings
never reach over the end of a text, and what repeats is judged on the input.

* Anchors.  A window of ``length`` bytes has an anchor: the leftmost of its 32-byte
  grams with the smallest hash.  Equal windows have equal anchors at equal offsets.
  So the windows of one anchor occurrence, a run of neighbours, form a context of
  less than two lengths of bytes, and repeats can only be between contexts of equal
  anchors.  Anchors met once are dropped after a count.
* Contexts that are equal to the byte are one context with a count, before any
  bytes are shuffled; copies of a text, however many, cost one row each and no more.
* Index.  The distinct contexts of an anchor that has several go to one task
  together with those of other anchors.  It sorts their suffixes, keeps the run-length
  compressed Burrows-Wheeler transform with a sample at each run's first and last
  row (text position, longest match with the row before or after), and streams the
  matching statistics over the text: from one sample to the next they fall by one
  with each position.  A position whose longest match with another suffix has
  ``length`` bytes or more starts a repeated window.
* One index holds at most ``CROWD`` distinct contexts of a group, so that no task holds
  an unbounded one.  A larger group (the contexts of an anchor in a popular line) is
  parted by more of the bytes around its anchor: of the bytes that a window has besides
  its anchor, at least half lie on one side, and the anchor's place in the window says
  on which.  So a context falls into at most two, each of which shares half of the open
  bytes with every window equal to one of its own; equal ones are one again, with a
  count, and groups are those of equal anchors and shared bytes.  This is repeated, with
  what is still open, until every group fits (when nothing is open a group is a single
  window), and every group of several goes through an index.

Edge cases: a null text counts as empty; a text shorter than ``length`` has no
window; rows that repeat doc_id and text are separate texts (so all of it repeats).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from baitscope.llm.common import arrow_map, stored, workers_import

LENGTH, GRAM = 400, 32
#: Windows of a text that are anchored at a time; distinct contexts of a group in one index; bytes of an index, about.
SEGMENT, CROWD, INDEX_BYTES = 1 << 18, 500, 1 << 17
#: Bits of the fixed-size maps that keep texts without a match out of shuffles.
MAP_BITS = 20
BASE = 0x9E3779B97F4A7C15 | 1
LOW = np.uint64((1 << 24) - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    inverse = pow(BASE, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up = np.concatenate(([np.uint64(1)], np.full(n - 1, BASE, np.uint64))).cumprod(dtype=np.uint64)
        down = np.concatenate(([np.uint64(1)], np.full(n - 1, inverse, np.uint64))).cumprod(dtype=np.uint64)
    return up, down


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes at each position."""
    up, down = powers(SEGMENT + (1 << 16))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:len(b)], dtype=np.uint64)))
    m = len(b) - GRAM + 1
    return mixed((total[GRAM:] - total[:-GRAM]) * down[:m])


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """The smallest of each ``size`` neighbours."""
    m = len(x) - size + 1
    padded = np.full(-(-len(x) // size) * size, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(x)] = x
    rows = padded.reshape(-1, size)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:m], ahead[size - 1:size - 1 + m])


def anchored(b: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """first window, windows, offset of the anchor, anchor hash of each context of a text, segment by segment."""
    for start in range(0, len(b) - length + 1, SEGMENT):
        part = b[start:start + SEGMENT + length - 1]
        h = gram_hashes(part)
        least = sliding_min((h & ~LOW) | np.arange(len(h), dtype=np.uint64), length - GRAM + 1)
        at = (least & LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        count = np.diff(np.append(first, len(at)))
        yield first + start, count, at[first] - first, h[at[first]].view(np.int64)


def contexts_of(length: int):
    def make(batch: pa.RecordBatch) -> dict:
        out = {c: [] for c in ("key", "p", "windows", "a")}
        prints = []
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
            raw = (text or "").encode("utf-8")
            if len(raw) < length:
                continue
            for first, count, offset, anchor in anchored(np.frombuffer(raw, np.uint8), length):
                out["key"].append(np.full(len(first), key))
                out["p"].append(first)
                out["windows"].append(count.astype(np.int32))
                out["a"].append(anchor)
                stop = first + count + length - 1
                # The anchor's offset is part of a context: equal bytes may be cut from elsewhere.
                prints += [xxhash.xxh3_128_digest(raw[i:j], seed=o) for i, j, o in zip(first.tolist(), stop.tolist(), offset.tolist(), strict=True)]
        both = np.frombuffer(b"".join(prints), "<i8").reshape(-1, 2)
        columns = {c: pa.array(np.concatenate(v)) if v else pa.array([], pa.int32() if c == "windows" else pa.int64()) for c, v in out.items()}
        return {**columns, "c1": pa.array(np.ascontiguousarray(both[:, 0])), "c2": pa.array(np.ascontiguousarray(both[:, 1]))}
    return make


class RunIndex:
    """Run-length compressed Burrows-Wheeler transform of some byte strings, with samples at both ends of every run."""

    def __init__(self, parts: list[bytes]) -> None:
        sizes = np.array([len(p) for p in parts])
        n = int(sizes.sum()) + len(parts)
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        # Bytes by rank among those that occur, from 1; a string ends with 0.
        raw = np.frombuffer(b"".join(parts), np.uint8)
        codes = np.cumsum(np.bincount(raw, minlength=256) > 0)
        self.text = np.zeros(n, np.int64)
        inner = np.ones(n, bool)
        inner[self.starts + sizes] = False
        self.text[inner] = codes[raw]
        self.left = np.repeat(self.starts + sizes, sizes + 1) - np.arange(n)
        rows = self._sort()
        before = self.text[rows - 1]
        before[rows == 0] = 0
        # What stands before a whole string is no symbol of it, so it is a run of its own.
        change = (before[1:] != before[:-1]) | (before[1:] == 0)
        self.heads = np.flatnonzero(np.concatenate(([True], change)))
        self.symbols = before[self.heads]
        ends = np.flatnonzero(np.concatenate((change, [True])))
        # Samples: text position of each run's first and last row, and its match with the row before and after.
        self.head_at, self.end_at = rows[self.heads], rows[ends]
        self.head_match = np.zeros(len(self.heads), np.int64)
        self.head_match[1:] = self._match(rows[self.heads[1:]], rows[self.heads[1:] - 1])
        self.end_match = np.zeros(len(ends), np.int64)
        self.end_match[:-1] = self._match(rows[ends[:-1]], rows[ends[:-1] + 1])
        self.levels = []

    def _sort(self) -> np.ndarray:
        """Suffixes (up to the end of their strings, then by position) in order, by doubling; keeps the ranks for ``_match``."""
        n, place = len(self.text), np.arange(len(self.text))
        width = int(self.text.max(initial=1)).bit_length()
        size = max(1, 63 // width - 1)
        padded = np.concatenate((self.text, np.zeros(size, np.int64)))
        key, alive = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(size):
            symbol = padded[k:k + n]
            key = key << width | symbol * alive
            alive &= symbol > 0
        self.levels: list[tuple[int, np.ndarray]] = []
        while True:
            order = np.argsort(key)
            key = key[order]
            rank = np.empty(n, np.int32)
            rank[order] = np.cumsum(np.concatenate(([False], key[1:] != key[:-1])))
            self.levels.append((size, rank))
            if rank[order[-1]] == n - 1:
                return order
            if size > self.left.max():
                return np.argsort(rank * np.int64(n) + place)
            ahead = np.zeros(n, np.int64)
            ahead[:n - size] = rank[size:] + 1
            key = rank * np.int64(n + 1) + ahead * (self.left >= size)
            size *= 2

    def _match(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Lengths of the longest common prefixes of suffixes."""
        n, most = len(self.text), np.minimum(self.left[x], self.left[y])
        x, y = x.copy(), y.copy()
        length = np.zeros(len(x), np.int64)
        for size, rank in self.levels[::-1] + [(1, self.text)] * (self.levels[0][0] - 1):
            same = (rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)]) & (np.maximum(x, y) < n)
            step = size * same
            length += step
            x += step
            y += step
        return np.minimum(length, most)

    def statistics(self) -> np.ndarray:
        """For each text position the longest match of its suffix with any other suffix."""
        out = np.zeros(len(self.text), np.int64)
        place = np.arange(len(self.text))
        for at, match in ((self.head_at, self.head_match), (self.end_at, self.end_match)):
            reach = np.zeros(len(self.text), np.int64)
            reach[at] = at + match
            out = np.maximum(out, np.maximum.accumulate(reach) - place)
        return out


def spans(marked: np.ndarray) -> tuple[list[int], list[int]]:
    """Starts and ends of the runs of true values."""
    edge = np.diff(np.concatenate(([0], marked.astype(np.int8), [0])))
    return np.flatnonzero(edge > 0).tolist(), np.flatnonzero(edge < 0).tolist()


def index_marks(rows: DataFrame, length: int) -> DataFrame:
    """c1, c2, starts, ends: repeated windows of contexts (g1, g2, c1, c2, n, bytes), one index for some groups."""
    def solve(held: list[tuple]) -> pa.RecordBatch:
        index = RunIndex([x[3] for x in held])
        longest = index.statistics()
        out = [[], [], [], []]
        for (c1, c2, n, raw), at in zip(held, index.starts.tolist(), strict=True):
            marked = longest[at:at + len(raw) - length + 1] >= length
            first, last = ([0], [len(marked)]) if n > 1 else spans(marked)
            if first:
                for column, x in zip(out, (c1, c2, first, last), strict=True):
                    column.append(x)
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["c1", "c2", "starts", "ends"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            for g1, g2, *row in zip(*(batch.column(c).to_pylist() for c in ("g1", "g2", "c1", "c2", "n", "bytes")), strict=True):
                if (g1, g2) != last and size >= INDEX_BYTES:
                    yield solve(held)
                    held, size = [], 0
                held.append(tuple(row))
                size += len(row[3])
                last = (g1, g2)
        if held:
            yield solve(held)

    workers_import(rows.sparkSession)
    return rows.repartition("g1", "g2").sortWithinPartitions("g1", "g2", "c1", "c2").mapInArrow(
        run, "c1 long, c2 long, starts array<int>, ends array<int>")


def halves(raw: bytes, at: int, core: int, length: int) -> Iterator[tuple[int, int, int, int, int]]:
    """A context's windows by the side on which they surely hold half of their open bytes.

    Windows of ``length`` bytes of ``raw`` all hold its ``core`` bytes from
    ``at``.  Yields side, first window, windows, and the core's place in ``raw``
    and size, enlarged by the bytes that all of them hold there.
    """
    free, windows = length - core, len(raw) - length + 1
    half = (free + 1) // 2
    left = min(windows, at - half + 1)  # windows with half or more of the open bytes before the core
    if left > 0:
        yield 0, 0, left, at - half, core + half
    first = max(left, 0)
    if first < windows:
        yield 1, first, windows - first, at, core + free - half + 1


def parted(rows: DataFrame, length: int) -> DataFrame:
    """Contexts cut in two, with their first window (``shift``) in the context (p1, p2) they come from."""
    names = ["p1", "p2", "shift", "g1", "g2", "c1", "c2", "n", "path", "at", "core", "bytes"]

    def make(batch: pa.RecordBatch) -> dict:
        out = {x: [] for x in names}
        for row in batch.select(["c1", "c2", "n", "path", "at", "core", "bytes"]).to_pylist():
            raw, at = row["bytes"], row["at"]
            if at is None:
                at = int(next(anchored(np.frombuffer(raw, np.uint8), length))[2][0])
            for side, first, windows, place, core in halves(raw, at, row["core"], length):
                path, part = row["path"] * 2 + side, raw[first:first + windows + length - 1]
                # Equal windows take equal paths, so hashes tell paths apart, and contexts by the core's place too.
                group = np.frombuffer(xxhash.xxh3_128_digest(raw[place:place + core], seed=path), "<i8").tolist()
                name = np.frombuffer(xxhash.xxh3_128_digest(part, seed=path << 16 | place - first), "<i8").tolist()
                for column, x in zip(names, (row["c1"], row["c2"], first, *group, *name, row["n"], path, place - first, core, part), strict=True):
                    out[column].append(x)
        return out

    return arrow_map(rows, "bytes", "p1 long, p2 long, shift int, g1 long, g2 long, c1 long, c2 long, n long, path long, at int, core int, bytes binary", make)


def group_marks(rows: DataFrame, length: int, crowd: int) -> DataFrame:
    """Repeated windows of contexts (g1, g2, m, c1, c2, n, path, at, core, bytes); groups of over ``crowd`` are parted first."""
    found = index_marks(rows.where(F.col("m") <= crowd), length)
    crowded = rows.where(F.col("m") > crowd)
    if crowded.isEmpty():
        return found
    cut = stored(parted(crowded, length), "parted-contexts")
    kids = stored(cut.groupBy("g1", "g2", "c1", "c2").agg(F.sum("n").alias("n"), *[F.first(x).alias(x) for x in ("path", "at", "core", "bytes")]), "parts")
    groups = stored(kids.groupBy("g1", "g2").agg(F.count("*").alias("m")), "part-groups")
    kids = stored(kids.join(groups, ["g1", "g2"]).where("m > 1 OR n > 1"), "open-parts")
    whole = kids.where("m = 1").select("c1", "c2", F.array(F.lit(0)).alias("starts"), F.array(F.octet_length("bytes") - length + 1).alias("ends"))
    marks = stored(whole.union(group_marks(kids.where("m > 1"), length, crowd)), "part-marks")
    back = cut.select("p1", "p2", "shift", "c1", "c2").join(marks, ["c1", "c2"])
    return found.union(back.select("p1", "p2", *(F.transform(x, lambda i: i + F.col("shift")).alias(x) for x in ("starts", "ends"))))


def text_key():
    """Equal for rows of the same doc_id and text."""
    return F.xxhash64("doc_id", "text", F.col("doc_id").isNull())


def key_map(rows: DataFrame) -> np.ndarray:
    """A fixed-size bit map of the keys of ``rows``; at most 2**MAP_BITS numbers reach the driver."""
    found = rows.select(F.shiftrightunsigned("key", 64 - MAP_BITS).alias("b")).distinct().collect()
    bits = np.zeros(1 << MAP_BITS, bool)
    bits[np.array([r["b"] for r in found], np.int64)] = True
    return np.packbits(bits, bitorder="little")


def mapped_texts(texts: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """The rows of (key, text) whose key may be in the map."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column("key").to_numpy().view(np.uint64) >> np.uint64(64 - MAP_BITS)
            kept = bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1
            yield batch.filter(pa.array(kept > 0))

    workers_import(texts.sparkSession)
    return texts.mapInArrow(run, "key long, text string")


def repeated_windows(texts: DataFrame, length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """key, runs (p, starts, ends): where repeated windows start in each text of (key, text) that has any."""
    c = F.col
    schema = "key long, p long, windows int, a long, c1 long, c2 long"
    met = stored(arrow_map(texts, "text", schema, contexts_of(length)), "contexts")
    # A table of its own: joined straight to the shuffled contexts, so that a hot anchor's rows can be split.
    often = stored(met.groupBy("a").count().where("count > 1").select("a"), "shared-anchors")
    met = stored(met.join(often, "a", "left_semi"), "shared-contexts")
    distinct = met.groupBy("a", "c1", "c2").agg(F.count("*").alias("n"), F.min("windows").alias("windows"), F.min(F.struct("key", "p")).alias("at"))
    distinct = stored(distinct, "distinct-contexts")
    groups = stored(distinct.groupBy("a").agg(F.count("*").alias("m")), "anchor-groups")
    alone = groups.where("m = 1").select("a")
    whole = distinct.join(alone, "a", "left_semi").select(
        "c1", "c2", F.array(F.lit(0)).alias("starts"), F.array("windows").alias("ends"))
    # Bytes of the contexts of anchors that have several, from the whole texts they lie in.
    several = stored(distinct.join(groups.where("m > 1"), "a").select(
        c("at.key").alias("key"), c("at.p").alias("p"), "windows", "a", "m", "n", "c1", "c2"), "open-contexts")
    wanted = several.groupBy("key").agg(F.collect_list(F.struct("p", "windows", "a", "m", "n", "c1", "c2")).alias("cuts"))

    def cut(batch: pa.RecordBatch) -> dict:
        out = {x: [] for x in ("a", "m", "n", "c1", "c2", "bytes")}
        for text, cuts in zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist(), strict=True):
            raw = (text or "").encode("utf-8")
            for x in cuts:
                for name in ("a", "m", "n", "c1", "c2"):
                    out[name].append(x[name])
                out["bytes"].append(raw[x["p"]:x["p"] + x["windows"] + length - 1])
        return out

    held = mapped_texts(texts, key_map(several)).join(wanted, "key")
    parts = arrow_map(held, "text", "a long, m long, n long, c1 long, c2 long, bytes binary", cut)
    # Rows that repeat a key give a context more than once.
    parts = stored(parts.groupBy("c1", "c2").agg(*[F.first(x).alias(x) for x in ("a", "m", "n", "bytes")]), "context-bytes")
    root = parts.select(c("a").alias("g1"), F.lit(0).cast("long").alias("g2"), "m", "c1", "c2", "n", F.lit(1).cast("long").alias("path"),
                        F.lit(None).cast("int").alias("at"), F.lit(GRAM).alias("core"), "bytes")
    marks = whole.union(group_marks(root, length, crowd))
    rows = met.select("key", "p", "c1", "c2").distinct().join(stored(marks, "marks"), ["c1", "c2"])
    return rows.groupBy("key").agg(F.collect_list(F.struct("p", "starts", "ends")).alias("runs"))


def covered(runs: list[dict], length: int) -> list[tuple[int, int]]:
    """Maximal removed byte ranges."""
    if not runs:
        return []
    lo = np.concatenate([np.array(r["starts"], np.int64) + r["p"] for r in runs])
    hi = np.concatenate([np.array(r["ends"], np.int64) + r["p"] for r in runs]) + length - 1
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.concatenate(([True], lo[1:] > hi[:-1]))
    last = np.append(np.flatnonzero(new)[1:] - 1, len(lo) - 1)
    return list(zip(lo[new].tolist(), hi[last].tolist(), strict=True))


def without(raw: bytes, ranges: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for lo, hi in ranges:
        kept.append(raw[at:lo])
        at = hi
    return b"".join([*kept, raw[at:]])


def _runs(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """(key, text) of the texts with repeated windows, each with its runs; both tables are cut off from their making."""
    texts = docs.select(text_key().alias("key"), "text")
    found = stored(repeated_windows(texts, length), "repeated")
    return found, mapped_texts(texts, key_map(found)).join(found, "key")


def repeat_digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    _, hit = _runs(rows, length)

    def make(batch: pa.RecordBatch) -> dict:
        out = {"key": batch.column("key"), "n_removed": [], "n_spans": [], "kept_sha256": []}
        for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
            raw = (text or "").encode("utf-8")
            ranges = covered(runs, length)
            out["n_removed"].append(sum(hi - lo for lo, hi in ranges))
            out["n_spans"].append(len(ranges))
            out["kept_sha256"].append(hashlib.sha256(without(raw, ranges)).hexdigest())
        return out

    cut = arrow_map(hit, "text", "key long, n_removed long, n_spans long, kept_sha256 string", make).dropDuplicates(["key"])
    text = F.coalesce("text", F.lit(""))
    base = rows.select("doc_id", text_key().alias("key"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole"))
    return base.join(cut, "key", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with all columns, repeated strings cut out of ``text``; a character that a cut splits goes as a whole.

    Texts without repeats are not shuffled if the table of the others is small enough to broadcast.
    """
    found, hit = _runs(docs, length)

    def make(batch: pa.RecordBatch) -> dict:
        kept = [without((t or "").encode("utf-8"), covered(r, length)).decode("utf-8", "ignore")
                for t, r in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True)]
        return {"_cut_key": batch.column("key"), "_cut_text": kept}

    cut = arrow_map(hit, "text", "_cut_key long, _cut_text string", make).dropDuplicates(["_cut_key"])
    rows = docs.join(stored(cut, "cut-texts"), text_key() == F.col("_cut_key"), "left")
    return rows.select(*[F.when(F.col("_cut_key").isNotNull(), F.col("_cut_text")).otherwise(F.col(x)).alias(x) if x == "text" else F.col(x)
                         for x in docs.columns])
