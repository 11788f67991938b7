"""Operator 8: embedding near-duplicates by a subspace pigeonhole join.

Vectors are scaled to length one, rotated by a fixed random matrix and split into
blocks of ``WIDTH`` coordinates.  Two vectors of cosine ``least`` or more have a
squared distance of at most 2 - 2 * least; so in at least one block theirs is at
most that block's proportional share.  Each block is range-joined on the cells of
pivots: a vector stays with its nearest pivot and visits the cells of later pivots
that some vector within the share could lie in, so each pair of near vectors meets
once.  That is decided exactly: the other vector is nearer to its own pivot than to
any other, so this one lies at most the share's root beyond the plane between the two
pivots, for each of the ``PLANES`` pivots nearest to it.  A pair is taken up in the
first block within whose share it lies, and is checked there exactly.

The pivots are a sample by hash, ``PIVOT_RATE`` for each square root of the number of
vectors within ``LEAST_PIVOTS`` and ``MOST_PIVOTS``; they steer the work and never the result.  A
length that no pivot has is one cell.

Equal vectors of a label are one vector with a count.  Cells of more than
``CELL_ROWS`` vectors are dealt into chunks; what is compared with a chunk streams
past it, so no task holds more than a chunk and a batch.  A task returns link counts
and a spanning forest, never pairs.

Edge cases: a null label, a null, empty or zero vector and one with a null or
non-finite component link with nothing; vectors of different lengths are not
compared; repeated rows are separate vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from baitscope.llm.common import stored, workers_import
from baitscope.llm.graph import components, local_components

LEAST, WIDTH, SEED = 0.98, 16, 11
#: Pivots: at least (or all vectors), for each square root of the number of vectors, at most.
LEAST_PIVOTS, PIVOT_RATE, MOST_PIVOTS = 1024, 4, 8192
#: Nearest pivots whose planes bound a visit.
PLANES = 4
#: Vectors placed among the pivots at a time.
PLACED = 256
#: Vectors of a chunk of a cell; vectors compared with it at a time.
CELL_ROWS, SLAB = 4096, 512
#: Guards the budget against rounding; the exact check decides.
SLACK = 1e-9
#: The same for distances to pivots, which are in single precision.
PIVOT_SLACK = 1e-5
CELL = ["label", "d", "block", "cell"]


@lru_cache(maxsize=8)
def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def bounds(d: int) -> list[tuple[int, int]]:
    """The blocks of ``d`` coordinates."""
    n = max(1, d // WIDTH)
    cuts = [d * k // n for k in range(n + 1)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def budget(d: int, lo: int, hi: int, least: float) -> float:
    """The block's share of the squared distance."""
    return (2 - 2 * least) * (hi - lo) / d + SLACK


def units(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), "<f4").reshape(len(raw), -1).astype(float)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def turned_units(raw: list[bytes]) -> np.ndarray:
    """Unit vectors and, behind each, its rotation."""
    x = units(raw)
    return np.hstack([x, x @ rotation(x.shape[1])])


def pivots(vectors: DataFrame) -> dict[int, np.ndarray]:
    """The vectors of least hash, by length; at most ``MOST_PIVOTS`` of them in all."""
    most = max(LEAST_PIVOTS, min(MOST_PIVOTS, int(PIVOT_RATE * np.sqrt(vectors.count()))))
    # k is a hash, so its least values are a sample.
    raw = [np.array(v, "<f4") for v in vectors.orderBy("k").limit(most).toArrow().column("embedding").to_pylist()]
    return {d: units([v.tobytes() for v in raw if len(v) == d]) for d in sorted({len(v) for v in raw})}


def place(y: np.ndarray, p: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's nearest pivot; the rows and later pivots whose cells hold points within ``r`` of them."""
    if not len(p):
        return np.zeros(len(y), np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)
    y, p = y.astype(np.float32), p.astype(np.float32)
    away = (y ** 2).sum(axis=1)[:, None] + (p ** 2).sum(axis=1) - 2 * (y @ p.T)
    home = away.argmin(axis=1)
    # Nobody within r is further from its nearest pivot than this row from its own, plus r.
    reach = (np.sqrt(np.maximum(away.min(axis=1), 0)) + 2 * r) ** 2 + PIVOT_SLACK
    row, to = np.nonzero(away <= reach[:, None])
    row, to = row[to > home[row]], to[to > home[row]]
    planes = min(PLANES, len(p))
    for near in np.argpartition(away, planes - 1, axis=1)[:, :planes].T:
        apart = np.sqrt(((p[near[row]] - p[to]) ** 2).sum(axis=1))
        inside = away[row, to] - away[row, near[row]] <= 2 * r * apart + PIVOT_SLACK
        row, to = row[inside], to[inside]
    return home.astype(np.int32), row, to.astype(np.int32)


def cells(vectors: DataFrame, least: float) -> DataFrame:
    """Each vector once for each block, with its cell and those it visits; (k, label, m, embedding) in."""
    workers_import(vectors.sparkSession)
    shared = vectors.sparkSession.sparkContext.broadcast(pivots(vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turned = {d: p @ rotation(d) for d, p in shared.value.items()}
        for whole in batches:
            for start in range(0, whole.num_rows, PLACED):
                batch = whole.slice(start, PLACED)
                raw = [np.array(v, "<f4").tobytes() for v in batch.column("embedding").to_pylist()]
                size = np.array([len(x) // 4 for x in raw])
                for d in np.unique(size).tolist():
                    at = np.flatnonzero(size == d)
                    own = [raw[i] for i in at]
                    x, p = units(own) @ rotation(d), turned.get(d, np.zeros((0, d)))
                    ids = pa.array(at)
                    for b, (lo, hi) in enumerate(bounds(d)):
                        home, row, to = place(x[:, lo:hi], p[:, lo:hi], float(np.sqrt(budget(d, lo, hi, least))))
                        ends = np.searchsorted(row, np.arange(len(at) + 1)).astype(np.int32)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("label").take(ids), pa.array(np.full(len(at), d, np.int32)),
                             pa.array(np.full(len(at), b, np.int32)), pa.array(home),
                             batch.column("k").take(ids), batch.column("m").take(ids), pa.array(own, pa.binary()),
                             pa.ListArray.from_arrays(pa.array(ends), pa.array(to))],
                            [*CELL, "k", "m", "vec", "visits"])

    return vectors.mapInArrow(run, "label int, d int, block int, cell int, k long, m long, vec binary, visits array<int>")


def meet(rows: DataFrame, least: float) -> DataFrame:
    """k, n, other: links found of a vector in a task's comparisons, and a vector of its component there."""
    key = [*CELL, "chunk"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, home = None, None
        for whole in batches:
            roles = whole.column("role").to_numpy()
            ids = np.stack([whole.column(x).to_numpy() for x in key])
            k, m = whole.column("k").to_numpy(), whole.column("m").to_numpy()
            # Runs of one cell and chunk; those of a chunk come before what visits it.
            new_run = (ids[:, 1:] != ids[:, :-1]).any(axis=0) | (np.diff(roles) != 0)
            cuts = np.concatenate(([0], np.flatnonzero(new_run) + 1, [whole.num_rows])).tolist()
            of_d = ids[key.index("d")]
            d_cuts = np.concatenate(([0], np.flatnonzero(np.diff(of_d)) + 1, [whole.num_rows])).tolist()
            # All vectors of a stretch of one length are turned at once.
            x: list[np.ndarray] = []
            for start, end in zip(d_cuts[:-1], d_cuts[1:], strict=True):
                if end > start:
                    x.extend(turned_units(whole.column("vec").slice(start, end - start).to_pylist()))
            for first, last in zip(cuts[:-1], cuts[1:], strict=True):
                for start in range(first, last, CELL_ROWS):
                    end = min(start + CELL_ROWS, last)
                    own = tuple(ids[:, start].tolist())
                    part = Side(k[start:end], m[start:end], np.stack(x[start:end]), least, own[2])
                    new = own != at
                    if roles[start] > 0:
                        if not new and home is not None:
                            yield from part.against(home)
                    else:
                        yield from part.within()
                        if new or home is None:
                            home = part
                        else:
                            # A cell's own vectors that came in more than one batch; a chunk's size bounds them.
                            yield from part.against(home)
                            home = home.joined(part)
                    if new and roles[start] > 0:
                        home = None
                    at = own

    workers_import(rows.sparkSession)
    dealt = rows.repartition(*key).sortWithinPartitions(*key, "role", "k")
    return dealt.mapInArrow(run, "k long, n long, other long")


class Side:
    """Vectors of one cell, ready to be compared; ``x`` holds the unit vectors, then the rotated ones."""

    def __init__(self, k: np.ndarray, m: np.ndarray, x: np.ndarray, least: float, block: int) -> None:
        self.k, self.m, self.both, self.least, self.block = k, m, x, least, block
        d = x.shape[1] // 2
        self.x, self.turned = x[:, :d], x[:, d:]
        self.cuts = bounds(d)[:block + 1]

    def joined(self, more: Side) -> Side:
        return Side(np.append(self.k, more.k), np.append(self.m, more.m), np.vstack([self.both, more.both]), self.least, self.block)

    def _near(self, a: slice, other: Side, b: slice, block: int) -> np.ndarray:
        lo, hi = self.cuts[block]
        most = budget(self.x.shape[1], lo, hi, self.least)
        mine, theirs = self.turned[a, lo:hi], other.turned[b, lo:hi]
        gap = (mine ** 2).sum(axis=1)[:, None] + (theirs ** 2).sum(axis=1)
        return gap - 2 * (mine @ theirs.T) <= most

    def links(self, a: slice, other: Side, b: slice) -> np.ndarray:
        """Which pairs lie within this block's share, within no earlier block's, and are near enough."""
        near = self._near(a, other, b, self.block)
        for earlier in range(self.block):
            if not near.any():
                return near
            near &= ~self._near(a, other, b, earlier)
        return near & (self.x[a] @ other.x[b].T >= self.least) if near.any() else near

    def within(self) -> Iterator[pa.RecordBatch]:
        yield from self._compare(self, same=True)

    def against(self, other: Side) -> Iterator[pa.RecordBatch]:
        yield from self._compare(other, same=False)

    def _compare(self, other: Side, same: bool) -> Iterator[pa.RecordBatch]:
        n, o = len(self.k), 0 if same else len(self.k)
        size = n if same else n + len(other.k)
        count, us, vs = np.zeros(size, np.int64), [], []
        for i in range(0, n, SLAB):
            a = slice(i, min(i + SLAB, n))
            for j in range(i if same else 0, len(other.k), SLAB):
                b = slice(j, min(j + SLAB, len(other.k)))
                found = self.links(a, other, b)
                if same and i == j:
                    found = np.triu(found, 1)
                if not found.any():
                    continue
                count[a] += found @ other.m[b]
                count[b.start + o:b.stop + o] += self.m[a] @ found
                u, v = np.nonzero(found)
                # A forest of this slab's links keeps its components.
                rows, columns = a.stop - a.start, b.stop - b.start
                label = local_components(rows + columns, u, v + rows)
                where = np.concatenate((np.arange(a.start, a.stop), np.arange(b.start, b.stop) + o))
                linked = np.flatnonzero(label != np.arange(len(label)))
                us.append(where[linked])
                vs.append(where[label[linked]])
        if us:
            u, v = np.concatenate(us), np.concatenate(vs)
            label = local_components(size, u, v)
            ids = self.k if same else np.concatenate((self.k, other.k))
            held = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(ids[held]), pa.array(count[held]), pa.array(ids[label[held]])], ["k", "n", "other"])


def meetings(vectors: DataFrame, least: float = LEAST, cell_rows: int = CELL_ROWS) -> DataFrame:
    """The rows that ``meet`` compares: vectors by cell and chunk, at home (role 0) or on a visit (1)."""
    c = F.col
    home = stored(cells(vectors, least), "cells")
    crowded = stored(home.groupBy(*CELL).count().where(c("count") > cell_rows)
                     .select(*CELL, F.ceil(c("count") / cell_rows * 1.25).cast("int").alias("chunks")), "crowded")
    chunks = F.coalesce("chunks", F.lit(1))
    own = home.join(crowded, CELL, "left").withColumns({"chunks": chunks, "chunk": F.pmod(F.xxhash64("k"), chunks).cast("int")})
    stay = own.withColumn("role", F.lit(0))
    # In a dealt cell a vector also meets the chunks before its own.
    meets = own.where("chunk > 0").withColumns({"chunk": F.explode(F.sequence(F.lit(0), c("chunk") - 1)), "role": F.lit(1)})
    visits = (home.withColumn("cell", F.explode("visits")).join(crowded, CELL, "left")
              .withColumns({"chunk": F.explode(F.sequence(F.lit(0), chunks - 1)), "role": F.lit(1)}))
    names = [*CELL, "chunk", "role", "k", "m", "vec"]
    return stay.select(names).union(meets.select(names)).union(visits.select(names))


def link_rows(vectors: DataFrame, least: float = LEAST, cell_rows: int = CELL_ROWS) -> DataFrame:
    """k, n, other of ``meet`` for distinct vectors (k, label, m, embedding)."""
    return meet(meetings(vectors, least, cell_rows), least)


def keyed(embeddings: DataFrame) -> DataFrame:
    """vec_id, embedding, label, and k: the vector's key, null where it can link with nothing."""
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>"), F.col("label").cast("int"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    return rows.withColumn("k", F.when(usable, F.xxhash64("label", "embedding")))


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """k, label, embedding, m (rows) and least_id of each vector."""
    return rows.where("k IS NOT NULL").groupBy("k", "label", "embedding").agg(
        F.count("*").alias("m"), F.min("vec_id").alias("least_id"))


def near_vectors(embeddings: DataFrame, least: float = LEAST, cell_rows: int = CELL_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, embedding, label)."""
    c = F.col
    rows = keyed(embeddings)
    vectors = stored(distinct_vectors(rows), "vectors")
    found = stored(link_rows(vectors.select("k", "label", "m", "embedding"), least, cell_rows), "vector-links")
    counts = found.groupBy("k").agg(F.sum("n").alias("n"))
    linked = components(found.select(c("k").alias("u"), c("other").alias("v")))
    own = vectors.select("k", "m", "least_id")
    of = own.join(linked.withColumnRenamed("node", "k"), "k", "left").select("k", F.coalesce("component", "k").alias("component"), "least_id")
    least_ids = of.groupBy("component").agg(F.min("least_id").alias("component_id"))
    facts = (own.join(counts, "k", "left").join(of.select("k", "component"), "k").join(least_ids, "component")
             .select("k", (c("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id"))
    out = rows.select("vec_id", "k").join(facts, "k", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(c("k").isNull(), c("vec_id")).otherwise(c("component_id")).alias("component_id"))
    return out.withColumn("kept", c("vec_id").eqNullSafe(c("component_id")))


ORACLE_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0
    AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
p AS (SELECT a.vec_id AS u, b.vec_id AS v FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id
      AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.98),
r AS (SELECT vec_id AS n, vec_id AS c FROM embeddings UNION SELECT p.v, r.c FROM r JOIN p ON p.u = r.n),
g AS (SELECT n, min(c) AS component_id FROM r GROUP BY n),
l AS (SELECT u, count(*) AS k FROM p GROUP BY u)
SELECT m.vec_id, CAST(coalesce(l.k, 0) AS BIGINT) AS n_links, g.component_id, m.vec_id = g.component_id AS kept
FROM embeddings m JOIN g ON g.n = m.vec_id LEFT JOIN l ON l.u = m.vec_id
"""
