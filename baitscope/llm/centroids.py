"""Operator 12: centroid clustering with a Walsh-Hadamard progressive search.

Vectors become integers, floor(64 x) of each component.  The Walsh-Hadamard
transform H is exact on integers and H H = 64 I, so 64 |v - c|^2 is the squared
difference of the transforms.  Coefficients are summed coarse to fine (by
sequency, in growing groups).  After the first group the centroid that leads is
measured over all 64; a centroid whose sum so far is strictly greater than that
cannot win nor tie and goes.  The others are summed to the end, so distances
are exact and ties go to the smallest number.

Each round is one pass over the vectors; a task sends one row a cluster (count
and 64 sums), and at most ``k`` centroids come to the driver.

Edge cases: vectors that are null, have not 64 components, or hold a null or
non-finite one are left out; with fewer than ``k`` vectors there are fewer
centroids; an empty table gives an empty table.  A vector without a vec_id is
clustered but starts no centroid; of rows of one vec_id each is a vector (the
lesser vector first, where they start centroids).  Vectors with a component of
2**20 or more (as integer) are computed in Python's unbounded integers; a distance or sum that no long
holds is null.  Other columns, also of the operator's own names, are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from baitscope.llm.common import stored, workers_import
from baitscope.llm.turns import batched, rows_of

DIM = 64
#: Coefficient groups, coarse to fine.
GROUPS = (0, 4, 8, 16, 32, 64)
#: Below this, sums of 64 squared coefficient differences fit a 64-bit integer.
PLAIN = 1 << 20
#: Vectors handled at a time.
ROWS = 4096


def sequency_order() -> np.ndarray:
    """The places of the naturally ordered transform, by number of sign changes."""
    bits = np.arange(DIM)
    signs = np.array([[bin(i & j).count("1") & 1 for j in bits] for i in bits])
    return np.argsort((np.diff(signs, axis=1) != 0).sum(axis=1), kind="stable")


ORDER = sequency_order()


def transform(v: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows of ``v`` (64-bit or Python integers), by sequency."""
    n = len(v)
    for half in (1, 2, 4, 8, 16, 32):
        v = v.reshape(n, DIM // (2 * half), 2, half)
        v = np.stack((v[:, :, 0] + v[:, :, 1], v[:, :, 0] - v[:, :, 1]), axis=2)
    return v.reshape(n, DIM)[:, ORDER]


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row of ``v``, and the squared distance."""
    if not len(v):
        return np.zeros(0, np.int64), np.zeros(0, v.dtype)
    a, b = transform(v), transform(centroids)
    first = a[:, None, :GROUPS[1]] - b[None, :, :GROUPS[1]]
    sums = (first * first).sum(axis=2)
    lead = sums.argmin(axis=1)
    rest = a[:, GROUPS[1]:] - b[lead, GROUPS[1]:]
    bound = sums[np.arange(len(v)), lead] + (rest * rest).sum(axis=1)
    row, cand = np.nonzero(sums <= bound[:, None])
    total = sums[row, cand]
    for start, end in zip(GROUPS[1:-1], GROUPS[2:], strict=True):
        d = a[row, start:end] - b[cand, start:end]
        total = total + (d * d).sum(axis=1)
        keep = (total <= bound[row]).astype(bool)
        row, cand, total = row[keep], cand[keep], total[keep]
    # Candidates of a row lie together, in ascending order; the first of the least wins.
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    best = np.minimum.reduceat(total, starts)
    hit = np.flatnonzero(total == best[row])
    hit = hit[np.diff(row[hit], prepend=-1) != 0]
    return cand[hit], total[hit] // DIM


def integers(v: np.ndarray) -> np.ndarray:
    """floor(64 x) of finite doubles, as 64-bit integers if all are small, else as Python's."""
    v = np.floor(v * DIM)
    if np.abs(v).max(initial=0) < PLAIN:
        return v.astype(np.int64)
    return np.array([[int(x) for x in r] for r in v.tolist()], object).reshape(v.shape)


def usable(rows: DataFrame) -> DataFrame:
    """Rows whose vector has 64 components, all finite."""
    vector = F.col("embedding").cast("array<double>")
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return rows.select(F.col("vec_id").cast("long"), vector.alias("embedding")).where((F.size("embedding") == DIM) & F.coalesce(fine, F.lit(False)))


def chunks(batches: Iterator[pa.RecordBatch], *centroids: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[np.ndarray]]]:
    """Pieces of Arrow batches with their vectors as integers; small and large vectors apart, with the centroids in the same integers."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            piece = batch.slice(at, ROWS)
            floats = piece.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM)
            large = (np.abs(floats) >= PLAIN // DIM - 1).any(axis=1)
            for mask in (large, ~large):
                if mask.any():
                    v = integers(floats[mask])
                    kind = object if v.dtype == object or any(c.dtype == object for c in centroids) else np.int64
                    yield piece.filter(pa.array(mask)), v.astype(kind), [c.astype(kind) for c in centroids]


def start(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of ``seed:vec_id``."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.where("vec_id IS NOT NULL").orderBy(key, "vec_id", "embedding").limit(k).collect()
    return integers(np.array([r["embedding"] for r in rows], float).reshape(-1, DIM))


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid replaced by floor(sum / count) of its vectors; empty ones stay."""
    k = len(centroids)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(k, np.int64), [[0] * DIM for _ in range(k)]
        for _, v, (c,) in chunks(batches, centroids):
            which, _ = nearest(v, c)
            count += np.bincount(which, minlength=k)
            for j in np.unique(which).tolist():
                sums[j] = [a + b for a, b in zip(sums[j], v[which == j].sum(axis=0).tolist(), strict=True)]
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(range(k), pa.int32()), "n": pa.array(count, pa.int64()),
                                          "sums": pa.array([[str(x) for x in s] for s in sums], pa.list_(pa.string()))})

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int]]:
        found: dict[int, list[int]] = {}
        for row in rows_of(batches):
            held = found.setdefault(row["cluster"], [0] * (DIM + 1))
            found[row["cluster"]] = [a + int(b) for a, b in zip(held, (row["n"], *row["sums"]), strict=True)]
        for j, (n, *s) in found.items():
            yield (j, [str(x // n) for x in s] if n else None), 0

    workers_import(vectors.sparkSession)
    sums = vectors.mapInArrow(partial, "cluster int, n long, sums array<string>").where("n > 0")
    rows = batched(sums.repartition("cluster"), "cluster int, means array<string>", total).collect()
    new = [list(map(int, c)) for c in centroids.tolist()]
    for r in rows:
        new[r["cluster"]] = list(map(int, r["means"]))
    plain = all(abs(x) < PLAIN for c in new for x in c)
    return np.array(new, np.int64 if plain else object).reshape(k, DIM)


def cluster(rows: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every usable vector of (vec_id, embedding)."""
    vectors = usable(rows)
    centroids = start(vectors, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(vectors, centroids)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    wide = "vec_id long, cluster int, exact decimal(38,0)"

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, v, (c,) in chunks(batches, centroids):
            which, distance = nearest(v, c)
            exact = [x if x < 10 ** 38 else None for x in map(int, distance)]
            yield pa.RecordBatch.from_pydict({"vec_id": piece.column("vec_id"), "cluster": pa.array(which, pa.int32()),
                                              "exact": pa.array(exact, pa.decimal128(38, 0))})

    workers_import(rows.sparkSession)
    if len(centroids):
        assigned = stored(vectors.mapInArrow(assign, wide), "clusters")
    else:
        assigned = rows.sparkSession.createDataFrame([], wide)
    known, names = assigned.groupBy("cluster").agg(F.count(F.lit(1)) == F.count("exact"), F.sum("exact")).collect(), dict(enumerate(names))
    parts = {j: int(s) if full and s is not None else None for j, full, s in known}
    whole = None if None in parts.values() else sum(parts.values())

    def long(x: int | None) -> int | None:
        return x if x is not None and x < 1 << 63 else None

    ids = rows.sparkSession.createDataFrame([(j, long(s), long(whole), names[j]) for j, s in parts.items()],
                                            "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # One row a centroid: bounded by k.
    return assigned.join(F.broadcast(ids), "cluster").select(
        "vec_id", "cluster", F.expr("try_cast(exact AS long)").alias("distance"), "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(k: int = 16, rounds: int = 3, seed: int = 1) -> str:
    """DuckDB twin: every vector against every centroid, round after round."""
    steps = [f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = 64
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS c, e FROM (SELECT sha256('{seed}:' || vec_id) AS h, e FROM v ORDER BY h LIMIT {k})
)"""]
    for i in range(rounds + 1):
        steps.append(f""", a{i} AS MATERIALIZED (
  SELECT vec_id, any_value(v.e) AS e,
    min({{'d': list_sum(list_transform(list_zip(v.e, c{i}.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 'c': c}}) AS best
  FROM v CROSS JOIN c{i} GROUP BY vec_id
)""")
        if i < rounds:
            steps.append(f""", m{i} AS MATERIALIZED (
  SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY pos) AS e
  FROM (SELECT best.c AS c, pos, sum(e[pos]) AS s, count(*) AS n FROM a{i} CROSS JOIN (SELECT unnest(range(1, 65)) AS pos) GROUP BY 1, 2)
  GROUP BY c
), c{i + 1} AS MATERIALIZED (SELECT c{i}.c AS c, coalesce(m{i}.e, c{i}.e) AS e FROM c{i} LEFT JOIN m{i} ON m{i}.c = c{i}.c)""")
    return "".join(steps) + f"""
SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance,
  CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c{rounds}.e, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON c{rounds}.c = a{rounds}.best.c"""


ORACLE_SQL = oracle_sql()
