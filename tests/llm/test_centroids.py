"""Operator 12 against plain Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from baitscope.llm import centroids as C

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, distance string, exact string"


def brute(rows, k=16, rounds=3, seed=1):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), i, v) for i, v in kept if i is not None)
    cents = [v for _, _, v in named[:k]]

    def best(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(best(v)[1], []).append(v)
        for j, vs in groups.items():
            cents[j] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    found = [(i, *best(v)) for i, v in kept]
    total = {}
    for _, d, j in found:
        total[j] = total.get(j, 0) + d
    whole = sum(total.values())

    def long(x):
        return x if x < 1 << 63 else None

    return sorted(((i, j, long(d), long(total[j]), long(whole), hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest())
                   for i, d, j in found), key=repr)


def collected(df):
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def floats(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "z", "z", "z") for i, v in rows], SCHEMA).repartition(5)


def sample(rng, n):
    return [(i, [rng.gauss(0, .2) for _ in range(64)]) for i in range(n)]


def test_transform_is_exact_and_orthogonal():
    v = np.random.default_rng(1).integers(-500, 500, (50, 64))
    t = C.transform(v)
    assert ((t[:, None] - t[None]) ** 2).sum(2).tolist() == (64 * ((v[:, None] - v[None]) ** 2).sum(2)).tolist()
    assert (t[:, 0] == v.sum(1)).all()


@pytest.mark.parametrize("kind", [np.int64, object])
def test_nearest_with_ties(kind):
    rng = np.random.default_rng(2)
    v, c = rng.integers(-2, 2, (400, 64)), rng.integers(-2, 2, (9, 64))
    v[:, 4:] = 0
    c[:, 4:] = 0
    c = np.concatenate([c, c])
    which, distance = C.nearest(v.astype(kind), c.astype(kind))
    full = ((v[:, None] - c[None]) ** 2).sum(2)
    assert which.tolist() == full.argmin(1).tolist()
    assert distance.tolist() == full.min(1).tolist()


def test_clusters_equal_brute_force(spark):
    rng = random.Random(4)
    rows = sample(rng, 150)
    rows += [(200 + i, rows[3][1]) for i in range(60)]  # one vector with a share of all rows
    rows += [(7, rows[8][1]), (7, rows[7][1]), (None, rows[9][1]), (300, None), (301, []), (302, [0.1] * 63), (303, [0.1] * 65),
             (304, [None] + [0.1] * 63), (305, [float("nan")] * 64), (306, [float("inf")] + [0.] * 63), (307, [0.] * 64)]
    rows = floats(rows)
    assert collected(C.cluster(table(spark, rows))) == brute(rows)


def test_fewer_vectors_than_centroids(spark):
    rows = floats(sample(random.Random(6), 5))
    assert collected(C.cluster(table(spark, rows))) == brute(rows)
    assert collected(C.cluster(table(spark, rows).limit(0))) == []


def test_huge_components(spark):
    rng = random.Random(7)
    rows = sample(rng, 30) + [(100, [1e6] * 64), (101, [-3e18] + [0.5] * 63), (102, [3e38] * 64), (103, [16384.] * 64)]
    rows = floats(rows)
    assert collected(C.cluster(table(spark, rows), k=4)) == brute(rows, k=4)
