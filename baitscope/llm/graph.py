"""Connected components of a distributed edge table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from baitscope.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of an edge (u, v), long ids.

    Alternates large-star and small-star steps until nothing changes.  Every step is
    a grouped minimum and a join on a unique side; each round's edges are a table in
    the shared folder, and only a count and a checksum reach the driver.  Nodes of
    many edges are fine: the minimum is taken before the shuffle, and the side of the
    join that repeats a node can be split.
    """
    c = F.col
    e = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, last = stored(e, "edges"), None
    while True:
        both = e.union(e.select(c("v").alias("u"), c("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), c("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(c("v").alias("u"), c("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = least.select("u", c("m").alias("v")).union(joined.where("v != m").select(c("v").alias("u"), c("m").alias("v")))
        e = stored(small.distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == last:
            return e.select(c("u").alias("node"), c("v").alias("component")).union(
                e.select(c("v").alias("node"), c("v").alias("component")).distinct())
        last = tuple(now)


def local_components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest member of each node's component, for a small graph held by one task."""
    label = np.arange(n)
    while len(u):
        low = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, u, low)
        np.minimum.at(label, v, low)
        np.minimum.at(label, before[u], low)
        np.minimum.at(label, before[v], low)
        label = label[label]
        if (label == before).all():
            break
    return label
