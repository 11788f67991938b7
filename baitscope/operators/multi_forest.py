"""CLS-07: one forest for many 0/1 targets, all its trees grown together.

The input is read once and its features are binned once.  A tree level is one pass: each task routes its rows
through the trees so far and adds up (node, feature, bin) counts for the open
nodes of every tree of every target; Spark sums them, and a window over the
bins of a node's feature finds its best Gini split.  Passes depend on the
depth, never on the number of targets.  The driver holds only the nodes (at
most targets x trees x 2**depth), as does the model that goes to the tasks.

Null and NaN features count as 0, null targets as 0; vectors are padded or cut
to the length of ``n_features``; a constant target is a constant; fitting on
no rows raises a ValueError.  A row's bootstrap weight is Poisson(1) from a
hash of its key and the tree, so a task that runs again counts the same.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from baitscope.session import ensure_checkpoint_dir

#: Cuts of a feature: so many quantiles of its values, and as many of its distinct values.
QUANTILES = 32
#: Cumulative Poisson(1) probabilities, from zero on.
POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate(([1.0], np.arange(1.0, 12.0)))))


@dataclass
class MultiForest:
    """Flat trees: ``feature`` (-1: leaf), ``cut`` (bins up to it go left), ``left`` (right is next to it), ``prob``."""
    targets: list[str]
    cuts: list[np.ndarray]
    roots: np.ndarray  # one row a target, one column a tree
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    prob: np.ndarray
    passes: int = 0

    def probabilities(self, features: Column | str) -> Column:
        """Mean probability of each target, in the order of ``targets``."""
        trees = self

        @F.pandas_udf("array<double>")
        def score(vectors: pd.Series) -> pd.Series:
            x = binned(vectors.tolist(), trees.cuts)
            out = np.zeros((len(x), len(trees.targets)))
            for k, roots in enumerate(trees.roots):
                for root in roots:
                    out[:, k] += trees.prob[route(x, root, trees.feature, trees.cut, trees.left)]
            return pd.Series(list(out / trees.roots.shape[1]))

        return score(features)

    def predict(self, df: DataFrame, features: str = "features") -> DataFrame:
        """``df`` with a 0/1 column pred_<target> for each target; a tie is 0."""
        flags = [(F.col("_p")[k] > 0.5).cast("int").alias(f"pred_{name}") for k, name in enumerate(self.targets)]
        return df.withColumn("_p", self.probabilities(features)).select(*[F.col(f"`{name}`") for name in df.columns], *flags)

    def save(self, spark: SparkSession, path: str) -> None:
        """Two small tables: nodes, and cuts with the names and roots."""
        nodes = pd.DataFrame({"id": np.arange(len(self.prob)), "feature": self.feature, "cut": self.cut, "left": self.left, "prob": self.prob})
        spark.createDataFrame(nodes).write.mode("overwrite").parquet(f"{path}/nodes")
        rows = [("cuts", k, "", [float(v) for v in row]) for k, row in enumerate(self.cuts)]
        rows += [("roots", k, name, [float(v) for v in row]) for k, (name, row) in enumerate(zip(self.targets, self.roots, strict=True))]
        spark.createDataFrame(rows, "part string, id int, name string, numbers array<double>").write.mode("overwrite").parquet(f"{path}/heads")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> MultiForest:
        nodes = spark.read.parquet(f"{path}/nodes").toPandas().sort_values("id")
        heads = spark.read.parquet(f"{path}/heads").orderBy("id").collect()
        roots = [r for r in heads if r["part"] == "roots"]
        return cls([r["name"] for r in roots], [np.array(r["numbers"], float) for r in heads if r["part"] == "cuts"],
                   np.array([r["numbers"] for r in roots], np.int64), *[nodes[n].to_numpy() for n in ("feature", "cut", "left", "prob")])


def binned(vectors: list, cuts: list[np.ndarray]) -> np.ndarray:
    """Number of cuts below each value, one row a vector."""
    x = np.zeros((len(vectors), len(cuts)))
    for row, v in zip(x, vectors, strict=True):
        if v is not None:
            v = np.asarray(v, float)[:len(cuts)]
            row[:len(v)] = v
    x[np.isnan(x)] = 0.0
    return np.stack([np.searchsorted(cut, x[:, k], side="left") for k, cut in enumerate(cuts)], axis=1).astype(np.uint8)


def route(x: np.ndarray, root: int, feature: np.ndarray, cut: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The leaf or open node of each row."""
    node = np.full(len(x), root, np.int64)
    at = np.arange(len(x))
    while len(at):
        f = feature[node[at]]
        at, f = at[f >= 0], f[f >= 0]
        node[at] = left[node[at]] + (x[at, f] > cut[node[at]])
    return node


def draws(key: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """Poisson(1) weight of each key in a tree."""
    with np.errstate(over="ignore"):
        h = key.view(np.uint64) ^ (np.uint64(tree + 1) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(seed)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        h ^= h >> np.uint64(31)
    return np.searchsorted(POISSON, (h >> np.uint64(11)) * 2.0 ** -53, side="right")


def find_cuts(df: DataFrame, features: str, n_features: int) -> list[np.ndarray]:
    """Sorted cuts of each feature; rare values have theirs from the quantiles of distinct values."""
    value = F.coalesce(F.nanvl("col", F.lit(0.0)), F.lit(0.0))
    values = df.select(F.posexplode(features)).where(F.col("pos") < n_features).select("pos", value.alias("v"))
    steps = [k / QUANTILES for k in range(QUANTILES)]
    found = [x.groupBy("pos").agg(F.percentile_approx("v", steps).alias("q")) for x in (values, values.distinct())]
    cuts = [{0.0} for _ in range(n_features)]
    for r in found[0].union(found[1]).collect():
        cuts[r["pos"]].update(r["q"])
    return [np.array(sorted(c)) for c in cuts]


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/multi-forest-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def training_table(df: DataFrame, features: str, targets: list[str], key: str) -> DataFrame:
    """key (hash), x and flags (a byte for each target) of every row: the only pass over ``df``, which may cost much."""
    flags = F.concat(*[F.when(F.col(f"`{name}`") > 0, F.lit(b"\x01")).otherwise(F.lit(b"\x00")) for name in targets])
    return stored(df.select(F.xxhash64(key).alias("key"), F.col(features).cast("array<double>").alias("x"), flags.alias("flags")), "rows")


def binned_table(rows: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """key, bins and flags (a byte each) of every row, written once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = binned(batch.column("x").to_pylist(), cuts)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([r.tobytes() for r in x], pa.binary()), batch.column("flags")],
                                             ["key", "bins", "flags"])

    return stored(rows.mapInArrow(run, "key long, bins binary, flags binary"), "bins")


def level_counts(data: DataFrame, trees: MultiForest, opened: np.ndarray, tried: np.ndarray, seed: int) -> DataFrame:
    """Rows a (open node), f, bin, n, pos: weights and weights of ones, for the ``tried`` features of the ``opened`` nodes.

    ``opened`` is sorted by tree: the nodes of one tree are next to each other.
    """
    width, bins = tried.shape[1], max(map(len, trees.cuts)) + 1
    place = np.full(len(trees.feature), -1, np.int64)
    place[opened[:, 1]] = np.arange(len(opened))
    of_tree, first, count = np.unique(opened[:, 0], return_index=True, return_counts=True)
    n_trees = trees.roots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            flags = np.frombuffer(b"".join(batch.column("flags").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            key = batch.column("key").to_numpy()
            for tree in range(n_trees):
                w = draws(key, tree, seed)
                drawn = np.flatnonzero(w)
                out = []
                for t, lo, m in zip(of_tree, first, count, strict=True):
                    if t % n_trees != tree:
                        continue
                    a = place[route(every[drawn], trees.roots[t // n_trees, tree], trees.feature, trees.cut, trees.left)]
                    rows, a = drawn[a >= 0], a[a >= 0]
                    code = ((a - lo)[:, None] * width + np.arange(width)) * bins + every[rows[:, None], tried[a]]
                    weight = np.repeat(w[rows], width)
                    n = np.bincount(code.ravel(), weight, m * width * bins)
                    pos = np.bincount(code.ravel(), weight * np.repeat(flags[rows, t // n_trees], width), m * width * bins)
                    hit = np.flatnonzero(n)
                    node = lo + hit // (width * bins)
                    out.append((node, tried[node, hit // bins % width], hit % bins, n[hit], pos[hit]))
                if out:
                    columns = [pa.array(np.concatenate(x).astype(kind)) for x, kind in
                               zip(zip(*out, strict=True), (np.int32, np.int32, np.int32, np.int64, np.int64), strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, ["a", "f", "bin", "n", "pos"])

    counts = data.mapInArrow(run, "a int, f int, bin int, n long, pos long")
    return counts.groupBy("a", "f", "bin").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))


def best_splits(counts: DataFrame, least: int) -> DataFrame:
    """a, n, pos (of the node), and gain (negative: none), f, bin, n and pos on the left of its best split."""
    c = F.col
    bins = Window.partitionBy("a", "f")
    upto = bins.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    x = counts.select("a", "f", "bin", F.sum("n").over(upto).alias("nl"), F.sum("pos").over(upto).alias("pl"),
                      F.sum("n").over(bins).alias("n"), F.sum("pos").over(bins).alias("pos"))
    pure = lambda n, p: (p * p + (n - p) * (n - p)) / n
    nr, pr = c("n") - c("nl"), c("pos") - c("pl")
    gain = F.when((c("nl") >= least) & (nr >= least), pure(c("nl"), c("pl")) + pure(nr, pr) - pure(c("n"), c("pos"))).otherwise(-1.0)
    best = F.max(F.struct(gain.alias("gain"), (-c("f")).alias("f"), (-c("bin")).alias("bin"), "nl", "pl")).alias("best")
    return x.groupBy("a").agg(F.max("n").alias("n"), F.max("pos").alias("pos"), best).select(
        "a", "n", "pos", "best.gain", (-c("best.f")).alias("f"), (-c("best.bin")).alias("bin"), "best.nl", "best.pl")


def fit_multi_forest(df: DataFrame, targets: list[str], n_features: int, features: str = "features", key: str = "row_id",
                     num_trees: int = 100, max_depth: int = 15, least: int = 2, seed: int = 42) -> MultiForest:
    """A forest of ``num_trees`` trees for each of ``targets`` on an array column; sqrt of the features are tried a node."""
    rows = training_table(df, features, targets, key)
    cuts = find_cuts(rows, "x", n_features)
    data = binned_table(rows, cuts)
    total = len(targets) * num_trees
    trees = MultiForest(list(targets), cuts, np.arange(total).reshape(len(targets), num_trees), np.full(total, -1, np.int64),
                        np.zeros(total, np.int64), np.zeros(total, np.int64), np.zeros(total))
    opened = np.stack([np.arange(total), np.arange(total)], axis=1)  # tree, node
    width = int(np.ceil(np.sqrt(n_features)))
    for level in range(max_depth):
        random = np.random.default_rng((seed, level)).random((len(opened), n_features))
        tried = np.argsort(random, axis=1)[:, :width]
        found = best_splits(level_counts(data, trees, opened, tried, seed), least).toPandas().sort_values("a")
        if not level and not len(found):
            raise ValueError("no rows to fit a forest on")
        trees.passes += 1
        at = found["a"].to_numpy()
        trees.prob[opened[at, 1]] = found["pos"] / found["n"]
        split = found[found["gain"] > 1e-9]
        parent = opened[split["a"].to_numpy()]
        lefts = len(trees.feature) + 2 * np.arange(len(split))
        trees.feature[parent[:, 1]], trees.cut[parent[:, 1]], trees.left[parent[:, 1]] = split["f"], split["bin"], lefts
        n = np.stack([split["nl"], split["n"] - split["nl"]], axis=1).ravel()
        pos = np.stack([split["pl"], split["pos"] - split["pl"]], axis=1).ravel()
        more = len(n)
        trees.feature = np.concatenate([trees.feature, np.full(more, -1, np.int64)])
        trees.cut, trees.left = (np.concatenate([v, np.zeros(more, np.int64)]) for v in (trees.cut, trees.left))
        trees.prob = np.concatenate([trees.prob, pos / np.maximum(n, 1)])
        children = np.stack([np.repeat(parent[:, 0], 2), len(trees.feature) - more + np.arange(more)], axis=1)
        opened = children[(n >= 2 * least) & (pos > 0) & (pos < n)]
        if not len(opened):
            break
    return trees
