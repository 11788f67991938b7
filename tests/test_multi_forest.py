"""CLS-07: the forest of many targets against separate Spark ML forests, its passes, its file, and odd rows."""

import numpy as np
import pytest

from baitscope.operators import ml as ML
from baitscope.operators.multi_forest import fit_multi_forest, MultiForest

N, WIDTH = 1500, 12


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.random((N, WIDTH)), 3)
    x[:, 3] = rng.random(N) < 0.02
    flags = {"a": x[:, 0] > 0.6, "b": (x[:, 1] > 0.3) & (x[:, 2] < 0.8), "rare": x[:, 3] > 0, "none": np.zeros(N, bool), "all": np.ones(N, bool)}
    names = list(flags)
    data = [(k, [float(v) for v in x[k]], *[int(flags[n][k]) for n in names]) for k in range(N)]
    df = spark.createDataFrame(data, "row_id long, features array<double>, " + ", ".join(f"`{n}` int" for n in names)).cache()
    df.count()  # the jobs that fill the cache are not those of a fit
    return df, names


def jobs_of(spark, group, work):
    spark.sparkContext.setJobGroup(group, group)
    try:
        return work(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_agrees_with_separate_forests(spark, rows, tmp_path):
    df, names = rows
    model, jobs = jobs_of(spark, "five", lambda: fit_multi_forest(df, names, WIDTH, num_trees=10, max_depth=6))
    one, jobs_of_one = jobs_of(spark, "one", lambda: fit_multi_forest(df, ["b"], WIDTH, num_trees=10, max_depth=6))
    assert model.passes == one.passes == 6 and jobs == jobs_of_one
    model.save(spark, str(tmp_path / "m"))
    back = MultiForest.load(spark, str(tmp_path / "m"))
    got = back.predict(model.predict(df).selectExpr("*", *[f"pred_{n} AS was_{n}" for n in names]).drop(*[f"pred_{n}" for n in names])).toPandas()
    vectors = ML.to_vector(df, "features")
    for name in names:
        assert (got[f"pred_{name}"] == got[f"was_{name}"]).all()
        mine = (got[f"pred_{name}"] == got[name]).mean()
        if name in ("none", "all"):
            assert mine == 1
            continue
        theirs = ML.forest(num_trees=10, max_depth=6, weighted=False, label=name).fit(vectors).transform(vectors).where(
            f"prediction = `{name}`").count() / N
        assert mine >= theirs - 0.01, (name, mine, theirs)


def test_result_does_not_depend_on_partitions(spark, rows):
    df, _ = rows
    a, b = (fit_multi_forest(df.repartition(n), ["a", "rare"], WIDTH, num_trees=3, max_depth=4) for n in (1, 7))
    assert all(np.array_equal(getattr(a, f), getattr(b, f)) for f in ("feature", "cut", "left", "prob", "roots"))


def test_odd_rows(spark):
    schema = "row_id long, features array<double>, y int, pred_z int"
    data = [(k, [float(k), 1.0], int(k > 10), 9) for k in range(20)] + [(None, None, None, None), (3, [float("nan")], 0, 9), (4, [None, 2.0, 3.0], 0, 9)]
    df = spark.createDataFrame(data, schema)
    model = fit_multi_forest(df, ["y"], 2, num_trees=5, max_depth=3)
    got = model.predict(df).collect()
    assert len(got) == len(data) and {r["pred_y"] for r in got if r["row_id"] is not None and r["row_id"] > 12} == {1}
    assert all(r["pred_y"] == 0 for r in got[20:]) and got[0].asDict().keys() == {"row_id", "features", "y", "pred_z", "pred_y"}
    with pytest.raises(ValueError):
        fit_multi_forest(df.limit(0), ["y"], 2, num_trees=2, max_depth=2)
