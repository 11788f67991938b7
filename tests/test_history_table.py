"""Surrogate ids, lookups of one file, deletes and repeated appends."""

import pytest
from pyspark.sql import functions as F

from baitscope.operators.history_table import HistoryTable


def batch(spark, ids, hot=False):
    stamp = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    rows = spark.createDataFrame([(i, f"v{i}") for i in ids], "email_id long, verdict string").repartition(6)
    return rows.select("email_id", "verdict", (stamp if hot else stamp + F.make_dt_interval(mins=(1000 - F.col("email_id")).cast("int"))).alias("timestamp"),
                       F.lit(0.0).alias("analysis_time_seconds"))


@pytest.fixture()
def apart(spark):
    """Small partitions stay apart, so that a batch has several files."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_ids_are_gapless_and_ordered(apart, tmp_path):
    t = HistoryTable(apart, str(tmp_path / "h"))
    t.append(batch(apart, range(100)), 1)
    t.append(batch(apart, range(100, 150), hot=True), 2)
    got = {r.email_id: r.id for r in t.read().collect()}
    assert sorted(got.values()) == list(range(1, 151))
    assert [got[i] for i in range(99, -1, -1)] == list(range(1, 101))  # later emails have earlier times
    assert [got[i] for i in range(100, 150)] == list(range(101, 151))  # one time: by email
    assert t.manifest().count() > 4
    assert t.read().agg(F.min("analysis_time_seconds")).first()[0] > 0
    assert [(r.batch, r.n_rows) for r in t.throughput().orderBy("batch").collect()] == [(1, 100), (2, 50)]


def test_repeated_append_gives_the_same_ids(apart, tmp_path):
    t = HistoryTable(apart, str(tmp_path / "h"))
    t.append(batch(apart, range(30)), 1)
    t.append(batch(apart, range(30, 60)), 2)
    once = {r.email_id: r.id for r in t.read().collect()}
    t.append(batch(apart, range(30, 60)), 2)
    assert {r.email_id: r.id for r in t.read().collect()} == once and t.read().count() == 60
    with pytest.raises(ValueError, match="after batch 1"):
        t.append(batch(apart, [1]), 1)


def test_lookup_opens_one_file_and_delete_rewrites_one(apart, tmp_path):
    t = HistoryTable(apart, str(tmp_path / "h"))
    t.append(batch(apart, range(80)), 1)
    before = {r.file: (r.first_id, r.last_id) for r in t.manifest().collect()}
    found = t.lookup(41)
    assert len(found.inputFiles()) == 1 < len(before) and found.first().verdict == "v39"
    old = t.read()
    assert t.delete(41) and not t.delete(41) and not t.delete(500)
    after = {r.file: (r.first_id, r.last_id) for r in t.manifest().collect()}
    assert len(set(before) - set(after)) == 1 and sorted(before.values()) == sorted(after.values())
    assert t.lookup(41).count() == 0 and t.read().count() == 79
    assert old.count() == 80  # a reader of the version before is not disturbed
    assert t.lookup(500).count() == 0
    assert [r.id for r in t.page(3, 2).collect()] == [78, 77, 76] and len(t.page(3, 2).inputFiles()) < len(after)


def test_deleted_numbers_are_not_given_again(apart, tmp_path):
    t = HistoryTable(apart, str(tmp_path / "h"))
    t.append(batch(apart, [7]), 1)
    assert t.delete(1)
    with pytest.raises(ValueError, match="deleted"):
        t.read()
    t.append(batch(apart, [8, 9]), 2)
    assert sorted(r.id for r in t.read().collect()) == [2, 3]
