"""A CSV with quoted line breaks, read by byte ranges, has the rows of the whole reader."""

import os
import random
import tempfile

import pytest

from baitscope.sources.files import read_csv
from baitscope.sources.split_csv import lines, ranges, read_split_csv, records


def _field(rng):
    kind = rng.randrange(6)
    text = " ".join(rng.choice(["pay", "now", "ünder", "a,b", 'say "x"', "x;y"]) for _ in range(rng.randrange(1, 30)))
    if kind == 0:
        return ""
    if kind < 4:
        text = text.replace(" ", rng.choice([" ", "\n", "\r\n", "\n\n"]), 3)
    return '"' + text.replace('"', '""') + '"'


def _rows(df):
    return sorted(tuple("\0" if v is None else v for v in r) for r in df.collect())


@pytest.fixture
def small_ranges(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    yield spark
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_rows_of_the_whole_reader(small_ranges, end):
    spark, rng = small_ranges, random.Random(4)
    d = tempfile.mkdtemp(prefix="split-csv-", dir="/tmp")
    for name in ("a", "b"):
        rows = [[str(k), _field(rng), _field(rng), rng.choice(["0", "1", ""])] for k in range(400)]
        # A record over many ranges, a blank line, a short row.
        rows[200][2] = '"' + "long line, \n" * 2000 + '"'
        rows += [[""], ["7", "short"]]
        with open(os.path.join(d, f"{name}.csv"), "w", newline="") as f:
            f.write(end.join(",".join(r) for r in [["id", "subject", "body", "label"], *rows]) + end)
    got = read_split_csv(spark, d)
    want = read_csv(spark, d)
    assert got.columns == want.columns
    assert _rows(got) == _rows(want)
    # The work is dealt to many tasks, and some ranges begin inside a field.
    assert records(spark, d).select("file", "start").distinct().count() > 20
    assert ranges(lines(spark, d)).where("opened").count() > 5


def test_small_files(spark):
    d = tempfile.mkdtemp(prefix="split-csv-", dir="/tmp")
    for name, raw in {"none": b"", "head": b"x,y\n", "open": b'x,y\n1,"never closed\n2,z', "bad": b"x,y\n1,\xff\xfez\n"}.items():
        path = os.path.join(d, f"{name}.csv")
        with open(path, "wb") as f:
            f.write(raw)
        if raw:
            assert _rows(read_split_csv(spark, path, ",")) == _rows(read_csv(spark, path, ",")), name
        else:
            assert records(spark, path).count() == 0
