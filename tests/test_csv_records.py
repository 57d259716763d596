"""CSV records that span lines, put together from splits that many tasks read."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from latelane.sources import tables


@pytest.fixture
def small_splits(spark):
    settings = {"spark.sql.files.maxPartitionBytes": "2k", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def cells(rng):
    plain = ["a", "b c", "", "12", "ü"]
    hard = ['say "x"', "two\nlines", "a,b", '"', "\n", 'one\n"two"\nthree', "tail\n"]
    return rng.choice(hard) if rng.random() < 0.2 else rng.choice(plain)


def write(path, rows, ending="\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator=ending).writerows(rows)


def given(seed, n=800):
    rng = random.Random(seed)
    return [[str(i), *(cells(rng) for _ in range(3))] for i in range(n)]


def expected(rows):
    return sorted(tuple(c or "" for c in r) for r in rows)


def found(df):
    return sorted(tuple(c or "" for c in r) for r in df.collect())


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_one_file_is_read_by_several_tasks(spark, tmp_path, small_splits, ending):
    rows = given(1)
    path = tmp_path / "t.csv"
    write(path, [["id", "x", "y", "z"], *rows], ending)
    assert spark.read.text(str(path)).rdd.getNumPartitions() > 5
    df = tables._csv_table(spark, str(path), None)
    assert df.columns == ["id", "x", "y", "z"]
    assert found(df) == expected(rows)
    blocks = tables.csv_records(spark, str(path)).select("block").distinct().count()
    assert blocks > 5


def test_records_longer_than_a_split(spark, tmp_path, small_splits):
    rows = [["1", "x" * 3000 + "\n" + 'y"' * 2000, "a"], ["2", "b", "line\n" * 2000], ["3", "", "end"]]
    path = tmp_path / "t.csv"
    write(path, [["id", "x", "y"], *rows])
    assert found(tables._csv_table(spark, str(path), None)) == expected(rows)


def test_several_files_and_a_broken_header(spark, tmp_path, small_splits):
    folder = tmp_path / "t.csv"
    folder.mkdir()
    rows = [given(s, 200) for s in (2, 3, 4)]
    for i, part in enumerate(rows):
        write(folder / f"part-{i}.csv", [["id", "first\nname", "y", "z"], *part])
    df = tables._csv_table(spark, str(folder), None)
    assert df.columns == ["id", "first\nname", "y", "z"]
    assert found(df) == expected([r for part in rows for r in part])
    write(folder / "part-9.csv", [["id", "x", "y", "z"], ["1", "a\nb", "", ""]])
    with pytest.raises(ValueError):
        tables._csv_table(spark, str(folder), None)


def test_the_same_rows_as_in_multi_line_mode(spark, tmp_path):
    path = tmp_path / "t.csv"
    write(path, [["id", "x", "y", "z"], *given(6, 300)])
    whole = tables._csv_table(spark, str(path), True)
    assert found(tables._csv_table(spark, str(path), None)) == found(whole)


def test_only_torn_lines_are_moved(spark, tmp_path):
    path = tmp_path / "t.csv"
    write(path, [["id", "x"], *[[str(i), "plain"] for i in range(500)], ["n", "a\nb"]])
    records = tables.csv_records(spark, str(path))
    assert records.count() == 502
    assert records.where(F.col("value").contains("\n")).count() == 1
