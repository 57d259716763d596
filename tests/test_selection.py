import random
from statistics import median

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from latelane.operators import selection
from latelane.operators.selection import (
    counted_values,
    exact_medians,
    histogram_median,
    running_totals,
)


def skewed_rows(seed, n=3000):
    """A third of the rows in one group, many equal values in another, some nulls."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else rng.choice(["a", "b", "c", None])
        value = rng.choice([1.0, 1.0, 7.5]) if key == "b" else rng.lognormvariate(0, 6)
        rows.append((key, None if rng.random() < 0.1 else value, float(i % 5)))
    rows.append(("void", None, None))
    return rows


SCHEMA = "k string, x double, y double"


def test_grouped_medians(spark):
    rows = skewed_rows(1)
    found = exact_medians(spark.createDataFrame(rows, SCHEMA), ["x", "y"], ["k"])
    found = {r["k"]: (r["x"], r["y"]) for r in found.collect()}
    assert set(found) == {"hot", "a", "b", "c", "void"}
    for key, pair in found.items():
        for place, value in enumerate(pair, 1):
            present = [r[place] for r in rows if r[0] == key and r[place] is not None]
            assert value == (pytest.approx(median(present)) if present else None)


def test_overall_medians(spark):
    rows = skewed_rows(2)
    row = exact_medians(spark.createDataFrame(rows, SCHEMA), ["x", "y"]).first()
    assert row["x"] == pytest.approx(median(r[1] for r in rows if r[1] is not None))
    assert row["y"] == 2.0


def test_even_count_interpolates(spark):
    df = spark.createDataFrame([(float(i),) for i in (1, 2, 3, 4)], "x double")
    assert exact_medians(df, ["x"]).first()["x"] == 2.5
    counted = df.groupBy("x").agg(F.lit(3).cast("bigint").alias("n"))
    assert counted.agg(histogram_median("x", "n")).first()[0] == 2.5


@pytest.mark.parametrize(
    "values, expected",
    [
        ([1.0, 2.0, float("nan")], 1.5),
        ([float("inf"), 1.0, 2.0], 2.0),
        ([float("-inf"), float("inf"), 5.0], 5.0),
        ([float("inf"), float("inf"), 1.0], float("inf")),
        ([1.7e308, 1.7e308], 1.7e308),
        ([1.6e308, 1.7e308], 1.65e308),
        ([-1.7e308, 1.7e308], 0.0),
        ([0.0, -0.0, 3.0], 0.0),
        ([None, float("nan")], None),
        ([], None),
    ],
)
def test_medians_of_odd_values(spark, values, expected):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    found = exact_medians(df, ["x"]).first()["x"]
    assert found == (expected if expected is None else pytest.approx(expected, rel=1e-15))


def test_a_bracket_that_misses_the_rank_costs_another_pass(spark, monkeypatch):
    monkeypatch.setattr(selection, "ACCURACY", 1)
    monkeypatch.setattr(selection, "MARGIN", -0.3)
    test_grouped_medians(spark)
    test_overall_medians(spark)


def test_only_values_inside_the_bracket_move(spark):
    """Of 40,000 values one in a hundred or so is counted one by one."""
    rows = spark.range(40_000).selectExpr("cast(id as double) as value", "19000D as _lo", "19100D as _hi", "1 as k")
    found = selection.ranks_inside(rows, ["k"]).collect()
    assert len(found) == 101
    assert all(r["n_below"] == r["value"] and r["n"] == 1 for r in found)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.floats(allow_nan=False)), max_size=40))
def test_how_many_are_below(spark, rows):
    df = spark.createDataFrame(rows, "k string, value double")
    found = running_totals(counted_values(df, ["k"]), ["k"], "value", ["n"]).collect()
    assert sum(r["n"] for r in found) == len(rows)
    for r in found:
        same = [v for k, v in rows if k == r["k"]]
        assert r["n_below"] == sum(v < r["value"] for v in same)
        assert r["n"] == sum(v == r["value"] for v in same)


def test_a_single_group_is_shared_by_tasks(spark):
    counted = spark.range(4000).selectExpr("'one' as k", "cast(id as double) as value", "1L as n")
    placed = running_totals(counted, ["k"], "value", ["n"])
    assert placed.where("n_below <> value").count() == 0
    sizes = placed.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < 2000
