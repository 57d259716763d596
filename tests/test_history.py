"""Histories that leave the row's own outcome out, against plain loops."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from latelane.operators.split import stratified_split
from latelane.plans import history
from latelane.plans.order_base import build_order_base
from latelane.sources.scratch import written
from latelane.sources.star import marketplace_tables

from .conftest import SMALL

SCHEMA = (
    "order_id string, review_score double, order_status string, order_purchase_timestamp timestamp_ntz, "
    "is_late boolean, seller_id string, customer_id string, seller_orders bigint, seller_late_rate double, "
    "customer_orders bigint, customer_late_rate double"
)


def day(n):
    return None if n is None else datetime(2020, 1, 1 + n)


ROWS = [
    # order, score, status, day, late, seller, customer
    ("o1", 5.0, "delivered", 1, True, "s", "c1"),
    ("o1", 5.0, "delivered", 1, True, "s", "c1"),
    ("o1", 1.0, "delivered", 1, True, "s", "c1"),
    ("o2", 5.0, "delivered", 1, False, "s", "c2"),
    ("o3", 4.0, "shipped", 2, False, "s", "c1"),
    ("o4", 4.0, "delivered", 3, False, "s", "c1"),
    ("o5", 3.0, "delivered", 3, True, None, "c2"),
    ("o6", 3.0, "delivered", None, True, "s", None),
    (None, 2.0, "delivered", 4, True, "s", "c1"),
    ("o7", 2.0, "delivered", 5, False, "t", "c3"),
]


@pytest.fixture(scope="module")
def base(spark):
    rows = [(o, score, status, day(d), late, s, c, 99, 0.99, 99, 0.99) for o, score, status, d, late, s, c in ROWS]
    return written(spark.createDataFrame(rows, SCHEMA).repartition(3), "history_base")


def outcome(rows):
    """(orders, late rate) of rows of ROWS."""
    return sum(r[0] is not None for r in rows), sum(r[4] for r in rows) / len(rows) if rows else None


def found(df):
    columns = ["order_id", "review_score", "seller_orders", "seller_late_rate", "customer_orders", "customer_late_rate"]
    return sorted((tuple(r) for r in df.select(columns).collect()), key=repr)


def test_asof_counts_strictly_earlier_purchases(base):
    def past(row, key):
        if row[key] is None or row[3] is None:
            return None, None
        return outcome([r for r in ROWS if r[key] == row[key] and r[3] is not None and r[3] < row[3]])

    expected = [(r[0], r[1], *past(r, 5), *past(r, 6)) for r in ROWS]
    result = history.with_history_asof(base)
    assert result.columns == base.columns
    assert found(result) == sorted(expected, key=repr)


def test_left_out_counts_the_other_rows(base):
    counted = lambda r: r[1] != 4.0

    def others(row, key):
        if row[key] is None:
            return None, None
        rows = [r for i, r in enumerate(ROWS) if i != ROWS.index(row) and r[key] == row[key] and counted(r)]
        # Equal rows stand for each other: one of them is left out.
        return outcome(rows)

    expected = [(r[0], r[1], *others(r, 5), *others(r, 6)) for r in ROWS]
    flagged = written(base.withColumn("_counted", F.col("review_score") != 4.0), "flagged")
    assert found(history.with_history_left_out(flagged, "_counted")) == sorted(expected, key=repr)


def test_empty_table(base):
    for kind in ("asof", "train_only"):
        empty = history.HISTORIES[kind](written(base.where("false"), "empty_base"))
        assert empty.columns == base.columns and empty.isEmpty()


def test_a_test_rows_outcome_changes_no_history(spark):
    """Turning the outcome of all test rows leaves every training row's history as it is."""
    base = written(build_order_base(marketplace_tables(spark, SMALL)), "small_base")
    label = F.when(F.col("order_status") == "delivered", F.col("is_late").cast("double"))
    split = written(stratified_split(base.withColumn("_label", label), "_label"), "small_split")
    flagged = split.drop("_label").withColumn("_counted", ~F.col("is_test"))
    turned = flagged.withColumn("is_late", F.when(F.col("is_test"), ~F.col("is_late")).otherwise(F.col("is_late")))
    plain = history.with_history_left_out(written(flagged, "plain"), "_counted")
    other = history.with_history_left_out(written(turned, "turned"), "_counted")
    assert found(plain) == found(other)
    assert found(plain) == found(history.with_history_train_only(base))
    assert flagged.where("is_test").count() > 0


def test_a_hot_key_is_shared_by_tasks(spark):
    rows = spark.range(5000).selectExpr(
        "cast(id as string) as order_id", "timestamp_ntz'2020-01-01' + make_dt_interval(0, 0, cast(id as int)) as order_purchase_timestamp",
        "id % 2 = 0 as is_late", "'hot' as seller_id",
    )
    asof = history.history_asof(rows, "seller")
    assert asof.agg(F.max("seller_orders"), F.count("*")).first() == (4999, 5000)
    sizes = asof.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 2500
