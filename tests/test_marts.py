"""Marts rolled up from one scan against each measure made by itself."""

import pytest
from pyspark.sql import functions as F

from latelane.operators import cube as cubes, metrics
from latelane.plans.marts import Marts, mart_cells
from latelane.plans.order_base import build_order_base
from latelane.sources.scratch import written
from latelane.sources.star import marketplace_tables

from .conftest import SMALL


@pytest.fixture(scope="module")
def base(spark):
    """Enriched orders with missing keys and measures of every kind."""
    rows = build_order_base(marketplace_tables(spark, SMALL))
    holes = {
        c: F.when(F.crc32(F.concat(F.lit(c), F.col("order_id").cast("string"))) % 11 > 0, F.col(c))
        for c in ["order_purchase_date", "customer_state", "category_most_common", "purchase_month", "revenue",
                  "delivery_delay", "actual_delivery_days", "review_score"]
    }
    return written(rows.withColumns(holes), "holed_base")


@pytest.fixture(scope="module")
def marts(base):
    return Marts.of(base).tables()


def alone(base):
    delivered = metrics.delivered_only(base)
    delays = metrics.delay_ranking(delivered, "customer_state")
    return {
        "kpi_summary": metrics.kpi_formatted(metrics.kpi_summary(delivered)),
        "revenue_by_category": metrics.revenue_ranking(delivered, "category_most_common"),
        "revenue_by_state": metrics.revenue_ranking(delivered, "customer_state"),
        "delay_by_state": delays,
        "delay_table": metrics.delay_formatted(metrics.top(delays, metrics.TOP_TABLE)),
        "revenue_by_date": metrics.revenue_by_date(delivered),
        "month_profile": metrics.month_profile(delivered),
        "delivery_days_histogram": metrics.delivery_days_histogram(delivered),
        "review_score_histogram": metrics.review_score_histogram(delivered),
        "states": metrics.filter_domain(delivered, "customer_state"),
        "categories": metrics.filter_domain(delivered, "category_most_common"),
        "date_bounds": metrics.date_bounds(delivered),
        "dashboard_cube": cubes.dashboard_cube(delivered),
    }


def rows_of(df, ordered):
    columns = sorted(df.columns)
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    return columns, rows if ordered else sorted(rows, key=lambda r: repr([v for v in r if not isinstance(v, float)]))


@pytest.mark.parametrize("name", [
    "kpi_summary", "revenue_by_category", "revenue_by_state", "delay_by_state", "delay_table", "revenue_by_date",
    "month_profile", "delivery_days_histogram", "review_score_histogram", "states", "categories", "date_bounds",
    "dashboard_cube",
])
def test_mart_equals_its_measure(base, marts, name):
    ordered = name != "dashboard_cube"
    columns, found = rows_of(marts[name], ordered)
    same_columns, expected = rows_of(alone(base)[name], ordered)
    assert columns == same_columns and len(found) == len(expected) > 0
    for row, other in zip(found, expected):
        assert all(v == (pytest.approx(o, rel=1e-12) if isinstance(o, float) else o) for v, o in zip(row, other))


def test_one_scan_of_the_order_table(base, marts):
    scans = mart_cells(metrics.delivered_only(base))._jdf.queryExecution().executedPlan().toString().count("FileScan")
    assert scans == 1
    for df in marts.values():
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "FileScan" in plan and "holed_base" not in plan


def test_no_delivered_orders(base):
    empty = Marts.of(base.where("false")).tables()
    first = empty["kpi_summary"].first()
    assert first["total_revenue"] == 0 and first["avg_ticket"] is None and first["late_rate"] is None
    assert empty["date_bounds"].first()["min_date"] is None
    for name in ("revenue_by_state", "delay_by_state", "dashboard_cube", "delivery_days_histogram", "states"):
        assert empty[name].isEmpty()
