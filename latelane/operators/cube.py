"""The dashboard cube: additive measures per date, state, category and month."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from latelane.functions.columns import all_present, ratio, sum_or_zero
from latelane.operators.metrics import TOP_CHART

KEYS = ["order_purchase_date", "customer_state", "category_most_common", "purchase_month"]
MEASURES = ["sum_revenue", "sum_late", "sum_delivery_days", "sum_review_score", "order_count"]


def dashboard_cube(delivered: DataFrame) -> DataFrame:
    """One row per present combination of the keys; the date becomes ISO text."""
    return (
        all_present(delivered, KEYS)
        .groupBy(*KEYS)
        .agg(
            sum_or_zero("revenue").alias("sum_revenue"),
            F.count_if("is_late").alias("sum_late"),
            sum_or_zero("actual_delivery_days").alias("sum_delivery_days"),
            sum_or_zero("review_score").alias("sum_review_score"),
            F.count("order_id").alias("order_count"),
        )
        .withColumn("order_purchase_date", F.col("order_purchase_date").cast("string"))
    )


def filtered(
    cube: DataFrame,
    state: str | None = None,
    category: str | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
) -> DataFrame:
    """Rows matching every given filter; ``None``, '' and 'all' leave one open."""

    def wanted(value: str | None) -> bool:
        return value not in (None, "", "all")

    if wanted(state):
        cube = cube.where(F.col("customer_state") == state)
    if wanted(category):
        cube = cube.where(F.col("category_most_common") == category)
    if wanted(date_from):
        cube = cube.where(F.col("order_purchase_date") >= date_from)
    if wanted(date_to):
        cube = cube.where(F.col("order_purchase_date") <= date_to)
    return cube


def rolled_up(cube: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Additive measures summed per ``keys``; a missing measure counts 0."""
    return cube.groupBy(*keys).agg(*[sum_or_zero(s).alias(s) for s in sums])


def cube_kpis(cube: DataFrame) -> DataFrame:
    """Headline figures from the cube: every mean divides by the order count.

    These differ from ``kpi_summary``, whose means skip rows missing the value.
    """
    orders = F.col("order_count")
    return rolled_up(cube, [], MEASURES).select(
        F.col("sum_revenue").alias("total_revenue"),
        ratio("sum_revenue", orders).alias("avg_ticket"),
        ratio("sum_delivery_days", orders).alias("avg_delivery_days"),
        ratio("sum_late", orders).alias("late_rate"),
        ratio("sum_review_score", orders).alias("avg_review_score"),
    )


def cube_revenue_by_date(cube: DataFrame) -> DataFrame:
    return rolled_up(cube, ["order_purchase_date"], ["sum_revenue"]).orderBy("order_purchase_date")


def cube_top_revenue(cube: DataFrame, key: str, rows: int = TOP_CHART) -> DataFrame:
    return rolled_up(cube, [key], ["sum_revenue"]).orderBy(F.desc("sum_revenue"), key).limit(rows)


def cube_late_rate(cube: DataFrame, key: str) -> DataFrame:
    rate = F.coalesce(ratio("sum_late", "order_count"), F.lit(0.0))
    return rolled_up(cube, [key], ["sum_late", "order_count"]).withColumn("late_rate", rate)


def cube_top_late(cube: DataFrame, key: str, rows: int = TOP_CHART) -> DataFrame:
    return cube_late_rate(cube, key).orderBy(F.desc("late_rate"), key).limit(rows)


def chart_tables(cube: DataFrame) -> Mapping[str, DataFrame]:
    """The five charts that follow the filters."""
    return {
        "revenue_by_date": cube_revenue_by_date(cube),
        "top_states": cube_top_revenue(cube, "customer_state"),
        "top_categories": cube_top_revenue(cube, "category_most_common"),
        "late_states": cube_top_late(cube, "customer_state"),
        "late_months": cube_late_rate(cube, "purchase_month").orderBy("purchase_month"),
    }
