"""Business measures of the enriched order table: headline figures, rankings, profiles.

Rankings end with their group key as the last sort key, so ties have one order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from latelane.functions.columns import (
    amount_text,
    all_present,
    days_text,
    late_share,
    money_text,
    percent_text,
    plain_text,
    ratio,
    sum_or_zero,
)
from latelane.operators.selection import histogram_median

DELIVERED = "delivered"  # fixed value
TOP_CHART = 12  # fixed value
TOP_TABLE = 10  # fixed value
DELIVERY_BINS = 30  # fixed value


def delivered_only(base: DataFrame, status: str = "order_status") -> DataFrame:
    return base.where(F.col(status) == DELIVERED)


def kpi_summary(delivered: DataFrame) -> DataFrame:
    """One row of headline figures; each mean skips its own missing values."""
    return delivered.agg(
        sum_or_zero("revenue").alias("total_revenue"),
        F.avg("revenue").alias("avg_ticket"),
        F.avg("actual_delivery_days").alias("avg_delivery_days"),
        late_share().alias("late_rate"),
        F.avg("review_score").alias("avg_review_score"),
    )


def kpi_formatted(kpis: DataFrame) -> DataFrame:
    """The headline figures as display text, next to the numbers."""
    return kpis.select(
        "*",
        money_text("total_revenue").alias("total_revenue_text"),
        money_text("avg_ticket").alias("avg_ticket_text"),
        days_text("avg_delivery_days").alias("avg_delivery_days_text"),
        percent_text("late_rate").alias("late_rate_text"),
        plain_text("avg_review_score", 2).alias("avg_review_score_text"),
    )


def revenue_by(df: DataFrame, key: str) -> DataFrame:
    """Revenue per key, unsorted."""
    return all_present(df, [key]).groupBy(key).agg(sum_or_zero("revenue").alias("revenue"))


def revenue_ranking(df: DataFrame, key: str) -> DataFrame:
    return revenue_by(df, key).orderBy(F.desc("revenue"), key)


def revenue_by_date(df: DataFrame) -> DataFrame:
    return revenue_by(df, "order_purchase_date").orderBy("order_purchase_date")


def delay_by(df: DataFrame, key: str) -> DataFrame:
    """Late rate, median delay and revenue per key, unsorted.

    Rows are counted per (key, delay in days) first. That combines on the map side and
    bounds what the median of even a huge group has to hold by the distinct day counts.
    """
    per_day = (
        all_present(df, [key])
        .groupBy(key, "delivery_delay")
        .agg(
            F.count("*").alias("n"),
            F.count_if("is_late").alias("late"),
            F.sum("revenue").alias("revenue"),
        )
    )
    return per_day.groupBy(key).agg(
        ratio(F.sum("late"), F.sum("n")).alias("late_rate"),
        histogram_median("delivery_delay", "n").alias("median_delay"),
        sum_or_zero("revenue").alias("revenue"),
    )


def delay_ranking(df: DataFrame, key: str) -> DataFrame:
    return delay_by(df, key).orderBy(
        F.desc_nulls_last("late_rate"), F.desc_nulls_last("median_delay"), key
    )


def delay_formatted(ranking: DataFrame) -> DataFrame:
    """The delay ranking as display text, next to the numbers."""
    return ranking.select(
        "*",
        amount_text("revenue").alias("revenue_text"),
        percent_text("late_rate").alias("late_rate_text"),
        plain_text("median_delay", 1).alias("median_delay_text"),
    )


def top(ranking: DataFrame, rows: int) -> DataFrame:
    return ranking.limit(rows)


def month_profile(df: DataFrame) -> DataFrame:
    """Late rate and revenue per month of the year, years pooled."""
    return (
        all_present(df, ["purchase_month"])
        .groupBy("purchase_month")
        .agg(late_share().alias("late_rate"), sum_or_zero("revenue").alias("revenue"))
        .orderBy("purchase_month")
    )


def date_bounds(df: DataFrame) -> DataFrame:
    """First and last purchase date as ISO text."""
    return df.agg(
        F.min("order_purchase_date").cast("string").alias("min_date"),
        F.max("order_purchase_date").cast("string").alias("max_date"),
    )


def filter_domain(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct present values of a filter column."""
    return all_present(df, [column]).select(column).distinct().orderBy(column)


def delivery_days_histogram(df: DataFrame, bins: int = DELIVERY_BINS) -> DataFrame:
    """Rows per equal-width bin of delivery days between the smallest and largest.

    The last bin includes its upper edge. Empty bins are left out. The table is read
    once, into counts per distinct number of days.
    """
    counts = (
        all_present(df, ["actual_delivery_days"])
        .groupBy("actual_delivery_days")
        .agg(F.count("*").alias("n"))
    )
    return binned_days(counts, bins)


def binned_days(counts: DataFrame, bins: int = DELIVERY_BINS) -> DataFrame:
    """The histogram from (actual_delivery_days, n) counts."""
    edges = counts.agg(
        F.min("actual_delivery_days").cast("double").alias("lo"),
        F.max("actual_delivery_days").cast("double").alias("hi"),
    )
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.floor((F.col("actual_delivery_days") - F.col("lo")) / F.nullif(width, F.lit(0.0)))
    bin_number = F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).cast("int")
    return (
        counts.crossJoin(F.broadcast(edges))  # one row
        .groupBy(bin_number.alias("bin"), "lo", width.alias("width"))
        .agg(F.sum("n").alias("n"))
        .select(
            "bin",
            (F.col("lo") + F.col("bin") * F.col("width")).alias("bin_start"),
            (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("bin_end"),
            "n",
        )
        .orderBy("bin")
    )


def review_score_histogram(df: DataFrame) -> DataFrame:
    """Rows per whole review score; a half point counts to the score below."""
    return (
        all_present(df, ["review_score"])
        .groupBy(F.floor("review_score").cast("int").alias("score"))
        .agg(F.count("*").alias("n"))
        .orderBy("score")
    )
