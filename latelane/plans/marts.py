"""Every mart from one scan of the enriched order table.

One aggregate with grouping sets makes all cells: the cube's keys, with missing keys kept as
groups of their own, a histogram of delays per state, one of delivery days and one of review
scores. Their measures are sums and counts, so each mart is a roll-up of the written cells, which
are as many as there are distinct keys, whatever the number of orders.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from latelane.functions.columns import all_present, ratio, sum_or_zero
from latelane.operators import cube as cubes, metrics
from latelane.operators.selection import histogram_median
from latelane.sources.scratch import written

KEYS = [*cubes.KEYS, "delivery_delay", "actual_delivery_days", "score"]
SETS = {
    "cube": cubes.KEYS,
    "delays": ["customer_state", "delivery_delay"],
    "days": ["actual_delivery_days"],
    "scores": ["score"],
}
MEASURES = [
    "revenue", "n_revenue", "late", "n", "delivery_days", "n_delivery_days", "review_scores",
    "n_review_scores", "order_count",
]


def _set_number(keys: list[str]) -> int:
    """The grouping id of a set: a bit per key that is not in it, the first key's the highest."""
    return sum((k not in keys) << i for i, k in enumerate(reversed(KEYS)))


def mart_cells(delivered: DataFrame) -> DataFrame:
    """``set``, the keys (null where not in the set, or missing) and the measures."""
    # Delivery days and scores are keys of some sets and measures of others.
    days, score = F.col("_days"), F.col("_score")
    rows = delivered.select(
        *cubes.KEYS, "delivery_delay", "actual_delivery_days",
        F.floor("review_score").cast("int").alias("score"),
        "revenue", "is_late", "order_id",
        F.col("actual_delivery_days").alias("_days"), F.col("review_score").alias("_score"),
    )
    columns = {k: F.col(k) for k in KEYS}
    sets = [[columns[k] for k in keys] for keys in SETS.values()]
    cells = rows.groupingSets(sets, *columns.values()).agg(
        F.grouping_id(*columns.values()).alias("set"),
        F.sum("revenue").alias("revenue"),
        F.count("revenue").alias("n_revenue"),
        F.count_if("is_late").alias("late"),
        F.count("*").alias("n"),
        F.sum(days).alias("delivery_days"),
        F.count(days).alias("n_delivery_days"),
        F.sum(score).alias("review_scores"),
        F.count(score).alias("n_review_scores"),
        F.count("order_id").alias("order_count"),
    )
    return cells.select("set", *KEYS, *MEASURES)


@dataclass
class Marts:
    """The marts as roll-ups of ``cells``."""

    cells: DataFrame

    @classmethod
    def of(cls, base: DataFrame) -> Marts:
        return cls(written(mart_cells(metrics.delivered_only(base)), "mart_cells"))

    def _cells(self, name: str) -> DataFrame:
        return self.cells.where(F.col("set") == _set_number(SETS[name]))

    def _revenue_by(self, key: str) -> DataFrame:
        return all_present(self._cells("cube"), [key]).groupBy(key).agg(sum_or_zero("revenue").alias("revenue"))

    def kpi_summary(self) -> DataFrame:
        def mean(total: str, count: str) -> Column:
            return ratio(F.sum(total), F.sum(count))

        return self._cells("cube").agg(
            sum_or_zero("revenue").alias("total_revenue"),
            mean("revenue", "n_revenue").alias("avg_ticket"),
            mean("delivery_days", "n_delivery_days").alias("avg_delivery_days"),
            mean("late", "n").alias("late_rate"),
            mean("review_scores", "n_review_scores").alias("avg_review_score"),
        )

    def revenue_ranking(self, key: str) -> DataFrame:
        return self._revenue_by(key).orderBy(F.desc("revenue"), key)

    def revenue_by_date(self) -> DataFrame:
        return self._revenue_by("order_purchase_date").orderBy("order_purchase_date")

    def delay_ranking(self) -> DataFrame:
        delays = all_present(self._cells("delays"), ["customer_state"]).groupBy("customer_state").agg(
            ratio(F.sum("late"), F.sum("n")).alias("late_rate"),
            histogram_median("delivery_delay", "n").alias("median_delay"),
            sum_or_zero("revenue").alias("revenue"),
        )
        order = [F.desc_nulls_last("late_rate"), F.desc_nulls_last("median_delay"), "customer_state"]
        return delays.orderBy(*order)

    def month_profile(self) -> DataFrame:
        months = all_present(self._cells("cube"), ["purchase_month"]).groupBy("purchase_month")
        late = ratio(F.sum("late"), F.sum("n")).alias("late_rate")
        return months.agg(late, sum_or_zero("revenue").alias("revenue")).orderBy("purchase_month")

    def delivery_days_histogram(self) -> DataFrame:
        counts = all_present(self._cells("days"), ["actual_delivery_days"])
        return metrics.binned_days(counts.select("actual_delivery_days", "n"))

    def review_score_histogram(self) -> DataFrame:
        return all_present(self._cells("scores"), ["score"]).select("score", "n").orderBy("score")

    def dashboard_cube(self) -> DataFrame:
        return all_present(self._cells("cube"), cubes.KEYS).select(
            F.col("order_purchase_date").cast("string").alias("order_purchase_date"),
            *cubes.KEYS[1:],
            F.coalesce("revenue", F.lit(0.0)).alias("sum_revenue"),
            F.col("late").alias("sum_late"),
            F.coalesce("delivery_days", F.lit(0)).alias("sum_delivery_days"),
            F.coalesce("review_scores", F.lit(0.0)).alias("sum_review_score"),
            "order_count",
        )

    def tables(self) -> dict[str, DataFrame]:
        """Every table behind the dashboard."""
        delays, states = self.delay_ranking(), self.revenue_ranking("customer_state")
        categories = self.revenue_ranking("category_most_common")
        cube = self._cells("cube")
        return {
            "kpi_summary": metrics.kpi_formatted(self.kpi_summary()),
            "revenue_by_category": categories,
            "revenue_by_state": states,
            "delay_by_state": delays,
            "top_states": metrics.top(states, metrics.TOP_CHART),
            "top_categories": metrics.top(categories, metrics.TOP_CHART),
            "late_states": metrics.top(delays, metrics.TOP_CHART),
            "delay_table": metrics.delay_formatted(metrics.top(delays, metrics.TOP_TABLE)),
            "revenue_by_date": self.revenue_by_date(),
            "month_profile": self.month_profile(),
            "delivery_days_histogram": self.delivery_days_histogram(),
            "review_score_histogram": self.review_score_histogram(),
            "states": metrics.filter_domain(cube, "customer_state"),
            "categories": metrics.filter_domain(cube, "category_most_common"),
            "date_bounds": metrics.date_bounds(cube),
            "dashboard_cube": self.dashboard_cube(),
        }
