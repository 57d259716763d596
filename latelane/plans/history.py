"""Late histories of sellers and customers that do not see the row's own outcome.

The plain history (``all``) counts every row of a key, the scored row included. ``asof`` counts
the rows with an earlier purchase, ``train_only`` the rows outside the test part, less the row
itself. Both keep the plain history's rules: all statuses count, a missing key has no history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from latelane.functions.columns import all_present, ratio
from latelane.operators.joins import lookup
from latelane.operators.metrics import DELIVERED
from latelane.operators.selection import running_totals
from latelane.operators.split import SEED, TEST_SHARE, stratified_split
from latelane.sources.scratch import written

MOMENT = "order_purchase_timestamp"
SIDES = ("seller", "customer")


def _names(side: str) -> tuple[str, str, str]:
    return f"{side}_id", f"{side}_orders", f"{side}_late_rate"


def _totals() -> dict[str, Column]:
    return {
        "_orders": F.count("order_id"),
        "_late": F.count_if("is_late"),
        "_n": F.count("*"),
    }


def history_asof(base: DataFrame, side: str, moment: str = MOMENT) -> DataFrame:
    """(key, moment, orders, late rate) of every key and purchase moment: what all strictly
    earlier purchases of the key add up to. No earlier one: 0 orders and no rate.

    Purchases are counted per key and moment, and running totals are made in ranges of them,
    so a key with a third of all orders is shared by many tasks.
    """
    key, orders, rate = _names(side)
    counted = all_present(base, [key, moment]).groupBy(key, moment)
    counted = counted.agg(*[total.alias(c) for c, total in _totals().items()])
    before = running_totals(counted, [key], moment, list(_totals()))
    return before.select(
        key,
        moment,
        F.col("_orders_below").alias(orders),
        ratio("_late_below", "_n_below").alias(rate),
    )


def with_history_asof(base: DataFrame, moment: str = MOMENT) -> DataFrame:
    """``base``, best a scan, with both histories as of each row's purchase. A row without
    the key or the moment has none."""
    columns = base.columns
    for side in SIDES:
        key, orders, rate = _names(side)
        history = written(history_asof(base, side, moment), f"{side}_asof")
        base = base.drop(orders, rate).join(history, [key, moment], "left")
    return base.select(columns)


def with_history_left_out(base: DataFrame, counted: str) -> DataFrame:
    """``base``, best a scan, with both histories over the rows where ``counted`` is true, each
    row itself left out."""
    columns = base.columns
    own = F.col(counted).cast("int")
    for side in SIDES:
        key, orders, rate = _names(side)
        totals = all_present(base.where(counted), [key]).groupBy(key)
        totals = written(totals.agg(*[total.alias(c) for c, total in _totals().items()]), f"{side}_totals")
        found = lookup(base.drop(orders, rate), totals, key)
        here = F.col(key).isNotNull()
        others = {
            "_orders": F.coalesce("_orders", F.lit(0)) - own * F.col("order_id").isNotNull().cast("int"),
            "_late": F.coalesce("_late", F.lit(0)) - own * F.col("is_late").cast("int"),
            "_n": F.coalesce("_n", F.lit(0)) - own,
        }
        found = found.withColumns(others)
        base = found.withColumn(orders, F.when(here, F.col("_orders"))).withColumn(
            rate, F.when(here, ratio("_late", "_n"))
        )
        base = base.drop(*others)
    return base.select(columns)


def with_history_train_only(base: DataFrame, share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """``base`` with both histories over what is not in the classifier's test part, each row
    itself left out. The split is the one that training makes: delivered rows, by lateness."""
    label = F.when(F.col("order_status") == DELIVERED, F.col("is_late").cast("double"))
    split = stratified_split(base.withColumn("_label", label), "_label", share, seed)
    rows = split.drop("_label").withColumn("_counted", ~F.col("is_test")).drop("is_test")
    return with_history_left_out(written(rows, "history_rows"), "_counted").drop("_counted")


HISTORIES = {
    "all": lambda base: base,
    "asof": with_history_asof,
    "train_only": with_history_train_only,
}
