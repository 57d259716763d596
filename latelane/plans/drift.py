"""Comparing the predicted late rate of a batch of orders with the historical one."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, functions as F

from latelane.functions.columns import late_share, ratio
from latelane.ml.delay_model import training_rows
from latelane.operators.split import SEED, fixed_sample

# How far above the baseline each tier starts, and the sample size.
RETRAIN_ABOVE = 1.1
WATCH_ABOVE = 1.05
SAMPLE_ROWS = 80



def tier(rate: Column, baseline: Column) -> Column:
    """retrain, watch or stable; both limits are exclusive. Null without a rate or baseline,
    so that an empty batch never passes as healthy."""
    known = rate.isNotNull() & baseline.isNotNull()
    return F.when(
        known,
        F.when(rate > baseline * RETRAIN_ABOVE, "retrain")
        .when(rate > baseline * WATCH_ABOVE, "watch")
        .otherwise("stable"),
    )


def with_tier(rates: DataFrame) -> DataFrame:
    """Adds the tier and the reason for it to (expected_late_rate, baseline_late_rate) rows."""
    expected, baseline = F.col("expected_late_rate"), F.col("baseline_late_rate")
    by = (ratio(expected, baseline) - 1) * 100
    change = F.when(by.isNotNull(), F.format_string("%+.1f%% against history", by))
    limits = F.lit(f"; watch over {WATCH_ABOVE:g}x, retrain over {RETRAIN_ABOVE:g}x")
    reason = F.coalesce(F.concat(change, limits), F.lit("nothing to compare"))
    return rates.withColumn("tier", tier(expected, baseline)).withColumn("recommendation", reason)


def historical_late_rate(delivered: DataFrame) -> DataFrame:
    return delivered.agg(late_share().alias("baseline_late_rate"))


def drift_check(model: PipelineModel, new_orders: DataFrame, delivered: DataFrame) -> DataFrame:
    """One row: mean predicted label of ``new_orders``, history, tier, recommendation."""
    predicted = model.transform(training_rows(new_orders)).agg(
        F.avg("prediction").alias("expected_late_rate"), F.count("*").alias("orders")
    )
    both = predicted.crossJoin(F.broadcast(historical_late_rate(delivered)))  # one row each
    return with_tier(both)


def sampled_drift_check(
    model: PipelineModel, delivered: DataFrame, rows: int = SAMPLE_ROWS, seed: int = SEED
) -> DataFrame:
    """The drift check on a seeded sample of delivered orders."""
    return drift_check(model, fixed_sample(delivered, rows, seed), delivered)
