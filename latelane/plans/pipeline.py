"""The whole run: load, enrich, measure, train, check for drift, write."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from latelane.functions.columns import money_text, percent_text, plain_text
from latelane.ml.delay_model import MAX_DEPTH, TREES, TrainedModel, train
from latelane.operators import metrics
from latelane.plans.drift import sampled_drift_check
from latelane.plans.history import HISTORIES
from latelane.plans.marts import Marts
from latelane.plans.order_base import build_order_base
from latelane.sources.scratch import scratch_run, written
from latelane.sources.sinks import write_json_records, write_marts
from latelane.sources.tables import load_tables


def mart_tables(base: DataFrame) -> dict[str, DataFrame]:
    """Every table behind the dashboard, from one scan of the enriched order table."""
    return Marts.of(base).tables()


def _leader(ranking: DataFrame, key: str, value: str, prefix: str) -> DataFrame:
    """The first row of a ranking as one row of columns; nulls when it is empty."""
    first = metrics.top(ranking, 1)
    return first.agg(F.first(key).alias(prefix), F.first(value).alias(f"{prefix}_{value}"))


def report_headline(marts: Mapping[str, DataFrame]) -> DataFrame:
    """One row: the headline figures and the leader of each ranking."""
    parts = [
        _leader(marts["revenue_by_category"], "category_most_common", "revenue", "top_category"),
        _leader(marts["revenue_by_state"], "customer_state", "revenue", "top_state"),
        _leader(marts["delay_by_state"], "customer_state", "late_rate", "most_late_state"),
    ]
    report = marts["kpi_summary"]
    for part in parts:
        report = report.crossJoin(F.broadcast(part))  # one row each
    return report.withColumns(
        {
            "top_category_revenue_text": money_text("top_category_revenue"),
            "top_state_revenue_text": money_text("top_state_revenue"),
            "most_late_state_late_rate_text": percent_text("most_late_state_late_rate"),
        }
    )


def report_summary(
    marts: Mapping[str, DataFrame], trained: TrainedModel, drift: DataFrame
) -> DataFrame:
    """The headline row with the model's quality and the drift result added."""
    report = report_headline(marts)
    for part in (trained.auc(), drift):
        report = report.crossJoin(F.broadcast(part))  # one row each
    return report.withColumns(
        {
            "roc_auc_text": plain_text("roc_auc", 4),
            "expected_late_rate_text": percent_text("expected_late_rate"),
            "baseline_late_rate_text": percent_text("baseline_late_rate"),
        }
    )


def run_pipeline(
    spark: SparkSession,
    base_path: str,
    out: str,
    trees: int = TREES,
    max_depth: int = MAX_DEPTH,
    history: str = "all",
) -> dict[str, str]:
    """Runs everything on the tables in ``base_path``; returns the paths written.

    ``history`` says what the late histories among the features count: "all" rows, the row
    itself included, or "asof" or "train_only", which do not see its outcome.

    Each mart is written once, under ``out``; the rankings for the report are read back
    from there. The model is saved under ``out`` as well. Intermediate tables are deleted
    when the run ends.
    """
    with scratch_run(spark):
        return _run(spark, base_path, out, trees, max_depth, history)


def _run(
    spark: SparkSession, base_path: str, out: str, trees: int, max_depth: int, history: str
) -> dict[str, str]:
    base = written(build_order_base(load_tables(spark, base_path, convert=True)), "order_base")
    if history != "all":
        base = written(HISTORIES[history](base), "order_base_history")
    delivered = metrics.delivered_only(base)
    paths = write_marts(mart_tables(base), out)
    marts = {name: spark.read.parquet(path) for name, path in paths.items()}
    paths["dashboard_cube_json"] = write_json_records(
        marts["dashboard_cube"], f"{out.rstrip('/')}/dashboard_cube_json"
    )
    trained = train(delivered, trees, max_depth)
    paths["model"] = f"{out.rstrip('/')}/model"
    trained.model.write().overwrite().save(paths["model"])
    drift = sampled_drift_check(trained.model, delivered)
    ordered = {
        **marts,
        "revenue_by_category": marts["revenue_by_category"].orderBy(
            F.desc("revenue"), "category_most_common"
        ),
        "revenue_by_state": marts["revenue_by_state"].orderBy(
            F.desc("revenue"), "customer_state"
        ),
        "delay_by_state": marts["delay_by_state"].orderBy(
            F.desc("late_rate"), F.desc("median_delay"), "customer_state"
        ),
    }
    quality = {
        "model_report": trained.report(),
        "drift": drift,
        "report_summary": report_summary(ordered, trained, drift),
    }
    return {**paths, **write_marts(quality, out)}
