
from __future__ import annotations

import sys
from collections.abc import Callable, Mapping
from functools import cached_property
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.ml import Pipeline
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from entry_sql import oracle_queries
from latelane.functions.columns import first_token, freight_ratio
from latelane.ml import delay_model
from latelane.ml.scaling import MedianScaler
from latelane.operators import cube as cubes, enrich, evaluation, metrics, split
from latelane.plans import drift, history, order_base, pipeline
from latelane.sources import sinks
from latelane.sources.scratch import scratch_path, written
from latelane.sources.star import marketplace_tables
from latelane.sources.tables import load_tables, missing_inputs

FILTERS = {
    "state": "NATION_3",
    "category": "medium_en",
    "date_from": "1996-03-01",
    "date_to": "2000-06-30",
}
DATES = {k: v for k, v in FILTERS.items() if k.startswith("date")}

DIGITS = {
    "geolocation_lat": 6, "geolocation_lng": 6, "customer_lat": 6, "customer_lng": 6,
    "seller_lat": 6, "seller_lng": 6, "payment_value": 6, "freight_value": 6,
    "avg_item_price": 6, "avg_product_weight": 6, "avg_length_cm": 6, "avg_height_cm": 6,
    "avg_width_cm": 6, "freight_ratio": 6, "distance_km": 6, "seller_late_rate": 6,
    "customer_late_rate": 6, "late_rate": 6, "expected_late_rate": 6, "baseline_late_rate": 6,
    "total_revenue": 2, "sum_revenue": 2, "avg_ticket": 4, "avg_delivery_days": 6,
    "avg_review_score": 6, "bin_start": 6, "bin_end": 6, "median": 6, "mean": 6, "scale": 6,
    "roc_auc": 6, "precision": 4, "recall": 4, "f1_score": 4,
}


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Float columns rounded for comparison; the digits can be overridden."""
    wanted = {**DIGITS, **digits}
    return df.withColumns({c: F.round(c, wanted[c]) for c in df.columns if c in wanted})


class Workspace:
    """The tables of one data folder and what the queries share of them.

    As in a full run, the enriched order table is built and written once and the
    measures scan it; so are the cube, the split and the trained model.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.tables = marketplace_tables(spark, sf_dir)

    @cached_property
    def base(self) -> DataFrame:
        return written(order_base.build_order_base(self.tables), "order_base")

    @cached_property
    def delivered(self) -> DataFrame:
        return metrics.delivered_only(self.base)

    @cached_property
    def marts(self) -> dict[str, DataFrame]:
        return pipeline.mart_tables(self.base)

    @cached_property
    def cube(self) -> DataFrame:
        return written(cubes.dashboard_cube(self.delivered), "dashboard_cube")

    @cached_property
    def split(self) -> DataFrame:
        rows = split.with_hashes(delay_model.training_rows(self.delivered))
        rows = written(rows, "training_rows")
        return written(split.stratified_split(rows, "label"), "split")

    @cached_property
    def trained(self) -> delay_model.TrainedModel:
        return delay_model.train(self.delivered)

    @cached_property
    def drift(self) -> DataFrame:
        return written(drift.sampled_drift_check(self.trained.model, self.delivered), "drift")

    @property
    def train_rows(self) -> DataFrame:
        return self.split.where("not is_test")


_workspaces: dict[tuple[str, str], Workspace] = {}


def _workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _workspaces:
        _workspaces[key] = Workspace(spark, sf_dir)
    return _workspaces[key]


def _items(w: Workspace) -> DataFrame:
    return enrich.items_per_order(enrich.items_with_products(w.tables), w.tables["items"])


def _geo(w: Workspace) -> DataFrame:
    return enrich.geo_centroids(w.tables["geolocation"])


def _texts(df: DataFrame) -> DataFrame:
    """Dates and timestamps as text, which reads the same in every engine."""
    moments = [f.name for f in df.schema.fields if f.dataType.typeName() in ("date", "timestamp_ntz")]
    return df.withColumns({c: F.col(c).cast("string") for c in moments})


def _history(w: Workspace, side: str) -> DataFrame:
    orders = w.base.withColumn("copies", F.lit(1))
    return order_base.late_history(orders, f"{side}_id", f"{side}_orders", f"{side}_late_rate")


def _with_history(w: Workspace, kind: str) -> DataFrame:
    rows = history.HISTORIES[kind](w.base).select(
        "order_id", "review_score", "seller_orders", "seller_late_rate", "customer_orders",
        "customer_late_rate",
    )
    return _rounded(rows)


def _review_fill(w: Workspace) -> DataFrame:
    orders = w.tables["orders"].select("order_id")
    counted = order_base.counted_reviews(w.tables["reviews"])
    return order_base.review_fill(order_base.with_reviews(orders, counted))


def _filter_domains(w: Workspace) -> DataFrame:
    return metrics.filter_domain(w.delivered, "customer_state").select(
        F.lit("state").alias("domain"), F.col("customer_state").alias("value")
    ).unionByName(
        metrics.filter_domain(w.delivered, "category_most_common").select(
            F.lit("category").alias("domain"), F.col("category_most_common").alias("value")
        )
    )


def _cube_json(w: Workspace) -> DataFrame:
    path = sinks.write_json_records(w.cube, scratch_path(w.spark, "cube_json"))
    return w.spark.read.schema(w.cube.schema).json(path)


def _split_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.col("label").cast("int").alias("label"), "is_test").agg(
        F.count("*").alias("n"), F.sum("order_id").alias("id_total")
    )


def _approximate_split(w: Workspace) -> DataFrame:
    return split.approximate_split(delay_model.training_rows(w.delivered))


def _holdout_sample(w: Workspace) -> DataFrame:
    keys = w.delivered.select("order_id", "review_score", "is_late")
    return split.fixed_sample(keys, drift.SAMPLE_ROWS)


def _scaling(w: Workspace) -> DataFrame:
    scaler = MedianScaler(inputCols=delay_model.NUMERIC).fit(w.train_rows)
    return scaler.statistics(w.train_rows)


def _slots(w: Workspace) -> DataFrame:
    """Feature, category and slot number, read off the fitted indexer."""
    fitted = Pipeline(stages=delay_model.encoder_stages()[:2]).fit(w.train_rows)
    labels = fitted.stages[1].labelsArray
    rows = [
        (feature, category.removeprefix(f"{feature}="), slot)
        for feature, categories in zip(delay_model.CATEGORICAL, labels)
        for slot, category in enumerate(categories)
    ]
    return w.spark.createDataFrame(rows, "feature string, category string, slot int")


def _rule_scores(w: Workspace) -> DataFrame:
    return w.delivered.select(
        F.col("is_late").cast("int").alias("label"),
        F.col("seller_late_rate").alias("score"),
        (F.col("seller_late_rate") > 0.4).cast("int").alias("prediction"),
    )


def _drift_by_state(w: Workspace) -> DataFrame:
    states = metrics.delay_by(w.delivered, "customer_state").select(
        "customer_state", F.col("late_rate").alias("expected_late_rate")
    )
    history = F.broadcast(drift.historical_late_rate(w.delivered))  # one row
    return drift.with_tier(states.crossJoin(history)).drop("recommendation")


def _csv_roundtrip(w: Workspace) -> DataFrame:
    folder = scratch_path(w.spark, "csv")
    for name, df in w.tables.items():
        sinks.write_csv(df, f"{folder}/{name}.csv")
    loaded = load_tables(w.spark, folder)
    none = F.lit(None)
    summed = {
        "customers": ("customer_state", "customer_zip_code_prefix", none),
        "geolocation": ("geolocation_zip_code_prefix", "geolocation_lat", none),
        "items": ("product_id", "price", F.max("shipping_limit_date")),
        "payments": ("payment_type", "payment_value", none),
        "reviews": ("review_score", "review_score", none),
        "orders": ("order_status", None, F.max("order_delivered_customer_date")),
        "products": ("product_category_name", "product_weight_g", none),
        "sellers": ("seller_state", "seller_zip_code_prefix", none),
        "categories": ("product_category_name_english", None, none),
    }
    result = None
    for name, (text, number, moment) in summed.items():
        total = F.sum(F.col(number).cast("double")) if number else none.cast("double")
        part = loaded[name].agg(
            F.count("*").alias("n_rows"),
            F.count(text).alias("n_texts"),
            F.round(F.coalesce(total, F.lit(0.0)), 2).alias("total"),
            moment.cast("string").alias("last_moment"),
        )
        part = part.select(F.lit(name).alias("table_name"), "*")
        result = part if result is None else result.unionByName(part)
    return result


def _placed(ranking: DataFrame) -> DataFrame:
    """A sorted ranking with the place each row came out at (groups are few)."""
    order = Window.orderBy(F.monotonically_increasing_id())
    return ranking.withColumn("place", F.row_number().over(order).cast("bigint"))


def _quoted_lines(w: Workspace) -> DataFrame:
    """Products whose category holds quotes and line breaks, written as CSV and loaded."""
    folder = scratch_path(w.spark, "quoted_csv")
    text = F.concat(F.col("product_category_name"), F.lit('\n"q", '), F.col("product_id"))
    for name, df in w.tables.items():
        if name == "products":
            df = df.withColumn("product_category_name", text)
        sinks.write_csv(df, f"{folder}/{name}.csv")
    loaded = load_tables(w.spark, folder)["products"]
    return loaded.select(
        F.col("product_id").cast("bigint").alias("product_id"), "product_category_name",
        "product_weight_g", "product_width_cm",
    )


def _model_rows(w: Workspace) -> DataFrame:
    """What SQL can check of the scored test rows."""
    return w.trained.test_scores.select(
        "order_id",
        "review_score",
        F.col("label").cast("int").alias("label"),
        F.col("score").between(0, 1).alias("score_in_range"),
        (F.col("prediction") == (F.col("score") > 0.5).cast("double")).alias("prediction_follows"),
    )


def _model_quality(w: Workspace) -> DataFrame:
    """Support per class, and whether quality is in range and above chance."""
    auc = F.broadcast(w.trained.auc())  # one row
    in_range = F.col("precision").between(0, 1) & F.col("recall").between(0, 1)
    return w.trained.report().crossJoin(auc).select(
        "class", "support", in_range.alias("in_range"), (F.col("roc_auc") > 0.6).alias("useful")
    )


def _drift_rule(w: Workspace) -> DataFrame:
    """The drift check with its tier made again from the two rates."""
    by = F.col("expected_late_rate") / F.col("baseline_late_rate")
    again = F.when(by > 1.1, "retrain").when(by > 1.05, "watch").otherwise("stable")
    return w.drift.select(
        "orders",
        F.round("baseline_late_rate", 6).alias("baseline_late_rate"),
        F.col("expected_late_rate").between(0, 1).alias("rate_in_range"),
        (F.col("tier") == again).alias("tier_follows"),
    )


def _report_headline_texts(w: Workspace) -> DataFrame:
    return _report(w).select(
        "total_revenue_text", "avg_ticket_text", "top_category", "top_state", "most_late_state"
    )


def _mart(w: Workspace, name: str) -> DataFrame:
    return w.marts[name]


def _marts_roundtrip(w: Workspace) -> DataFrame:
    """Every mart written to a folder and read back: its rows and the sum of one number."""
    numbers = {
        "kpi_summary": "total_revenue", "revenue_by_category": "revenue", "revenue_by_state": "revenue",
        "delay_by_state": "median_delay", "top_states": "revenue", "top_categories": "revenue",
        "late_states": "late_rate", "delay_table": "late_rate", "revenue_by_date": "revenue",
        "month_profile": "late_rate", "delivery_days_histogram": "n", "review_score_histogram": "n",
        "states": None, "categories": None, "date_bounds": None, "dashboard_cube": "order_count",
    }
    paths = sinks.write_marts(w.marts, scratch_path(w.spark, "marts"))
    result = None
    for name, path in paths.items():
        total = F.sum(F.col(numbers[name]).cast("double")) if numbers[name] else F.lit(0.0)
        part = w.spark.read.parquet(path).agg(F.count("*").alias("n_rows"), F.round(total, 2).alias("total"))
        part = part.select(F.lit(name).alias("mart"), "n_rows", "total")
        result = part if result is None else result.unionByName(part)
    return result


def _missing_inputs(w: Workspace) -> DataFrame:
    """What a folder lacks that holds all tables but one, and two of them without a column."""
    folder = scratch_path(w.spark, "incomplete")
    for name, df in w.tables.items():
        if name != "sellers":
            lost = {"orders": "order_status", "items": "price"}.get(name)
            (df.drop(lost) if lost else df).write.parquet(f"{folder}/{name}.parquet")
    return missing_inputs(w.spark, folder)


def _drift_boundaries(w: Workspace) -> DataFrame:
    """The tier of each state's late rate against itself times factors around the limits."""
    rates = metrics.delay_by(w.delivered, "customer_state").select(
        "customer_state", F.col("late_rate").alias("baseline_late_rate")
    )
    factors = F.explode(F.array(*[F.lit(f) for f in (0.9, 1.0, 1.04, 1.05, 1.06, 1.09, 1.1, 1.11)]))
    moved = rates.withColumn("factor", factors).withColumn(
        "expected_late_rate", F.col("baseline_late_rate") * F.col("factor")
    )
    return drift.with_tier(moved).select("customer_state", "factor", "tier")


def _filtered(w: Workspace, **filters: str) -> DataFrame:
    return cubes.filtered(w.cube, **filters)


def _chart(w: Workspace, name: str, **filters: str) -> DataFrame:
    return cubes.chart_tables(_filtered(w, **filters))[name]


def _model_metrics(w: Workspace) -> DataFrame:
    auc = F.broadcast(w.trained.auc())  # one row
    return w.trained.report().crossJoin(auc)


def _report(w: Workspace) -> DataFrame:
    return pipeline.report_summary(w.marts, w.trained, w.drift)


def _queries() -> Mapping[str, Callable[[Workspace], DataFrame]]:
    return {
        "geo_centroid": lambda w: _rounded(_geo(w)),
        "payments_per_order": lambda w: _rounded(enrich.payments_per_order(w.tables["payments"])),
        "items_per_order": lambda w: _rounded(
            _items(w).drop("seller_id", "seller_count"), revenue=6
        ),
        "order_primary_seller": lambda w: _items(w).select("order_id", "seller_id", "seller_count"),
        "customer_geo": lambda w: _rounded(
            enrich.located_customers(w.tables["customers"], _geo(w))
        ),
        "seller_geo_dedup": lambda w: _rounded(
            enrich.located_sellers(w.tables["sellers"], _geo(w))
        ),
        "order_delivery_features": lambda w: order_base.delivery_columns(w.tables["orders"]).select(
            "order_id", "estimated_delivery_days", "actual_delivery_days", "delivery_delay",
            "is_late",
        ),
        "order_calendar": lambda w: _texts(
            order_base.delivery_columns(w.tables["orders"]).select(
                "order_id", "order_purchase_date", "purchase_weekday", "purchase_month"
            )
        ),
        "order_distance": lambda w: _rounded(
            w.base.select("order_id", "seller_id", "distance_km")
        ),
        "order_freight_ratio": lambda w: _rounded(
            _items(w).select(
                "order_id", freight_ratio("freight_value", "revenue").alias("freight_ratio")
            )
        ),
        "order_payment_primary": lambda w: enrich.payments_per_order(w.tables["payments"]).select(
            "order_id", first_token("payment_types").alias("payment_type_primary")
        ),
        "seller_history": lambda w: _rounded(_history(w, "seller")),
        "customer_history": lambda w: _rounded(_history(w, "customer")),
        "seller_history_asof": lambda w: _rounded(_texts(history.history_asof(w.base, "seller"))),
        "order_base_asof": lambda w: _with_history(w, "asof"),
        "order_base_train_only": lambda w: _with_history(w, "train_only"),
        "review_fill": _review_fill,
        "order_base": lambda w: _rounded(_texts(w.base), revenue=6),
        "kpi_summary": lambda w: _rounded(metrics.kpi_summary(w.delivered)),
        "kpi_formatted": lambda w: metrics.kpi_formatted(metrics.kpi_summary(w.delivered)).select(
            "total_revenue_text", "avg_ticket_text", "avg_delivery_days_text", "late_rate_text",
            "avg_review_score_text",
        ),
        "revenue_by_category": lambda w: _rounded(
            _placed(metrics.revenue_ranking(w.delivered, "category_most_common")), revenue=2
        ),
        "revenue_by_state": lambda w: _rounded(
            _placed(metrics.revenue_ranking(w.delivered, "customer_state")), revenue=2
        ),
        "delay_by_state": lambda w: _rounded(
            _placed(metrics.delay_ranking(w.delivered, "customer_state")), revenue=2
        ),
        "top_category": lambda w: _rounded(
            metrics.top(metrics.revenue_ranking(w.delivered, "category_most_common"), 1), revenue=2
        ),
        "top_state": lambda w: _rounded(
            metrics.top(metrics.revenue_ranking(w.delivered, "customer_state"), 1), revenue=2
        ),
        "delay_state_top10": lambda w: _rounded(
            metrics.top(metrics.delay_ranking(w.delivered, "customer_state"), metrics.TOP_TABLE),
            revenue=2,
        ),
        "delay_table_formatted": lambda w: metrics.delay_formatted(
            metrics.top(metrics.delay_ranking(w.delivered, "customer_state"), metrics.TOP_TABLE)
        ).select("customer_state", "revenue_text", "late_rate_text", "median_delay_text"),
        "state_top12": lambda w: _rounded(_mart(w, "top_states"), revenue=2),
        "category_top12": lambda w: _rounded(_mart(w, "top_categories"), revenue=2),
        "late_state_top12": lambda w: _rounded(_mart(w, "late_states"), revenue=2),
        "revenue_by_date": lambda w: _rounded(
            _texts(metrics.revenue_by_date(w.delivered)), revenue=2
        ),
        "profile_by_month": lambda w: _rounded(metrics.month_profile(w.delivered), revenue=2),
        "delivery_days_hist": lambda w: _rounded(metrics.delivery_days_histogram(w.delivered)),
        "review_score_hist": lambda w: metrics.review_score_histogram(w.delivered),
        "filter_domains": _filter_domains,
        "date_bounds": lambda w: metrics.date_bounds(w.delivered),
        "dashboard_cube": lambda w: _rounded(cubes.dashboard_cube(w.delivered)),
        "cube_json": lambda w: _rounded(_cube_json(w)),
        "cube_rollup": lambda w: _rounded(
            cubes.rolled_up(w.cube, ["customer_state", "purchase_month"], cubes.MEASURES)
        ),
        "page_kpis": lambda w: _rounded(cubes.cube_kpis(w.cube)),
        "filtered_kpis": lambda w: _rounded(cubes.cube_kpis(_filtered(w, **FILTERS))),
        "filtered_revenue_by_date": lambda w: _rounded(_chart(w, "revenue_by_date", **FILTERS)),
        "filtered_state_top12": lambda w: _rounded(_chart(w, "top_states", **DATES)),
        "filtered_category_top12": lambda w: _rounded(_chart(w, "top_categories", **DATES)),
        "filtered_late_state_top12": lambda w: _rounded(_chart(w, "late_states", **DATES)),
        "filtered_late_month": lambda w: _rounded(_chart(w, "late_months", **FILTERS)),
        "training_rows": lambda w: _rounded(
            delay_model.training_rows(w.delivered), revenue=6
        ),
        "stratified_split_counts": lambda w: _split_counts(w.split),
        "approximate_split_counts": lambda w: _split_counts(_approximate_split(w)),
        "holdout_sample": _holdout_sample,
        "impute_scale_numeric": lambda w: _rounded(_scaling(w)),
        "onehot_categorical": _slots,
        "auc_of_score": lambda w: _rounded(evaluation.roc_auc(_rule_scores(w))),
        "classification_report_of_score": lambda w: _rounded(
            evaluation.classification_report(_rule_scores(w).where("score is not null"))
        ),
        "drift_tier_by_state": lambda w: _rounded(_drift_by_state(w)),
        "historical_late_rate": lambda w: _rounded(drift.historical_late_rate(w.delivered)),
        "report_headline": lambda w: pipeline.report_headline(w.marts).select(
            "total_revenue_text", "avg_ticket_text", "avg_delivery_days_text", "late_rate_text",
            "avg_review_score_text", "top_category", "top_category_revenue_text", "top_state",
            "top_state_revenue_text", "most_late_state", "most_late_state_late_rate_text",
        ),
        "csv_roundtrip": _csv_roundtrip,
        "csv_quoted_lines": _quoted_lines,
        "marts_roundtrip": _marts_roundtrip,
        "missing_inputs": _missing_inputs,
        "drift_tier_rule": _drift_boundaries,
        "late_model_rows": _model_rows,
        "late_model_quality": _model_quality,
        "drift_check_rule": _drift_rule,
        "report_texts": _report_headline_texts,
        "late_model_scores": lambda w: _rounded(w.trained.test_scores, score=6),
        "late_model_metrics": lambda w: _rounded(_model_metrics(w)),
        "drift_check": lambda w: w.drift,
        "report_summary": _report,
    }


def _llm() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    """Queries and SQL twins of the ``llm`` subpackage and the pipeline, none if it is absent."""
    try:
        import corpus_pipeline
        from latelane.llm.queries import ORACLES, QUERIES
    except ModuleNotFoundError as missing:
        if missing.name not in {"corpus_pipeline", "latelane.llm", "latelane.llm.queries"}:
            raise
        return {}, {}
    twins = dict(ORACLES)
    if corpus_pipeline.ORACLE_SQL is not None:
        twins["pipeline"] = corpus_pipeline.ORACLE_SQL
    return {**QUERIES, "pipeline": corpus_pipeline.run}, twins


def entry(spark: SparkSession) -> DataFrame:
    """States with the highest share of late deliveries."""
    return queries()["delay_state_top10"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:

    def bound(query: Callable[[Workspace], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: query(_workspace(spark, sf_dir))

    return {name: bound(query) for name, query in _queries().items()} | _llm()[0]


def oracle_sql() -> dict[str, str]:
    """SQL twins; the trained forest and what depends on it have none."""
    return oracle_queries(FILTERS) | _llm()[1]
