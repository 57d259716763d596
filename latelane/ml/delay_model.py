"""The late-delivery classifier: features, pipeline, training and scoring."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from latelane.functions.sampling import hash_number, hash_text
from latelane.ml.forest import GroupedForestClassifier
from latelane.ml.scaling import CategoryText, MedianScaler
from latelane.operators.evaluation import classification_report, roc_auc
from latelane.operators.split import ROW_KEYS, SEED, TEST_SHARE, stratified_split, with_hashes
from latelane.sources.scratch import written

# The model's input columns, seed and forest size.
NUMERIC = [
    "estimated_delivery_days",
    "freight_value",
    "revenue",
    "avg_item_price",
    "total_items",
    "freight_ratio",
    "distance_km",
    "purchase_weekday",
    "purchase_month",
    "payment_installments",
    "seller_late_rate",
    "customer_late_rate",
    "distinct_categories",
]
CATEGORICAL = ["payment_type_primary", "customer_state", "seller_state"]
TREES = 200
MAX_DEPTH = 10
# Partitions the training rows are dealt to: so many at least, and more where there would be
# over so many rows in one. Spark draws a tree's rows per partition, so a layout that follows
# from the number of rows makes the model depend on rows and seed alone.
FIT_PARTITIONS = 32
FIT_PARTITION_ROWS = 62_500


def training_rows(delivered: DataFrame) -> DataFrame:
    """Row keys, label and the 16 features of delivered orders."""
    return delivered.select(
        *ROW_KEYS,
        F.col("is_late").cast("double").alias("label"),
        *[F.col(c).cast("double").alias(c) for c in NUMERIC],
        *CATEGORICAL,
    )


def encoder_stages() -> list:
    """Missing text filled, indexed in alphabetical order, one slot per seen category.

    A category not seen in training gets index n of n, the one the encoder drops, hence
    a zero vector.
    """
    return [
        CategoryText(inputCols=CATEGORICAL),
        StringIndexer(
            inputCols=[c + CategoryText.SUFFIX for c in CATEGORICAL],
            outputCols=[f"{c}_index" for c in CATEGORICAL],
            handleInvalid="keep",
            stringOrderType="alphabetAsc",
        ),
        OneHotEncoder(
            inputCols=[f"{c}_index" for c in CATEGORICAL],
            outputCols=[f"{c}_slots" for c in CATEGORICAL],
            dropLast=True,
        ),
    ]


def build_pipeline(trees: int = TREES, max_depth: int = MAX_DEPTH, seed: int = SEED) -> Pipeline:
    """Imputation and scaling, encoding, assembly and the forest."""
    scaler = MedianScaler(inputCols=NUMERIC)
    return Pipeline(
        stages=[
            scaler,
            *encoder_stages(),
            VectorAssembler(
                inputCols=[*scaler.output_columns(), *[f"{c}_slots" for c in CATEGORICAL]],
                outputCol="features",
            ),
            GroupedForestClassifier(
                numTrees=trees,
                maxDepth=max_depth,
                maxBins=64,
                impurity="gini",
                featureSubsetStrategy="sqrt",
                seed=seed,
                maxMemoryInMB=512,
                cacheNodeIds=True,
            ),
        ]
    )


def scored(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Row keys, label, predicted label and probability of being late."""
    return model.transform(rows).select(
        *ROW_KEYS,
        "label",
        "prediction",
        vector_to_array("probability")[1].alias("score"),
    )


@dataclass
class TrainedModel:
    model: PipelineModel
    test_scores: DataFrame

    def auc(self) -> DataFrame:
        return roc_auc(self.test_scores)

    def report(self) -> DataFrame:
        return classification_report(self.test_scores)


def fitting_rows(training: DataFrame, most: int | None = None, seed: int = SEED) -> DataFrame:
    """All training rows, in a layout that no cluster setting changes.

    Only a caller that gives ``most`` gets about so many of them, drawn by hash.
    """
    key = hash_text(ROW_KEYS, seed + 1)
    rows = training.count()
    if most is not None and rows > most:
        training = training.where(hash_number(key) < most / rows * 16.0**13)
        rows = most
    dealt = training.repartition(max(FIT_PARTITIONS, ceil(rows / FIT_PARTITION_ROWS)), key)
    return dealt.sortWithinPartitions(key, *[c for c in training.columns])


def train(
    delivered: DataFrame,
    trees: int = TREES,
    max_depth: int = MAX_DEPTH,
    share: float = TEST_SHARE,
    seed: int = SEED,
    max_training_rows: int | None = None,
) -> TrainedModel:
    """Split, fit on the larger part, score the other; the scores are written once.

    The fit sees every row of the larger part, unless a caller bounds them with
    ``max_training_rows``; the test part is scored whole.
    The seller and customer late rates among the features come from the whole table,
    the scored row included, so the quality measured is on the optimistic side.
    """
    rows = written(with_hashes(training_rows(delivered), seed), "training_rows")
    split = written(stratified_split(rows, "label", share, seed), "split")
    # Every stage passes over these rows, some twice. A written table would lose their layout.
    fit = fitting_rows(split.where("not is_test").drop("is_test"), max_training_rows, seed).persist()
    try:
        model = build_pipeline(trees, max_depth, seed).fit(fit)
    finally:
        fit.unpersist()
    return TrainedModel(model, written(scored(model, split.where("is_test")), "test_scores"))
