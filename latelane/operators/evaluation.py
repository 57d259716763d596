"""Classifier quality from scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from latelane.functions.columns import ratio
from latelane.operators.selection import running_totals
from latelane.sources.scratch import written


def roc_auc(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row: exact ROC AUC, tied scores counting half, and how many rows have no score.

    Rows are counted per distinct score; running totals over the scores give how many
    negatives each positive beats. A null or NaN score leaves its row out and is counted
    in ``unscored``.
    """
    value = F.col(score).cast("double")
    rows = scored.select(F.nanvl(value, F.lit(None).cast("double")).alias("score"), label)
    counts = rows.groupBy("score").agg(
        F.count_if(F.col(label) == 1).alias("pos"),
        F.count_if(F.col(label) == 0).alias("neg"),
        F.count("*").alias("n"),
    )
    counts = written(counts, "score_counts")
    placed = running_totals(counts.where("score is not null"), [], "score", ["neg"])
    wins = F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    unscored = counts.where("score is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("unscored"))
    return placed.agg(ratio(F.sum(wins), pairs).alias("roc_auc")).crossJoin(F.broadcast(unscored))


def classification_report(
    scored: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy and the two averages.

    One pass counts (label, prediction) pairs. A quotient with a zero divisor is 0.
    """
    pairs = scored.groupBy(
        F.col(label).cast("int").alias("truth"), F.col(prediction).cast("int").alias("guess")
    ).agg(F.count("*").alias("n"))
    # From here on a row per class and pair of classes.
    sides = pairs.select(
        F.inline(
            F.array(
                F.struct(F.col("truth").alias("class"), F.col("n").alias("support"),
                         F.lit(0).cast("bigint").alias("guessed"),
                         F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0)
                         .alias("hits")),
                F.struct(F.col("guess").alias("class"), F.lit(0).cast("bigint").alias("support"),
                         F.col("n").alias("guessed"), F.lit(0).cast("bigint").alias("hits")),
            )
        )
    ).groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "guessed", "hits")])

    def or_zero(a: Column, b: Column) -> Column:
        return F.coalesce(ratio(a, b), F.lit(0.0))

    classes = sides.select(
        F.col("class").cast("string").alias("class"),
        or_zero(F.col("hits"), F.col("guessed")).alias("precision"),
        or_zero(F.col("hits"), F.col("support")).alias("recall"),
        or_zero(2 * F.col("hits"), F.col("guessed") + F.col("support")).alias("f1_score"),
        "support",
        "hits",
    )
    scores = ["precision", "recall", "f1_score"]
    support = F.sum("support")
    accuracy = or_zero(F.sum("hits"), support)

    def weighted(c: str) -> Column:
        return or_zero(F.sum(F.col(c) * F.col("support")), support)

    def line(name: str, values: dict[str, Column]) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            *[v.alias(c) for c, v in values.items()],
            support.alias("support"),
        )

    overall = classes.agg(
        F.array(
            line("accuracy", {c: accuracy for c in scores}),
            line("macro avg", {c: F.avg(c) for c in scores}),
            line("weighted avg", {c: weighted(c) for c in scores}),
        ).alias("lines")
    ).select(F.inline("lines"))
    return classes.drop("hits").unionByName(overall)
