"""Median imputation and standard scaling fitted exactly in two aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, functions as F

from latelane.operators.selection import exact_medians

SCALED_SUFFIX = "_scaled"


class _ScalingParams(Params):
    inputCols = Param(
        Params._dummy(), "inputCols", "numeric columns", TypeConverters.toListString
    )

    def output_columns(self) -> list[str]:
        return [c + SCALED_SUFFIX for c in self.getOrDefault(self.inputCols)]


class MedianScaler(Estimator, _ScalingParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fills missing values with the exact median, then centres and scales.

    The scale is the population standard deviation, 1 where that is 0. A column without
    any value is filled with 0.
    """

    @keyword_only
    def __init__(self, *, inputCols: Sequence[str] = ()):
        super().__init__()
        self._set(inputCols=list(inputCols))

    def _fit(self, dataset: DataFrame) -> MedianScalerModel:
        columns = self.getOrDefault(self.inputCols)
        row = exact_medians(dataset, columns).first()
        medians = [0.0 if row is None or row[c] is None else float(row[c]) for c in columns]
        filled = [_filled(c, m) for c, m in zip(columns, medians)]
        moments = dataset.agg(
            F.array(*[F.avg(v) for v in filled]).alias("means"),
            F.array(*[F.stddev_pop(v) for v in filled]).alias("scales"),
        ).first()
        return MedianScalerModel(
            inputCols=columns,
            medians=medians,
            means=[m or 0.0 for m in moments["means"]],
            scales=[s or 1.0 for s in moments["scales"]],
        )


def _filled(column: str, median: float) -> Column:
    return F.coalesce(F.col(column).cast("double"), F.lit(median))


class MedianScalerModel(Model, _ScalingParams, DefaultParamsReadable, DefaultParamsWritable):
    medians = Param(Params._dummy(), "medians", "fill values", TypeConverters.toListFloat)
    means = Param(Params._dummy(), "means", "centres", TypeConverters.toListFloat)
    scales = Param(Params._dummy(), "scales", "divisors", TypeConverters.toListFloat)

    @keyword_only
    def __init__(
        self,
        *,
        inputCols: Sequence[str] = (),
        medians: Sequence[float] = (),
        means: Sequence[float] = (),
        scales: Sequence[float] = (),
    ):
        super().__init__()
        self._set(
            inputCols=list(inputCols),
            medians=list(medians),
            means=list(means),
            scales=list(scales),
        )

    def _fitted(self) -> list[tuple[str, float, float, float]]:
        columns, *numbers = (
            self.getOrDefault(p) for p in (self.inputCols, self.medians, self.means, self.scales)
        )
        return list(zip(columns, *numbers))

    def statistics(self, like: DataFrame) -> DataFrame:
        """The fitted numbers as a table, a row per column."""
        return like.sparkSession.createDataFrame(
            self._fitted(), "feature string, median double, mean double, scale double"
        )

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumns(
            {
                c + SCALED_SUFFIX: (_filled(c, median) - mean) / scale
                for c, median, mean, scale in self._fitted()
            }
        )


class CategoryText(Transformer, _ScalingParams, DefaultParamsReadable, DefaultParamsWritable):
    """Text columns as 'column=value', a null value as 'missing'.

    Empty text stays a value of its own. The prefix keeps alphabetical order and gives
    the encoded slots names that are never empty, which the assembler requires.
    """

    FILL = "missing"  # fixed value
    SUFFIX = "_text"

    @keyword_only
    def __init__(self, *, inputCols: Sequence[str] = ()):
        super().__init__()
        self._set(inputCols=list(inputCols))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumns(
            {
                c + self.SUFFIX: F.concat(F.lit(f"{c}="), F.coalesce(c, F.lit(self.FILL)))
                for c in self.getOrDefault(self.inputCols)
            }
        )
