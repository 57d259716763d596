"""Exact ranks and order statistics by counts per value, one plan for every size.

A rank is found in two passes: a bracket of values that holds it, then counts. Only values
inside the bracket are counted one by one and moved; those below it are a number per task.
Whether the bracket held the rank is checked, so a poor bracket costs another pass, never
the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from latelane.functions.columns import all_present
from latelane.sources.scratch import written

# The quantile summary's ranks are off by a group's size over this at most; the bracket is
# twice as wide on either side.
ACCURACY = 2_000
MARGIN = 2 / ACCURACY
EVERYTHING = (float("-inf"), float("inf"))


def running_totals(
    counted: DataFrame, keys: Sequence[str], value: str, sums: Sequence[str]
) -> DataFrame:
    """``counted`` with ``<c>_below`` for each ``sums`` column: its total over the smaller
    values of the same keys.

    A row per (keys, value) is wanted; null keys are a group. Rows are cut into ranges of
    (keys, value), totals per range and keys are the offsets, and running totals are made
    inside a range. So a group of any size is shared by many tasks, and no group is held
    in memory.
    """
    spark, keys = counted.sparkSession, list(keys)
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = counted.repartitionByRange(ranges, *keys, value)
    cut = written(cut.withColumn("_range", F.spark_partition_id()), "ranges")
    totals = cut.groupBy("_range", *keys).agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    # Per group at most a row per range.
    ahead = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("_range").alias("_offset_range"),
        *[F.col(k).alias(f"_offset_{k}") for k in keys],
        *[F.coalesce(F.sum(f"_{c}").over(ahead), F.lit(0)).alias(f"_{c}") for c in sums],
    )
    same = F.col("_range") == F.col("_offset_range")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_offset_{k}"))
    inside = (
        Window.partitionBy("_range", *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    )
    below = {
        f"{c}_below": F.col(f"_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums
    }
    placed = cut.join(offsets, same).withColumns(below)
    return placed.select(*counted.columns, *below)


def counted_values(values: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """(keys, value, n) of the values that are neither null nor NaN."""
    present = values.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return present.groupBy(*keys, value).agg(F.count("*").alias("n"))


def ranks_inside(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, value, n, n_below) of the values from ``_lo`` to ``_hi``, both on every row.

    ``n_below`` counts all smaller values of the keys, also those under the bracket. Values
    are neither null nor NaN, keys are not null.
    """
    inside = F.when(F.col("value") >= F.col("_lo"), F.col("value"))
    counts = rows.where("value <= _hi").groupBy(*keys, inside.alias("value")).agg(F.count("*").alias("n"))
    counts = written(counts, "bracket_counts")
    under = counts.where("value is null").select(*keys, F.col("n").alias("_under"))
    ranked = running_totals(counts.where("value is not null"), keys, "value", ["n"])
    below = F.col("n_below") + F.coalesce("_under", F.lit(0))
    return ranked.join(under, list(keys), "left").withColumn("n_below", below).drop("_under")


def _middle_values(ranked: DataFrame, sizes: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, lower, upper) of every group in ``sizes``: the values that hold the middle ranks
    of its ``_size`` values, null where ``ranked`` does not have them."""
    upto, half = F.col("n_below") + F.col("n"), F.col("_size") / 2
    low, high = F.ceil(half), F.floor(half) + 1
    lower = (F.col("n_below") < low) & (low <= upto)
    upper = (F.col("n_below") < high) & (high <= upto)
    held = ranked.join(sizes.select(*group, "_size"), list(group)).where(lower | upper)
    ends = [F.max(F.when(side, F.col("value"))).alias(c) for c, side in (("lower", lower), ("upper", upper))]
    return sizes.select(*group).join(held.groupBy(*group).agg(*ends), list(group), "left")


def exact_medians(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Exact interpolated median of each column, per group of ``keys`` (or overall).

    Nulls and NaN are skipped, groups with a missing key are dropped, a group without
    values has a null median. Infinities take part in order. ``df`` is read twice and
    should be a scan.
    """
    keys, group = list(keys), [*keys, "_column"]
    numbers = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns]
    df = all_present(df, keys).select(*keys, *numbers)
    edges = [0.5 - MARGIN, 0.5 + MARGIN]
    summary = written(
        df.groupBy(*keys).agg(
            *[F.struct(F.count(c).alias("size"), F.percentile_approx(c, edges, ACCURACY).alias("edges")).alias(f"_{i}")
              for i, c in enumerate(columns)]
        ),
        "brackets",
    )

    def bracket(i: int, *values: Column) -> Column:
        at = F.col(f"_{i}")
        named = [F.lit(i).alias("_column"), at["size"].alias("_size")]
        return F.struct(*named, at["edges"][0].alias("_lo"), at["edges"][1].alias("_hi"), *values)

    brackets = summary.select(*keys, F.inline(F.array(*[bracket(i) for i in range(len(columns))])))
    brackets = brackets.where("_size > 0")
    beside = df.join(summary, keys) if keys else df.crossJoin(F.broadcast(summary))  # one row
    cells = [bracket(i, F.col(c).alias("value")) for i, c in enumerate(columns)]
    rows = beside.select(*keys, F.inline(F.array(*cells)))
    found = written(_middle_values(ranks_inside(rows, group), brackets, group), "medians")
    missed = found.where("lower is null or upper is null").select(*group)
    if not missed.isEmpty():
        lo, hi = EVERYTHING
        again = rows.join(missed, group, "left_semi").where("value is not null")
        again = again.withColumns({"_lo": F.lit(lo), "_hi": F.lit(hi)})
        rest = _middle_values(ranks_inside(again, group), brackets.join(missed, group, "left_semi"), group)
        found = found.join(missed, group, "left_anti").unionByName(written(rest, "more_medians"))

    def median(i: int, c: str) -> Column:
        # Halved first: the sum of two large values would overflow.
        middle = F.when(F.col("lower") == F.col("upper"), F.col("lower")).otherwise(F.col("lower") / 2 + F.col("upper") / 2)
        return F.max(F.when(F.col("_column") == i, middle)).alias(c)

    medians = [median(i, c) for i, c in enumerate(columns)]
    if not keys:
        return found.agg(*medians)
    found = found.groupBy(*keys).agg(*medians)
    return summary.select(*keys).join(found, keys, "left").select(*keys, *columns)


def histogram_median(value: str, count: str) -> Column:
    """Aggregate: exact median of pre-counted values (a value and how often it occurs)."""
    return F.percentile(F.col(value), F.lit(0.5), F.col(count))
