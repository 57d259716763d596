"""Null-safe left outer lookups, repeated rows and groups that move once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def lookup(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left outer join on ``key`` where a missing key matches a missing key.

    Catalyst broadcasts the right side when it is under the session's broadcast
    threshold. Otherwise both sides shuffle on the key, and adaptive execution splits the
    partition of a hot key (the missing one too) among tasks, by its size at run time. For
    that ``right`` should be a scan: a side that is already partitioned cannot be split.
    """
    right_key = f"_{key}"
    right = right.withColumnRenamed(key, right_key)
    match = F.col(key).eqNullSafe(F.col(right_key))
    return left.join(right, match, "left").drop(right_key)


def repeated(
    df: DataFrame, copies: str, counted: DataFrame | None = None, chunk: int = 100_000
) -> DataFrame:
    """Each row as many times as its ``copies`` column says (which is dropped).

    Rows with up to ``chunk`` copies expand where they are. The others expand in two
    steps with a shuffle of (row, chunk number) in between, so that the copies of one
    row are made by many tasks, none of them holding a long array.
    """

    def numbers(count: Column) -> Column:
        return F.explode(F.sequence(F.lit(1), count.cast("int")))

    few = df.where(F.col(copies) <= chunk).withColumn("_n", numbers(F.col(copies)))
    if (df if counted is None else counted).where(F.col(copies) > chunk).isEmpty():
        return few.drop(copies, "_n")
    parts = F.ceil(F.col(copies) / chunk)
    many = (
        df.where(F.col(copies) > chunk)
        .withColumn("_part", numbers(parts))
        .repartition(*[c for c in df.columns if c != copies], "_part")
        .withColumn(
            "_n", numbers(F.least(F.lit(chunk), F.col(copies) - (F.col("_part") - 1) * chunk))
        )
        .drop("_part")
    )
    return few.unionByName(many).drop(copies, "_n")


HUGE = 100_000  # rows of a key that one task may get as they are
KEY_BUCKETS = 1 << 16


def grouped_once(
    df: DataFrame,
    key: str,
    grouped: Callable[[DataFrame], DataFrame],
    counted: DataFrame | None = None,
    huge: int = HUGE,
) -> DataFrame:
    """``grouped(df)``, an aggregate per ``key``, where most keys have few rows.

    Combining such rows before they move saves little and fills the memory of the tasks that
    read, so they move once as they are, and all steps of the aggregate find them together.
    Rows are counted per bucket of the key's hash (in ``counted`` if given, a plainer table of
    these keys); buckets of over ``huge`` rows, which hold every key of so many, are combined
    first. Keys are not null.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(KEY_BUCKETS))
    counts = (df if counted is None else counted).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    full = [r["bucket"] for r in counts.where(F.col("n") > huge).collect()]  # of KEY_BUCKETS
    if not full:
        return grouped(df.repartition(key))
    combined = bucket.isin(full)
    return grouped(df.where(~combined).repartition(key)).unionByName(grouped(df.where(combined)))
