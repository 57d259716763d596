"""Seeded samples and splits of an exact size, without sorting whole groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from latelane.functions.sampling import hash_number, hash_text
from latelane.operators.joins import repeated
from latelane.operators.selection import EVERYTHING, ranks_inside
from latelane.sources.scratch import written

SEED = 42  # fixed value
TEST_SHARE = 0.2  # fixed value
ROW_KEYS = ("order_id", "review_score")
HASHES = 16.0**13  # hash numbers are below this
HASH = "_hash"  # column of the rows' hashes, where they were made beforehand
DEVIATIONS = 6  # of the rank of a uniform hash, on either side of where a cut is looked for


def with_hashes(
    df: DataFrame, seed: int = SEED, row_keys: Sequence[str] = ROW_KEYS
) -> DataFrame:
    """df with the hashes ``stratified_split`` orders its rows by; written with the rows, they
    are made once instead of in each of its passes."""
    return df.withColumn(HASH, hash_number(hash_text(row_keys, seed)))


def stratified_split(
    df: DataFrame,
    label: str,
    share: float = TEST_SHARE,
    seed: int = SEED,
    row_keys: Sequence[str] = ROW_KEYS,
) -> DataFrame:
    """df with ``is_test``: exactly round(share * n) rows of each label are true.

    Rows are ordered at random by a seeded hash of ``row_keys``. Hashes are uniform, so the
    one that separates the two parts of a label lies in a bracket of known width; counts
    find it there, and rows are compared with it where they are. Should the bracket not
    hold it, as when most rows share their keys, all hashes of the label are counted. Only
    rows sharing that very hash are ordered further. Rows without a label are kept and are
    never test rows. ``df`` is read several times and should be a scan, if possible one of
    rows ``with_hashes`` of the same seed and keys.
    """
    key = hash_text(row_keys, seed)
    hashed = df if HASH in df.columns else with_hashes(df, seed, row_keys)
    hashed = hashed.withColumnRenamed(HASH, "value")
    df = df.drop(HASH)
    sizes = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("_n"))
    sizes = written(sizes, "label_sizes")
    smallest = sizes.agg(F.min("_n")).first()[0]
    if smallest is not None and smallest < 2:
        raise ValueError(f"a stratified split needs two rows of each {label}")
    wanted = sizes.withColumn("_k", F.round(F.col("_n") * share).cast("bigint"))
    at = F.col("_k") / F.col("_n")
    off = DEVIATIONS * (F.sqrt(at * (1 - at) / F.col("_n")) + 1 / F.col("_n"))
    brackets = wanted.withColumns({"_lo": (at - off) * HASHES, "_hi": (at + off) * HASHES})
    rest = [c for c in df.columns if c != label]
    numbers = hashed.where(F.col(label).isNotNull()).select(label, "value")

    def edges_in(brackets: DataFrame) -> DataFrame:
        rows = numbers.join(brackets.select(label, "_lo", "_hi"), label)  # a row per label
        ranked = ranks_inside(rows, [label]).join(wanted, label)
        return written(
            ranked.where("n_below < _k and _k <= n_below + n").select(
                label, "_k", F.col("value").alias("_edge"), F.col("n_below").alias("_below")
            ),
            "edges",
        )

    edges = edges_in(brackets)
    missed = brackets.where("_k > 0").join(edges, label, "left_anti")
    if not missed.isEmpty():
        lo, hi = EVERYTHING
        edges = edges.unionByName(edges_in(missed.withColumns({"_lo": F.lit(lo), "_hi": F.lit(hi)})))
    placed = hashed.join(edges, label, "left")  # a row per label
    off_edge = placed.where("_edge is null or value <> _edge").withColumn(
        "is_test", F.coalesce(F.col("value") < F.col("_edge"), F.lit(False))
    )
    # Equal rows are interchangeable: count them, share out the counts, then repeat.
    equal = (
        placed.where("value = _edge")
        .groupBy(*df.columns, "_k", "_below")
        .agg(F.count("*").alias("_n"))
    )
    upto = F.sum("_n").over(Window.partitionBy(label).orderBy(key, *rest))
    in_test = F.greatest(
        F.lit(0), F.least(F.col("_n"), F.col("_k") - F.col("_below") - (upto - F.col("_n")))
    )
    shared = equal.withColumn("_test", in_test).select(
        *df.columns,
        F.inline(
            F.array(
                F.struct(F.lit(True).alias("is_test"), F.col("_test").alias("_copies")),
                F.struct(F.lit(False).alias("is_test"), (F.col("_n") - F.col("_test")).alias("_copies")),
            )
        ),
    )
    on_edge = repeated(written(shared.where("_copies > 0"), "edge_rows"), "_copies")
    return off_edge.select(*df.columns, "is_test").unionByName(on_edge)


def approximate_split(
    df: DataFrame, share: float = TEST_SHARE, seed: int = SEED, row_keys: Sequence[str] = ROW_KEYS
) -> DataFrame:
    """df with ``is_test`` from the hash alone: no shuffle, shares only near ``share``."""
    edge = float(int(share * HASHES))
    return df.withColumn("is_test", hash_number(hash_text(row_keys, seed)) < edge)


def fixed_sample(
    df: DataFrame, rows: int, seed: int = SEED, row_keys: Sequence[str] = ROW_KEYS
) -> DataFrame:
    """``rows`` rows in the order of a seeded hash; an error if there are fewer.

    Each task keeps its first ``rows`` rows only, and the sample is written, so this is for
    small samples.
    """
    order = [hash_text(row_keys, seed), *[c for c in df.columns]]
    sample = written(df.orderBy(*order).limit(rows).coalesce(1), "sample")
    found = sample.count()
    if found < rows:
        raise ValueError(f"cannot sample {rows} rows of {found}")
    return sample
