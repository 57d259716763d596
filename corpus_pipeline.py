"""From raw documents to packed training sequences.

Each stage takes what its predecessor kept, decides over all of it and returns the rows
that stay with their columns; the last one returns the pieces of the packed sequences.
Between stages rows are written as Parquet, so a lost executor costs part of one stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from latelane.llm import exact_dedup, jaccard_join, language_id, packing, quality_classifier
from latelane.llm.common import documents, table, written
from latelane.llm.queries import BYTE_BPE

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a language of the corpus; those without a letter and those that fit their
    language worse than nearly all known texts go."""
    scored = language_id.recognised(docs)
    kept = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= language_id.REJECT_BELOW)
    return scored.where(kept).select(*docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that are likely enough of the best grade."""
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.scored(docs, model).where("kept").select(*docs.columns)


def exactly_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, that of the largest doc_id."""
    decided = exact_dedup.duplicates(docs).where("kept")

    def key(digest):
        return F.concat_ws(":", F.col("doc_id").cast("string"), digest)

    kept = decided.groupBy(key("text_sha256").alias("key")).agg(F.count("*").alias("n"))
    kept = written(kept, "kept_texts")
    lower = F.translate(F.coalesce("text", F.lit("")), exact_dedup.UPPER, exact_dedup.UPPER.lower())
    keyed = docs.withColumn("key", key(F.sha2(lower.cast("binary"), 256)))
    stays = keyed.join(kept.where("n = 1").select("key"), "key", "left_semi").drop("key")
    again = kept.where("n > 1").select("key")
    if again.isEmpty():
        return stays
    # Rows that repeat a doc_id with an equal text: their copies are the same but for case.
    order = Window.partitionBy("key").orderBy("text")
    one = keyed.join(again, "key", "left_semi").withColumn("place", F.row_number().over(order))
    return stays.unionByName(one.where("place = 1").drop("key", "place"))


def nearly_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that of the smallest doc_id.

    Rows are told apart by their place in a written copy, so a repeated or null doc_id keeps
    or drops each of its rows by that row's own group. Of equal ids in a group the first place
    stays, a null id only where no other is in the group. Texts without words, which link with
    nothing, stay.
    """
    columns = docs.columns
    placed = written(docs.withColumn("_place", F.monotonically_increasing_id()), "placed")
    found = jaccard_join.near_duplicates(placed.select(F.col("_place").alias("doc_id"), "text"))
    ids = placed.select("_place", F.col("doc_id").alias("_id"))
    rows = found.join(ids, found["doc_id"] == ids["_place"])
    first = F.min(F.struct(F.col("_id").isNull(), "_id", "_place"))["_place"].alias("_place")
    kept = written(rows.groupBy("component_id").agg(first).select("_place"), "kept_places")
    return placed.join(kept, "_place", "left_semi").select(columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts in sequences of 2048 tokens."""
    return packing.packed_documents(docs, BYTE_BPE)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", known_language),
    ("quality_classifier", good_quality),
    ("exact_dedup", exactly_once),
    ("jaccard_join", nearly_once),
    ("packing", packed),
]

# Language models, a fitted classifier and column generation are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
