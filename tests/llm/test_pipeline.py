"""The corpus pipeline stage by stage against brute force on the small documents."""

import pytest

import corpus_pipeline
from latelane.llm.common import documents, written
from tests.llm.test_duplicates import brute_components, brute_groups
from tests.llm.test_tokens import check_packing

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs, found = documents(spark, FOLDER), []
    for name, stage in corpus_pipeline.STAGES:
        found.append((name, docs, written(stage(spark, docs, FOLDER), name)))
        docs = found[-1][2]
    return {name: (before, after) for name, before, after in found}


def ids(docs):
    return sorted(r["doc_id"] for r in docs.select("doc_id").collect())


def test_stages_keep_the_columns_of_documents(stages):
    for name, (before, after) in stages.items():
        if name != "packing":
            assert after.schema.simpleString() == before.schema.simpleString()


def test_filters_keep_clean_documents(spark, stages):
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    clean = {i for i, r in labels.items() if r["quality"] == 1 and r["toxic"] == 0}
    for name in ("language_id", "quality_classifier"):
        before, after = (set(ids(x)) for x in stages[name])
        assert after <= before
        assert len(clean & before - after) <= 0.02 * len(clean)
    toxic = {i for i, r in labels.items() if r["toxic"] == 1}
    assert len(toxic & set(ids(stages["quality_classifier"][1]))) < 0.5 * len(toxic)


def test_exact_copies_go(stages):
    before, after = stages["exact_dedup"]
    groups = brute_groups(before.collect())
    assert ids(after) == sorted(max(g) for g in groups.values())
    assert len(groups) < before.count()


def test_near_copies_go(stages):
    before, after = stages["jaccard_join"]
    found = brute_components(before.collect())
    assert ids(after) == sorted(i for i, _, c in found if i == c)
    assert after.count() < before.count()


def test_everything_left_is_packed(stages):
    before, pieces = stages["packing"]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    assert check_packing(pieces.collect(), texts, 2048) > 0.97


def test_odd_rows_pass_through(spark, odd, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for start in (odd, odd.where("false")):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, str(tmp_path)), name)
        if start is odd:
            assert docs.where("doc_id = 9").count() >= 1 and docs.where("doc_id = 7").count() == 0
            assert docs.where("doc_id in (1, 2, 3) and start = 0").count() <= 1
        else:
            assert docs.count() == 0


def test_near_copies_are_decided_by_row(spark):
    """Rows that share an id, or have none, stay or go by their own group."""
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    other = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    rows = [
        (1, f"{base} fifteen a"),
        (2, f"{base} fifteen b"),  # goes: near 1
        (2, f"{other} pi a"),  # stays: first of its group
        (3, f"{other} pi b"),  # goes
        (None, f"{other} pi c"),  # goes
        (None, "a text of its own without an id that no other row of the table comes near to"),
        (4, None), (4, ""), (None, " "),
    ]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, lang string").repartition(3)
    kept = corpus_pipeline.nearly_once(spark, docs, FOLDER)
    assert kept.columns == docs.columns
    stays = [rows[0], rows[2], *rows[5:]]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted(stays, key=repr)


def test_of_equal_rows_one_stays(spark):
    text = "the very same text stands in three rows of the table under one id and under none"
    docs = spark.createDataFrame([(7, text), (7, text), (None, text)], "doc_id bigint, text string")
    assert [tuple(r) for r in corpus_pipeline.nearly_once(spark, docs, FOLDER).collect()] == [(7, text)]
