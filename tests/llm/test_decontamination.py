"""Benchmark hits against a plain version, and what is removed."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from latelane.llm import decontamination as dc
from tests.conftest import SMALL

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def hit_places(doc, items, window=10):
    """(hit words, items that occur) of a document's words."""
    hit, found = set(), set()
    for item_id, text in items:
        item = words(text)
        size = min(window, len(item))
        grams = {tuple(item[i : i + size]) for i in range(len(item) - size + 1)} if item else set()
        for i in range(len(doc) - size + 1) if item else ():
            if tuple(doc[i : i + size]) in grams:
                hit.update(range(i, i + size))
                found.add(item_id)
    return hit, found


def brute_force(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        doc = words(text)
        hit, found = hit_places(doc, items, window)
        ids = ",".join(sorted(str(i) for i in found if i is not None))
        digest = hashlib.sha256(ids.encode()).hexdigest()
        out.append((doc_id, len(doc), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=repr)


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
ITEMS = [
    (1, ITEM),
    (2, "Short one"),
    (2, "another row of the same item with more than ten words in it"),
    (30, "ONE"),
    (4, None),
    (5, " ?! "),
    (6, "the quick brown fox jumps over the lazy dog while nobody looks"),
    (None, "seven wizards brew a potion"),
    (7, "x " * 30),
    (8, "x " * 30),
    (9, "été 日本 größe"),
]
DOCS = [
    (1, f"before {ITEM} after"),
    (2, "Alpha, BETA; gamma--delta epsilon\nzeta eta (theta) iota kappa. lambda? mu!"),
    (3, "alpha beta gamma delta epsilon zeta eta theta iota"),
    (4, "a short one and one"),
    (5, "x " * 9), (6, "x " * 10), (7, "x " * 500),
    (8, None), (9, ""), (10, "..."), (11, f"{ITEM} {ITEM} short {ITEM} one"),
    (12, "ÉTÉ été 日本 größe"), (12, "ete"), (12, "ete"), (None, "one"),
]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(*i, "clash") for i in ITEMS], "item_id bigint, text string, words string")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*d, 1, "h") for d in DOCS]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n_words int, hash string").repartition(3)


COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


@pytest.mark.parametrize("block", [dc.BLOCK, 7])
def test_equals_brute_force(docs, items, block, monkeypatch):
    monkeypatch.setattr(dc.scanned, "__defaults__", (block,))
    found = dc.contaminated(docs, items)
    assert found.columns == COLUMNS
    assert sorted(map(tuple, found.collect()), key=repr) == brute_force(DOCS, ITEMS)


def test_other_window(docs, items):
    found = dc.contaminated(docs, items, window=3)
    assert sorted(map(tuple, found.collect()), key=repr) == brute_force(DOCS, ITEMS, 3)


def test_odd_rows(odd, nothing, items):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    assert sorted(map(tuple, dc.contaminated(odd, items).collect()), key=repr) == brute_force(rows, ITEMS)
    assert dc.contaminated(nothing, items).collect() == []


def test_empty_benchmark(docs, items):
    found = dc.contaminated(docs, items.where("false"))
    assert sorted(map(tuple, found.collect()), key=repr) == brute_force(DOCS, [])
    found = dc.contaminated(docs, items.where("item_id in (4, 5)"))
    assert not any(r["contaminated"] for r in found.collect())


def test_equal_hashes_are_told_apart(spark, docs, items):
    """A hit whose words differ from the window's does not count."""
    windows = dc.benchmark_windows(items)
    found = dc.scanned(docs, windows)
    forged = found.withColumn("gram", F.when(F.col("gram").isNotNull(), F.transform("gram", lambda w: F.concat(w, F.lit("x")))))
    assert dc.verified(forged, windows).count() == 0 < dc.verified(found, windows).count()


def test_documents_are_removed(docs, items):
    kept = dc.decontaminated(docs, items, remove="documents")
    assert kept.columns == docs.columns
    clean = sorted((d for d in DOCS if not hit_places(words(d[1]), ITEMS)[0]), key=repr)
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == clean


def test_spans_are_removed(docs, items):
    def cut(text):
        hit, _ = hit_places(words(text), ITEMS)
        if not hit:
            return text
        between = WORD.split(text)
        kept = [w + between[i + 1] for i, w in enumerate(WORD.findall(text)) if i not in hit]
        return "".join([between[0], *kept])

    found = dc.decontaminated(docs, items)
    assert found.columns == docs.columns
    expected = sorted(((d, cut(t)) for d, t in DOCS), key=repr)
    assert sorted(((r["doc_id"], r["text"]) for r in found.collect()), key=repr) == expected
    # What is left may hold new windows only where cuts brought words together.
    assert ("before after") in [r["text"] for r in found.collect()]


def test_planted_passages_are_found(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    bench = [(r["item_id"], r["text"]) for r in items.collect()]
    found = sorted(map(tuple, dc.contaminated(docs, items).collect()), key=repr)
    assert found == brute_force(rows, bench)
    assert any(r[-1] for r in found) and not all(r[-1] for r in found)


def test_no_python_and_a_broadcast_set(docs, items):
    plan = dc.scan(dc.worded(docs), dc.benchmark_windows(items).select("hash").distinct(), [2, 10], True)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text
    assert "Python" not in text and "Arrow" not in text
