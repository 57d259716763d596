"""Boundary sets and fill-in-the-middle rows against plain versions."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from latelane.llm import fill_in_middle as fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_ends(text):
    return [m.end() for m in UNIT.finditer(text)]


def plain_row(key, text, rate=50):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return key, n, "plain", None, None, text
    if h4 % 100 < 80:
        return key, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return key, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \t\n\x0b\r\x1c\x85 é😀", max_size=60))
def test_offsets_are_unit_ends(text):
    ends = fim.BoundarySet(text)
    assert [ends.offset(k) for k in range(len(ends) + 1)] == [0, *plain_ends(text)]


SHAPES = {
    "sparse words": ("word " * 40_000, fim.ArrayContainer),
    "one word": ("x" * 200_000, fim.ArrayContainer),
    "letters": ("a b" * 60_000, fim.BitmapContainer),
    "spaces only": (" " * 150_000, fim.ArrayContainer),
    "beyond the basic plane": ("😀 " * 70_000, fim.BitmapContainer),
}


@pytest.mark.parametrize("name", SHAPES)
def test_containers_of_long_texts(name):
    text, kind = SHAPES[name]
    if name == "sparse words":
        text, kind = "longer_words_here_" * 2 + text.replace("word", "w" * 19), fim.ArrayContainer
    expected = plain_ends(text)
    ends = fim.BoundarySet(text)
    assert len(ends) == len(expected)
    assert any(isinstance(c, kind) for c in ends.containers)
    for k in [*range(1, len(expected) + 1, max(1, len(expected) // 997)), len(expected)]:
        assert ends.offset(k) == expected[k - 1]


def test_units_at_the_edge_of_a_window():
    for shift in range(-3, 4):
        for tail in ("b", " ", " b", "b ", "  b"):
            text = "a" * (65_536 + shift) + tail
            ends = fim.BoundarySet(text)
            assert [ends.offset(k + 1) for k in range(len(ends))] == plain_ends(text)


@pytest.mark.parametrize("kind", [fim.ArrayContainer, fim.BitmapContainer, fim.RunContainer])
def test_every_container_selects(kind):
    rng = np.random.default_rng(1)
    for positions in (
        np.arange(65_536),
        np.array([0]),
        np.array([65_535]),
        np.flatnonzero(rng.random(65_536) < 0.3),
        np.concatenate([np.arange(10, 500), np.arange(700, 701), np.arange(60_000, 65_536)]),
    ):
        held = kind(positions)
        for k in [0, len(positions) // 2, len(positions) - 1]:
            assert held.select(k) == positions[k]


def test_the_smallest_container_is_taken():
    assert isinstance(fim.container(np.arange(5_000)), fim.RunContainer)
    assert isinstance(fim.container(np.arange(0, 60_000, 100)), fim.ArrayContainer)
    assert isinstance(fim.container(np.arange(0, 65_536, 2)), fim.BitmapContainer)


def test_rows_of_odd_texts(odd, nothing):
    rows = odd.select("doc_id", "text").collect()
    found = fim.transformed(odd)
    assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted((plain_row(*r) for r in rows), key=repr)
    assert fim.transformed(nothing).collect() == []


def test_every_form_is_restored(spark):
    texts = ["", "a", "a b c", " lead and trail ", "<P", "a<S b>", "M> <", "line\n\n two\t", "has <M> mark", "😀 é 日本"]
    rows = [(i, texts[i % len(texts)]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = fim.transformed(docs, fim.Plan(rate=100)).withColumn("text", fim.restored()).collect()
    assert {r["doc_id"]: r["text"] for r in out} == dict(rows)
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}
    assert all(r["form"] == "plain" for r in out if "<M>" in r["text"] or not r["text"])


def test_shares_follow_the_rates(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "'one two three four' as text")
    forms = [r["form"] for r in fim.transformed(docs).collect()]
    assert abs(forms.count("plain") / 4000 - 0.5) < 0.04
    assert abs(forms.count("spm") / (4000 - forms.count("plain")) - 0.8) < 0.04
