"""Archives: round trip, format and revisits against brute force."""

import gzip
import hashlib
import io
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from latelane.llm import warc

ODD = [
    (1, "http://a/1", "x" * 99),
    (2, "http://a/2", "x" * 99),
    (3, "http://a/3", "y" * 100),
    (4, None, "y" * 100),
    (4, None, "y" * 100),
    (3, "http://a/3", "y" * 100),
    (5, "http://a/5\r\nX: y", "z" * 40 + "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" + "é日" * 40),
    (6, "http://a/6", None),
    (7, "http://a/7", ""),
    (8, "http://a/8", "\r\n\r\n" * 60),
    (9, "http://a/9", "\r\n\r\n" * 60),
    (None, "http://a/n", "y" * 100),
    (None, "http://a/n", "only without an id " * 9),
    (10, "http://a/10", "long " * 400_000),
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(*r, "clash", 7) for r in ODD]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, payload_digest string, original int")


def expected(rows):
    least = defaultdict(list)
    for page_id, _, html in rows:
        if page_id is not None:
            least[html or ""].append(page_id)
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        first = min(least[html or ""], default=None) if len(data) >= 100 else None
        revisit = first is not None and first != page_id
        out.append(
            (page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response",
             first if revisit else None)
        )
    return sorted(out, key=str)


def test_archives_hold_every_record(pages):
    assert sorted((tuple(r) for r in warc.archived(pages).collect()), key=str) == expected(ODD)
    assert warc.archived(pages.where("false")).count() == 0


def test_payloads_come_back_and_copies_are_stored_once(pages, tmp_path):
    spark = pages.sparkSession
    path = warc.write_archives(pages, str(tmp_path / "archives"))
    stored = warc.read_archives(spark, path, payload=True).collect()
    assert len(stored) == len(ODD)
    texts = {r["record_id"]: r["html"] for r in stored if r["record_type"] == "response"}
    for r in stored:
        original = texts[r["refers_to_record"] or r["record_id"]]
        assert original in {h or "" for p, _, h in ODD if p == r["page_id"]}
        if r["record_type"] == "revisit":
            assert r["html"] == "" and r["payload_bytes"] == 0
    assert {r["url"] for r in stored} == {u.replace("\r\n", "%0D%0A") if u else None for _, u, _ in ODD}
    for file in Path(path).glob("part-*"):
        data = gzip.decompress(file.read_bytes())
        assert not data or data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n")


def test_a_record_is_read_at_its_offset(pages, tmp_path):
    spark = pages.sparkSession
    path = warc.write_archives(pages, str(tmp_path / "archives"))
    index = warc.archive_index(spark, path).collect()
    assert len(index) == len(ODD)
    of_page = {(p, hashlib.sha256((h or "").encode()).hexdigest()): h or "" for p, _, h in ODD}
    urls = {p: u for p, u, _ in ODD}
    for r in index:
        with open(r["file"].removeprefix("file:"), "rb") as file:
            file.seek(r["offset"])
            record = gzip.decompress(file.read(r["length"]))
        (row,) = warc.parse_records(io.BytesIO(record), payload=True)
        assert (row[0], row[1], row[3]) == (r["record_id"], r["page_id"], r["record_type"])
        html = of_page[r["page_id"], r["payload_digest"]]
        if r["record_type"] == "response":
            assert row[7] == html
        else:
            first = min(p for p, _, h in ODD if h == html and p is not None)
            named = f"WARC-Refers-To-Target-URI: {urls[first]}\r\n".encode()
            assert row[5] == 0 and named in record and b"WARC-Refers-To-Date: 20" in record


def test_rows_that_fill_archives_by_one_key_are_dealt_to_several(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 50_000)
    rows = [(None, None, None)] * 600 + [(7, "http://a/7", "w" * 200)] * 300 + [(None, "u", "w" * 200)] * 300
    rows += [(n, "http://b", f"page {n} " * 40) for n in range(100, 400)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    path = warc.write_archives(pages, str(tmp_path / "archives"))
    assert sorted(map(str, warc.full_records(warc.read_archives(spark, path)).toLocalIterator())) == sorted(
        map(str, spark.createDataFrame(expected(rows), warc.archived(pages).schema).toLocalIterator())
    )
    sizes = [r["n"] for r in warc.archive_index(spark, path).groupBy("file").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 200


def test_members_end_with_zero_at_every_size():
    for size in (0, 1, 100, 1 << 16, (1 << 24) - 1, 1 << 24, (1 << 24) + 5):
        packed = warc.member(bytes(size))
        assert packed[-1] == 0 and len(gzip.decompress(packed)) == size
    three = warc.member(b"a" * 9) + warc.member(bytes(1 << 24)) + warc.member(b"b")
    found = list(warc.members(three))
    assert [len(r) for _, _, r in found] == [9, 1 << 24, 1]
    assert all(gzip.decompress(three[o : o + n]) == r for o, n, r in found)
    with pytest.raises(ValueError):
        list(warc.members(three[:-3]))


def test_torn_archives_are_noticed():
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <u:1>\r\nContent-Length: 30\r\n\r\n"
    block = b"HTTP/1.1 200 OK\r\n\r\n" + b"0123456789a"
    assert len(block) == 30
    rows = list(warc.parse_records(io.BytesIO(head + block + b"\r\n\r\n"), payload=True))
    assert rows[0][5] == 11 and rows[0][7] == "0123456789a"
    for torn in (head + block[:20], head + block + b"\r\n", b"\r\n" + head):
        with pytest.raises(ValueError):
            list(warc.parse_records(io.BytesIO(torn)))
