"""Token alignment against a plain whole-text version."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from latelane.llm import token_alignment as ta
from latelane.llm.common import file_bytes
from latelane.llm.queries import BYTE_BPE, PIECES, op11_token_alignment

from tests.conftest import SMALL


@pytest.fixture(scope="module")
def vocabularies():
    return ta.Vocabularies(file_bytes(BYTE_BPE), file_bytes(PIECES))


def plain_groups(of, text):
    """Groups of a whole text by byte offsets, None without tokens."""
    if not text:
        return None
    raw = (" " + text).encode()
    a = of.a.encode(" " + text, add_special_tokens=False).ids
    b = of.b.encode(text)
    if b"".join(of.a_bytes[i] for i in a) != raw or b"".join(of.b_bytes[i] for i in b) != raw:
        return None
    ends_a = np.cumsum([len(of.a_bytes[i]) for i in a]).tolist()
    ends_b = np.cumsum([len(of.b_bytes[i]) for i in b]).tolist()
    cuts = sorted(set(ends_a) & set(ends_b))
    place_a, place_b = {e: i + 1 for i, e in enumerate(ends_a)}, {e: i + 1 for i, e in enumerate(ends_b)}
    groups, last_a, last_b = [], 0, 0
    for cut in cuts:
        groups.append((a[last_a : place_a[cut]], b[last_b : place_b[cut]]))
        last_a, last_b = place_a[cut], place_b[cut]
    return a, b, groups


def brute_force(of, rows):
    """The query's rows, sorted, from (doc_id, text)."""
    found = [(doc_id, plain_groups(of, text)) for doc_id, text in rows]
    counts = Counter((g[0][-1], g[1][-1]) for _, f in found if f for g in f[2])
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for doc_id, f in found:
        if f is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups = f
        links = [(x[-1], y[-1]) for x, y in groups]
        shown = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        is_best = sum(counts[link] == best[link[1]] for link in links)
        total = sum(counts[link] for link in links)
        digest = hashlib.sha256(shown.encode()).hexdigest()
        out.append((doc_id, len(a), len(b), len(groups), len(links), is_best, total, digest))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD_TEXTS = [
    "a", " ", "  ", "a ", " a", "a  ", "a  b", "a \n b", "\n", "a\n\n  b\t c", "it's  we'll 's", "x  y",
    "a\x1c b", "▁x y", "z ▁", "é́ ½ ﬁ", "日本語 テキスト 😀", "1234567 8 9.0", "<|endoftext|> <s> </s> <unk>",
    "a\x00b \x00", "　wide 　 ", "ab " * 500, "trailing   ", "\r\n a", "<0x41> A",
]


def test_vectors_of_fixed_length(vocabularies):
    assert len(vocabularies.a_bytes) == 50_257 and len(vocabularies.b_bytes) == 32_000
    assert vocabularies.separable
    named = np.flatnonzero(vocabularies.identity >= 0)
    assert len(named) > 5_000
    for a in named[:: len(named) // 500]:
        assert vocabularies.a_bytes[a] == vocabularies.b_bytes[vocabularies.identity[a]]
    # A byte that is a piece too is mapped to the piece.
    a = vocabularies.a_bytes.index(b"A")  # byte tokens come first
    assert vocabularies.b.id_to_piece(int(vocabularies.identity[a])) == "A"


def test_token_bytes_are_the_libraries(vocabularies):
    own = Tokenizer.from_file(BYTE_BPE)
    text = "Größe, 日本 and\tmore"
    ids = own.encode(text, add_special_tokens=False).ids
    assert b"".join(vocabularies.a_bytes[i] for i in ids).decode() == text
    pieces = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    assert b"".join(vocabularies.b_bytes[i] for i in pieces.encode(text)).decode() == " " + text


def shown(groups):
    return ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups).encode()


def in_blocks(of, text, size, monkeypatch):
    """(tokens of A, of B, groups, string, exact links, pairs) of a text cut into blocks."""
    monkeypatch.setattr(ta, "BLOCK_CHARS", size)
    found = ta.grouped(of, text)
    if found is None:
        return None
    exact = Counter((int(i), int(of.identity[i])) for g in found for i in g.exact)
    pairs = Counter((int(p) >> 32, int(p) & 0xFFFFFFFF) for g in found for p in g.pairs)
    counts = (sum(g.n_a for g in found), sum(g.n_b for g in found), sum(g.n_groups for g in found))
    return *counts, b"".join(g.text() for g in found)[:-1], exact, pairs


@pytest.mark.parametrize("size", [1, 5, 1 << 18])
@pytest.mark.parametrize("text", ODD_TEXTS)
def test_blocks_join_to_the_whole_text(vocabularies, monkeypatch, text, size):
    whole = plain_groups(vocabularies, text)
    found = in_blocks(vocabularies, text, size, monkeypatch)
    if whole is None:
        assert found is None
        return
    a, b, groups = whole
    assert found[:4] == (len(a), len(b), len(groups), shown(groups))
    assert not found[4].keys() & found[5].keys()
    assert found[4] + found[5] == Counter((x[-1], y[-1]) for x, y in groups)


def test_blocks_of_random_texts(vocabularies, monkeypatch):
    rng = np.random.default_rng(5)
    signs = np.array(list("ab c  \n\t'é1.日▁-") + ["the ", " and", "  ", "'s"])
    for i in range(400):
        text = "".join(rng.choice(signs, rng.integers(1, 30)))
        whole, found = plain_groups(vocabularies, text), in_blocks(vocabularies, text, 1 + i % 7, monkeypatch)
        assert (whole is None) == (found is None), repr(text)
        if found:
            assert found[3] == shown(whole[2]), repr(text)


@pytest.mark.parametrize("text", ["x" * 9000, " " * 9000, "\n" * 5000 + "a", "ab" * 3000 + " c " + "é" * 4000])
def test_long_runs(vocabularies, monkeypatch, text):
    whole = plain_groups(vocabularies, text)
    assert in_blocks(vocabularies, text, 100, monkeypatch)[3] == shown(whole[2])


def test_pair_totals_are_sums():
    totals, expected = ta.PairTotals(), Counter()
    rng = np.random.default_rng(3)
    for i in range(50):
        pairs, times = rng.integers(0, 40, 30), rng.integers(1, 5, 30)
        totals.add(pairs, times)
        for p, n in zip(pairs.tolist(), times.tolist()):
            expected[p] += n
        if i % 7 == 0:
            totals.sums()
    pairs, times = totals.sums()
    assert dict(zip(pairs.tolist(), times.tolist())) == expected


def test_query_equals_brute_force(spark, vocabularies):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    found = op11_token_alignment(spark, SMALL)
    assert found.columns == COLUMNS
    assert sorted(map(tuple, found.collect()), key=repr) == brute_force(vocabularies, rows)


def test_odd_rows(spark, odd, nothing, vocabularies):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    found = ta.aligned(odd, BYTE_BPE, PIECES)
    assert sorted(map(tuple, found.collect()), key=repr) == brute_force(vocabularies, rows)
    assert ta.aligned(nothing, BYTE_BPE, PIECES).collect() == []


def test_odd_texts_together(spark, vocabularies):
    rows = [(f"k{i}", t) for i, t in enumerate(ODD_TEXTS * 3)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    found = ta.aligned(docs, BYTE_BPE, PIECES)
    assert sorted(map(tuple, found.collect()), key=repr) == brute_force(vocabularies, rows)


def test_totals_may_leave_early(spark, vocabularies, monkeypatch):
    docs = spark.createDataFrame([(i, f"über {i} Größen, naïve {i * 7}") for i in range(50)], "doc_id bigint, text string")
    monkeypatch.setattr(ta, "PAIRS_HELD", 3)
    rows = ta.alignments(docs, BYTE_BPE, PIECES, groups=True).collect()
    assert all(r["groups"] is None for r in rows if r["is_total"])
    shown = {r["doc_id"]: r["groups"] for r in rows if not r["is_total"]}
    assert all(hashlib.sha256(shown[r["doc_id"]].encode()).hexdigest() == r["groups_sha256"] for r in rows if not r["is_total"])
    exact, pairs = Counter(), Counter()
    for r in rows:
        sign = 1 if r["is_total"] else -1
        for i, n in zip(r["exact"], r["exact_n"]):
            exact[i] += sign * n
        for i, n in zip(r["pairs"], r["pairs_n"]):
            pairs[i] += sign * n
    assert not any(exact.values()) and not any(pairs.values())
