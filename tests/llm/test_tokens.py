"""BPE, unigram counts and packing against the tokenizers library."""

import hashlib
import random
import zlib
from array import array
from collections import defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from latelane.llm import bpe, packing, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = bpe.encoder(open(PATH, "rb").read())


def ids_of(text):
    return bpe.unpacked(b"".join(ENCODER.blocks(text)))


def library_ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def decoded(ids):
    machine = bpe.Decoder(ENCODER.vocabulary)
    return "".join(machine.feed([i]) for i in ids) + machine.finish()


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from(list("abeéß日😀 \n\t\r'slt1!-= \x85\x1c")), max_size=60))
def test_ids_and_text_are_the_librarys(text):
    ids = library_ids(text)
    assert ids_of(text) == ids
    assert decoded(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize(
    "text",
    [
        "x" * 50_000, " " * 40_000 + "y", "!" * 30_000 + "'ll go", "ÃÂ" * 9000, "the" * 7000,
        "a\n" * 40_000, "it's " * 30_000, "a<|endoftext|>b <|endof", "  lead and trail  ",
    ],
)
def test_long_and_odd_texts(text):
    assert ids_of(text) == library_ids(text)


def test_window_edges_do_not_matter():
    rng = random.Random(5)
    for _ in range(20):
        text = "".join(rng.choice(["ab", " ", "'ll", "\n", "9", "é", "??"]) for _ in range(60_000))
        text = text[: bpe.WINDOW + rng.randrange(-5, 6)]
        assert ids_of(text) == library_ids(text)


def test_stable_tokens_leave_before_the_end():
    rng = random.Random(7)
    word = "".join(rng.choice("etaoinshrdlu") for _ in range(20_000))
    machine = bpe.Transducer(ENCODER.vocabulary)
    out, most = [], 0
    for i in range(0, len(word), 100):
        out += machine.feed(word[i : i + 100].encode())
        most = max(most, len(machine.buffer))
    out += machine.finish()
    assert out == library_ids(word)
    assert most <= ENCODER.vocabulary.lookahead + 2 * bpe.BLOCK


def test_lookahead_covers_every_change():
    rng = random.Random(11)
    merged, length = ENCODER.vocabulary.merged, ENCODER.vocabulary.bytes_of
    for _ in range(300):
        text = "".join(rng.choice("eshinga-=") for _ in range(rng.randrange(2, 60))).encode()
        short, whole = merged(text), merged(text + b"ingly=====")
        same, end = 0, 0
        while same < len(short) and short[same] == whole[same]:
            end += len(length[short[same]])
            same += 1
        assert len(text) - end <= ENCODER.vocabulary.lookahead


def test_lookahead_of_small_lists():
    # ab, then c + ab: a change of the last byte reaches back over c.
    assert bpe.lookahead([(0, 1, 3), (2, 3, 4)], {0: 1, 1: 1, 2: 1, 3: 2, 4: 3}) == 2
    assert bpe.lookahead([], {}) == 0


def test_bytes_that_are_no_text_decode_as_the_library_does():
    rng = random.Random(3)
    singles = ENCODER.vocabulary.byte_id
    for _ in range(300):
        ids = [singles[rng.choice([0x41, 0x80, 0xC3, 0xE2, 0x82, 0xF0, 0x9F, 0xFF])] for _ in range(8)]
        assert decoded(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_encode_decode_and_digests(odd, nothing):
    encoded = bpe.encode(odd, PATH)
    texts = sorted((r["text"] or "") for r in odd.collect())
    assert sorted(r["text"] for r in bpe.decode(encoded, PATH).collect()) == texts
    rows = sorted(tuple(r) for r in bpe.round_trip_digests(odd.where("doc_id is not null"), PATH).collect())
    expected = []
    for r in odd.where("doc_id is not null").collect():
        ids = library_ids(r["text"] or "")
        digest = hashlib.sha256(array("I", ids).tobytes()).hexdigest()
        expected.append((r["doc_id"], len(ids), digest, hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert rows == sorted(expected)
    assert bpe.round_trip_digests(nothing, PATH).count() == 0


def unigram_library(unigram):
    low = min(s for _, s in unigram.pieces)
    pieces = [("<unk>", low), *unigram.pieces]
    if unigram.byte_fallback:
        pieces += [(f"<0x{b:02X}>", low) for b in range(256)]
    library = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=unigram.byte_fallback))
    library.pre_tokenizer = pre_tokenizers.Metaspace()
    return library


def test_counts_with_ties_and_unknown_characters():
    rng = random.Random(2)
    for _ in range(200):
        names = {rng.choice("abc▁é") for _ in range(rng.randrange(1, 5))}
        names |= {"".join(rng.choice("abc▁é") for _ in range(rng.randrange(1, 5))) for _ in range(9)}
        scored = tuple((n, -float(rng.randrange(1, 4))) for n in sorted(names))
        unigram = token_counts.Unigram(scored, rng.random() < 0.5)
        library, counter = unigram_library(unigram), token_counts.Counter(unigram)
        for _ in range(20):
            text = "".join(rng.choice("abcé xü▁") for _ in range(rng.randrange(25)))
            assert counter.of_text(text) == len(library.encode(text, add_special_tokens=False).ids), text


def test_counts_of_documents(odd, nothing):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = unigram_library(token_counts.vocabulary(open(path, "rb").read()))
    found = sorted(r["n_tokens"] for r in token_counts.token_counts(odd, path).collect())
    texts = [r["text"] or "" for r in odd.collect()]
    assert found == sorted(len(library.encode(t, add_special_tokens=False).ids) for t in texts)
    assert token_counts.token_counts(nothing, path).count() == 0


def check_packing(rows, texts, capacity):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for doc_id, text in texts.items():
        ids = library_ids(text or "") + [packing.END_ID]
        at = 0
        for r in sorted(by_doc.pop(doc_id), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            part = array("I", ids[at : at + r["length"]])
            assert r["ids_crc32"] == zlib.crc32(part.tobytes())
            at += r["length"]
        assert at == len(ids)
    assert not by_doc
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return sum(r["length"] for r in rows) / (capacity * max(1, len(by_sequence)))


def test_packing_keeps_every_id(odd, nothing):
    known = odd.dropDuplicates(["doc_id"])
    texts = {r["doc_id"]: r["text"] for r in known.collect()}
    rows = packing.packed_documents(known, PATH).collect()
    assert check_packing(rows, texts, packing.CAPACITY) > 0.9
    repeated = packing.packed_documents(odd, PATH).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in repeated}) == len(repeated)
    assert packing.packed_documents(nothing, PATH).count() == 0


def test_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert check_packing(packing.packed_documents(docs, PATH).collect(), texts, packing.CAPACITY) > 0.97


def test_little_padding_of_many_short_texts(spark):
    texts = {i: "a b c d e f g h" if i % 3 else None for i in range(20_000)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert check_packing(packing.packed_documents(docs, PATH).collect(), texts, packing.CAPACITY) > 0.95


def test_packed_sequences_hold_the_ids(odd, tmp_path):
    pieces = packing.cut_pieces(odd.where("doc_id in (1, 9, 14)"), PATH, ids=True)
    pieces.write.parquet(str(tmp_path / "pieces"))
    packed = packing.pack(odd.sparkSession.read.parquet(str(tmp_path / "pieces")))
    whole = packing.sequences(packed)
    assert all(len(r["ids"]) == r["n_tokens"] <= packing.CAPACITY for r in whole.collect())
    expected = sum(len(library_ids(r["text"])) + 1 for r in odd.where("doc_id in (1, 9, 14)").collect())
    assert sum(r["n_tokens"] for r in whole.collect()) == expected


@pytest.mark.parametrize("length, each", [(341, 6), (409, 5), (682, 3), (256, 8), (1025, 1)])
def test_a_hot_length_is_packed_exactly(length, each):
    patterns = packing.plan_patterns({length: 9000}, 2048)
    assert sum(p.times for p in patterns) == -(-9000 // each)


def test_hot_lengths_among_others_are_packed_within_a_hundredth():
    rng = random.Random(3)
    for lengths in (
        [rng.randrange(130, 255) for _ in range(9000)],
        [682] * 3000 + [rng.randrange(1, 2048) for _ in range(6000)],
        [1] * 3000 + [int(2048 * rng.random() ** 3) + 1 for _ in range(6000)],
    ):
        demand = {n: lengths.count(n) for n in set(lengths)}
        patterns = packing.plan_patterns(demand, 2048)
        assert sum(p.times for p in patterns) <= 1.01 * sum(lengths) / 2048 + 1


def test_a_hot_length_of_documents_leaves_little_padding(spark):
    text = " a" * 681  # 682 tokens with the end id
    assert len(library_ids(text)) == 681
    texts = {i: text for i in range(900)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    rows = packing.packed_documents(docs, PATH).collect()
    assert check_packing(rows, texts, packing.CAPACITY) > 0.99


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(0, 200), max_size=12))
def test_patterns_hold_the_demand_exactly(demand):
    patterns = packing.plan_patterns(demand, 40)
    held = defaultdict(int)
    for p in patterns:
        assert sum(s * n for s, n in p.counts.items()) <= 40
        for s, n in p.counts.items():
            held[s] += n * p.times
    assert held == {s: n for s, n in demand.items() if n}
    least = -(-sum(s * n for s, n in demand.items()) // 40)
    used = sum(p.times for p in patterns)
    assert used <= sum(demand.values()) and used >= least


def test_linear_program_finds_the_known_optimum():
    # Three fit as 20 + 13 + 7; first-fit by size alone would need more sequences.
    patterns = packing.plan_patterns({20: 100, 13: 100, 7: 100}, 40)
    assert sum(p.times for p in patterns) == 100
