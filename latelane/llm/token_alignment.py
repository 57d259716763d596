"""Alignment of two tokenizers' tokens over a corpus, with an identity map as the fast path.

Tokenizer A is a byte-level BPE file, B a sentencepiece file with byte fallback; both encode
the text with a space in front. Byte offsets where tokens of both end cut the tokens into
groups; the last tokens of a group are linked. ``identity_map`` holds, per A id, the B id of
the same bytes. A group of one token on either side that the map names is exact: such links
are counted in a vector with a place per A id. Only the links of other groups are pairs, which
go through a shuffle.

Long texts are aligned in blocks. A block ends before a space that follows a visible
character: neither tokenizer has a token across such a place (for B the pieces are checked,
otherwise a text is one block), so memory is bounded by the block, or by the longest run
without such a place.

The first pass writes a row per document (digest, distinct exact A ids and pairs with how
often they occur) and rows of each task's totals. Totals are summed to the vector and the
pair table; the highest count per B id follows from both. The second pass reads the rows of
the first: exact links by look-up in the vector, pairs by a join on the pair, which adaptive
execution splits where a pair is hot. Driver and broadcasts hold vectors of the vocabularies'
lengths only.

Null and empty texts, and texts whose joined token bytes of A or B differ from the text with
its space, have no tokens: zeros and the empty string. Special tokens' strings are ordinary
text. Repeated rows, and rows without an id, are aligned and counted one by one; ties for the
highest count are all highest; only doc_id and text are read; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from latelane.llm import bpe
from latelane.llm.common import file_bytes, map_rows, with_package, written

BLOCK_CHARS = 1 << 18  # a block's length, about
PAIRS_HELD = 500_000  # pairs a task holds before it sums them, and sums before it passes them on
LONG_RUN = 2_000  # characters of one kind from which on the rank-merging library is too slow
_CUT = re.compile(r"(?<=\S) (?!\Z)")
_MARK = "\u2581"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>\Z")
_B_BITS = 32


class Vocabularies:
    """Both tokenizers and their tokens' bytes."""

    def __init__(self, a: bytes, b: bytes):
        vocabulary = bpe.Vocabulary(a)
        self.a = Tokenizer.from_str(a.decode())
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        plain = {i: t for i, t in vocabulary.bytes_of.items() if i not in vocabulary.special.values()}
        self.a_bytes = [plain.get(i, b"") for i in range(self.a.get_vocab_size(with_added_tokens=True))]
        # Merging by rank is exact, and faster, where ids follow the merge order.
        order = [new for _, _, new in vocabulary.rules]
        self.ranked = None
        if order == sorted(set(order)) and len(set(plain.values())) == len(plain):
            ranks = {t: i for i, t in plain.items()}
            self.ranked = tiktoken.Encoding("a", pat_str=bpe.PIECES, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [self._piece_bytes(i, p) for i, p in enumerate(pieces)]
        # No piece goes on over a space after something else: blocks are independent.
        self.separable = not any(re.search(f"[^{_MARK}]{_MARK}", p) for p in pieces)
        self.identity = identity_map(self.a_bytes, self.b_bytes, [self.b.is_byte(i) for i in range(len(pieces))])
        self.a_sizes = np.array([len(t) for t in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(t) for t in self.b_bytes], np.int64)
        self.digits = _digits(max(len(self.a_bytes), len(self.b_bytes)))

    def _piece_bytes(self, i: int, piece: str) -> bytes:
        if self.b.is_unknown(i) or self.b.is_control(i):
            return b""
        if self.b.is_byte(i):
            return bytes.fromhex(_BYTE.match(piece).group(1))
        return piece.replace(_MARK, " ").encode()

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """A ids and B ids of a text with a space in front; None where the joined bytes of
        either are not the text's."""
        spaced = " " + text
        raw = spaced.encode()
        if self.ranked is None or _long_run(text):
            a = self.a.encode(spaced, add_special_tokens=False).ids
        else:
            a = self.ranked.encode_ordinary(spaced)
        if b"".join(map(self.a_bytes.__getitem__, a)) != raw:
            return None
        b = self.b.encode(text)
        if b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)


def _long_run(text: str) -> bool:
    words = text.split()
    spaces = len(text) - sum(map(len, words))
    return max(map(len, words), default=0) > LONG_RUN or spaces > len(words) + LONG_RUN


def identity_map(a_bytes: list[bytes], b_bytes: list[bytes], b_is_byte: list[bool]) -> np.ndarray:
    """Per A id the B id of the same bytes, -1 without one; whole pieces before byte pieces."""
    of: dict[bytes, int] = {}
    for i in sorted(range(len(b_bytes)), key=lambda i: (b_is_byte[i], i)):
        if b_bytes[i]:
            of.setdefault(b_bytes[i], i)
    return np.array([of.get(t, -1) if t else -1 for t in a_bytes], np.int64)


def _digits(size: int) -> np.ndarray:
    """The decimal digits of the numbers below ``size``, zero bytes in front, a place behind."""
    width = len(str(size))
    rows = [str(i).encode().rjust(width, b"\0") + b"\0" for i in range(size)]
    return np.frombuffer(b"".join(rows), np.uint8).reshape(size, width + 1)


class Groups:
    """The groups of a text's tokens: how many, their links, and their string."""

    def __init__(self, of: Vocabularies, a: np.ndarray, b: np.ndarray):
        ends_a, ends_b = np.cumsum(of.a_sizes[a]), np.cumsum(of.b_sizes[b])
        marked = np.zeros(int(ends_a[-1]) + 1, np.int8)
        marked[ends_a] = 1
        self.cut_b = marked[ends_b] == 1
        marked[:] = 0
        marked[ends_b] = 1
        self.cut_a = marked[ends_a] == 1
        self.of, self.a, self.b = of, a, b
        self.last_a, self.last_b = np.flatnonzero(self.cut_a), np.flatnonzero(self.cut_b)
        self.n_a, self.n_b, self.n_groups = len(a), len(b), len(self.last_a)
        linked_a, linked_b = a[self.last_a], b[self.last_b]
        alone = (np.diff(self.last_a, prepend=-1) == 1) & (np.diff(self.last_b, prepend=-1) == 1)
        exact = alone & (of.identity[linked_a] == linked_b)
        self.exact = linked_a[exact]
        self.pairs = linked_a[~exact] << _B_BITS | linked_b[~exact]

    def text(self) -> bytes:
        """``a1,a2|b1;a3|b2;``: a comma or the end of its side behind each id."""
        digits = self.of.digits
        group_a = np.cumsum(self.cut_a) - self.cut_a
        group_b = np.cumsum(self.cut_b) - self.cut_b
        # A token stands behind all groups before its own, B's behind A's of the same group.
        before = np.concatenate([[0], self.last_b[:-1] + 1])
        at_a = np.arange(self.n_a) + before[group_a]
        at_b = np.arange(self.n_b) + (self.last_a + 1)[group_b]
        cells = np.empty((self.n_a + self.n_b, digits.shape[1]), np.uint8)
        cells[at_a], cells[at_b] = digits[self.a], digits[self.b]
        cells[:, -1] = ord(",")
        cells[at_a[self.last_a], -1] = ord("|")
        cells[at_b[self.last_b], -1] = ord(";")
        flat = cells.ravel()
        return flat[flat != 0].tobytes()


def blocks(text: str, size: int) -> Iterator[str]:
    """A text in parts of ``size`` characters or some more, each without the space in front.

    A lone space at the end of the text has no block of its own: B would add its space to nothing.
    """
    start = 0
    while len(text) - start > size:
        cut = _CUT.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.end()
    yield text[start:]


def grouped(of: Vocabularies, text: str) -> list[Groups] | None:
    """The groups of a text, block by block; None where it has no tokens."""
    size = BLOCK_CHARS if of.separable else len(text)
    encoded = [of.encode(part) for part in blocks(text, size)]
    if any(e is None for e in encoded):
        return None
    return [Groups(of, a, b) for a, b in encoded]


def _summed(values: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, in order, and how often each occurs."""
    if times is None:
        return np.unique(values, return_counts=True)
    distinct, inverse = np.unique(values, return_inverse=True)
    sums = np.zeros(len(distinct), np.int64)
    np.add.at(sums, inverse, times)
    return distinct, sums


class PairTotals:
    """Sums of pairs, in arrays of bounded length."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, pairs: np.ndarray, times: np.ndarray) -> None:
        self.parts.append((pairs, times))
        self.held += len(pairs)

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        values, times = zip(*self.parts) if self.parts else ([np.zeros(0, np.int64)],) * 2
        summed = _summed(np.concatenate(values), np.concatenate(times))
        self.parts, self.held = [summed], len(summed[0])
        return summed


_loaded: dict[bytes, Vocabularies] = {}


def _vocabularies(a: bytes, b: bytes) -> Vocabularies:
    """The process's tokenizers for two files, kept between tasks."""
    key = hashlib.sha256(a).digest() + hashlib.sha256(b).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabularies(a, b)
    return _loaded[key]


LINKS = "exact array<int>, exact_n array<bigint>, pairs array<bigint>, pairs_n array<bigint>"


def alignments(docs: DataFrame, path_a: str, path_b: str, groups: bool = False) -> DataFrame:
    """A row per document (``is_total`` false): doc_id, n_a, n_b, n_groups, n_links,
    groups_sha256, its links, and ``groups`` themselves if asked for; and rows of totals of
    the links (``is_total`` true), whose other columns are null."""
    spark = docs.sparkSession.sparkContext
    shared = spark.broadcast((file_bytes(path_a), file_bytes(path_b)))  # the files' fixed size

    def make():
        of = _vocabularies(*shared.value)
        exact_totals = np.zeros(len(of.a_bytes), np.int64)  # a place per A id
        pair_totals = PairTotals()

        def totals():
            ids = np.flatnonzero(exact_totals)
            pairs, times = pair_totals.sums()
            row = (ids.tolist(), exact_totals[ids].tolist(), pairs.tolist(), times.tolist())
            exact_totals[:] = 0
            pair_totals.__init__()
            yield (True, None, None, None, None, None, None, *row, *[None] * groups)

        def each(doc_id, text):
            found = grouped(of, text) if text else None
            if found is None:
                yield (False, doc_id, 0, 0, 0, 0, "", [], [], [], [], *[""] * groups)
                return
            exact, exact_n = _summed(np.concatenate([g.exact for g in found]))
            pairs, pairs_n = _summed(np.concatenate([g.pairs for g in found]))
            exact_totals[exact] += exact_n
            pair_totals.add(pairs, pairs_n)
            digest, shown = hashlib.sha256(), []
            for i, g in enumerate(found, 1):
                part = g.text() if i < len(found) else g.text()[:-1]
                digest.update(part)
                if groups:
                    shown.append(part)
            n_groups = sum(g.n_groups for g in found)
            counts = (sum(g.n_a for g in found), sum(g.n_b for g in found), n_groups, n_groups)
            links = (exact.tolist(), exact_n.tolist(), pairs.tolist(), pairs_n.tolist())
            strings = [b"".join(shown).decode()] * groups
            yield (False, doc_id, *counts, digest.hexdigest(), *links, *strings)
            if pair_totals.held >= 2 * PAIRS_HELD and len(pair_totals.sums()[0]) >= PAIRS_HELD:
                yield from totals()

        each.end = totals
        return each

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"is_total boolean, doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint"
    schema += f", groups_sha256 string, {LINKS}" + ", groups string" * groups
    size = lambda r: 16 * (len(r[7]) + len(r[9])) + (len(r[-1] or "") if groups else 0)
    return map_rows(docs.select("doc_id", "text"), schema, make, size=size)


def link_counts(rows: DataFrame, path_a: str, path_b: str) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """From ``alignments``: per A id how often its exact link occurs and whether that is the
    highest count of its B id, and (pair, n, best) of all other pairs."""
    of = Vocabularies(file_bytes(path_a), file_bytes(path_b))
    totals = rows.where("is_total")
    exact = totals.select(F.inline(F.arrays_zip(F.col("exact").alias("a"), F.col("exact_n").alias("n"))))
    vector, best = np.zeros(len(of.a_bytes), np.int64), np.zeros(len(of.b_bytes), np.int64)
    for r in exact.groupBy("a").agg(F.sum("n").alias("n")).collect():  # at most a row per A id
        vector[r["a"]] = r["n"]
    pairs = totals.select(F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("pairs_n").alias("n"))))
    pairs = written(pairs.groupBy("pair").agg(F.sum("n").alias("n")), "pair_counts")
    b = F.col("pair").bitwiseAND((1 << _B_BITS) - 1).cast("int")
    for r in pairs.groupBy(b.alias("b")).agg(F.max("n").alias("n")).collect():  # a row per B id
        best[r["b"]] = r["n"]
    known = of.identity >= 0
    np.maximum.at(best, of.identity[known], vector[known])
    exact_best = np.zeros(len(vector), bool)
    exact_best[known] = vector[known] == best[of.identity[known]]
    highest = F.broadcast(_highest(rows, best))  # at most a row per B id
    is_best = (F.col("n") == F.col("highest")).alias("best")
    return vector, exact_best, written(pairs.join(highest, b == F.col("b")).select("pair", "n", is_best), "judged_pairs")


def _highest(rows: DataFrame, best: np.ndarray) -> DataFrame:
    """(b, highest) of the B ids that a link has; at most the vocabulary's length."""
    found = [(int(i), int(best[i])) for i in np.flatnonzero(best)]
    return rows.sparkSession.createDataFrame(found, "b int, highest bigint")


def _exact_sums(rows: DataFrame, vector: np.ndarray, best: np.ndarray) -> DataFrame:
    """``rows`` with ``sum`` and ``n_best`` of the exact links in place of their columns."""
    shared = rows.sparkSession.sparkContext.broadcast((vector, best.astype(np.int64)))  # a place per A id
    kept = [c for c in rows.columns if c not in ("exact", "exact_n")]
    schema = rows.select(*kept).schema.add("sum", "long").add("n_best", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, highest = shared.value
        for batch in batches:
            ids, n = batch.column("exact"), batch.column("exact_n")
            of = np.repeat(np.arange(len(ids)), ids.value_lengths().to_numpy(zero_copy_only=False))
            a, times = ids.flatten().to_numpy(), n.flatten().to_numpy()
            sums, n_best = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            np.add.at(sums, of, counts[a] * times)
            np.add.at(n_best, of, highest[a] * times)
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sums), pa.array(n_best)], names=schema.names)

    return with_package(rows).mapInArrow(run, schema)


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row."""
    rows = written(alignments(docs, path_a, path_b), "alignments")
    vector, best, pairs = link_counts(rows, path_a, path_b)
    own = rows.where("not is_total").drop("is_total").withColumn("row", F.monotonically_increasing_id())
    own = written(_exact_sums(own, vector, best), "exact_sums")
    links = F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("pairs_n").alias("times")))
    found = own.select("row", links).join(pairs, "pair").groupBy("row").agg(
        F.sum(F.col("times") * F.col("n")).alias("pair_sum"),
        F.sum(F.when(F.col("best"), F.col("times"))).alias("pair_best"),
    )
    none = F.lit(0).cast("bigint")
    return own.join(found, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        (F.col("n_best") + F.coalesce("pair_best", none)).alias("n_best"),
        (F.col("sum") + F.coalesce("pair_sum", none)).alias("count_sum"),
        "groups_sha256",
    )
