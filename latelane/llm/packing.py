"""Packing token sequences by cutting-stock column generation.

A document's ids (with an end id) are cut into blocks of the capacity and a rest. The
histogram of rest lengths, one class per length, is the demand of a cutting-stock problem: a
pattern says how many pieces of each length fill one sequence. The linear program over
patterns starts from the basis that first-fit by decreasing length gives when patterns may be
used a fraction of times; a knapsack dynamic program over the lengths' dual prices finds the
next patterns. Prices are smoothed towards those of the best lower bound, and the program
ends within ``GAP`` of that bound, or when patterns improve it too little (``PATIENCE``). Patterns are used their
rounded-down number of times, what remains is packed first-fit by decreasing length. The
driver handles lengths and patterns only, whose numbers the capacity bounds; pieces are
ranked within their length and the rank says sequence and place.

Ranks come from counts per length and hash bucket, so a length that a third of all pieces
share is ranked by many tasks.

A null or empty text is the end id alone; a null doc_id is kept as it is; repeated rows are
packed one by one; an empty table gives no pieces. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import tiktoken
from pyspark.sql import DataFrame, Window, functions as F

from latelane.llm import bpe
from latelane.llm.common import file_bytes, map_rows, written

CAPACITY = 2048
END_ID = 1
GAP = 5e-4  # share of sequences by which the linear program may miss its lower bound
ROUNDS = 400  # prices the linear program may try; it is feasible at every step
PATIENCE = 50  # rounds in which it must save ``GAP`` of its sequences to go on
OFFERS = 64  # patterns tried for each
SMOOTHING = 0.7  # weight of the best bound's prices
BUCKET_PIECES = 16_384
LEAST_BUCKETS = 64
LONG_TEXT, LONG_RUN = 20_000, 2_000

PIECE = "doc_id {}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


class _Tokens:
    """A text's ids; the rank-merging library is exact where ids follow the merge order."""

    def __init__(self, content: bytes):
        self.own = bpe.encoder(content)
        vocabulary = self.own.vocabulary
        order = [new for _, _, new in vocabulary.rules]
        special = vocabulary.special
        ranks = {b: i for i, b in vocabulary.bytes_of.items() if i not in special.values()}
        self.library = None
        if order == sorted(set(order)) and len(ranks) + len(special) == len(vocabulary.bytes_of):
            self.library = tiktoken.Encoding(
                "vocabulary", pat_str=bpe.PIECES, mergeable_ranks=ranks, special_tokens=special
            )

    def ids(self, text: str) -> array:
        if self.library is None or (len(text) > LONG_TEXT and _long_run(text)):
            # Long runs without a break take the library time in the square of their length.
            return array("I", bpe.unpacked(b"".join(self.own.blocks(text))))
        return array("I", self.library.encode(text, allowed_special="all"))


def _long_run(text: str) -> bool:
    words = text.split()
    longest = max(map(len, words), default=0)
    return longest > LONG_RUN or len(text) - sum(map(len, words)) > len(words) + LONG_RUN


_tokens: dict[bytes, _Tokens] = {}


def _tokens_of(content: bytes) -> _Tokens:
    if content not in _tokens:
        _tokens.clear()
        _tokens[content] = _Tokens(content)
    return _tokens[content]


def cut_pieces(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False
) -> DataFrame:
    """Blocks of ``capacity`` ids and the rest of every document, with a CRC-32 of the ids
    as little-endian 32-bit integers, and the ids themselves if asked for."""
    content = docs.sparkSession.sparkContext.broadcast(file_bytes(path))  # the file's fixed size

    def make():
        tokens = _tokens_of(content.value)

        def each(doc_id, text):
            found = tokens.ids(text or "")
            found.append(end_id)
            view = memoryview(found).cast("B")
            for start in range(0, len(found), capacity):
                part = view[4 * start : 4 * (start + capacity)]
                row = (doc_id, start, len(part) // 4, zlib.crc32(part), len(found))
                yield (*row, found[start : start + capacity].tolist()) if ids else row

        return each

    schema = PIECE.format(docs.schema["doc_id"].dataType.simpleString())
    rows = docs.select("doc_id", "text")
    return map_rows(rows, schema + ", ids array<int>" * ids, make, size=lambda r: 4 * r[2] * ids)


# The plan, on the driver: lengths and patterns only


@dataclass
class Pattern:
    """How often each length occurs in a sequence, and how many such sequences."""

    counts: dict[int, int]
    times: int


def _priced(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, list[np.ndarray]]:
    """Unbounded knapsack: the highest price of a pattern, and for the lengths with the
    dearest ones the best pattern that holds the length, dearest first."""
    best = np.zeros(capacity + 1)
    taken = np.full(capacity + 1, -1)
    paying = np.flatnonzero(prices > 1e-12)
    sizes_paying, prices_paying = sizes[paying], prices[paying]
    fitting = np.searchsorted(sizes_paying, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if n := fitting[room]:
            values = best[room - sizes_paying[:n]] + prices_paying[:n]
            k = int(values.argmax())
            if values[k] > best[room] + 1e-12:
                best[room], taken[room] = values[k], k

    def holding(first: int) -> np.ndarray:
        counts = np.zeros(len(sizes))
        counts[first] = 1
        room = capacity - sizes[first]
        while room > 0:
            if taken[room] < 0:
                room -= 1
            else:
                k = paying[taken[room]]
                counts[k] += 1
                room -= sizes[k]
        return counts

    dearest = np.argsort(-(prices_paying + best[capacity - sizes_paying]), kind="stable")
    return best[-1], [holding(k) for k in paying[dearest[:OFFERS]]]


def _fractional_first_fit(sizes: np.ndarray, demand: np.ndarray, capacity: int):
    """A basis of patterns and how often each is used.

    Each pattern is used until one of its lengths runs out, which no later pattern holds, so
    with lengths in that order the matrix is triangular.
    """
    left = demand.copy()
    lengths = list(range(len(sizes)))[::-1]
    columns, used = np.zeros((len(sizes), len(sizes))), np.zeros(len(sizes))
    for i in range(len(sizes)):
        room, held = capacity, []
        for k in lengths:
            if n := room // sizes[k]:
                columns[k, i] = n
                held.append(k)
                room -= n * sizes[k]
            if room < sizes[lengths[-1]]:
                break
        uses = left[held] / columns[held, i]
        out = held[int(uses.argmin())]
        used[i] = uses.min()
        left[held] = np.maximum(left[held] - used[i] * columns[held, i], 0)
        lengths.remove(out)
    return columns, used


def _linear_program(sizes: np.ndarray, demand: np.ndarray, capacity: int):
    """Columns (patterns) and how often each is used, fractions allowed."""
    columns, used = _fractional_first_fit(sizes, demand, capacity)
    centre = sizes / capacity  # no pattern costs more than 1: a bound from the room alone
    bound = centre @ demand
    if used.sum() <= bound * (1 + GAP):
        return columns, used
    inverse = np.linalg.inv(columns)
    prices = inverse.sum(axis=0)
    weight = SMOOTHING
    for turn in range(ROUNDS):
        if turn % PATIENCE == 0:
            if turn and used.sum() > before * (1 - GAP):
                break
            before = used.sum()
        smoothed = weight * centre + (1 - weight) * prices
        dearest, patterns = _priced(sizes, smoothed, capacity)
        if smoothed @ demand > bound * dearest:
            bound, centre = smoothed @ demand / dearest, smoothed / dearest
        entered = False
        for pattern in patterns:
            gain = prices @ pattern - 1
            if gain <= 1e-9:
                continue
            held = np.flatnonzero(pattern)
            direction = inverse[:, held] @ pattern[held]
            rising = np.flatnonzero(direction > 1e-9)
            if not len(rising):
                continue
            ratios = used[rising] / direction[rising]
            leave = rising[int(ratios.argmin())]
            step = used[leave] / direction[leave]
            used -= step * direction
            used[leave] = step
            np.maximum(used, 0, out=used)
            columns[:, leave] = pattern
            inverse[leave] /= direction[leave]
            prices = prices - gain * inverse[leave]
            direction[leave] = 0
            rows, cells = np.flatnonzero(direction), np.flatnonzero(inverse[leave])
            inverse[np.ix_(rows, cells)] -= np.outer(direction[rows], inverse[leave, cells])
            entered = True
        if used.sum() <= bound * (1 + GAP) or not (entered or weight):
            break
        weight = SMOOTHING if entered else 0.0
    return columns, used


def plan_patterns(demand: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that together hold exactly ``demand`` (length to pieces)."""
    left = {s: n for s, n in sorted(demand.items()) if n}
    patterns = [Pattern({capacity: 1}, left.pop(capacity))] if capacity in left else []
    if left:
        sizes = np.array(list(left))
        columns, used = _linear_program(sizes, np.array(list(left.values()), float), capacity)
        for column, times in zip(columns.T.astype(int), np.floor(used + 1e-6).astype(int)):
            held = np.flatnonzero(column)
            counts = {int(s): int(n) for s, n in zip(sizes[held], column[held])}
            times = min([int(times), *(left[s] // n for s, n in counts.items())])
            if times:
                patterns.append(Pattern(counts, times))
                for s, n in counts.items():
                    left[s] -= n * times
    # Less than one rounded-off use of each pattern.
    return patterns + _first_fit(left, capacity)


def _first_fit(left: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns by decreasing length; uses up ``left``."""
    patterns = []
    lengths = sorted((s for s, n in left.items() if n), reverse=True)
    while lengths:
        counts, room = {}, capacity
        for s in lengths:
            if n := min(left[s], room // s):
                counts[s] = n
                room -= n * s
        times = min(left[s] // n for s, n in counts.items())
        patterns.append(Pattern(counts, times))
        for s, n in counts.items():
            left[s] -= n * times
        lengths = [s for s in lengths if left[s]]
    return patterns


def slot_rows(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank, first sequence, pieces per sequence, place) rows."""
    next_rank: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern in patterns:
        for place, (size, n) in enumerate(sorted(pattern.counts.items(), reverse=True)):
            first = next_rank.get(size, 0)
            next_rank[size] = first + n * pattern.times
            rows.append((size, first, next_rank[size] - 1, sequence, n, place))
        sequence += pattern.times
    return rows


# The pieces, on the executors


def _ranked(pieces: DataFrame, n_pieces: int) -> DataFrame:
    """``rank`` from 0 within ``length`` in the order of hash bucket, doc_id, start."""
    buckets = max(LEAST_BUCKETS, n_pieces // BUCKET_PIECES)
    spread = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets))
    pieces = pieces.withColumn("bucket", spread)
    counted = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(
        counted.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"),
        "length_offsets",
    )
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "start")
    return pieces.join(offsets, ["length", "bucket"]).withColumn(
        "rank", F.col("before") + F.row_number().over(inside) - 1
    )


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset; sequences hold at most ``capacity`` ids.

    ``pieces`` should be a written table: it is read for the histogram and for the ranks.
    """
    demand = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # <= capacity
    slots = slot_rows(plan_patterns(demand, capacity))
    schema = "length bigint, first bigint, last bigint, base bigint, per bigint, place bigint"
    slots = F.broadcast(pieces.sparkSession.createDataFrame(slots, schema))  # bounded by capacity
    placed = _ranked(pieces, sum(demand.values())).join(slots, "length").where("rank between first and last")
    inside = F.col("rank") - F.col("first")
    placed = written(
        placed.withColumn("sequence_id", F.col("base") + F.floor(inside / F.col("per")))
        .withColumn("slot", inside % F.col("per"))
        .select(*pieces.columns, "sequence_id", "place", "slot"),
        "placed_pieces",
    )
    before = (
        Window.partitionBy("sequence_id")
        .orderBy("place", "slot")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offset = F.coalesce(F.sum("length").over(before), F.lit(0))
    return placed.withColumn("offset", offset).drop("place", "slot")


def packed_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    return pack(written(cut_pieces(docs, path, capacity), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens and ids of every sequence of pieces that carry their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most capacity ids
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"),
        F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"),
    )
