"""Ordinal quality classifier: cumulative-link regression on hashed text.

Grades are ordered: 0 toxic, 1 of low quality, 2 good. All grades share one weight per
hash bucket of a text's features; ordered thresholds on the weighted sum divide the
grades. ``expected_grade`` is the mean grade, ``tail_prob`` the probability of the best.
Features are the distinct words of the whole text by their letters, the words' beginnings,
and classes of how many are in capitals, hold symbols, repeat the word before, or occur
once. Buckets whose texts spread over the grades as all texts do get no weight.

All labelled rows take part: four of five folds in the fit, the good ones of the fifth in the
cutoff. Each evaluation of the loss is one Spark job whose tasks add up loss and gradient over
their rows; the driver holds vectors of the model's length only. A text is kept if its tail
probability reaches the cutoff: one half, or less if that would reject more than ``GOOD_LOST``
of the held-out good rows; without such rows all texts are kept.

A null or empty text has no words and a grade by its empty features; null labels are not
used, of several labels of a doc_id the lowest grade counts, rows that repeat a doc_id are
one example (of the smallest features). Without labelled rows every row is kept with null
grades. Other columns pass through unread; those named like results are replaced.
"""

from __future__ import annotations

import math
import operator
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from latelane.llm.common import add_columns, map_rows, with_package, written
from latelane.operators.selection import running_totals

BUCKETS = 1 << 18
GRADES = 3
RATINGS_EACH = 4_000_000  # ratings that tasks hold at a time to find their texts
STEM = 5  # letters of a word's beginning
LEAST_CHI2 = 25  # of a bucket's texts over the grades, below which it has no weight
DECAY = 2e-4
EVALUATIONS, TOLERANCE, MEMORY = 60, 1e-5, 10  # of the loss, of its relative decrease, of L-BFGS
FIT_PARTITIONS = 32  # tasks of an evaluation at most; each returns a gradient
GOOD_LOST = 0.002
FOLDS, HELD_OUT = 5, 0
CACHE_WORDS = 100_000

_LETTERS = re.compile(r"[^\W\d_]+")
_SYMBOL = re.compile(r"[#*$%&|<>@{}\[\]=~^\\]")


_digest = xxhash.xxh3_64_intdigest


def bucket(feature: str) -> int:
    return _digest(feature.encode()) % BUCKETS


class Features:
    """Buckets of texts; what is known of a word is remembered up to a bound."""

    def __init__(self) -> None:
        self.places: dict[str, int] = {}
        self.table = np.zeros((4096, 4), np.int64)  # buckets, in capitals, with a symbol

    def _learn(self, words: set[str]) -> None:
        new = words.difference(self.places)
        if not new:
            return
        if len(self.places) + len(new) > CACHE_WORDS:
            self.places.clear()
            new = words
        start = len(self.places)
        end = start + len(new)
        while len(self.table) < end:
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        hashes, capitals, symbols = [], [], []
        for word in new:
            plain = word.isalpha()
            letters = word if plain else "".join(_LETTERS.findall(word))
            lower = letters.lower()
            # Of other scripts a letter may become two, or another at the end of a word.
            stem = lower[:STEM] if letters.isascii() else letters[:STEM].lower()
            hashes.append(_digest(("word " + lower).encode()))
            hashes.append(_digest(("stem " + stem).encode()))
            capitals.append(len(letters) > 1 and letters.isupper())
            symbols.append(not plain and _SYMBOL.search(word) is not None)
        self.table[start:end, :2] = np.array(hashes, np.uint64).reshape(-1, 2) % np.uint64(BUCKETS)
        self.table[start:end, 2] = capitals
        self.table[start:end, 3] = symbols
        self.places.update(zip(new, range(start, end)))

    def of(self, text: str | None) -> np.ndarray:
        """The buckets of a text's words, their beginnings, and its classes, each once."""
        words = (text or "").split()
        distinct = set(words)
        self._learn(distinct)
        rows = self.table[np.fromiter(map(self.places.__getitem__, distinct), np.int64, len(distinct))]
        n, d = max(1, len(words)), max(1, len(distinct))
        repeats = sum(map(operator.eq, words, words[1:]))
        length = len(words).bit_length()
        classes = (
            f"length {length}",
            f"capitals {10 * int(rows[:, -2].sum()) // d}",
            f"symbols {10 * int(rows[:, -1].sum()) // d}",
            f"repeats {20 * repeats // n}",
            f"distinct {10 * len(distinct) // n} of {min(length, 12)}",
        )
        buckets = np.concatenate([rows[:, 0], rows[:, 1], [bucket("class " + c) for c in classes]])
        buckets = np.sort(buckets.astype(np.int32))
        return buckets[np.r_[True, buckets[1:] != buckets[:-1]]]


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    cutoff: float

    def above(self, features: np.ndarray) -> np.ndarray:
        """Probability of a grade over 0, over 1, ..."""
        return _sigmoid(float(self.weights[features].sum()) - self.thresholds)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def _columns(texts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The buckets that get a weight; ``texts`` counts texts by grade and bucket, ``sizes`` by grade."""
    expected = texts.sum(axis=0) * (sizes / sizes.sum())[:, None]
    chi2 = ((texts - expected) ** 2 / np.maximum(expected, 1e-9)).sum(axis=0)
    return np.flatnonzero((chi2 >= LEAST_CHI2) & (texts.sum(axis=0) > 0))


def _grade_weights(sizes: np.ndarray) -> np.ndarray:
    """What a row of each grade counts, so that all grades that occur weigh alike."""
    return 1 / (np.maximum(sizes, 1) * (sizes > 0).sum())


def _cuts(params: np.ndarray, width: int) -> np.ndarray:
    return np.cumsum(np.r_[params[width] - 1, np.exp(params[width + 1 :])])


def _loss(
    params: np.ndarray, width: int, columns: np.ndarray, lengths: np.ndarray, grades: np.ndarray, weights: np.ndarray
) -> np.ndarray:
    """The loss of some texts, then its gradient, both without the decay.

    ``params`` are ``width`` weights, the first threshold plus 1 and the logarithms of the gaps.
    """
    n, cuts = len(grades), _cuts(params, width)
    owner = np.repeat(np.arange(n, dtype=np.int32), lengths)
    f = np.bincount(owner, params[columns], n)
    below = _sigmoid(cuts[None, :] - f[:, None])  # P(grade <= k)
    upper = np.c_[below, np.ones(n)][np.arange(n), grades]
    lower = np.c_[np.zeros(n), below][np.arange(n), grades]
    mass, weight = np.maximum(upper - lower, 1e-9), weights[grades]
    d_f = weight * (upper * (1 - upper) - lower * (1 - lower)) / mass
    d_cuts = np.zeros(len(cuts))
    for k in range(len(cuts)):
        slope = below[:, k] * (1 - below[:, k]) / mass * weight
        d_cuts[k] = slope[grades == k + 1].sum() - slope[grades == k].sum()
    later = np.cumsum(d_cuts[::-1])[::-1]
    return np.r_[
        -(weight * np.log(mass)).sum(),
        np.bincount(columns, d_f[owner], width),
        later[:1],
        later[1:] * np.exp(params[width + 1 :]),
    ]


def _minimum(loss: Callable[[np.ndarray], np.ndarray], width: int, n_grades: int) -> np.ndarray:
    """The parameters where loss and decay are least, by L-BFGS with halved steps."""
    decay = np.r_[np.full(width, DECAY), np.full(n_grades - 1, 1e-4)]

    def at(x: np.ndarray) -> tuple[float, np.ndarray]:
        found = loss(x)
        return found[0] + (decay * x * x).sum() / 2, found[1:] + decay * x

    x = np.zeros(width + n_grades - 1)
    value, gradient = at(x)
    calls, pairs = 1, []
    while True:
        way, shares = -gradient, []
        for s, y in reversed(pairs):
            shares.append((s @ way) / (s @ y))
            way = way - shares[-1] * y
        if pairs:
            s, y = pairs[-1]
            way = way * ((s @ y) / (y @ y))
        else:
            way = way / max(1.0, float(np.linalg.norm(gradient)))
        for (s, y), share in zip(pairs, reversed(shares)):
            way = way + (share - (y @ way) / (s @ y)) * s
        step, slope = 1.0, float(way @ gradient)
        while True:
            if calls >= EVALUATIONS or slope >= 0:
                return x
            there = x + step * way
            new, steeper = at(there)
            calls += 1
            if new <= value + 1e-4 * step * slope:
                break
            step /= 2
        s, y = there - x, steeper - gradient
        if s @ y > 1e-12 * (s @ s):
            pairs = [*pairs, (s, y)][-MEMORY:]
        done = value - new <= TOLERANCE * value
        x, value, gradient = there, new, steeper
        if done:
            return x


def fit(buckets: np.ndarray, lengths: np.ndarray, grades: np.ndarray, n_grades: int = GRADES):
    """Weights and thresholds of least mean loss, grades weighing alike, for texts at hand.

    ``buckets`` are those of all texts in a row, ``lengths`` how many each has.
    """
    owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    sizes = np.bincount(grades, minlength=n_grades)
    texts = np.array([np.bincount(buckets[grades[owner] == k], minlength=BUCKETS) for k in range(n_grades)])
    present = _columns(texts, sizes)
    columns, lengths = _narrowed(buckets, lengths, present)
    width, each = len(present), _grade_weights(sizes)
    params = _minimum(lambda x: _loss(x, width, columns, lengths, grades, each), width, n_grades)
    weights = np.zeros(BUCKETS)
    weights[present] = params[:width]
    return weights, _cuts(params, width)


def _narrowed(buckets: np.ndarray, lengths: np.ndarray, present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``present`` of the buckets found there, and how many each text keeps."""
    place = np.full(BUCKETS, -1, np.int32)
    place[present] = np.arange(len(present), dtype=np.int32)
    found = place[buckets]
    owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    used = found >= 0
    return found[used], np.bincount(owner[used], minlength=len(lengths))


def _cutoff(low: float | None, good: int) -> float:
    """From the ``GOOD_LOST`` quantile of ``good`` rows' tail probabilities: itself, 0.5 at most;
    with fewer rows than show it, up to one logit below the smallest."""
    if low is None:
        return 0.0
    low = min(max(low, 1e-12), 1 - 1e-12)
    margin = max(0.0, 1 - good * GOOD_LOST)
    return min(0.5, float(_sigmoid(np.log(low / (1 - low)) - margin)))


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of labels with quality and toxic."""
    grade = F.when(F.col("toxic") > 0, 0).when(F.col("quality") <= 0, 1).otherwise(2)
    known = labels.where("doc_id is not null and (toxic > 0 or quality is not null)")
    return known.groupBy("doc_id").agg(F.min(grade).alias("grade"))


def _fold() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS


def _rated(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, grade, held_out, features) of every labelled text, written in the order of ids.

    Texts meet the ratings where they lie: ratings are broadcast, in blocks of at most about
    ``RATINGS_EACH``, so texts are read once a block and never moved.
    """
    ratings = written(graded(labels).withColumn("held_out", _fold() == HELD_OUT), "ratings")
    blocks = max(1, math.ceil(ratings.count() / RATINGS_EACH))

    def make():
        features = Features()
        return lambda doc_id, grade, held_out, text: [(doc_id, grade, held_out, features.of(text))]

    kind = docs.schema["doc_id"].dataType.simpleString()
    rated = None
    for block in range(blocks):
        held = ratings.where(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) == block)
        texts = docs.select("doc_id", "text").join(F.broadcast(held), "doc_id")
        part = map_rows(
            texts.select("doc_id", "grade", "held_out", "text"),
            f"doc_id {kind}, grade int, held_out boolean, features array<int>",
            make,
            size=lambda r: 4 * len(r[3]),
        )
        rated = part if rated is None else rated.unionByName(part)
    once = rated.groupBy("doc_id", "grade", "held_out").agg(F.min("features").alias("features"))
    return written(once.sortWithinPartitions("doc_id"), "rated")


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features of a batch's rows in a row, how many each has, and the grades."""
    lists = batch.column("features")
    return (
        lists.flatten().to_numpy(zero_copy_only=False),
        lists.value_lengths().to_numpy(zero_copy_only=False),
        batch.column("grade").to_numpy(zero_copy_only=False),
    )


def _weighted_buckets(rated: DataFrame, sizes: np.ndarray) -> np.ndarray:
    """As ``_columns``, where the rows lie: the driver gets the buckets only, as Arrow."""
    texts = [F.count_if(F.col("grade") == k).alias(f"_{k}") for k in range(GRADES)]
    counted = rated.select("grade", F.explode("features").alias("bucket")).groupBy("bucket").agg(*texts)
    total = sum((F.col(f"_{k}") for k in range(1, GRADES)), F.col("_0"))
    parts = []
    for k, share in enumerate((sizes / sizes.sum()).tolist()):
        expected = total * F.lit(share)
        off = F.col(f"_{k}") - expected
        parts.append(off * off / F.greatest(expected, F.lit(1e-9)))
    chi2 = sum(parts[1:], parts[0])
    found = counted.where(chi2 >= LEAST_CHI2).select("bucket").toArrow()  # <= BUCKETS rows
    return np.sort(found.column("bucket").to_numpy()).astype(np.int64)


def _fitted(rated: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """As ``fit``, over the rows of ``rated`` (grade, features) where they lie."""
    context = rated.sparkSession.sparkContext
    sizes = np.zeros(GRADES, np.int64)
    for row in rated.groupBy("grade").count().collect():  # a row per grade
        sizes[row["grade"]] = row["count"]
    if not sizes.sum():
        return None
    present, each = _weighted_buckets(rated, sizes), _grade_weights(sizes)
    width, shared = len(present), context.broadcast(present)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, lengths, _ = _lists(batch)
            columns, lengths = _narrowed(buckets, lengths, shared.value)
            ends = np.r_[0, np.cumsum(lengths)].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(columns, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("grade"), lists], ["grade", "features"])

    rows = with_package(rated.select("grade", "features"))
    rows = written(rows.mapInArrow(narrow, "grade int, features array<int>"), "narrowed")

    def loss(x: np.ndarray) -> np.ndarray:
        params = context.broadcast(x)

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 + len(params.value))
            for batch in batches:
                total += _loss(params.value, width, *_lists(batch), each)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

        # At most FIT_PARTITIONS vectors of the model's length.
        parts = with_package(rows.coalesce(FIT_PARTITIONS)).mapInArrow(summed, "total binary").collect()
        params.unpersist()
        return np.sum([np.frombuffer(p["total"]) for p in parts], axis=0)

    params = _minimum(loss, width, GRADES)
    weights = np.zeros(BUCKETS)
    weights[present] = params[:width]
    return weights, _cuts(params, width)


def _good_limit(good: DataFrame, model: Model) -> tuple[float | None, int]:
    """The ``GOOD_LOST`` quantile of the tail probabilities of ``good`` rows, exact, and their number."""
    shared = good.sparkSession.sparkContext.broadcast(model)

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = (x.values.to_numpy() for x in batch.column("features"))
            found = [float(shared.value.above(x)[-1]) for x in lists]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64())], ["tail"])

    rows = with_package(good.select("features")).mapInArrow(tails, "tail double")
    counts = written(rows.groupBy("tail").agg(F.count("*").alias("n")), "good_tails")
    n = counts.agg(F.sum("n")).first()[0] or 0
    if not n:
        return None, 0
    rank = math.floor((n - 1) * GOOD_LOST)
    here = (F.col("n_below") <= rank) & (F.col("n_below") + F.col("n") > rank)
    return running_totals(counts, [], "tail", ["n"]).where(here).first()["tail"], n


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model of all labelled rows of ``docs`` (doc_id, text)."""
    rated = _rated(docs, labels)
    found = _fitted(rated.where("not held_out"))
    if found is None:
        return None
    model = Model(*found, 0.0)
    good = rated.where((F.col("grade") == GRADES - 1) & F.col("held_out"))
    model.cutoff = _cutoff(*_good_limit(good, model))
    return model


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with expected_grade, tail_prob and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights

    def make():
        features, known = Features(), shared.value

        def of_slice(texts):
            if known is None:
                return [(None, None, True)] * len(texts)
            rows = []
            for text in texts:
                above = known.above(features.of(text))
                rows.append((float(above.sum()), float(above[-1]), bool(above[-1] >= known.cutoff)))
            return rows

        return of_slice

    return add_columns(docs, ["text"], "expected_grade double, tail_prob double, kept boolean", make)


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, expected_grade, tail_prob and kept of every row of ``docs``."""
    return scored(docs.select("doc_id", "text"), train(docs, labels)).drop("text")

