"""Language identification with interpolated Kneser-Ney character models.

One model per language over the characters of lower-cased words (runs of letters, with a
boundary on either side). All labelled training rows are counted and all their n-grams are
kept: counts of n-grams and totals of their contexts, under 64-bit hashes in sorted order. The
language with the lowest cross-entropy per character wins, the first in alphabetical order of
equals.

The n-grams of the highest order that any text has, each once, are expanded to their shorter
ones and contexts and looked up in the store in one join; interpolation makes a row of
log-probabilities of each. Tasks hold the most frequent of them (at most ``HOT_WORDS``) as a
sorted array of 64-bit hashes beside a matrix, searched by bisection; the others of a text are
joined to their rows, each distinct text once. That decides where an n-gram is looked up, not
its score, so what the driver and a task hold is bounded by ``HOT_WORDS`` x languages.

``score`` is the share of calibration rows (labelled, not counted) of the predicted language
and about the same length that fit it no better than this text. Among the ``TAIL`` that fit
worst it is not counted but smoothed, falling exponentially with their mean excess, so that
any number of calibration rows can tell a text that fits no language. Length classes with
few rows are pooled with the next ones, a language without any with all languages; with no
calibration row at all nothing is rejected (score 1). Texts below ``REJECT_BELOW`` fit no
learned language as well as nearly all known texts do.

Defined results: a null text, an empty one and one without a letter is ``und`` with score
0; rows with a null language teach nothing; if nothing can be learned all rows are ``und``.
Repeated rows count as often as they occur. Only doc_id, text and lang are read;
other columns pass through, and those named like results are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cache
from itertools import repeat

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from latelane.llm.common import add_columns, cleared, map_rows, written

ORDER = 5
PAD = " " * (ORDER - 1)
HOT_WORDS = 1_000_000  # n-grams of words whose scores every task holds
REJECT_BELOW = 0.0002
UNKNOWN = "und"
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 1
MIN_CALIBRATION = 200  # rows of a length class below which those of the next lengths are added
TAIL = 0.1  # share of calibration rows that the smoothed tail stands for
PRIOR_EXCESS = 0.5  # nats per character, as one more row of the tail: a margin where rows are few
CELL = 0.005  # nats per character of a calibration histogram's cell
COUNTED_WORDS = 60_000  # distinct words a task counts before it turns them into n-grams
HELD_GRAMS = 500_000  # n-grams a task sums before it passes them on
KNOWN_WORDS = 100_000  # words whose sums a task remembers

_LETTERS = re.compile(r"[^\W\d_]+")
_SPACE = 32


def fold(key: str = "doc_id") -> Column:
    return (F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS).cast("int")


def letter_runs(word: str) -> list[str]:
    return _LETTERS.findall(word.lower())


# N-grams of words as numbers


@cache
def _is_letter() -> np.ndarray:
    """For every code point whether it is a letter."""
    table = np.zeros(0x110000, bool)
    points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    table[points] = [_LETTERS.match(chr(i)) is not None for i in points]
    return table


def word_grams(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ``ORDER``-grams of the letter runs of lower-cased words, an end after each run: a row
    of code points each, and the place of its word. Words hold no line break."""
    text = "\n".join(words) + "\n"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _is_letter()[points]
    # Letters, and the one place after each run.
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    is_end = ~letter[kept]
    of = np.cumsum(points == 10)
    of = (of - (points == 10))[kept]
    sequence = np.where(is_end, _SPACE, points[kept]).astype(np.uint32)
    ends = np.flatnonzero(is_end)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    inside = np.arange(len(sequence)) - np.repeat(starts, ends - starts + 1)
    grams = np.full((len(sequence), ORDER), _SPACE, np.uint32)
    grams[:, -1] = sequence
    for back in range(1, ORDER):
        grams[back:, -1 - back] = np.where(inside[back:] >= back, sequence[:-back], _SPACE)
    return grams, of


def hashed(grams: np.ndarray) -> np.ndarray:
    """64-bit hashes of rows of code points."""
    h = np.full(len(grams), 0x9E3779B97F4A7C15, np.uint64)
    for column in grams.T:
        h = (h ^ column) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def texts_of(grams: np.ndarray) -> list[str]:
    joined = np.ascontiguousarray(grams, "<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [joined[i : i + ORDER] for i in range(0, len(joined), ORDER)]


def grams_of(texts: Sequence[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, ORDER)


# Counting


class _GramSums:
    """Sums of n-grams in arrays."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, counted: Counter) -> None:
        grams, of = word_grams(list(counted))
        n = np.fromiter(counted.values(), np.int64, len(counted))[of]
        self.parts.append((hashed(grams), grams, n))
        self.parts = [self._summed()]

    def _summed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hashes, grams, n = (np.concatenate(p) for p in zip(*self.parts))
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        sums = np.zeros(len(distinct), np.int64)
        np.add.at(sums, inverse, n)
        return distinct, grams[first], sums

    def __len__(self) -> int:
        return sum(len(h) for h, _, _ in self.parts)

    def rows(self, group: str | None) -> Iterator[tuple]:
        for _, grams, sums in self.parts:
            for at in range(0, len(sums), 65536):
                names = texts_of(grams[at : at + 65536])
                yield from zip(repeat(group), names, sums[at : at + 65536].tolist())


def gram_counts(docs: DataFrame, group: Column) -> DataFrame:
    """(group, gram, n) of the ``ORDER``-grams of all texts of ``docs``, null groups too."""

    def make():
        words: dict[str | None, Counter] = {}
        sums: dict[str | None, _GramSums] = {}
        size = 0

        def counted() -> None:
            nonlocal size
            for key, counter in words.items():
                sums.setdefault(key, _GramSums()).add(counter)
            words.clear()
            size = 0

        def flushed() -> Iterator[tuple]:
            counted()
            for key, held in sums.items():
                yield from held.rows(key)
            sums.clear()

        def each(text, key):
            nonlocal size
            counter = words.setdefault(key, Counter())
            before = len(counter)
            counter.update(text.lower().split())
            size += len(counter) - before
            if size > COUNTED_WORDS:
                counted()
                if sum(map(len, sums.values())) > HELD_GRAMS:
                    yield from flushed()

        each.end = flushed
        return each

    rows = docs.where("text is not null").select("text", group.alias("group"))
    found = map_rows(rows, "group string, gram string, n bigint", make, flush_rows=50_000)
    return found.groupBy("group", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Tail:
    """Calibration rows of a language and length: how many fit no better, cell by cell up to
    the tail, which begins at an entropy of ``start`` and falls by ``excess``."""

    first: int  # cell of ``counts[0]``
    counts: list[int]
    rows: int
    start: float
    excess: float
    beyond: int  # rows in the tail


@dataclass
class Model:
    """``store`` has, under the hash of each n-gram of two characters and more, its discounted
    count per language, and under that of each context its total and what the discounts of its
    n-grams add up to. ``single`` has the probabilities of single characters."""

    langs: list[str]
    store: DataFrame | None = None  # hash, a, b: arrays by language, null where not seen
    single: DataFrame | None = None  # gram, p
    unseen: list[float] = field(default_factory=list)  # p of a character not seen, by language
    calibration: dict[tuple[int, int], Tail] = field(default_factory=dict)
    shared: list[Broadcast] = field(default_factory=list)  # scorers that executors hold

    def release(self) -> None:
        """Executors drop their scorers; rows scored but not written are scored with them again."""
        while self.shared:
            self.shared.pop().unpersist()


def train(docs: DataFrame) -> Model:
    """Kneser-Ney models from all labelled rows of ``docs`` (text, lang)."""
    labelled = docs.where("lang is not null").select("text", "lang")
    return _model(written(gram_counts(labelled, F.col("lang")), "gram_counts"))


def _model(counts: DataFrame) -> Model:
    """The models of the groups of ``gram_counts``."""
    top = counts.where("group is not null").select(F.col("group").alias("lang"), "gram", "n")
    # The shorter an n-gram, the more it counts in how many contexts it occurs, not how often.
    longer = F.explode(F.array(*[F.substring("gram", ORDER - s, s + 1) for s in range(1, ORDER)]))
    longer = top.select("lang", longer.alias("longer")).distinct()
    shorter = longer.groupBy("lang", F.substring("longer", 2, ORDER).alias("gram"))
    shorter = shorter.agg(F.count("*").alias("n"))
    grams = top.unionByName(shorter).withColumn("size", F.length("gram"))
    grams = written(grams, "grams")
    sums = grams.groupBy("lang", "size").agg(
        F.count_if(F.col("n") == 1).alias("once"),
        F.count_if(F.col("n") == 2).alias("twice"),
        F.count("*").alias("kinds"),
        F.sum("n").alias("total"),
    )
    sums = sums.collect()  # languages x orders
    langs = sorted({r["lang"] for r in sums})
    if not langs:
        return Model([])
    at = {lang: i for i, lang in enumerate(langs)}
    discounts = {
        (r["lang"], r["size"]): r["once"] / (r["once"] + 2 * r["twice"]) if r["once"] and r["twice"] else 0.5
        for r in sums
    }
    spark = counts.sparkSession
    known = [(lang, at[lang], size, d) for (lang, size), d in discounts.items()]
    known = F.broadcast(spark.createDataFrame(known, "lang string, at int, size int, discount double"))
    grams = grams.join(known, ["lang", "size"])

    def by_language(rows: DataFrame, key: str, *values: str) -> DataFrame:
        arrays = [F.array(*[F.max(F.when(F.col("at") == i, F.col(v))) for i in range(len(langs))]).alias(v) for v in values]
        return rows.groupBy(key).agg(*arrays)

    entries = grams.where("size > 1").select(
        F.xxhash64("gram").alias("hash"), "at", (F.col("n") - F.col("discount")).alias("a"),
        F.lit(None).cast("double").alias("b"),
    )
    contexts = grams.where("size > 1").groupBy("at", "discount", F.expr("substring(gram, 1, size - 1)").alias("context"))
    contexts = contexts.agg(F.sum("n").cast("double").alias("a"), F.count("*").alias("kinds")).select(
        _context_hash(F.col("context")).alias("hash"), "at", "a", (F.col("discount") * F.col("kinds")).alias("b")
    )
    store = by_language(entries.unionByName(contexts), "hash", "a", "b").sortWithinPartitions("hash")
    single = written(by_language(grams.where("size = 1"), "gram", "n"), "single")
    alphabet = single.count() + 1
    ones = {r["lang"]: r for r in sums if r["size"] == 1}
    unseen = [discounts[lang, 1] * ones[lang]["kinds"] / ones[lang]["total"] / alphabet for lang in langs]
    p = F.array(
        *[F.coalesce((F.col("n")[i] - discounts[lang, 1]) / ones[lang]["total"], F.lit(0.0)) + unseen[i]
          for i, lang in enumerate(langs)]
    )
    return Model(langs, written(store, "store"), single.select("gram", p.alias("p")), unseen)


def _context_hash(context: Column) -> Column:
    return F.xxhash64(F.lit("context"), context)


# Scoring


def gram_scores(grams: DataFrame, model: Model) -> DataFrame:
    """gram, n and log_p, the log-probabilities by language, of distinct ``ORDER``-grams (gram,
    n) (a written table)."""
    sizes = range(2, ORDER + 1)
    keys = [
        F.struct(F.lit(slot).alias("slot"), key.alias("hash"))
        for s in sizes
        for slot, key in (
            (s, F.xxhash64(F.substring("gram", ORDER + 1 - s, s))),
            (-s, _context_hash(F.substring("gram", ORDER + 1 - s, s - 1))),
        )
    ]
    wanted = grams.select("gram", "n", F.inline(F.array(*keys)))
    found = wanted.join(model.store, "hash", "left").groupBy("gram", "n").agg(
        # A row per slot of one n-gram.
        F.map_from_entries(F.collect_list(F.struct("slot", F.struct("a", "b")))).alias("found")
    )
    last = F.substring("gram", ORDER, 1)
    single = F.broadcast(model.single.withColumnRenamed("gram", "last"))  # a row per character
    found = found.withColumn("last", last).join(single, "last", "left")
    unseen = F.array(*[F.lit(p) for p in model.unseen])

    def interpolated(i: Column) -> Column:
        p = F.get(F.coalesce("p", unseen), i)
        for s in sizes:
            own, context = F.element_at("found", F.lit(s)), F.element_at("found", F.lit(-s))
            total = F.get(context["a"], i)
            seen = F.coalesce(F.get(own["a"], i), F.lit(0.0)) + F.get(context["b"], i) * p
            p = F.when(total.isNull(), p).otherwise(seen / total)
        return F.log(p)

    log_p = F.transform(F.sequence(F.lit(0), F.lit(len(model.langs) - 1)), interpolated)
    return written(found.select("gram", "n", log_p.alias("log_p")), "gram_scores")


def _hot(scores: DataFrame) -> tuple[DataFrame, bool]:
    """The most frequent n-grams of ``scores``, at most ``HOT_WORDS``, and whether that is all."""
    if scores.count() <= HOT_WORDS:
        return scores, True
    cell = F.floor(8 * F.log2("n"))  # 8 cells each time n doubles
    sizes = {r["cell"]: r["count"] for r in scores.groupBy(cell.alias("cell")).count().collect()}
    least, held = None, 0
    for c in sorted(sizes, reverse=True):
        held += sizes[c]
        if held > HOT_WORDS:
            break
        least = c
    return scores.where(cell >= least if least is not None else F.lit(False)), False


class Scorer:
    """Sums of log-probabilities and characters per word, from a sorted array of the hashes of
    n-grams; row 0 is for no word."""

    def __init__(self, model: Model, hot: DataFrame | None = None):
        self.model = model
        self.languages = len(model.langs)
        self.hold(hot)
        self.forget()

    def hold(self, hot: DataFrame | None) -> None:
        grams, log_p = np.zeros((0, ORDER), np.uint32), np.zeros((0, self.languages))
        if hot is not None:
            rows = hot.select("gram", "log_p").toArrow()  # at most HOT_WORDS
            grams = grams_of(rows["gram"].to_pylist())
            log_p = rows["log_p"].combine_chunks().flatten().to_numpy().reshape(-1, self.languages)
        hashes = hashed(grams)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.log_p = np.concatenate([log_p[order], np.zeros((1, self.languages))])  # the last row: not held

    def forget(self) -> None:
        self.places: dict[str, int] = {}
        self.table = np.zeros((1, self.languages + 1))
        self.cold: dict[int, list[str]] = {}

    def learn(self, words: set[str]) -> None:
        """Score words on the driver, where the store can be read."""
        new = sorted(words)
        grams = Counter(texts_of(word_grams(new)[0])) if new else Counter()
        rows = SparkSession.active().createDataFrame(list(grams.items()), "gram string, n bigint")
        self.hold(gram_scores(rows, self.model))
        self.add(new)

    def add(self, words: list[str]) -> None:
        """Sums of words not known yet; their n-grams that are not held are noted."""
        grams, of = word_grams(words)
        hashes = hashed(grams)
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = -1
        held = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(at), bool)
        rows = np.zeros((len(words), self.languages + 1))
        np.add.at(rows, of[held], np.column_stack([self.log_p[at[held]], np.ones(int(held.sum()))]))
        first = len(self.table)
        self.table = np.concatenate([self.table, rows])
        self.places.update(zip(words, range(first, first + len(words))))
        missing = np.flatnonzero(~held)
        for place, gram in zip(of[missing].tolist(), texts_of(grams[missing])):
            self.cold.setdefault(first + place, []).append(gram)

    def sums(self, texts: list[str | None]) -> list[tuple]:
        """(sums by language, characters, n-grams not held, how often) of each text."""
        split = [text.lower().split() if text else [] for text in texts]
        new = {w for words in split for w in words if w not in self.places}
        if len(self.places) + len(new) > KNOWN_WORDS:
            self.forget()
            new = {w for words in split for w in words}
        if new:
            self.add(list(new))
        out = []
        for words in split:
            places = np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))
            sums = np.zeros(self.table.shape[1])
            for at in range(0, len(places), 65536):
                sums += self.table[places[at : at + 65536]].sum(axis=0)
            cold: Counter = Counter()
            if self.cold:
                for place, times in Counter(places.tolist()).items():
                    for gram in self.cold.get(place, ()):
                        cold[gram] += times
            out.append((sums[:-1].tolist(), int(sums[-1]), list(cold), list(cold.values())))
        return out


def _scored(docs: DataFrame, model: Model, grams: DataFrame | None = None, without: Sequence[str] = ()) -> DataFrame:
    """``docs`` with lang_pred, entropy (null for ``und``) and bits, the length class; ``grams``
    are those of its texts (gram, n), if they are counted already."""
    docs = cleared(docs, ["lang_pred", "entropy", "bits"])
    kept = [c for c in docs.columns if c not in without]
    if not model.langs:
        nothing = F.lit(None).cast("double").alias("entropy")
        return docs.select(*kept, F.lit(UNKNOWN).alias("lang_pred"), nothing, F.lit(0).alias("bits"))
    if grams is None:
        grams = gram_counts(docs, F.lit(None).cast("string")).select("gram", "n")
    scores = gram_scores(grams, model)
    hot, complete = _hot(scores)
    scorer = Scorer(Model(model.langs), hot)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # bounded by HOT_WORDS
    model.shared.append(shared)

    def make():
        return shared.value.sums  # words known from earlier tasks of the process stay known

    schema = "_sums array<double>, _chars bigint, _cold array<string>, _times array<bigint>"
    if complete:
        rows = add_columns(docs, ["text"], schema, make, rows_each=256, without=without).drop("_cold", "_times")
    else:
        keyed = docs.withColumn("_text_key", F.md5("text"))
        held = written(add_columns(keyed, ["text"], schema, make, rows_each=256, without=without), "held_sums")
        rows = _with_cold(held, scores, len(model.langs))
    best = F.array_max("_sums")
    langs = F.array(*[F.lit(lang) for lang in model.langs])
    lang = F.get(langs, (F.array_position("_sums", best) - 1).cast("int"))
    known = F.col("_chars") > 0
    return rows.select(
        *kept,
        F.when(known, lang).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(known, -best / F.col("_chars")).alias("entropy"),
        length_class(F.col("_chars")).alias("bits"),
    )


def _with_cold(held: DataFrame, scores: DataFrame, languages: int) -> DataFrame:
    """``held`` with the scores of the n-grams that tasks did not hold added to its sums."""
    pairs = F.inline(F.arrays_zip(F.col("_cold").alias("gram"), F.col("_times").alias("times")))
    cold = held.where(F.size("_cold") > 0).select("_text_key", pairs).toDF("_text_key", "gram", "times")
    cold = cold.distinct()  # equal texts once
    looked = cold.join(scores.select("gram", "log_p"), "gram").groupBy("_text_key")
    at = range(languages)
    more = [F.sum(F.col("times") * F.col("log_p")[i]) for i in at]
    more = looked.agg(F.array(*more).alias("_more"), F.sum("times").alias("_more_chars"))
    rows = held.drop("_cold", "_times").join(written(more, "cold_sums"), "_text_key", "left")
    sums = F.array(*[F.col("_sums")[i] + F.coalesce(F.col("_more")[i], F.lit(0.0)) for i in at])
    chars = F.col("_chars") + F.coalesce("_more_chars", F.lit(0))
    return rows.withColumn("_sums", sums).withColumn("_chars", chars)


def length_class(n_chars: Column) -> Column:
    return F.least(F.length(F.bin(n_chars)), F.lit(12))


def calibrate(docs: DataFrame, model: Model) -> Model:
    """Histogram of the cross-entropies of labelled rows that are recognised as labelled."""
    labelled = docs.where("lang is not null and text is not null").select("text")
    return _calibrated(_scored(labelled, model), model)


def _calibrated(scored: DataFrame, model: Model) -> Model:
    cell = F.floor(F.col("entropy") / CELL).alias("cell")
    cells = scored.where(F.col("lang_pred") != UNKNOWN).groupBy("lang_pred", "bits", cell).count()
    found = cells.toPandas()  # languages x length classes x cells
    for index, lang in enumerate(model.langs if len(found) else []):
        part = found[found["lang_pred"] == lang]
        part = part if len(part) else found
        for bits in range(13):
            away = (part["bits"] - bits).abs()
            sizes = part["count"].groupby(away).sum().sort_index().cumsum()
            enough = sizes[sizes >= MIN_CALIBRATION]
            own = part[away <= (enough.index.min() if len(enough) else 13)]
            model.calibration[index, bits] = _tail(own.groupby("cell")["count"].sum())
    return model


def _tail(sizes) -> Tail:
    """From the rows of each cell (a series)."""
    first, last = int(sizes.index.min()), int(sizes.index.max())
    dense = sizes.reindex(range(first, last + 1), fill_value=0)
    counts = dense[::-1].cumsum()[::-1].astype(int).tolist()
    rows = counts[0]
    # The last cell below the tail: rows beyond it are TAIL of all at most.
    body = next(i for i in range(len(counts)) if i + 1 == len(counts) or counts[i + 1] <= TAIL * rows)
    start = (first + body + 1) * CELL
    beyond = dense.iloc[body + 1 :]
    total = float((((beyond.index + 0.5) * CELL - start) * beyond).sum()) + PRIOR_EXCESS
    n = int(beyond.sum())
    return Tail(first, counts[: body + 1], rows, start, total / (n + 1), n)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score and entropy (null for ``und``)."""
    docs = cleared(docs, ["lang_pred", "score", "entropy"])
    return _judged(_scored(docs, model), model, docs.columns)


def _judged(scored: DataFrame, model: Model, columns: Sequence[str]) -> DataFrame:
    """``columns`` of scored rows with lang_pred, score and entropy."""
    rows = [
        (model.langs[i], bits, t.first, t.counts, t.rows, t.start, t.excess, t.beyond)
        for (i, bits), t in model.calibration.items()
    ]
    schema = "lang_pred string, bits int, _first bigint, _counts array<bigint>, _rows bigint"
    schema += ", _start double, _excess double, _beyond bigint"
    tails = F.broadcast(scored.sparkSession.createDataFrame(rows, schema))  # languages x length classes
    cell = F.greatest(F.floor(F.col("entropy") / CELL) - F.col("_first"), F.lit(0)).cast("int")
    as_bad = F.get("_counts", cell)
    smooth = F.exp((F.col("_start") - F.col("entropy")) / F.col("_excess"))
    smooth = F.least(smooth, F.lit(1.0)) * (1 + F.col("_beyond")) / (1 + F.col("_rows"))
    score = F.when(F.col("lang_pred") == UNKNOWN, 0.0).when(F.col("_rows").isNull(), 1.0)
    score = score.when(as_bad.isNull(), smooth).otherwise((1 + as_bad) / (1 + F.col("_rows")))
    found = scored.join(tails, ["lang_pred", "bits"], "left")
    return found.select(*columns, "lang_pred", score.alias("score"), "entropy")


def fitted(docs: DataFrame) -> Model:
    """Model and calibration from the labelled rows of ``docs`` outside the held-out fold."""
    labelled = docs.select("doc_id", "text", "lang").withColumn("fold", fold())
    counted = labelled.where(~F.col("fold").isin(HELD_OUT, CALIBRATION))
    return calibrate(labelled.where(F.col("fold") == CALIBRATION), train(counted))


def recognised(docs: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """``predict(docs, fitted(docs))`` with the texts read twice only, once to count and once
    to score. ``keep`` names the columns wanted (default: all)."""
    docs = cleared(docs, ["lang_pred", "score", "entropy"])
    columns = list(keep or docs.columns)
    # The fold is looked at before columns are dropped; a null id is in no fold.
    part = F.when(F.col("lang").isNotNull(), fold()).alias("_part")
    rows = docs.select(*dict.fromkeys([*columns, "text"]), part, "lang")
    if "lang" in columns:
        rows = docs.select(*dict.fromkeys([*columns, "text"]), part)
    taught = F.when(~F.col("_part").isin(HELD_OUT, CALIBRATION), F.col("lang"))
    counts = written(gram_counts(rows, taught), "gram_counts")
    model = _model(counts)
    grams = counts.groupBy("gram").agg(F.sum("n").alias("n"))
    without = [c for c in ("text", "lang") if c not in columns]
    scored = written(_scored(rows, model, grams, without), "scored")
    model.release()
    _calibrated(scored.where((F.col("_part") == CALIBRATION) & F.col("entropy").isNotNull()), model)
    return _judged(scored, model, columns)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and entropy of every document."""
    scored = recognised(docs.select("doc_id", "text", "lang"), ["doc_id"])
    return scored.withColumn("held_out", F.coalesce(fold() == HELD_OUT, F.lit(False))).select(
        "doc_id", "held_out", "lang_pred", "score", "entropy"
    )
