"""Quality rules with risk-controlled thresholds, with DataFrame functions only.

Each rule is a share of a text (symbols, capitals, repeated lines, repeated words) that
rejects from a cutoff on. The cutoffs of all rules move together along one chain of steps,
a constant that the labelled rows of a run do not move: none rejects before its whole share at
the first step, each has its strictest cutoff at the last. (``STRICTEST`` was set by judgement
after a look at the shares in one sample table; on that table itself the bound is not strict.) A row's step is the first at which a rule rejects it.
Labelled rows decide, per stratum, how far along the chain to go, by fixed-sequence testing:
a step is safe if, were more than ``RISK`` of the good rows rejected by it, so few rejections
among the labelled good rows would have a probability (exact binomial tail) of at most
``ERROR`` divided by the number of strata. Steps are tested from the mildest on and the first
that fails ends the sequence, so the steps of a stratum need no correction of their own. Hence
with probability 1 - ``ERROR`` no stratum loses more than ``RISK`` of its good rows to the
rules together. Of the safe steps the one that rejects most bad rows is taken, of equals the
mildest; a stratum without a safe step that rejects a bad row uses no rule. With four strata,
437 good rows without a rejection are enough.

Null and empty texts have no words and fail the base rule, as all texts under ten words
do. A null stratum is a stratum of its own. Repeated rows are judged one by one; a doc_id
with several labels counts with its lowest. Without labels only the base rule decides; an
empty table gives an empty one. Of the documents only doc_id, text and the stratum column
are read, of the labels doc_id and quality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from latelane.llm.common import written

RISK = 0.01  # share of good rows a stratum may lose
ERROR = 0.05
CELLS = 64  # cutoffs are cells: 1/64, 2/64, ... 1
LAST_STEP = 63
STRICTEST = {"symbols": 1, "capitals": 20, "dup_lines": 20, "repeats": 12}  # cells at the last step
WINDOW_WORDS = 5
LEAST_WORDS = 10
MOST_REPEATED = 20  # per cent

SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _without(text: str, characters: str) -> Column:
    """Code points of a text that are none of these characters."""
    return F.length(F.translate(F.col(text), characters, "")).cast("bigint")


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def measured(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum, counts and ``step`` (over ``LAST_STEP``: no rule rejects) of every row.

    Windows are compared by 64-bit hash within their text. Only texts with a repeated
    window, which the number of distinct windows shows, are sorted to find its words.
    """
    texts = docs.select(
        "doc_id",
        F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    split = texts.withColumn("words", words).withColumn("lines", lines)
    # Both are used twice below, so that the optimizer keeps them as columns.
    counted = split.select(
        "doc_id",
        "stratum",
        F.size("words").cast("bigint").alias("n_words"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
        _without("text", _SPACES).alias("word_chars"),
        (F.length("text") - _without("text", SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.length("text") - _without("text", _CAPITALS)).cast("bigint").alias("n_capitals"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
    )
    each = ", ".join(f"hashes[i + {k}]" for k in range(WINDOW_WORDS))
    windows = F.expr(
        f"case when size(hashes) <= {WINDOW_WORDS} then array() else "
        f"transform(sequence(0, size(hashes) - {WINDOW_WORDS}), i -> xxhash64({each})) end"
    )
    windowed = counted.withColumn("windows", windows).drop("hashes")
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    ranked = F.expr("sort_array(transform(windows, (w, i) -> struct(w, i)))")
    windowed = windowed.withColumn("repeated", repeated).withColumn(
        "ranked", F.when(repeated, ranked)
    )
    # Windows next to an equal one, back in text order.
    places = F.expr(
        """sort_array(transform(
             filter(ranked, (r, i) -> r.w = get(ranked, i - 1).w or r.w = get(ranked, i + 1).w),
             r -> r.i))"""
    )
    windowed = windowed.drop("windows").withColumn("places", places)
    new_words = F.expr(
        f"""aggregate(places, struct(-{WINDOW_WORDS} as last, 0L as n), (a, p) -> struct(
              p as last, a.n + least({WINDOW_WORDS}, p - a.last) as n), a -> a.n)"""
    )
    result = windowed.withColumn(
        "n_repeat_words", F.when(F.col("repeated"), new_words).otherwise(F.lit(0)).cast("bigint")
    )
    shares = {
        "symbols": _share("n_symbols", "word_chars"),
        "capitals": _share("n_capitals", "word_chars"),
        "dup_lines": _share("n_dup_lines", "n_lines"),
        "repeats": _share("n_repeat_words", "n_words"),
    }
    # The first step whose cutoff, CELLS - step * (CELLS - strictest) / LAST_STEP, is in the share's cell.
    steps = [
        F.ceil(LAST_STEP * (CELLS - F.floor(CELLS * shares[rule])) / F.lit(CELLS - strictest))
        for rule, strictest in STRICTEST.items()
    ]
    failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    )
    return result.select(
        "doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), F.least(*steps).cast("int").alias("step"),
    )


def _ln_factorial(x: str) -> str:
    series = f"{x} * ln({x}) - {x} + 0.5 * ln(2 * pi() * {x}) + 1 / (12D * {x}) - 1 / (360D * pow({x}, 3))"
    return f"(case when {x} <= 20 then ln(factorial(cast(least({x}, 20) as int))) else {series} end)"


def binomial_tail(k: str, n: str, risk: float) -> Column:
    """Probability of at most ``k`` of ``n`` at this risk; 1 where k reaches the mean.

    Below the mean the terms rise up to k, so those over 40 deviations below it are left out.
    """
    first = f"greatest(0, cast({k} - 40 * sqrt({n} * {risk}D) - 100 as bigint))"
    log_term = (
        f"{_ln_factorial(f'cast({n} as double)')} - {_ln_factorial('cast(j as double)')}"
        f" - {_ln_factorial(f'cast({n} - j as double)')}"
        f" + j * ln({risk}D) + ({n} - j) * ln(1 - {risk}D)"
    )
    return F.expr(
        f"case when {k} >= {n} * {risk}D then 1D else "
        f"aggregate(sequence({first}, {k}), 0D, (a, j) -> a + exp({log_term})) end"
    )


def safe_steps(measures: DataFrame, labels: DataFrame) -> DataFrame:
    """(stratum, last_step): the step up to which rows of a stratum are rejected."""
    rated = labels.where("doc_id is not null and quality is not null")
    rated = rated.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    judged_rows = measures.where(~F.col("base_failed")).select("doc_id", "stratum", "step")
    rows = judged_rows.join(rated, "doc_id")
    steps = rows.groupBy("stratum", "step").agg(
        F.count(F.when(F.col("quality") > 0, 1)).alias("good"),
        F.count(F.when(F.col("quality") <= 0, 1)).alias("bad"),
    )
    steps = written(steps, "rule_steps")  # at most 65 rows per stratum
    strata = steps.agg(F.count_distinct("stratum").alias("strata"))
    until = Window.partitionBy("stratum").orderBy("step")
    tested = (
        steps.withColumn("rejected", F.sum("good").over(until))
        .withColumn("caught", F.sum("bad").over(until))
        .withColumn("n", F.sum("good").over(Window.partitionBy("stratum")))
        .where(f"step <= {LAST_STEP} and n > 0 and caught > 0")
    )
    # Rejections only grow along the chain, so no step after a failed one passes.
    safe = tested.crossJoin(F.broadcast(strata)).where(  # one row
        binomial_tail("rejected", "n", RISK) <= F.lit(ERROR) / F.col("strata")
    )
    best = F.max(F.struct("caught", -F.col("step")))
    return safe.groupBy("stratum").agg((-best["col2"]).alias("last_step"))


def cutoffs(steps: DataFrame) -> DataFrame:
    """``safe_steps`` with the share from which each rule rejects."""
    moved = {
        rule: (CELLS - F.floor(F.col("last_step") * (CELLS - strictest) / F.lit(LAST_STEP))) / F.lit(CELLS)
        for rule, strictest in STRICTEST.items()
    }
    return steps.withColumns(moved)


def judged(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The measures of every row with base_failed and the verdict ``kept``."""
    measures = written(measured(docs, stratum), "measures")
    chosen = written(safe_steps(measures, labels), "safe_steps")
    broken = F.coalesce(F.col("step") <= F.col("last_step"), F.lit(False))
    return measures.join(chosen, "stratum", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", (~F.col("base_failed") & ~broken).alias("kept"),
    )
