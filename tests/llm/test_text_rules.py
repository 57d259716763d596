"""Language, quality and licence operators against brute force and held-out rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from latelane.llm import language_id, license_scan, quality_classifier, quality_rules
from latelane.llm.common import lower_ascii

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")


def test_held_out_languages_are_found(given):
    docs, _ = given
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held_out = [r for r in rows if r["held_out"]]
    assert len(rows) == docs.count() and len(held_out) > 100
    assert sum(r["lang"] == r["lang_pred"] for r in held_out) >= 0.98 * len(held_out)
    assert all(0 <= r["score"] <= 1 for r in rows)
    rejected = [r for r in rows if r["score"] < language_id.REJECT_BELOW]
    assert len(rejected) <= 0.01 * len(rows)


def kneser_ney(counts, alphabet):
    """P(last | rest) for one language by the textbook recursion, nothing pruned."""
    tables = {language_id.ORDER: counts}
    for size in range(language_id.ORDER - 1, 0, -1):
        tables[size] = Counter(g[1:] for g in tables[size + 1])

    def discount(size):
        cells = Counter(tables[size].values())
        return cells[1] / (cells[1] + 2 * cells[2]) if cells[1] and cells[2] else 0.5

    def p(gram):
        size = len(gram)
        below = p(gram[1:]) if size > 1 else 1 / alphabet
        same = {g: n for g, n in tables[size].items() if g[:-1] == gram[:-1]}
        total = sum(same.values())
        if not total:
            return below
        d = discount(size)
        rest = 1 - sum(max(n - d, 0) for n in same.values()) / total
        return max(tables[size].get(gram, 0) - d, 0) / total + rest * below

    return p


def test_probabilities_are_kneser_neys(spark):
    texts = ["banana bandana", "an ant and a nab", "Canada, and Anna!"]
    docs = spark.createDataFrame([(t, "xx") for t in texts] + [("zz zz", "yy")], "text string, lang string")
    model = language_id.train(docs)
    counts = Counter()
    for text in texts:
        for word in text.split():
            for run in language_id.letter_runs(word):
                padded = f"{language_id.PAD}{run} "
                counts.update(padded[i : i + 5] for i in range(len(run) + 1))
    alphabet = len({g[-1] for g in counts} | set("z ")) + 1
    p = kneser_ney(counts, alphabet)
    scorer = language_id.Scorer(model)
    at = model.langs.index("xx")
    for word in ("banana", "nada", "cab", "ants"):
        scorer.learn({word})
        row = scorer.table[scorer.places[word]]
        padded = f"{language_id.PAD}{word} "
        expected = sum(math.log(p(padded[i : i + 5])) for i in range(len(word) + 1))
        assert row[-1] == len(word) + 1
        assert row[at] == pytest.approx(expected, rel=1e-4)


def test_rare_grams_of_a_rich_language_count(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(14_000)]
    docs = spark.createDataFrame([(" ".join(words[i::50]), "xx") for i in range(50)], "text string, lang string")
    counts = Counter()
    for word in words:
        padded = f"{language_id.PAD}{word} "
        counts.update(padded[i : i + 5] for i in range(9))
    assert len(counts) > 70_000  # with most of them once
    p = kneser_ney(counts, 28)
    scorer = language_id.Scorer(language_id.train(docs))
    scorer.learn({words[0]})
    padded = f"{language_id.PAD}{words[0]} "
    expected = sum(math.log(p(padded[i : i + 5])) for i in range(9))
    assert scorer.table[scorer.places[words[0]]][0] == pytest.approx(expected, rel=1e-4)


def test_words_that_tasks_do_not_hold_score_the_same(odd, monkeypatch):
    def found():
        rows = language_id.predict(odd, language_id.fitted(odd)).collect()
        return sorted((str(r["doc_id"]), r["lang_pred"], round(r["entropy"] or 0, 9)) for r in rows)

    held = found()
    monkeypatch.setattr(language_id, "HOT_WORDS", 0)
    assert found() == held


def test_what_fits_no_language_is_rejected_on_small_inputs(given, spark):
    docs = given[0].select("doc_id", "text", F.when(F.col("lang") != "fr", F.col("lang")).alias("lang"))
    rng = random.Random(5)

    def noise():
        return " ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz", k=7)) for _ in range(40))

    strange = spark.createDataFrame([(f"n{i}", noise()) for i in range(40)], "doc_id string, text string")
    model = language_id.fitted(docs)
    known = docs.select(F.col("doc_id").cast("string"), "text").unionByName(strange)
    rows = language_id.predict(known, model)
    true = given[0].select(F.col("doc_id").cast("string"), "lang", language_id.fold().alias("fold"))
    rows = rows.join(true, "doc_id", "left").collect()

    def rejected(of):
        of = list(of)
        return sum(r["score"] < language_id.REJECT_BELOW for r in of) / len(of)

    assert rejected(r for r in rows if r["doc_id"].startswith("n")) == 1
    assert rejected(r for r in rows if r["lang"] == "fr") > 0.9
    clean = [r for r in rows if r["lang"] in ("de", "en", "es") and r["fold"] == language_id.HELD_OUT]
    assert len(clean) > 50 and rejected(clean) <= 0.02


def test_languages_of_odd_rows(odd, nothing):
    rows = {r["doc_id"]: r for r in language_id.identify(odd).collect()}
    assert len(language_id.identify(odd).collect()) == odd.count()
    for doc_id in (4, 5, 6, 7):
        assert (rows[doc_id]["lang_pred"], rows[doc_id]["score"]) == ("und", 0.0)
    assert rows[1]["lang_pred"] in {"en", "de", "und"}
    assert language_id.identify(nothing).count() == 0
    unlabelled = odd.withColumn("lang", odd["lang"].substr(1, 0)).replace("", None, ["lang"])
    assert {r["lang_pred"] for r in language_id.identify(unlabelled).collect()} == {"und"}
    passed = language_id.predict(odd, language_id.fitted(odd))
    assert sorted(passed.columns) == sorted({*odd.columns, "lang_pred", "score", "entropy"})


def test_toxic_rows_go_and_good_ones_stay(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_classifier.classified(docs, labels).join(quality_classifier.graded(labels), "doc_id")
    rows = rows.withColumn("held_out", quality_classifier._fold() == 0).collect()

    def kept(grade):
        of = [r["kept"] for r in rows if r["held_out"] and r["grade"] == grade]
        return sum(of) / len(of)

    assert kept(0) < 0.15 and kept(2) > 0.98 and kept(1) < kept(2)
    assert all(0 <= r["tail_prob"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in rows)


def test_ordinal_fit_recovers_the_order():
    rng = np.random.default_rng(1)
    grades = rng.integers(0, 3, 900)
    lists = [np.unique(np.r_[rng.integers(50, 80, 5), 10 * g + rng.integers(0, 4, 2)]) for g in grades]
    weights, cuts = quality_classifier.fit(np.concatenate(lists), np.array([len(x) for x in lists]), grades)
    assert cuts[0] < cuts[1]
    scores = np.array([weights[x].sum() for x in lists])
    assert (np.digitize(scores, cuts) == grades).mean() > 0.97


def test_fit_does_not_depend_on_the_order_of_texts():
    rng = np.random.default_rng(2)
    grades = rng.integers(0, 3, 300)
    lists = [np.unique(np.r_[rng.integers(5, 9, 2), g]) for g in grades]
    order = rng.permutation(300)
    one = quality_classifier.fit(np.concatenate(lists), np.array([len(x) for x in lists]), grades)
    two = quality_classifier.fit(
        np.concatenate([lists[i] for i in order]), np.array([len(lists[i]) for i in order]), grades[order]
    )
    assert np.allclose(one[0], two[0]) and np.allclose(one[1], two[1])


def brute_features(text):
    words = (text or "").split()
    letters = {w: re.sub(r"[\W\d_]", "", w) for w in words}
    found = {"word " + x.lower() for x in letters.values()} | {"stem " + x[:5].lower() for x in letters.values()}
    n, d, length = max(1, len(words)), max(1, len(letters)), len(words).bit_length()
    capitals = sum(len(x) > 1 and x.isupper() for x in letters.values())
    symbols = sum(any(c in "#*$%&|<>@{}[]=~^\\" for c in w) for w in letters)
    repeats = sum(words[i] == words[i + 1] for i in range(len(words) - 1))
    found |= {f"class length {length}", f"class capitals {10 * capitals // d}", f"class symbols {10 * symbols // d}"}
    found |= {f"class repeats {20 * repeats // n}", f"class distinct {10 * len(letters) // n} of {min(length, 12)}"}
    return {quality_classifier.bucket(x) for x in found}


def likelihoods(score, cuts):
    """P(grade = 0), P(grade = 1), ... from the cumulative logits, one by one."""
    below = [0.0, *(1 / (1 + math.exp(score - c)) for c in cuts), 1.0]
    return [b - a for a, b in zip(below, below[1:])]


def test_query_equals_grade_probabilities_worked_out_row_by_row(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_classifier.train(docs, labels)
    assert np.count_nonzero(model.weights) > 10
    found = {r["doc_id"]: r for r in quality_classifier.classified(docs, labels).collect()}
    assert len(found) == docs.count()
    for row in docs.select("doc_id", "text").collect():
        score = sum(model.weights[b] for b in brute_features(row["text"]))
        p = likelihoods(score, model.thresholds)
        result = found[row["doc_id"]]
        assert result["expected_grade"] == pytest.approx(sum(k * x for k, x in enumerate(p)), abs=1e-9)
        assert result["tail_prob"] == pytest.approx(p[-1], abs=1e-9)
        assert result["kept"] == (p[-1] >= model.cutoff) or abs(p[-1] - model.cutoff) < 1e-9


def test_fit_is_a_minimum_of_the_loss_summed_text_by_text():
    rng = np.random.default_rng(3)
    grades = rng.integers(0, 3, 400)
    lists = [np.unique(np.r_[rng.integers(20, 23, 1), g if rng.random() < 0.7 else rng.integers(0, 3)]) for g in grades]
    sizes = np.bincount(grades)

    def loss(weights, cuts):
        total = sum(
            -math.log(max(likelihoods(weights[x].sum(), cuts)[g], 1e-9)) / (3 * sizes[g]) for x, g in zip(lists, grades)
        )
        gap = math.log(cuts[1] - cuts[0])
        return total + quality_classifier.DECAY / 2 * (weights**2).sum() + 5e-5 * ((cuts[0] + 1) ** 2 + gap**2)

    weights, cuts = quality_classifier.fit(np.concatenate(lists), np.array([len(x) for x in lists]), grades)
    best, used = loss(weights, cuts), np.flatnonzero(weights)
    assert best < 0.8 * loss(np.zeros_like(weights), np.array([-1.0, 0.0])) and set(used) >= {0, 1, 2}
    for _ in range(60):
        moved = weights.copy()
        moved[used] += rng.normal(0, 0.2, len(used))
        assert loss(moved, cuts + rng.normal(0, 0.1, 2)) > best - 1e-4


def test_every_labelled_row_takes_part_in_the_fit(spark, monkeypatch):
    rng = random.Random(6)
    ids = spark.range(16_500).select(F.col("id").alias("doc_id"))
    ids = ids.where(quality_classifier._fold() != 0).orderBy(F.xxhash64("doc_id"))
    ids = [r["doc_id"] for r in ids.collect()]
    words = ("nasty", "sloppy", "sound")
    rows = []
    for place, i in enumerate(ids):
        grade = place % 3
        own = rng.choice(words) if rng.random() < 0.2 else words[grade]
        late = " latecomer" if place >= 12_000 and grade == 0 else ""  # past 4,000 of each grade
        rows.append((i, f"some {own} text{late}", int(grade > 1), int(grade == 0)))
    data = spark.createDataFrame(rows, "doc_id bigint, text string, quality int, toxic int").repartition(4)
    docs, labels = data.select("doc_id", "text"), data.drop("text")
    model = quality_classifier.train(docs, labels)
    assert model.weights[quality_classifier.bucket("word latecomer")] < -0.1

    features = quality_classifier.Features()
    lists = [features.of(text) for _, text, _, _ in rows]
    grades = np.array([0 if toxic else 1 + quality for _, _, quality, toxic in rows])
    weights, cuts = quality_classifier.fit(np.concatenate(lists), np.array([len(x) for x in lists]), grades)
    assert np.allclose(model.weights, weights, atol=1e-6) and np.allclose(model.thresholds, cuts, atol=1e-6)
    monkeypatch.setattr(quality_classifier, "RATINGS_EACH", 5000)
    assert np.allclose(quality_classifier.train(docs, labels).weights, weights, atol=1e-6)


def test_buckets_with_a_weight_reach_the_driver_as_arrow(spark, monkeypatch):
    rng = np.random.default_rng(8)
    grades = rng.integers(0, 3, 3000)
    lists = [np.unique(np.r_[rng.integers(0, 40, 6), 100 + g * rng.integers(0, 2)]) for g in grades]
    sizes = np.bincount(grades, minlength=3)
    texts = np.zeros((3, quality_classifier.BUCKETS), np.int64)
    for g, x in zip(grades, lists):
        texts[g, x] += 1
    wanted = quality_classifier._columns(texts, sizes)
    assert 0 < len(wanted) < 43
    rows = [(int(g), x.tolist()) for g, x in zip(grades, lists)]
    rated = spark.createDataFrame(rows, "grade int, features array<int>")

    def refused(self):
        raise AssertionError("counts of all buckets and grades on the driver")

    monkeypatch.setattr(type(rated), "toPandas", refused)
    assert quality_classifier._weighted_buckets(rated, sizes).tolist() == wanted.tolist()
    weights, cuts = quality_classifier._fitted(rated)
    assert set(np.flatnonzero(weights)) <= set(wanted)


def test_words_of_any_script_get_their_letters_buckets():
    words = ["İstanbul", "ΟΔΟΣ", "ΣΟΦΟΣΑΣ", "naïve", "x²y", "a_b", "٣abc", "日本語", "C++", "$5", "USA", "e\u0301te\u0301"]
    found = quality_classifier.Features().of(" ".join(words))
    assert set(found.tolist()) == brute_features(" ".join(words)) and found.dtype == np.int32
    assert (np.diff(found) > 0).all()


def test_cutoff_is_the_quantile_of_all_held_out_good_rows(spark):
    rng = np.random.default_rng(7)
    model = quality_classifier.Model(np.linspace(-3, 3, quality_classifier.BUCKETS), np.array([-1.0, 0.5]), 0.0)
    lists = [sorted({int(x) for x in rng.integers(0, quality_classifier.BUCKETS, 3)}) for _ in range(6000)]
    good = spark.createDataFrame([(x,) for x in lists], "features array<int>")
    low, n = quality_classifier._good_limit(good, model)
    tails = [float(model.above(np.array(x))[-1]) for x in lists]
    assert n == 6000 and low == float(np.quantile(tails, quality_classifier.GOOD_LOST, method="lower"))


def test_classifier_on_odd_rows(odd, nothing):
    labels = odd.sparkSession.createDataFrame(
        [(1, 1, 0), (2, 0, 0), (9, None, 1), (None, 1, 0), (1, 1, 0), (77, 1, 0)],
        "doc_id bigint, quality int, toxic int",
    )
    for known in (labels, labels.where("false")):
        rows = quality_classifier.classified(odd, known).collect()
        assert len(rows) == odd.count()
    assert all(r["kept"] and r["tail_prob"] is None for r in rows)
    assert quality_classifier.classified(nothing, labels).count() == 0
    model = quality_classifier.train(odd, labels)
    assert set(quality_classifier.scored(odd, model).columns) == {*odd.columns, "expected_grade", "tail_prob"}


def brute_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            covered |= set(range(i, i + 5))
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), symbols, repeated, len(covered), failed


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def repetitive(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(60):
        words = rng.choices(["a", "b", "c", "d*", "é"], k=rng.randrange(0, 60))
        rows.append((i, "".join(w + rng.choice([" ", "\n", "\t ", " "]) for w in words), "en"))
    return rows


def test_base_measures(odd, spark):
    docs = odd.select("doc_id", "text", "lang").unionByName(
        spark.createDataFrame(repetitive(3), "doc_id bigint, text string, lang string")
    )
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    found = [tuple(r[c] for c in ("doc_id", *BASE)) for r in quality_rules.judged(docs, labels).collect()]
    expected = [(r["doc_id"], *brute_measures(r["text"])) for r in docs.collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)
    assert quality_rules.judged(odd.where("false"), labels).count() == 0


@pytest.mark.parametrize("risk", [quality_rules.RISK, 0.0025])
def test_binomial_tail(spark, risk):
    cases = [(0, 100), (3, 2000), (7, 8000), (0, 1), (40, 30_000), (25, 10_000), (2400, 1_000_000)]
    frame = spark.createDataFrame(cases, "k bigint, n bigint")
    for k, n, found in frame.select("k", "n", quality_rules.binomial_tail("k", "n", risk)).collect():
        if k >= n * risk:
            assert found == 1
            continue
        log = [
            math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1)
            + j * math.log(risk) + (n - j) * math.log1p(-risk)
            for j in range(k + 1)
        ]
        assert found == pytest.approx(sum(map(math.exp, log)), rel=1e-8)


def test_cutoffs_keep_the_promise(spark):
    """With good rows spread over the symbol share, no more than the risk may be rejected."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    rows, labels = [], []
    for i in range(9000):
        good = i % 3 > 0
        few = rng.random() < (0.0005 if good else 0.9)
        text = " ".join(w + "#" * (rng.randrange(1, 12) if few else 0) for w in rng.sample(words, 30))
        rows.append((i, text, None if i % 10 else "en"))
        labels.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    rated = spark.createDataFrame(labels, "doc_id bigint, quality int")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judged(docs, rated).collect()}
    lost = [i for i, good in labels if good and not kept[i]]
    caught = [i for i, good in labels if not good and not kept[i]]
    assert len(lost) <= quality_rules.RISK * 6000
    assert len(caught) >= 200
    few = quality_rules.judged(docs, rated.where("doc_id < 300"))
    assert few.where("not kept").count() == 0  # too few labels to be sure of any cutoff


def measures_of(spark, rows):
    """Rows of (doc_id, stratum, step, quality) as measures and labels."""
    frame = spark.createDataFrame(rows, "doc_id bigint, stratum string, step int, quality int")
    return frame.withColumn("base_failed", F.lit(False)), frame.select("doc_id", "quality")


def brute_last_step(good, bad, strata):
    best = None
    for step in range(quality_rules.LAST_STEP + 1):  # from mild to strict, until one fails
        k, n = sum(g <= step for g in good), len(good)
        tail = sum(math.comb(n, j) * 0.01**j * 0.99 ** (n - j) for j in range(k + 1))
        if tail > 0.05 / strata:
            break
        caught = sum(b <= step for b in bad)
        if caught and (best is None or caught > best[0]):
            best = (caught, step)
    return best and best[1]


def test_the_chain_stops_where_brute_force_does(spark):
    rng = random.Random(9)
    rows, expected = [], {}
    strata = [(f"s{i}", n) for i, n in enumerate((100, 435, 520, 700, 1500, 2500, 900, 0))]
    for name, n in strata:
        good = [rng.randrange(20, 64) if rng.random() < 0.008 else 64 for _ in range(n)]
        bad = [rng.randrange(0, 64) for _ in range(25)]
        expected[name] = brute_last_step(good, bad, len(strata)) if good else None
        rows += [(len(rows) + i, name, step, 1) for i, step in enumerate(good)]
        rows += [(len(rows) + i, name, step, 0) for i, step in enumerate(bad)]
    steps = quality_rules.safe_steps(*measures_of(spark, rows))
    found = {r["stratum"]: r["last_step"] for r in steps.collect()}
    assert found == {name: step for name, step in expected.items() if step is not None}
    assert len(found) >= 3
    for r in quality_rules.cutoffs(steps).collect():
        assert quality_rules.STRICTEST["symbols"] / 64 <= r["symbols"] <= 1


def test_few_hundred_good_rows_are_enough(spark):
    def rows(n):
        good = [(i, f"s{i % 4}", 64, 1) for i in range(4 * n)]
        return [*good, *((4 * n + i, f"s{i % 4}", 30, 0) for i in range(8))]

    assert quality_rules.safe_steps(*measures_of(spark, rows(437))).count() == 4
    assert quality_rules.safe_steps(*measures_of(spark, rows(436))).count() == 0


def test_the_promise_holds_over_many_draws(spark):
    """A share of 3 % of good rows beyond a step: over many strata drawn alike the step must
    almost never be passed, since each stratum's error is ``ERROR`` over their number."""
    rng = random.Random(10)
    rows = []
    for s in range(200):
        for _ in range(600):
            rows.append((len(rows), f"s{s}", 40 if rng.random() < 0.03 else 64, 1))
        rows += [(len(rows) + i, f"s{s}", step, 0) for i, step in enumerate([10, 50, 60])]
    found = quality_rules.safe_steps(*measures_of(spark, rows)).collect()
    assert all(r["last_step"] == 10 for r in found)


def test_rules_act_on_the_given_tables(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = quality_rules.judged(docs, labels).join(docs.select("doc_id", "lang"), "doc_id")
    rows = rows.join(labels.groupBy("doc_id").agg(F.min("quality").alias("quality")), "doc_id")
    counts = (
        rows.where("not base_failed").groupBy("lang")
        .agg(F.sum((~F.col("kept") & (F.col("quality") > 0)).cast("int")).alias("lost"),
             F.sum((~F.col("kept") & (F.col("quality") <= 0)).cast("int")).alias("caught"),
             F.sum((F.col("quality") > 0).cast("int")).alias("good"))
    )
    found = {r["lang"]: r for r in counts.collect()}
    for lang in ("en", "de", "fr"):
        assert found[lang]["caught"] > 0
        assert found[lang]["lost"] <= quality_rules.RISK * found[lang]["good"]


def brute_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(text or ""))
    found = []
    for phrase, label in license_scan.BASE.items():
        wanted = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(wanted)] == wanted]
    at = [i for i, _ in found]
    return (
        len(words), len(found), min(at, default=None), max(at, default=None),
        ",".join(sorted({label for _, label in found})),
    )


def test_license_places(odd, given):
    docs = given[0].select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    docs = docs.unionByName(
        odd.sparkSession.createDataFrame(
            [(900_001, "cc by nc cc by nc by nc CC-BY-NC" * 50), (900_002, "under the mit the mit license")],
            "doc_id bigint, text string",
        )
    )
    columns = ("n_words", "n_base", "first_word", "last_word", "base_labels")
    rows = license_scan.scanned(docs).collect()
    found = [(r["doc_id"], *(r[c] for c in columns)) for r in rows]
    expected = [(r["doc_id"], *brute_places(r["text"])) for r in docs.collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)
    assert all({"", *r["base_labels"].split(",")} <= {"", *r["labels"].split(",")} for r in rows)
    assert all((r["score"] == 1.0) >= (r["n_base"] > 0) for r in rows)


def test_own_labels(spark, nothing):
    gpl = dict((label, words) for label, words in license_scan.NOTICES if "option" in words)["gpl-3"]
    long = gpl.split()
    texts = {
        1: gpl.title() + ".",
        2: " ".join(long[:10] + ["really"] + long[10:25] + long[26:]),  # a word more, a word less
        3: " ".join(long[:12]),
        4: "All rights reserved",
        5: "all rights are reserved",
        6: "nothing to see",
        7: "this work is licensed under the GNU General Public License, version 3.",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    labels = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scanned(docs).collect()}
    assert labels[1] == ("gpl-3", 1.0)
    assert labels[2][0] == "gpl-3" and 0.8 <= labels[2][1] <= 1
    assert labels[3][0] == "" and 0 < labels[3][1] < 0.8
    assert labels[4] == ("proprietary", 1.0)
    assert labels[5] == ("", 0.0) and labels[6] == ("", 0.0)
    assert labels[7] == ("gpl-3", 1.0)
    assert license_scan.scanned(nothing).count() == 0
