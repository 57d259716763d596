"""What a Python task holds at most, however many different words its texts have."""

import tracemalloc
from types import SimpleNamespace

import numpy as np

from latelane.llm import jaccard_join, language_id, quality_classifier

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def texts(words: int, each: int = 2000):
    """Texts whose words all differ, made as they are read."""
    for start in range(0, words, each):
        numbers = range(start, min(start + each, words))
        yield " ".join("".join(LETTERS[n // 26**k % 26] for k in range(5)) + "end" for n in numbers)


def task(module, monkeypatch, build):
    """The function of a task that ``build()`` makes, from what it gives to map_rows."""
    made = []

    def noted(df, schema, make, *args, **kwargs):
        made.append(make)
        return df.sparkSession.createDataFrame([], schema)

    monkeypatch.setattr(module, "map_rows", noted)
    build()
    return made[0]()


def peak_mb(run) -> float:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def read(each, rows) -> int:
    found = sum(1 for row in rows for _ in each(*row))
    return found + sum(1 for _ in each.end())


def test_counting_n_grams_of_many_words(odd, monkeypatch):
    each = task(language_id, monkeypatch, lambda: language_id.gram_counts(odd, odd["lang"]))
    assert peak_mb(lambda: read(each, ((text, "en") for text in texts(320_000)))) < 150


def test_n_grams_counted_in_parts_are_all_counted(odd, monkeypatch):
    def counted():
        rows = language_id.gram_counts(odd, odd["lang"]).collect()
        return sorted((str(r["group"]), r["gram"], r["n"]) for r in rows)

    whole = counted()
    monkeypatch.setattr(language_id, "COUNTED_WORDS", 50)
    monkeypatch.setattr(language_id, "HELD_GRAMS", 100)
    assert counted() == whole


def test_scoring_many_words():
    scorer = language_id.Scorer(language_id.Model(["a", "b", "c", "d"]))
    scorer.hashes = np.unique(language_id.hashed(language_id.word_grams([*LETTERS])[0]))
    scorer.log_p = np.zeros((len(scorer.hashes) + 1, 4))

    def run():
        for text in texts(320_000):
            scorer.cold.clear()
            scorer.sums([text])

    assert peak_mb(run) < 40


def test_features_of_many_words():
    features = quality_classifier.Features()
    assert peak_mb(lambda: [features.of(text) is None for text in texts(320_000)]) < 28


def test_sharing_a_slice_of_shingles(odd, monkeypatch):
    class InTask:
        @staticmethod
        def get():
            return SimpleNamespace(partitionId=lambda: 0)

    monkeypatch.setattr(jaccard_join, "TaskContext", InTask)
    each = task(jaccard_join, monkeypatch, lambda: jaccard_join._class_scan(odd, 0, 24))
    rows = [(i, text) for i, text in enumerate(texts(1_500_000, 5000))]
    assert peak_mb(lambda: read(each, rows)) < 32
