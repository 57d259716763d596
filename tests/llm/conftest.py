import pytest

# The same documents for all operators: nulls, empty and very long texts, ties, repeated
# rows, a null id, and columns that clash with the operators' own names.
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards brew a potion at dawn"


def odd_rows():
    near = PROSE.split()
    rows = [
        (1, PROSE, "en", "s0"),
        (2, PROSE.upper(), "en", "s0"),
        (3, PROSE, None, None),
        (3, PROSE, None, None),
        (4, None, "en", "s1"),
        (5, "", "de", "s1"),
        (6, " \n\t ", None, "s2"),
        (7, "### $$$ 123 !!!", "en", None),
        (8, " ".join([*near[:-1], "dusk"]), "en", "s3"),
        (9, " ".join(["w%d" % (i * i % 977) for i in range(30_000)]), "en", "s3"),
        (10, "x" * 70_000, "en", "s4"),
        (11, "Größe " * 3000, "de", "s4"),
        (12, "a b c", "en", "s4"),
        (13, "line\n" * 40, "en", "s4"),
        (None, PROSE + " tail", "en", "s5"),
        (14, "日本語のテキスト 😀   \x85 end", None, "s5"),
        (15, "Licensed under the MIT License. Apache License, Version 2.0; CC BY-NC cc by nc", "en", "s6"),
        (16, "a<|endoftext|>b  two  spaces \r\n", "en", "s6"),
    ]
    clash = ("x", 1, True, 0.5)
    return [(*r, *clash) for r in rows]


SCHEMA = (
    "doc_id bigint, text string, lang string, source string, "
    "words string, n_words int, kept boolean, score double"
)


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")
