"""Fill-in-the-middle: prefix, middle and suffix of a text in another order, with marks.

A text is cut into units, words with the white space before them, and white space at its end
as a unit of its own. The ends of the units are kept in a boundary set made like a Roaring
bitmap: positions are split by their high bits into containers of 65,536, each a sorted
array, a bitmap or a list of runs, whichever is smallest, with cumulative cardinalities over
the containers. The k-th boundary is a search among the cumulative cardinalities and a select
inside one container, so a cut costs no pass over the text and a text of any length is read
in windows.

Cuts and forms come from the SHA-256 of a seed and the row's id alone, so they do not depend
on how the table is dealt. Forms: ``plain`` (the text as it is), ``psm`` (prefix, suffix,
middle) and ``spm`` (suffix, prefix, middle). A text that holds one of the marks stays plain,
so that every output can be taken apart again.

Null and empty texts are plain, with no units and an empty output; a null id is hashed as an
empty one; rows with equal ids are cut alike, each by its own number of units. Only doc_id and
text are read, so other columns may have any name; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from latelane.llm.common import map_rows

SEED = 42
RATE = 50  # per cent of texts that are not left plain
SPM_RATE = 80  # per cent of those that get the suffix first
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"  # fixed values
MARKS = "<[PSM]>"

_HIGH = 16
_SPAN = 1 << _HIGH


class ArrayContainer:
    """Sorted positions, two bytes each."""

    def __init__(self, positions: np.ndarray):
        self.positions = positions.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.positions[k])


class BitmapContainer:
    """A bit per position, and how many bits are set before each word of 64."""

    def __init__(self, positions: np.ndarray):
        bits = np.zeros(_SPAN, np.uint8)
        bits[positions] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(bits.reshape(-1, 64).sum(axis=1, dtype=np.int64))])

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, side="right")) - 1
        bits = np.unpackbits(self.words[word : word + 1].view(np.uint8), bitorder="little")
        return 64 * word + int(np.flatnonzero(bits)[k - self.before[word]])


class RunContainer:
    """First positions of runs of neighbours, and how many positions lie before each run."""

    def __init__(self, positions: np.ndarray):
        first = np.flatnonzero(np.diff(positions, prepend=-2) != 1)
        self.starts = positions[first].astype(np.uint16)
        self.before = first

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.starts[run]) + k - int(self.before[run])


def container(positions: np.ndarray):
    """The smallest container for sorted positions below 65,536."""
    runs = 1 + int((np.diff(positions) != 1).sum())
    sizes = {ArrayContainer: 2 * len(positions), RunContainer: 4 * runs, BitmapContainer: _SPAN // 8}
    return min(sizes, key=sizes.get)(positions)


class BoundarySet:
    """The offsets (code points) at which the units of a text end, in order."""

    def __init__(self, text: str):
        self.keys: list[int] = []
        self.containers: list = []
        total, cumulative = 0, [0]
        for key, start in enumerate(range(0, len(text), _SPAN)):
            # One character more shows whether the window's last one ends a unit.
            window = text[start : start + _SPAN + 1].encode("utf-32-le", "surrogatepass")
            points = np.frombuffer(window, "<u4")
            space = (points == 0x20) | ((points >= 0x09) & (points <= 0x0D))
            ends = ~space[:-1] & space[1:]
            if start + len(points) == len(text) and len(points) <= _SPAN:
                ends = np.append(ends, True)
            positions = np.flatnonzero(ends)
            if len(positions):
                self.keys.append(key)
                self.containers.append(container(positions))
                total += len(positions)
                cumulative.append(total)
        self.cumulative = np.array(cumulative)

    def __len__(self) -> int:
        return int(self.cumulative[-1])

    def offset(self, units: int) -> int:
        """Where the first ``units`` units end."""
        if not units:
            return 0
        at = int(np.searchsorted(self.cumulative, units - 1, side="right")) - 1
        low = self.containers[at].select(units - 1 - int(self.cumulative[at]))
        return (self.keys[at] << _HIGH) + low + 1


@dataclass(frozen=True)
class Plan:
    """What decides cuts and forms."""

    seed: int = SEED
    rate: int = RATE
    spm_rate: int = SPM_RATE

    def draws(self, key) -> list[int]:
        digest = hashlib.sha256(f"{self.seed}:{'' if key is None else key}".encode()).hexdigest()
        return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]

    def apply(self, key, text: str) -> tuple:
        """(units, form, prefix and middle in code points or None, output)."""
        ends = BoundarySet(text)
        n = len(ends)
        one, two, change, order = self.draws(key)
        if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or change % 100 >= self.rate:
            return n, "plain", None, None, text
        first, last = sorted((ends.offset(one % (n + 1)), ends.offset(two % (n + 1))))
        prefix, middle, suffix = text[:first], text[first:last], text[last:]
        if order % 100 < self.spm_rate:
            form, output = "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
        else:
            form, output = "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
        return n, form, first, last - first, output


def transformed(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every row of ``docs``."""

    def make():
        return lambda doc_id, text: [(doc_id, *plan.apply(doc_id, text or ""))]

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    return map_rows(docs.select("doc_id", "text"), schema, make, size=lambda r: 4 * len(r[-1]))


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made of."""
    parts = F.split(F.col(output), MARKS, -1)
    prefix = F.when(F.col(form) == "psm", parts[1]).otherwise(parts[2])
    suffix = F.when(F.col(form) == "psm", parts[2]).otherwise(parts[1])
    return F.when(F.col(form) == "plain", F.col(output)).otherwise(F.concat(prefix, parts[3], suffix))


def digests(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """``transformed`` with SHA-256 of the output and of the text restored from it."""
    rows = transformed(docs, plan)
    return rows.select(
        *[c for c in rows.columns if c != "output"],
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored().cast("binary"), 256).alias("restored_sha256"),
    )
