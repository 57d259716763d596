"""Seeded, engine-independent hash keys used to order rows at random."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def hash_text(keys: Sequence[str], seed: int) -> Column:
    """md5 of the keys (nulls as '') and the seed, as hex text."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    return F.md5(F.concat_ws("#", *parts, F.lit(str(seed))))


def hash_number(text: Column) -> Column:
    """The first 13 hex digits as a number (52 bits, exact in a double)."""
    return F.conv(F.substring(text, 1, 13), 16, 10).cast("double")
