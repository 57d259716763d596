"""Exact duplicates by content-defined chunk recipes.

A text (A-Z lower-cased, null as empty) is cut where a rolling hash of its bytes meets a
condition, so equal texts are cut alike. A recipe is the ordered list of a text's chunk
identifiers. Chunks are deduplicated first: each task sends a chunk's bytes at most once,
with its 64-bit hash as identifier, and a hash that two different contents share is told
apart by a number, so an identifier stands for exactly one content. After that only
recipes move, never documents. Equal recipes are equal texts.

Of equal texts the row with the largest doc_id stays. A doc_id may repeat: rows with the
largest doc_id of a group all stay. A null doc_id counts as smaller than any other; a
group of null ids only keeps its rows and has a null keep_id. Empty tables give empty
tables; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from latelane.llm.common import lower_ascii, map_rows, written

MASK_BITS = 11  # chunks of about 2 KiB
LEAST, MOST = 256, 16384  # bytes of a chunk
GEAR_BYTES = 16  # bytes that decide about a cut
_BLOCK = 1 << 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _gear() -> np.ndarray:
    """A fixed pseudo-random number per byte value."""
    hashed = [xxhash.xxh32_intdigest(bytes([b]), seed=7) for b in range(256)]
    return np.array(hashed, np.uint32)


GEAR = _gear()


def _cut_places(data: np.ndarray) -> np.ndarray:
    """Places after which the last ``GEAR_BYTES`` bytes ask for a cut."""
    rolled = GEAR[data]
    reach = 1
    while reach < GEAR_BYTES:  # each step doubles the bytes a place has seen
        longer = rolled.copy()
        longer[reach:] += rolled[:-reach] << np.uint32(reach)
        rolled, reach = longer, 2 * reach
    # The upper of the bits that all GEAR_BYTES bytes reach.
    mask = np.uint32(((1 << MASK_BITS) - 1) << (GEAR_BYTES - MASK_BITS))
    return np.flatnonzero((rolled & mask) == 0) + 1


def chunks(data: bytes) -> Iterator[bytes]:
    """Chunks of ``data`` in order; the same bytes always give the same chunks."""
    start, n = 0, len(data)
    array = np.frombuffer(data, np.uint8)
    for block in range(0, n, _BLOCK):
        # Overlap, so that places near a block's start see all bytes that decide.
        first = max(0, block - GEAR_BYTES)
        for cut in (_cut_places(array[first : block + _BLOCK]) + first).tolist():
            if cut <= block and block:
                continue
            while cut - start > MOST:
                yield data[start : start + MOST]
                start += MOST
            if cut - start >= LEAST:
                yield data[start:cut]
                start = cut
    while n - start > MOST:
        yield data[start : start + MOST]
        start += MOST
    if start < n:
        yield data[start:]


def chunk_hash(chunk: bytes) -> int:
    return xxhash.xxh3_64_intdigest(chunk) - (1 << 63)


def _normalised(text: str | None) -> bytes:
    return lower_ascii(text or "").encode()


def chunk_store(docs: DataFrame) -> DataFrame:
    """(hash, content) of all chunks, one row per content."""

    def make():
        sent: dict[int, int] = {}

        def each(text):
            for chunk in chunks(_normalised(text)):
                h, length = chunk_hash(chunk), len(chunk)
                # A second, independent hash keeps unequal contents from being taken as sent.
                check = xxhash.xxh64_intdigest(chunk, seed=1)
                if sent.get(h) == check:
                    continue
                if len(sent) >= 200_000:
                    sent.clear()
                sent[h] = check
                yield h, chunk

        return each

    rows = map_rows(
        docs.select("text"), "hash bigint, content binary", make, size=lambda r: len(r[1])
    )
    return rows.groupBy("hash", "content").agg(F.lit(1).alias("one")).drop("one")


def colliding(store: DataFrame) -> DataFrame | None:
    """(hash, content, number) of the contents that share a hash with another one, if any.

    The expected number of such hashes is the square of the number of contents by 2^65.
    """
    counted = store.groupBy("hash").agg(F.count("*").alias("n"))
    shared = written(counted.where("n > 1").select("hash"), "shared_hashes")
    if shared.isEmpty():
        return None
    contents = written(store.join(shared, "hash"), "shared_contents")
    # Number = how many of the few contents of this hash are smaller.
    other = contents.select("hash", F.col("content").alias("other"))
    return (
        contents.join(other, "hash")
        .groupBy("hash", "content")
        .agg(F.sum((F.col("other") < F.col("content")).cast("bigint")).alias("number"))
    )


def recipes(docs: DataFrame, numbers: DataFrame | None = None) -> DataFrame:
    """(doc_id, text_sha256, recipe) per row; ``numbers`` tells colliding contents apart."""
    told_apart: dict[tuple[int, bytes], int] = {}
    if numbers is not None:
        # Two contents in 2^65 / contents^2 share a hash, so these are a handful.
        told_apart = {(r["hash"], bytes(r["content"])): r["number"] for r in numbers.collect()}

    def make():
        def each(doc_id, text):
            data = _normalised(text)
            identifiers = []
            for chunk in chunks(data):
                h = chunk_hash(chunk)
                identifiers.append(h.to_bytes(8, "big", signed=True))
                if told_apart and (number := told_apart.get((h, chunk))):
                    identifiers.append(b"#" + number.to_bytes(7, "big"))
            yield doc_id, hashlib.sha256(data).hexdigest(), b"".join(identifiers)

        return each

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_sha256 string, recipe binary"
    return map_rows(docs.select("doc_id", "text"), schema, make, size=lambda r: len(r[2]))


def duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of ``docs``."""
    listed = written(recipes(docs, colliding(chunk_store(docs))), "recipes")
    groups = written(
        listed.groupBy("recipe").agg(
            F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")
        ),
        "recipe_groups",
    )
    return listed.join(groups, "recipe").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )
