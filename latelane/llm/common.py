"""What the text operators share: Arrow batches in, rows out, and written tables."""

from __future__ import annotations

import re
import shutil
import tempfile
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from latelane.sources.scratch import written

__all__ = ["WORDS", "add_columns", "cleared", "documents", "file_bytes", "lower_ascii", "map_rows", "table", "with_package", "written"]

# Runs of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORDS = re.compile(r"[^\x20\x09-\x0D]+")

BATCH_BYTES = 1 << 20

_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def lower_ascii(text: str) -> str:
    """A-Z to a-z, everything else as it is."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


@cache
def _shipped(application: str) -> None:
    package = Path(__file__).resolve().parents[1]
    archive = f"{tempfile.mkdtemp(prefix='latelane-')}/latelane"
    path = shutil.make_archive(archive, "zip", package.parent, package.name)
    SparkSession.active().sparkContext.addPyFile(path)


def with_package(df: DataFrame) -> DataFrame:
    """``df`` ready for Python tasks of this package.

    Executors get a copy of the package (once). Batches of texts are held to ``BATCH_BYTES``
    in the session, since the JVM and the worker both keep a batch and its buffers.
    """
    spark = df.sparkSession
    _shipped(spark.sparkContext.applicationId)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def file_bytes(path: str) -> bytes:
    """A vocabulary file, read on the driver (a few MB; tasks get its bytes)."""
    return Path(path).read_bytes()


def map_rows(
    df: DataFrame,
    schema: str,
    make: Callable[[], Callable[..., Iterable[tuple]]],
    flush_rows: int = 4096,
    flush_bytes: int = BATCH_BYTES,
    size: Callable[[tuple], int] | None = None,
) -> DataFrame:
    """Rows of ``schema`` that ``make()``'s function yields for each row of ``df``.

    ``make`` runs once per task. Its function gets the row's values in column order; if it
    has an attribute ``end``, that is called after the last row and may yield more rows.
    Output leaves in batches of at most ``flush_rows`` rows or about ``flush_bytes``.
    """
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        held: list[tuple] = []
        held_bytes = 0

        def batch() -> pa.RecordBatch:
            columns = list(zip(*held)) if held else [()] * len(arrow)
            arrays = [pa.array(c, f.type) for c, f in zip(columns, arrow)]
            return pa.RecordBatch.from_arrays(arrays, schema=arrow)

        def rows() -> Iterator[tuple]:
            for b in batches:
                columns = [b.column(i) for i in range(b.num_columns)]
                for start in range(0, b.num_rows, 256):
                    for values in zip(*(c.slice(start, 256).to_pylist() for c in columns)):
                        yield from each(*values)
            if hasattr(each, "end"):
                yield from each.end()

        for row in rows():
            held.append(row)
            held_bytes += size(row) if size else 0
            if len(held) >= flush_rows or held_bytes >= flush_bytes:
                yield batch()
                held, held_bytes = [], 0
        if held:
            yield batch()

    return with_package(df).mapInArrow(run, fields)


def add_columns(
    df: DataFrame,
    inputs: Sequence[str],
    schema: str,
    make: Callable[[], Callable[..., list[tuple]]],
    rows_each: int = 1024,
    without: Sequence[str] = (),
) -> DataFrame:
    """``df`` with the columns of ``schema``, in place of columns of these names and ``without``.

    ``make`` runs once per task. Its function gets a list per input column, of up to
    ``rows_each`` rows, and returns a tuple per row.
    """
    added = StructType.fromDDL(schema)
    kept = cleared(df, [*added.names, *without])
    # The inputs are read before columns that clash are dropped.
    used = [F.col(c).alias(f"_input{i}") for i, c in enumerate(inputs)]
    rows = df.select(*used, *[F.col(f"`{c}`") for c in kept.columns])
    fields = StructType([*kept.schema.fields, *added.fields])
    arrow, n = to_arrow_schema(added), len(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_slice = make()
        for batch in batches:
            for start in range(0, batch.num_rows, rows_each):
                part = batch.slice(start, rows_each)
                found = of_slice(*(part.column(i).to_pylist() for i in range(n)))
                new = [pa.array(c, f.type) for c, f in zip(zip(*found), arrow)]
                old = [part.column(i) for i in range(n, part.num_columns)]
                yield pa.RecordBatch.from_arrays([*old, *new], names=fields.names)

    return with_package(rows).mapInArrow(run, fields)


def cleared(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` without columns that a result of these names would clash with."""
    taken = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])
