"""Loading the nine tables from a folder of CSV or Parquet files."""

from __future__ import annotations

import csv
import io

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from latelane.schemas import CSV_STEMS, TABLES, required_columns
from latelane.sources.scratch import written

# Tables all of whose columns reach the enriched order table.
PASS_THROUGH = {"orders", "customers"}

# The texts read as "missing" in a CSV cell.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


class MissingInputsError(FileNotFoundError):
    """Some of the nine tables, or columns they need, are absent."""


def _csv_source(spark: SparkSession, path: str, multiline: bool) -> DataFrame:
    """All columns as text, in file order; quotes are doubled inside quoted text."""
    return spark.read.csv(
        path, header=True, multiLine=multiline, escape='"', enforceSchema=False, mode="PERMISSIVE"
    )


def _present(text: Column) -> Column:
    return F.when(~text.isin(MISSING_TOKENS), text)


def _is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def _parsed(text: Column, kind: T.DataType) -> Column:
    """The text as its declared type, null when it cannot be read as that."""
    if isinstance(kind, T.StringType):
        return text
    if _is_number(kind):
        return _number(text.try_cast("double"), kind)
    return text.try_cast(kind)


def _number(number: Column, kind: T.DataType) -> Column:
    """A double as the declared type: NaN is missing, a fraction is no whole number."""
    present = F.nanvl(number, F.lit(None).cast("double"))
    if isinstance(kind, T.IntegerType):
        return F.when(present == F.floor(present), present.try_cast("int"))
    return present


def _cell(name: str, given: T.DataType, kind: T.DataType | None) -> tuple[Column, Column]:
    """(whether a cell is present, its value) of a column, by one rule for CSV and Parquet.

    Columns that are not declared and ids of any type but text stay as they are.
    """
    cell = F.col(name)
    if isinstance(given, T.StringType):
        text = _present(cell)
        return text.isNotNull(), _parsed(text, kind or given)
    if kind is None or name.endswith("_id") or isinstance(kind, T.StringType):
        return cell.isNotNull(), cell if kind is None or name.endswith("_id") else cell.cast(kind)
    if _is_number(kind) and _is_number(given):
        number = cell.cast("double")
        return cell.isNotNull() & ~F.isnan(number), _number(number, kind)
    return cell.isNotNull(), cell.try_cast(kind)


def _spans_lines(spark: SparkSession, path: str) -> bool:
    """Whether a quoted cell holds a line break.

    Then some physical line has an odd number of quotes; one splittable pass tells.
    """
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line, value) of every CSV record, with the line breaks inside its quotes.

    Files are split between tasks at line breaks. A line begins inside quotes if an odd number
    of quotes stands before it in its file: quotes are counted per split, prefix sums over a
    file's splits give each one's starting state, running sums inside a split the state of
    each line. Only lines of records with a line break are moved and joined; the others are
    records already. ``line`` grows with the place in the file, inside a block.
    """
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        (quotes % 2).alias("odd"),
        "value",
    )
    lines = written(lines, "csv_lines")
    split = Window.partitionBy("file", "block").orderBy("line")
    within = F.sum("odd").over(split.rowsBetween(Window.unboundedPreceding, 0))
    # Per file as many rows as splits.
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = lines.groupBy("file", "block").agg(F.sum("odd").alias("odds"))
    starts = starts.select("file", "block", F.coalesce(F.sum("odds").over(ahead), F.lit(0)).alias("before"))
    counted = lines.select("file", "block", "line", "odd").withColumn("within", within)
    counted = counted.join(starts, ["file", "block"]).withColumn("upto", F.col("before") + F.col("within"))
    # Odd lines open and close records in turn, so the n-th record has the counts 2n-1 and 2n.
    torn = ((F.col("upto") - F.col("odd")) % 2 == 1) | (F.col("odd") == 1)
    number = F.floor((F.col("upto") + 1) / 2).alias("number")
    torn = written(counted.where(torn).select("line", number), "torn_lines")
    parts = lines.join(torn, "line").groupBy("file", "number").agg(
        F.array_sort(F.collect_list(F.struct("block", "line", "value"))).alias("parts")  # of one record
    )
    joined = F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("value")
    first = F.col("parts")[0]
    mended = parts.select("file", first["block"].alias("block"), first["line"].alias("line"), joined)
    whole = lines.join(torn, "line", "left_anti").select("file", "block", "line", "value")
    records = whole.unionByName(mended)
    # What is left of a carriage return before the line break.
    value = F.when(F.col("value").endswith("\r"), F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))
    return records.withColumn("value", value)


def _csv_by_quotes(spark: SparkSession, path: str) -> DataFrame:
    """As ``_csv_source``, from records that may span lines; the files have one header."""
    records = written(csv_records(spark, path), "csv_records")
    first = records.where("block = 0").groupBy("file").agg(F.min("line").alias("line"))
    first = written(records.join(first, ["file", "line"]).select("line", "value"), "csv_headers")
    headers = [r["value"] for r in first.select("value").distinct().limit(2).collect()]
    if len(headers) != 1:
        raise ValueError(f"the CSV files of {path} have different headers")
    names = next(csv.reader(io.StringIO(headers[0].removeprefix("\ufeff"), newline="")))
    schema = T.StructType([T.StructField(name, T.StringType()) for name in names])
    rows = records.join(first, "line", "left_anti").where(F.trim("value") != "")
    cells = F.from_csv("value", schema.toDDL(), {"escape": '"', "mode": "PERMISSIVE"})
    return rows.select(cells.alias("cells")).select("cells.*")


def _csv_table(spark: SparkSession, path: str, multiline: bool | None) -> DataFrame:
    """Raw text columns of one CSV table.

    The content decides whether records are put together from lines first, unless the caller
    does: ``multiline=True`` reads each file in one task, as Spark's own mode does.
    """
    if multiline is None and _spans_lines(spark, path):
        return _csv_by_quotes(spark, path)
    return _csv_source(spark, path, bool(multiline))


def _typed(raw: DataFrame, table: str) -> DataFrame:
    kinds = {f.name: f.dataType for f in TABLES[table].fields}
    given = {f.name: f.dataType for f in raw.schema.fields}
    return raw.select([_cell(c, given[c], kinds.get(c))[1].alias(c) for c in raw.columns])


def _open(
    spark: SparkSession, base: str, table: str, multiline: bool | None
) -> tuple[str, DataFrame] | None:
    """First of the accepted places that exists: table.parquet, table.csv, *stem.csv."""
    for kind, path in (
        ("parquet", f"{base}/{table}.parquet"),
        ("csv", f"{base}/{table}.csv"),
        ("csv", f"{base}/*{CSV_STEMS[table]}.csv"),
    ):
        try:
            if kind == "parquet":
                return kind, spark.read.parquet(path)
            return kind, _csv_table(spark, path, multiline)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    return None


def _absent(opened: dict[str, tuple[str, DataFrame] | None]) -> list[tuple[str, str | None]]:
    """(table, column) of what is needed and not there; no column for a whole table."""
    absent = [(t, None) for t, found in opened.items() if found is None]
    for table, found in opened.items():
        if found is not None:
            absent += [(table, c) for c in required_columns(table) if c not in found[1].columns]
    return absent


def missing_inputs(spark: SparkSession, base: str) -> DataFrame:
    """(table_name, column_name) of every table and needed column that ``base`` lacks; the
    column is null where the whole table is absent. No rows: ``load_tables`` will find all."""
    opened = {t: _open(spark, base.rstrip("/"), t, False) for t in TABLES}
    return spark.createDataFrame(_absent(opened), "table_name string, column_name string")


def _open_all(
    spark: SparkSession, base: str, multiline: bool | None
) -> dict[str, tuple[str, DataFrame]]:
    opened = {t: _open(spark, base.rstrip("/"), t, multiline) for t in TABLES}
    missing = [
        f"column {t}.{c}" if c else f"table {t} ({t}.parquet, {t}.csv or *{CSV_STEMS[t]}.csv)"
        for t, c in _absent(opened)
    ]
    if missing:
        raise MissingInputsError(f"missing in {base}: " + "; ".join(missing))
    return opened


def load_tables(
    spark: SparkSession, base: str, multiline: bool | None = None, convert: bool = False
) -> dict[str, DataFrame]:
    """The nine tables as lazy, typed DataFrames.

    Every table and needed column is checked first, and one error names all that is
    missing. A cell that cannot be read as its declared type becomes null, from CSV and
    Parquet alike; ``rejected_cells`` counts them. With ``convert`` CSV tables are written as Parquet
    first: text is then parsed once, and later scans are split and pruned. Of tables
    whose other columns do not pass through, only the needed ones are written.
    """

    def typed(table: str, kind: str, df: DataFrame) -> DataFrame:
        parsed = _typed(df, table)
        if kind != "csv" or not convert:
            return parsed
        needed = parsed.columns if table in PASS_THROUGH else required_columns(table)
        return written(parsed.select(needed), table)

    return {
        table: typed(table, kind, df)
        for table, (kind, df) in _open_all(spark, base, multiline).items()
    }


def rejected_cells(
    spark: SparkSession, base: str, multiline: bool | None = None
) -> DataFrame:
    """Per table and column: how many present cells could not be read as their type."""
    counts = None
    for table, (_, raw) in _open_all(spark, base, multiline).items():
        given = {f.name: f.dataType for f in raw.schema.fields}
        typed = [f for f in TABLES[table].fields
                 if f.name in given and not isinstance(f.dataType, T.StringType)]
        if not typed:
            continue
        cells = {f.name: _cell(f.name, given[f.name], f.dataType) for f in typed}
        bad = raw.agg(
            *[F.count_if(there & value.isNull()).alias(c) for c, (there, value) in cells.items()]
        ).unpivot([], [f.name for f in typed], "column_name", "rejected")
        bad = bad.select(F.lit(table).alias("table_name"), "column_name", "rejected")
        counts = bad if counts is None else counts.unionByName(bad)
    return counts
