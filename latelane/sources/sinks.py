"""Writing results: data-mart tables and JSON records."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame


def write_marts(marts: Mapping[str, DataFrame], out: str) -> dict[str, str]:
    """One Parquet folder per table under ``out``; returns their paths."""
    paths = {name: f"{out.rstrip('/')}/{name}" for name in marts}
    for name, df in marts.items():
        df.write.mode("overwrite").parquet(paths[name])
    return paths


def write_json_records(df: DataFrame, path: str) -> str:
    """One JSON object per row; null fields are kept as null."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    """CSV with a header and doubled quotes, as ``load_tables`` reads it."""
    df.write.mode("overwrite").option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(
        path, header=True, escape='"', emptyValue=""
    )
    return path
