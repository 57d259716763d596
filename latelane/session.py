"""Session settings the package is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}

LOCAL_SETTINGS = {
    "spark.driver.host": "127.0.0.1",
    "spark.driver.bindAddress": "127.0.0.1",
}


def build_session(app: str = "latelane", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the package's settings.

    On a cluster leave ``master`` unset and give ``spark.sql.shuffle.partitions`` a
    value well above what the largest shuffle needs; adaptive execution merges the
    small ones. Extra settings use ``_`` for ``.``-free keyword names, or pass a dict
    with ``**{"spark.x.y": value}``.
    """
    builder = SparkSession.builder.appName(app)
    settings = dict(SETTINGS)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            settings.update(LOCAL_SETTINGS)
    settings.update({k: str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
