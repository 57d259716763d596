from collections import Counter

from latelane.operators import joins
from latelane.sources.scratch import written


def hot_orders(spark, n=3000):
    rows = [("hot" if i % 3 == 0 else f"k{i}" if i % 7 else None, i) for i in range(n)]
    return spark.createDataFrame(rows, "k string, i int")


def test_a_missing_key_matches_a_missing_key(spark):
    right = spark.createDataFrame(
        [("hot", "H"), (None, "N"), ("k1", "one"), ("k1", "again"), ("k2", "two")],
        "k string, v string",
    )
    got = joins.lookup(hot_orders(spark), right, "k")
    assert got.columns == ["k", "i", "v"]
    found = Counter((r["i"], r["v"]) for r in got.where("i in (0, 1, 7, 2, 4)").collect())
    assert found == Counter([(0, "H"), (1, "one"), (1, "again"), (7, "N"), (2, "two"), (4, None)])


def test_hot_and_missing_keys_are_split_at_run_time(spark):
    """Adaptive execution alone: a third of the rows on one key, more on the missing one."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.shuffle.partitions": "64",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        share = joins.F.expr("case when i % 3 = 0 then 'hot' when i % 3 = 1 then concat('k', i) end")
        left = spark.range(60_000).selectExpr("cast(id as int) as i").withColumn("k", share)
        left = written(left.repartition(16).withColumn("pad", joins.F.sha2(joins.F.col("i").cast("string"), 256)), "left")
        right = written(spark.range(60_000).selectExpr("concat('k', id) as k", "id as v"), "right")
        joined = joins.lookup(left, right, "k")
        rows = joined.withColumn("p", joins.F.spark_partition_id())
        sizes = rows.groupBy("p").count()
        counts = [r["count"] for r in sizes.collect()]
        plan = sizes._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in settings:
            spark.conf.unset(key)
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert "skew=true" in plan
    # Neither key's 20,000 rows are in one task.
    assert sum(counts) == 60_000 and max(counts) < 15_000


def test_repeated_rows(spark):
    df = spark.createDataFrame([("a", 1), ("b", 25), ("c", 10)], "k string, copies bigint")
    for chunk in (100, 10, 7, 1):
        rows = joins.repeated(df, "copies", chunk=chunk)
        assert rows.columns == ["k"]
        assert Counter(r["k"] for r in rows.collect()) == {"a": 1, "b": 25, "c": 10}
