import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from latelane.functions import columns as c


def one(spark, expression):
    return spark.range(1).select(expression).first()[0]


MOMENTS = "start timestamp_ntz, end timestamp_ntz"


@pytest.mark.parametrize("zone", ["UTC", "America/Sao_Paulo"])
def test_floor_days_and_late_flag(spark, zone):
    start = datetime(2018, 11, 3, 12)  # a clock change follows in Sao Paulo
    ends = [datetime(2018, 11, 4, 11), datetime(2018, 11, 4, 12), datetime(2018, 11, 3, 11), None]
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = spark.createDataFrame([(start, e) for e in ends], MOMENTS)
        days = c.floor_days("start", "end")
        found = rows.select(days, c.is_late(days)).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [r[0] for r in found] == [0, 1, -1, None]
    assert [r[1] for r in found] == [False, True, False, False]


def test_aggregates_of_an_all_null_group(spark):
    df = spark.createDataFrame([("a", None), ("a", None)], "k string, x double")
    row = df.groupBy("k").agg(
        c.sum_or_zero("x"), F.avg("x"), F.count("x"), F.median("x"), c.sorted_distinct_list("x")
    ).first()
    assert tuple(row) == ("a", 0.0, None, 0, None, "")


def test_null_group_key_is_dropped(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), ("b", 4)], "k string, x int")
    assert {r["k"] for r in c.all_present(df, ["k"]).groupBy("k").count().collect()} == {"a", "b"}


def test_freight_ratio(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, -0.0), (1.0, 5.0), (1.0, None)], "f double, r double")
    assert [r[0] for r in df.select(c.freight_ratio("f", "r")).collect()] == [None, None, 0.2, None]


def test_distance(spark):
    def km(*degrees):
        return one(spark, c.great_circle_km(*[F.lit(d).cast("double") for d in degrees]))

    assert km(0, 0, 0, 180) == pytest.approx(math.pi * 6371)
    assert km(None, None, None, None) == 0.0
    assert km(None, None, 0, 90) == pytest.approx(math.pi * 6371 / 2)
    assert km(-23.55, -46.63, -22.91, -43.17) == pytest.approx(360.75, abs=1)
    assert not math.isnan(km(90, 0, -90, 0))


@pytest.mark.parametrize(
    "types, text, first",
    [(["b", "a", "b", None], "a,b", "a"), ([None], "", ""), (["boleto"], "boleto", "boleto")],
)
def test_payment_list(spark, types, text, first):
    df = spark.createDataFrame([(t,) for t in types], "t string")
    row = df.agg(c.sorted_distinct_list("t").alias("l")).select("l", c.first_token("l")).first()
    assert tuple(row) == (text, first)


def test_weekday_counts_from_monday(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1),)], "t timestamp_ntz")
    assert df.select(F.weekday("t")).first()[0] == 0


@pytest.mark.parametrize("value", [0.0, 1234567.891, 0.125, 2.675, 999.995, 12.25, 0.38451])
def test_display_texts_match_python_formats(spark, value):
    x = F.lit(value)
    assert one(spark, c.money_text(x)) == f"R$ {value:,.2f}"
    assert one(spark, c.days_text(x)) == f"{value:.1f} dias"
    assert one(spark, c.percent_text(x)) == f"{value:.2%}"
    assert one(spark, c.plain_text(x, 4)) == f"{value:.4f}"
