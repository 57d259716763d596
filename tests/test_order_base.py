from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from latelane.operators import enrich, metrics
from latelane.operators.cube import cube_kpis, dashboard_cube, filtered
from latelane.plans.order_base import build_order_base
from latelane.schemas import TABLES
from latelane.sources.star import marketplace_tables

from .conftest import SMALL


def day(d, hour=0):
    return datetime(2024, 1, d, hour)


@pytest.fixture(scope="module")
def tables(spark):
    """A handful of rows with every awkward case: missing keys, repeats, ties."""
    rows = {
        "orders": [
            ("o1", "c1", "delivered", day(1), None, None, day(5, 23), day(5)),
            ("o2", "c1", "delivered", day(2), None, None, day(9), day(5)),
            ("o3", None, "shipped", day(3), None, None, None, day(9)),
            (None, "c2", "delivered", day(4), None, None, day(4, 12), day(8)),
            ("o5", "c9", "delivered", day(5), None, None, None, day(9)),
        ],
        "customers": [("c1", 1310, "SP"), ("c2", 99, "RJ"), (None, 1310, "MG")],
        "geolocation": [(1310, -23.0, -46.0), (1310, -24.0, -47.0), (None, 1.0, 1.0)],
        "items": [
            ("o1", 1, "p1", "s2", day(1), 10.0, 1.0),
            ("o1", 2, "p2", "s1", day(1), 30.0, 3.0),
            ("o1", 3, "p9", None, day(1), None, None),
            ("o2", 1, None, None, day(1), 0.0, 2.0),
            (None, 1, "p1", "s1", day(1), 5.0, 5.0),
            ("o5", 1, "p1", "s1", day(1), 7.0, 1.0),
        ],
        "payments": [
            ("o1", "voucher", 2, 10.0),
            ("o1", "boleto", 5, 20.0),
            ("o1", None, None, None),
            ("o2", None, 1, None),
            (None, "boleto", 1, 1.0),
        ],
        "reviews": [
            ("o1", 5.0, None, None),
            ("o1", 5.0, None, None),
            ("o1", 2.0, None, None),
            (None, 1.0, None, None),
            (None, 1.0, None, None),
            ("o9", 3.0, None, None),
        ],
        "products": [("p1", "toys", 100.0, 1.0, 2.0, 3.0), ("p2", None, None, 3.0, 2.0, 3.0),
                     (None, "books", 7.0, 7.0, 7.0, 7.0)],
        "categories": [("toys", "toys_en"), ("books", "books_en"), (None, "none_en")],
        "sellers": [("s1", 1310, "SP"), ("s1", 99, "RJ"), (None, 1310, "BA"), ("s2", 5, "PR")],
    }
    return {name: spark.createDataFrame(rows[name], TABLES[name]) for name in TABLES}


@pytest.fixture(scope="module")
def base(tables):
    return build_order_base(tables).cache()


def test_grain_is_order_and_review(base):
    counts = Counter(r["order_id"] for r in base.collect())
    assert counts == {"o1": 3, "o2": 1, "o3": 1, None: 2, "o5": 1}


def test_items_of_an_order(base):
    row = base.where("order_id = 'o1'").first()
    assert (row["total_items"], row["revenue"], row["freight_value"]) == (3, 40.0, 4.0)
    assert (row["avg_item_price"], row["avg_product_weight"]) == (20.0, 100.0)
    # p2 has no category name, p9 no product row; both meet the unnamed category.
    assert (row["distinct_categories"], row["category_most_common"]) == (2, "none_en")
    assert (row["seller_id"], row["seller_count"]) == ("s1", 2)
    assert (row["payment_value"], row["payment_installments"]) == (30.0, 5)
    assert (row["payment_types"], row["payment_type_primary"]) == ("boleto,voucher", "boleto")


def test_missing_keys_meet_missing_keys(base):
    unnamed = base.where("order_id is null").collect()
    assert [r["review_score"] for r in unnamed] == [1.0, 1.0]
    assert unnamed[0]["revenue"] is None and unnamed[0]["customer_state"] == "RJ"
    assert base.where("order_id = 'o3'").first()["customer_state"] == "MG"
    sellerless = base.where("order_id = 'o2'").first()
    assert (sellerless["seller_id"], sellerless["seller_state"]) == (None, "BA")
    assert sellerless["category_most_common"] == "books_en"


def test_empty_texts_fills_and_ratio(base):
    o2, o3 = (base.where(f"order_id = '{o}'").first() for o in ("o2", "o3"))
    assert (o2["payment_value"], o2["payment_types"], o2["payment_type_primary"]) == (0.0, "", "")
    assert o2["freight_ratio"] is None
    assert (o3["payment_value"], o3["payment_type_primary"]) == (None, None)
    assert (o3["payment_installments"], o3["total_items"]) == (1, None)
    # Scores present: 5, 5, 2 and 1, 1; their median fills the rest.
    assert o3["review_score"] == 2.0


def test_lateness_and_history(base):
    late = {r["order_id"]: r["is_late"] for r in base.collect()}
    assert late == {"o1": False, "o2": True, "o3": False, None: False, "o5": False}
    c1 = base.where("order_id = 'o2'").first()
    assert (c1["customer_orders"], c1["customer_late_rate"]) == (4, 0.25)
    assert (c1["seller_orders"], c1["seller_late_rate"]) == (None, None)
    # Rows without an order id count as rows of the mean but not as orders.
    c2 = base.where("order_id is null").first()
    assert (c2["customer_orders"], c2["customer_late_rate"]) == (0, 0.0)
    s1 = base.where("order_id = 'o5'").first()
    assert (s1["seller_orders"], s1["seller_late_rate"]) == (4, 0.0)


def test_facts_do_not_move_to_meet_customers(tables):
    """Customers have their history before orders meet them; only sellers meet the wide facts."""
    plan = build_order_base(tables)._jdf.queryExecution().optimizedPlan().toString()
    assert "_seller_id#" in plan and "_customer_id#" not in plan
    assert "payment_types#" in plan


def test_history_of_a_repeated_customer(tables, base):
    twice = tables["customers"].unionByName(tables["customers"].where("customer_id = 'c1'"))
    found = build_order_base({**tables, "customers": twice})
    assert found.columns == base.columns
    assert found.where("order_id = 'o1'").count() == 6  # three reviews, two rows of c1
    c1 = found.where("order_id = 'o2'").first()
    assert (c1["customer_orders"], c1["customer_late_rate"]) == (8, 0.25)
    # c9 has orders but no row among the customers.
    c9 = found.where("order_id = 'o5'").first()
    assert (c9["customer_state"], c9["customer_orders"], c9["customer_late_rate"]) == (None, 1, 0.0)
    assert found.where("order_id = 'o3'").first()["customer_orders"] is None


def test_places(base):
    o1 = base.where("order_id = 'o1'").first()
    assert (o1["customer_lat"], o1["customer_lng"]) == (-23.5, -46.5)
    # Of the two s1 rows the smaller state is kept; its zip has no coordinates.
    assert (o1["seller_state"], o1["seller_lat"]) == ("RJ", None)
    assert o1["distance_km"] > 4000


def test_orders_are_not_lost_to_hot_keys(spark):
    """A third of all orders, items and reviews on one key: the same rows with and without
    broadcasts and skew splits."""
    star = marketplace_tables(spark, SMALL)
    hot = F.col("order_id") % 3 == 0
    star["orders"] = star["orders"].withColumn(
        "customer_id", F.when(hot, 7).otherwise(F.col("customer_id"))
    )
    star["items"] = star["items"].withColumns(
        {
            "product_id": F.when(hot, 7).otherwise(F.col("product_id")),
            "seller_id": F.when(hot, 3).otherwise(F.col("seller_id")),
        }
    )
    star["reviews"] = star["reviews"].withColumn(
        "order_id", F.when(hot, 9).otherwise(F.col("order_id"))
    )

    def rounded_rows(df):
        kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
        cells = [F.round(c, 6) if kinds[c] == "double" else F.col(c) for c in sorted(df.columns)]
        return Counter(map(tuple, df.select(cells).collect()))

    plain = rounded_rows(build_order_base(star))
    split = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    for key, value in split.items():
        spark.conf.set(key, value)
    try:
        assert rounded_rows(build_order_base(star)) == plain
    finally:
        for key in split:
            spark.conf.unset(key)


def test_items_are_read_and_joined_once(spark):
    """One scan of the items, one product join, two shuffles for the per-order step."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        items = enrich.items_with_products(marketplace_tables(spark, SMALL))
        plan = enrich.items_per_order(items)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = plan.split("== Initial Plan ==")[0]
    assert plan.count("lineitem") == 1 and plan.count("SortMergeJoin") == 1
    assert plan.count("Exchange hashpartitioning") <= 4


def test_mode_ties_and_unknown(spark):
    rows = [("o", v) for v in ("b", "a", "b", "a", None)] + [("p", None), (None, "z")]
    items = spark.createDataFrame(rows, "order_id string, product_category_name_english string")
    others = ["order_item_id", "price", "freight_value", *enrich.PRODUCT_MEANS]
    items = items.withColumns({c: F.lit(None).cast("double") for c in others})
    items = items.withColumn("seller_id", F.col("product_category_name_english"))
    found = {r["order_id"]: r for r in enrich.items_per_order(items).collect()}
    assert set(found) == {"o", "p"}
    assert (found["o"]["category_most_common"], found["o"]["seller_id"]) == ("a", "a")
    assert (found["p"]["category_most_common"], found["p"]["seller_id"]) == ("unknown", None)
    assert (found["p"]["revenue"], found["p"]["avg_item_price"]) == (0.0, None)


def test_approximate_centroids(tables):
    row = enrich.geo_centroids(tables["geolocation"], approximate=True).first()
    assert row["geolocation_zip_code_prefix"] == 1310 and -24 <= row["geolocation_lat"] <= -23


def test_nothing_delivered(base):
    none = base.where("false")
    kpis = metrics.kpi_summary(none).first()
    assert kpis["total_revenue"] == 0.0
    assert [kpis[c] for c in kpis.asDict() if c != "total_revenue"] == [None] * 4
    for ranking in (
        metrics.revenue_ranking(none, "customer_state"),
        metrics.delay_ranking(none, "customer_state"),
        metrics.delivery_days_histogram(none),
        dashboard_cube(none),
    ):
        assert ranking.collect() == []


def test_two_definitions_of_the_headline_figures(base):
    delivered = metrics.delivered_only(base)
    direct = metrics.kpi_summary(delivered).first()
    cube = dashboard_cube(delivered)
    from_cube = cube_kpis(cube).first()
    # Direct: mean over rows with the value. Cube: over orders with all the keys.
    assert direct["avg_delivery_days"] == pytest.approx((4 * 3 + 7 + 0 + 0) / 6)
    assert from_cube["avg_delivery_days"] == pytest.approx((4 * 3 + 7) / 4)
    assert cube.agg(F.sum("order_count")).first()[0] == 4


def test_filters_are_inclusive_and_open_by_default(base):
    cube = dashboard_cube(metrics.delivered_only(base))
    everything = cube.count()
    assert filtered(cube, "all", "all", "", None).count() == everything
    dates = [r[0] for r in filtered(cube, "SP", None, "2024-01-02", "2024-01-02")
             .select("order_purchase_date").collect()]
    assert dates == ["2024-01-02"]
    assert cube_kpis(filtered(cube, "nowhere")).first()["avg_ticket"] is None


def test_ranking_order_with_missing_values(spark):
    df = spark.createDataFrame(
        [("x", True, 1, 1.0), ("y", True, None, 1.0), ("z", False, 5, 2.0), ("w", True, 1, 3.0)],
        "customer_state string, is_late boolean, delivery_delay bigint, revenue double",
    )
    ranking = [r["customer_state"] for r in metrics.delay_ranking(df, "customer_state").collect()]
    assert ranking == ["w", "x", "y", "z"]


def test_histogram_edges(spark):
    df = spark.createDataFrame([(i,) for i in [0, 1, 29, 30, 30, None]], "actual_delivery_days bigint")
    rows = [tuple(r) for r in metrics.delivery_days_histogram(df).collect()]
    assert rows == [(0, 0.0, 1.0, 1), (1, 1.0, 2.0, 1), (29, 29.0, 30.0, 3)]
    single = metrics.delivery_days_histogram(df.where("actual_delivery_days = 1")).collect()
    assert [tuple(r) for r in single] == [(0, 1.0, 1.0, 1)]


def test_review_histogram_floors_half_points(spark):
    df = spark.createDataFrame([(4.5,), (4.0,), (5.0,), (None,)], "review_score double")
    assert [tuple(r) for r in metrics.review_score_histogram(df).collect()] == [(4, 2), (5, 1)]


def test_items_and_payments_of_ordinary_orders_move_once(spark):
    items = spark.range(3000).selectExpr(
        "id % 700 as order_id", "id as order_item_id", "id % 13 as seller_id", "id * 1.0D as price",
        "1.0D as freight_value", "1.0D as product_weight_g", "1.0D as product_length_cm",
        "1.0D as product_height_cm", "1.0D as product_width_cm",
        "concat('c', id % 5) as product_category_name_english",
    )
    payments = items.selectExpr(
        "order_id", "price as payment_value", "1 as payment_installments",
        "product_category_name_english as payment_type",
    )
    for grouped, rows in ((enrich.items_per_order, items), (enrich.payments_per_order, payments)):
        once = grouped(rows)
        plan = once._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(order_id") == plan.count("Exchange hashpartitioning") == 1
        same = sorted(once.collect())
        assert len(same) == 700
        for huge in (0, 4, 60):  # all, some and no buckets are combined first
            assert sorted(grouped(rows, huge=huge).collect()) == same
