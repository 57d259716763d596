"""Aggregates and lookups that bring the side tables to order grain."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from latelane.functions.columns import all_present, ratio, sorted_distinct_list, sum_or_zero
from latelane.operators.joins import HUGE, grouped_once, lookup
from latelane.operators.selection import exact_medians
from latelane.sources.scratch import written

UNKNOWN_CATEGORY = "unknown"  # fixed value

# Product measure -> name of its mean per order.
PRODUCT_MEANS = {
    "product_weight_g": "avg_product_weight",
    "product_length_cm": "avg_length_cm",
    "product_height_cm": "avg_height_cm",
    "product_width_cm": "avg_width_cm",
}


def geo_centroids(geolocation: DataFrame, approximate: bool = False) -> DataFrame:
    """Median latitude and longitude per zip prefix.

    ``approximate=True`` swaps the exact medians for ``percentile_approx``: one pass with
    bounded memory whatever the size of a zip's group.
    """
    zip_code, lat, lng = (
        "geolocation_zip_code_prefix",
        "geolocation_lat",
        "geolocation_lng",
    )
    if approximate:
        return (
            all_present(geolocation, [zip_code])
            .groupBy(zip_code)
            .agg(*[F.percentile_approx(c, 0.5).alias(c) for c in (lat, lng)])
        )
    return exact_medians(geolocation, [lat, lng], [zip_code])


def payments_per_order(payments: DataFrame, huge: int = HUGE) -> DataFrame:
    """Amount paid, most installments and the sorted distinct payment types per order."""

    def grouped(rows: DataFrame) -> DataFrame:
        return rows.groupBy("order_id").agg(
            sum_or_zero("payment_value").alias("payment_value"),
            F.max("payment_installments").alias("payment_installments"),
            sorted_distinct_list("payment_type").alias("payment_types"),
        )

    used = ["order_id", "payment_value", "payment_installments", "payment_type"]
    return grouped_once(all_present(payments, ["order_id"]).select(used), "order_id", grouped, huge=huge)


def categorised_products(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Product measures with the English category name, written once.

    Written, Catalyst knows its real size when items are joined to it.
    """
    products = tables["products"].select("product_id", "product_category_name", *PRODUCT_MEANS)
    categories = tables["categories"].select(
        "product_category_name", "product_category_name_english"
    )
    name = "product_category_name"
    return written(lookup(products, written(categories, "categories"), name).drop(name), "products")


def items_with_products(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Items with product measures and the English category name."""
    items = tables["items"].select(
        "order_id", "order_item_id", "product_id", "seller_id", "price", "freight_value"
    )
    return lookup(items, categorised_products(tables), "product_id")


def _most_frequent(value: str) -> Column:
    """Aggregate over counted values: the most frequent one, the smallest of a tie."""
    ranked = F.struct((-F.col("n")).alias("rank"), F.col(value).alias("value"))
    return F.min(F.when(F.col(value).isNotNull(), ranked))["value"]


def items_per_order(
    items: DataFrame, counted: DataFrame | None = None, huge: int = HUGE
) -> DataFrame:
    """Totals, means, distinct counts and modes per order, in one pass over the items.

    An item gives one row for its seller, which carries its measures, and one for its
    category. Those are counted and added per (order, seller) and (order, category) first;
    the second step sees each distinct value of an order once. Items of ordinary orders move
    once, before both steps. Those of a huge order are spread over many tasks by the first
    step, which combines on the map side. Nothing is collected per order. ``counted`` may
    give the items before their products were joined.
    """
    used = ["order_id", "order_item_id", "seller_id", "price", "freight_value", *PRODUCT_MEANS]
    rows = all_present(items, ["order_id"]).select(*used, "product_category_name_english")
    counted = counted if counted is None else all_present(counted, ["order_id"])
    return grouped_once(rows, "order_id", _items_grouped, counted, huge)


def _items_grouped(items: DataFrame) -> DataFrame:
    measures = ["price", "freight_value", *PRODUCT_MEANS]
    category = F.col("product_category_name_english").alias("category")
    no_seller = F.lit(None).cast(items.schema["seller_id"].dataType).alias("seller_id")
    no_category = F.lit(None).cast("string").alias("category")
    values = ["order_item_id", *measures]
    no_values = [F.lit(None).cast(items.schema[c].dataType).alias(c) for c in values]
    sides = F.array(
        F.struct("seller_id", no_category, *values), F.struct(no_seller, category, *no_values)
    )
    counted = (
        items.select("order_id", F.inline(sides))
        .groupBy("order_id", "seller_id", "category")
        .agg(
            F.count("*").alias("n"),
            F.count("order_item_id").alias("items"),
            *[F.sum(m).alias(f"sum_{m}") for m in measures],
            *[F.count(m).alias(f"n_{m}") for m in measures],
        )
    )

    def mean(m: str) -> Column:
        return ratio(F.sum(f"sum_{m}"), F.sum(f"n_{m}"))

    return counted.groupBy("order_id").agg(
        F.sum("items").alias("total_items"),
        sum_or_zero("sum_price").alias("revenue"),
        sum_or_zero("sum_freight_value").alias("freight_value"),
        mean("price").alias("avg_item_price"),
        *[mean(m).alias(name) for m, name in PRODUCT_MEANS.items()],
        F.count("category").cast("int").alias("distinct_categories"),
        F.coalesce(_most_frequent("category"), F.lit(UNKNOWN_CATEGORY)).alias(
            "category_most_common"
        ),
        _most_frequent("seller_id").alias("seller_id"),
        F.count("seller_id").cast("int").alias("seller_count"),
    )


def _with_centroid(places: DataFrame, zip_column: str, geo: DataFrame) -> DataFrame:
    return places.join(
        geo, F.col(zip_column) == F.col("geolocation_zip_code_prefix"), "left"
    )


def located_customers(customers: DataFrame, geo: DataFrame) -> DataFrame:
    """Customers with the coordinates of their zip prefix."""
    return _with_centroid(customers, "customer_zip_code_prefix", geo).withColumnsRenamed(
        {"geolocation_lat": "customer_lat", "geolocation_lng": "customer_lng"}
    )


def located_sellers(sellers: DataFrame, geo: DataFrame) -> DataFrame:
    """One row per seller id with state and coordinates.

    Of repeated ids the smallest (state, zip prefix) row is kept, by an aggregate that
    combines on the map side. A missing id counts as one id.
    """
    pick = F.min(F.struct("seller_state", "seller_zip_code_prefix"))
    one_each = sellers.groupBy("seller_id").agg(pick.alias("kept")).select("seller_id", "kept.*")
    return _with_centroid(one_each, "seller_zip_code_prefix", geo).select(
        "seller_id",
        "seller_state",
        F.col("geolocation_lat").alias("seller_lat"),
        F.col("geolocation_lng").alias("seller_lng"),
    )
