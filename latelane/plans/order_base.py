"""The enriched order table: one row per order and review."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from latelane.functions.columns import (
    all_present,
    first_token,
    floor_days,
    freight_ratio,
    great_circle_km,
    is_late,
    ratio,
)
from latelane.operators.enrich import (
    geo_centroids,
    items_per_order,
    items_with_products,
    located_customers,
    located_sellers,
    payments_per_order,
)
from latelane.operators.joins import lookup, repeated
from latelane.operators.selection import histogram_median
from latelane.sources.scratch import written

DEFAULT_INSTALLMENTS = 1  # fixed value


def delivery_columns(df: DataFrame) -> DataFrame:
    """Calendar, duration and lateness columns of the order dates."""
    purchased, delivered, estimated = (
        "order_purchase_timestamp",
        "order_delivered_customer_date",
        "order_estimated_delivery_date",
    )
    return df.withColumns(
        {
            "order_purchase_date": F.to_date(purchased),
            "purchase_weekday": F.weekday(purchased),
            "purchase_month": F.month(purchased),
            "estimated_delivery_days": floor_days(purchased, estimated),
            "actual_delivery_days": floor_days(purchased, delivered),
            "delivery_delay": floor_days(estimated, delivered),
            "is_late": is_late(floor_days(estimated, delivered)),
        }
    )


def counted_reviews(reviews: DataFrame) -> DataFrame:
    """Reviews as (order, score, how many): the fan-out of an order in a few rows."""
    return reviews.groupBy("order_id", "review_score").agg(F.count("*").alias("copies"))


def with_reviews(orders: DataFrame, counted: DataFrame) -> DataFrame:
    """Orders left-joined to their counted scores; a missing id matches a missing id.

    The main join is a plain one on ``order_id``, which keeps the orders partitioned the
    way the joins around it need. Reviews without an id, a row per score, are broadcast
    to the orders without one.
    """
    unnamed = counted.where("order_id is null").select(
        F.lit(1).alias("_unnamed"),
        F.col("review_score").alias("_score"),
        F.col("copies").alias("_copies"),
    )
    without_id = F.when(F.col("order_id").isNull(), 1) == F.col("_unnamed")
    return (
        orders.join(counted.where("order_id is not null"), "order_id", "left")
        .join(F.broadcast(unnamed), without_id, "left")
        .withColumn("review_score", F.coalesce("review_score", "_score"))
        .withColumn("copies", F.coalesce("copies", "_copies", F.lit(1)))
        .drop("_unnamed", "_score", "_copies")
    )


def order_facts(
    tables: Mapping[str, DataFrame], customers: DataFrame, reviews: DataFrame
) -> DataFrame:
    """Orders with customer, payments, counted review scores and items, all as they are read.

    After the customer lookup every join is on ``order_id``, and the sides joined in are
    aggregated to a row (reviews: a row per score) of an order first. What follows from the
    order dates is left to the readers, which costs less than moving and writing it.
    """
    items = items_per_order(items_with_products(tables), tables["items"])
    return (
        lookup(tables["orders"], customers, "customer_id")
        .join(payments_per_order(tables["payments"]), "order_id", "left")
        .join(items, "order_id", "left")
        .transform(with_reviews, reviews)
        .withColumns(
            {
                "freight_ratio": freight_ratio("freight_value", "revenue"),
                "payment_type_primary": first_token("payment_types"),
                "payment_installments": F.coalesce(
                    "payment_installments", F.lit(DEFAULT_INSTALLMENTS)
                ),
            }
        )
    )


def late_history(facts: DataFrame, key: str, orders: str, rate: str) -> DataFrame:
    """Orders and late share per key over all statuses; a missing key has none."""
    counted = F.when(F.col("order_id").isNotNull(), F.col("copies")).otherwise(0)
    late = F.sum(F.when(F.col("is_late"), F.col("copies")).otherwise(0))
    return (
        all_present(facts, [key])
        .groupBy(key)
        .agg(F.sum(counted).alias(orders), ratio(late, F.sum("copies")).alias(rate))
    )


def customer_history(
    orders: DataFrame, customers: DataFrame, reviews: DataFrame
) -> DataFrame:
    """Late history per customer, from the few columns it needs.

    These rows are those of the facts: an order counts once per review, and once per row
    of a customer id that is repeated.
    """
    late = delivery_columns(orders).select("order_id", "customer_id", "is_late")
    seen = lookup(late, customers.select("customer_id"), "customer_id")
    rows = with_reviews(seen, reviews)
    return late_history(rows, "customer_id", "customer_orders", "customer_late_rate")


def review_fill(facts: DataFrame) -> DataFrame:
    """One row: the median review score over all rows, from its histogram."""
    histogram = (
        facts.where("review_score is not null")
        .groupBy("review_score")
        .agg(F.sum("copies").alias("n"))
    )
    return histogram.agg(histogram_median("review_score", "n").alias("fill_score"))


def with_history(places: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """Place and history of every ``key`` in either table."""
    places = places.withColumnRenamed(key, "_id")
    return (
        places.join(history, F.col("_id").eqNullSafe(F.col(key)), "full")
        .withColumn(key, F.coalesce(key, "_id"))
        .drop("_id")
    )


def build_order_base(
    tables: Mapping[str, DataFrame],
    approximate_geo: bool = False,
) -> DataFrame:
    """The enriched order table, at order and review grain.

    Customers get their late history before the orders meet them, from a few columns of the
    orders, so the wide facts move once more only, to meet the sellers. The facts are written
    once; the seller history, review median and that lookup each scan only the columns they
    need of them. Centroids, customers, reviews and sellers are written too: Catalyst then
    knows their real size, and when it is under the broadcast threshold neither orders nor
    facts are shuffled to meet them.
    """
    geo = written(geo_centroids(tables["geolocation"], approximate_geo), "centroids")
    reviews = written(counted_reviews(tables["reviews"]), "counted_reviews")
    places = written(located_customers(tables["customers"], geo), "customer_places")
    of_customers = customer_history(tables["orders"], places, reviews)
    customers = written(with_history(places, of_customers, "customer_id"), "customers")
    facts = written(order_facts(tables, customers, reviews), "order_facts")

    late = delivery_columns(facts)
    history = late_history(late, "seller_id", "seller_orders", "seller_late_rate")
    sellers = with_history(located_sellers(tables["sellers"], geo), history, "seller_id")
    base = (
        lookup(facts, written(sellers, "sellers"), "seller_id")
        .crossJoin(F.broadcast(review_fill(facts)))  # one row
        .withColumn("review_score", F.coalesce(F.col("review_score").cast("double"), "fill_score"))
        .withColumn(
            "distance_km",
            great_circle_km("customer_lat", "customer_lng", "seller_lat", "seller_lng"),
        )
        .drop("fill_score")
    )
    dates = [c for c in late.columns if c not in facts.columns]
    last = ["customer_orders", "customer_late_rate", "distance_km"]
    orders = [c for c in facts.columns if c in tables["orders"].columns]
    rest = [c for c in base.columns if c not in {*orders, *last}]
    return repeated(base.transform(delivery_columns).select(*orders, *dates, *rest, *last), "copies", facts)
