"""The nine marketplace tables derived from a star schema of orders and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

_ESTIMATE_HOURS = "24 * (12 + 4 * cast(substr(o_orderpriority, 1, 1) as int))"
_SENT_HOURS = "o_orderkey % 24 + (o_orderkey * 37) % 480"
_ARRIVED_HOURS = "o_orderkey % 24 + (o_orderkey * 37) % 960"
_TRANSLATED = "p_type not in ('PROMO', 'STANDARD')"
# A few ids occur twice, with another place each.
_SELLER = "case when s_suppkey % 17 = 0 then s_suppkey - 1 else s_suppkey end"


def _after(hours: str) -> str:
    return f"o_orderdate + make_dt_interval(0, cast({hours} as int), 0, 0)"


def marketplace_tables(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """Lazy marketplace tables over the star-schema Parquet files in ``base``.

    Every row of the star schema is kept; keys and values that shall be missing are null.
    """

    def star(name: str) -> DataFrame:
        return spark.read.parquet(f"{base}/{name}.parquet")

    part, customer, nation = star("part"), star("customer"), star("nation")
    located_customers = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    located_suppliers = star("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    customer_zip = "cast(c_nationkey * 10 + c_custkey % 10 as int)"

    return {
        "orders": star("orders").selectExpr(
            "o_orderkey as order_id",
            "o_custkey as customer_id",
            "case when o_orderstatus = 'O' then 'shipped' else 'delivered' end as order_status",
            f"{_after('o_orderkey % 24')} as order_purchase_timestamp",
            f"{_after('o_orderkey % 24 + 3')} as order_approved_at",
            f"case when o_orderkey % 103 <> 0 then {_after(_SENT_HOURS)} end"
            " as order_delivered_carrier_date",
            f"case when o_orderstatus <> 'O' and o_orderkey % 101 <> 0 then {_after(_ARRIVED_HOURS)}"
            " end as order_delivered_customer_date",
            f"{_after(_ESTIMATE_HOURS)} as order_estimated_delivery_date",
        ),
        "items": star("lineitem").selectExpr(
            "l_orderkey as order_id",
            "l_linenumber as order_item_id",
            "l_partkey as product_id",
            "l_suppkey as seller_id",
            "l_shipdate as shipping_limit_date",
            "case when l_orderkey % 97 = 0 then cast(0 as double) else l_extendedprice end as price",
            "l_extendedprice * abs(l_tax) as freight_value",
        ),
        "payments": star("lineitem").selectExpr(
            "case when l_orderkey % 89 <> 0 then l_orderkey end as order_id",
            "case when l_linestatus = 'O' and l_linenumber = 7 then null"
            " when l_returnflag = 'A' then 'credit_card'"
            " when l_returnflag = 'N' then 'boleto' else 'voucher' end as payment_type",
            "cast(l_quantity as int) % 12 + 1 as payment_installments",
            "l_extendedprice * (1 + abs(l_tax)) as payment_value",
        ),
        "reviews": star("events").selectExpr(
            "cast(floor(event_id / 2) as bigint) as order_id",
            "case when event_type <> 'error' then cast(user_id % 5 + 1 as int) end as review_score",
            "ts as review_creation_date",
            "ts as review_answer_timestamp",
        ),
        "products": part.selectExpr(
            "p_partkey as product_id",
            "case when p_type <> 'PROMO' then lower(p_type) end as product_category_name",
            "cast(case when p_size <> 50 then p_size * 100 end as double) as product_weight_g",
            "cast(p_size as double) as product_length_cm",
            "cast(p_size % 7 + 1 as double) as product_height_cm",
            "cast(p_size % 11 + 1 as double) as product_width_cm",
        ),
        "categories": part.selectExpr(
            f"case when {_TRANSLATED} then lower(p_type) end as product_category_name",
            f"case when {_TRANSLATED} then concat(lower(p_type), '_en') end"
            " as product_category_name_english",
        ).distinct(),
        "customers": located_customers.selectExpr(
            "c_custkey as customer_id",
            f"{customer_zip} as customer_zip_code_prefix",
            "n_name as customer_state",
        ),
        "sellers": located_suppliers.selectExpr(
            f"{_SELLER} as seller_id",
            "cast(s_nationkey * 10 + s_suppkey % 10 as int) as seller_zip_code_prefix",
            "n_name as seller_state",
        ),
        "geolocation": customer.selectExpr(
            f"case when c_nationkey <> 24 then {customer_zip} end as geolocation_zip_code_prefix",
            "cast(c_nationkey * 120 + (c_custkey * 7) % 13 - 3000 as double) / 100"
            " as geolocation_lat",
            "cast(c_nationkey * 130 + (c_custkey * 5) % 17 - 7000 as double) / 100"
            " as geolocation_lng",
        ),
    }
