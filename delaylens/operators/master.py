"""Order cohorts and the denormalised master table.

Plan shape (left variant, delivered cohort):

    orders --filter(status, delivered date)--> [x customers, at order grain]
      -- shuffle on order_id --> SMJ order_items -- (same partitioning) --> SMJ order_reviews
      --> products, sellers: broadcast when their files are small

A caller that names the columns it needs joins only the dimensions that have
them (dimension keys are unique, so a left join never changes the rows).

The status filter sits in the orders scan; customers joins at order grain
before the items fan out; the reviews join reuses the order_id partitioning
of the items join, so C1 + C3 cost one exchange per input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import late_flag
from ..sources.tables import Tables
from .joins import dimension_join

MASTER_COLUMNS = [
    "order_id",
    "customer_id",
    "order_status",
    "order_purchase_timestamp",
    "order_delivered_customer_date",
    "order_estimated_delivery_date",
    "seller_id",
    "is_late",
    "price",
    "freight_value",
    "product_weight_g",
    "product_category_name",
    "seller_zip_code_prefix",
    "seller_state",
    "customer_zip_code_prefix",
    "customer_state",
    "review_score",
]

COHORTS = ("delivered", "status_only", "lifecycle")


# ---------------------------------------------------------------- filters

def delivered_orders(orders: DataFrame) -> DataFrame:
    """B1 + B2: status 'delivered' and a customer delivery date present."""
    return orders.filter((F.col("order_status") == "delivered") & F.col("order_delivered_customer_date").isNotNull())


def status_orders(orders: DataFrame) -> DataFrame:
    """B1 only (notebook cohort): a missing delivery date counts as not late."""
    return orders.filter(F.col("order_status") == "delivered")


def lifecycle_orders(orders: DataFrame) -> DataFrame:
    """Delivered orders with approval, carrier and customer dates all set."""
    return status_orders(orders).na.drop(
        subset=["order_delivered_customer_date", "order_approved_at", "order_delivered_carrier_date"]
    )


def with_late_flag(orders: DataFrame) -> DataFrame:
    """Integer is_late; NULL delivered or estimated date gives 0."""
    return orders.withColumn("is_late", late_flag("order_delivered_customer_date", "order_estimated_delivery_date"))


def select_cohort(orders: DataFrame, cohort: str = "delivered") -> DataFrame:
    if cohort == "delivered":
        return delivered_orders(orders)
    if cohort == "status_only":
        return status_orders(orders)
    if cohort == "lifecycle":
        return lifecycle_orders(orders)
    raise ValueError(f"unknown cohort {cohort!r}; expected one of {COHORTS}")


# ---------------------------------------------------------------- fills

def catalog_mean_weight(products: DataFrame):
    """Scalar subquery: average weight over the whole product catalogue."""
    return products.agg(F.avg("product_weight_g")).scalar()


def fill_weight_from_catalog(df: DataFrame, products: DataFrame) -> DataFrame:
    """Weight <- COALESCE(weight, AVG(weight) over all products).

    The average is an uncorrelated scalar subquery: one small job whose
    single value is inlined into the projection, no cross join.
    """
    return df.withColumn(
        "product_weight_g", F.coalesce(F.col("product_weight_g"), catalog_mean_weight(products))
    )


# ---------------------------------------------------------------- joins

def order_items_joined(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Inner equi-join on order_id (1:n)."""
    return orders.join(items, "order_id")


def reviews_per_order(reviews: DataFrame, review_mode: str) -> DataFrame:
    if review_mode == "fanout":
        return reviews.select("order_id", "review_score")
    if review_mode == "mean":
        # one row per order: no fan-out, pre-aggregated before the shuffle
        return reviews.groupBy("order_id").agg(F.avg("review_score").alias("review_score"))
    raise ValueError(f"unknown review_mode {review_mode!r}")


PRODUCT_COLUMNS = ("product_weight_g", "product_category_name")
SELLER_COLUMNS = ("seller_zip_code_prefix", "seller_state")
CUSTOMER_COLUMNS = ("customer_zip_code_prefix", "customer_state")


def dimension_keys(tables: Tables) -> DataFrame:
    """Rows and distinct keys of each dimension; a narrow master is right only
    if they agree."""
    counted = [
        df.agg(F.lit(name).alias("dimension"), F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("keys"))
        for name, key, df in (
            ("customers", "customer_id", tables.customers),
            ("products", "product_id", tables.products),
            ("sellers", "seller_id", tables.sellers),
        )
    ]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


def build_master(
    tables: Tables,
    cohort: str = "delivered",
    join: str = "left",
    review_mode: str = "fanout",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """A4 body: the 17-column master table (one row per item x review).

    ``join="left"`` is the SQL warehouse build (C2 + C3), ``join="inner"``
    the notebook variant (C4, no reviews). ``review_mode="fanout"`` keeps
    the upstream row multiplication by reviews; ``"mean"`` averages reviews
    per order first. ``columns`` are the master columns the caller needs:
    in the left variant, dimensions with none of them are not joined. Reviews
    always are, for they change the number of rows.
    """
    how = "left" if join == "left" else "inner"
    wanted = list(columns or MASTER_COLUMNS)
    needs = lambda names: join != "left" or any(c in wanted for c in names)
    orders = with_late_flag(select_cohort(tables.orders, cohort)).select(
        "order_id",
        "customer_id",
        "order_status",
        "order_purchase_timestamp",
        "order_delivered_customer_date",
        "order_estimated_delivery_date",
        "is_late",
    )
    if needs(CUSTOMER_COLUMNS):
        customers = tables.customers.select("customer_id", *CUSTOMER_COLUMNS)
        orders = dimension_join(orders, customers, "customer_id", how)

    items = tables.order_items.select("order_id", "product_id", "seller_id", "price", "freight_value")
    df = order_items_joined(orders, items)
    if join == "left":
        df = df.join(reviews_per_order(tables.order_reviews, review_mode), "order_id", "left")
    else:
        df = df.withColumn("review_score", F.lit(None).cast("int"))

    if needs(PRODUCT_COLUMNS):
        df = dimension_join(df, tables.products.select("product_id", *PRODUCT_COLUMNS), "product_id", how)
    if needs(SELLER_COLUMNS):
        df = dimension_join(df, tables.sellers.select("seller_id", *SELLER_COLUMNS), "seller_id", how)
    if join == "left" and "product_weight_g" in wanted:
        df = fill_weight_from_catalog(df, tables.products)
    return df.select(*wanted)


def build_master_inner(tables: Tables, cohort: str = "status_only") -> DataFrame:
    """C4: the prototype's inner star (products, sellers, customers), no reviews.

    Weight is left as stored; the row-mean fill (B7) is a separate step.
    """
    df = build_master(tables, cohort=cohort, join="inner")
    return df.drop("review_score")


def review_fanout(tables: Tables, cohort: str = "delivered") -> DataFrame:
    """C3 on its own: items x reviews row counts per order (shows fan-out)."""
    orders = select_cohort(tables.orders, cohort).select("order_id")
    items = tables.order_items.select("order_id")
    reviews = tables.order_reviews.select("order_id", "review_score")
    joined = orders.join(items, "order_id").join(reviews, "order_id", "left")
    return joined.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("review_score").alias("reviewed_rows"),
    )
