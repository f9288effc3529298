"""Dashboard and business reports over the master / feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kpis(master: DataFrame) -> DataFrame:
    """Row count (the upstream 'total orders'), distinct orders, late rate,
    mean review score (NULLs skipped) and mean freight, in one aggregate."""
    return master.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("order_id").alias("distinct_orders"),
        F.avg("is_late").alias("late_rate"),
        F.avg("review_score").alias("avg_review_score"),
        F.avg("freight_value").alias("avg_freight"),
    )


def late_by_category(master: DataFrame) -> DataFrame:
    """Late rows per category, NULL category excluded."""
    return (
        master.filter((F.col("is_late") == 1) & F.col("product_category_name").isNotNull())
        .groupBy(F.col("product_category_name").alias("category"))
        .agg(F.count(F.lit(1)).alias("late_count"))
    )


def worst_categories(master: DataFrame, k: int = 10) -> DataFrame:
    """top-k categories by late count; ties broken by name ascending.

    orderBy + limit plans as TakeOrderedAndProject: each partition keeps k
    rows, so no global sort of the grouped result.
    """
    return late_by_category(master).orderBy(F.desc("late_count"), F.asc("category")).limit(k)


def preview(df: DataFrame, columns: list[str], n: int = 5) -> DataFrame:
    """First ``n`` rows of ``columns`` under an explicit total order on
    those columns (a top-n, not an arbitrary head)."""
    return df.select(*columns).orderBy(*columns).limit(n)


def review_by_late(master: DataFrame) -> DataFrame:
    """Review score by lateness."""
    return master.groupBy("is_late").agg(
        F.avg("review_score").alias("avg_review_score"),
        F.count("review_score").alias("reviews"),
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.when(F.col("review_score") == 5, 1.0).when(F.col("review_score").isNotNull(), 0.0)).alias(
            "five_star_share"
        ),
    )


def demand_by_state(features: DataFrame) -> DataFrame:
    """Destination demand by category x customer state, with distance."""
    return features.groupBy(
        F.col("product_category_name").alias("category"), "customer_state"
    ).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("price").alias("revenue"),
        F.avg("distance_km").alias("avg_distance_km"),
        F.avg("is_late").alias("late_rate"),
    )


def calendar_features(df: DataFrame, ts_col: str = "order_purchase_timestamp") -> DataFrame:
    """Friday and December flags from the purchase timestamp."""
    ts = F.col(ts_col)
    return df.withColumn("is_friday", (F.dayofweek(ts) == 6).cast("int")).withColumn(
        "is_december", (F.month(ts) == 12).cast("int")
    )


def calendar_late_rates(master: DataFrame) -> DataFrame:
    """L10 report: late rate by the two calendar flags."""
    return (
        calendar_features(master)
        .groupBy("is_friday", "is_december")
        .agg(F.count(F.lit(1)).alias("rows"), F.avg("is_late").alias("late_rate"))
    )


def daily_orders(orders: DataFrame, ts_col: str = "order_purchase_timestamp") -> DataFrame:
    """Daily order volume series (orders table: one row per order)."""
    return orders.groupBy(F.to_date(F.col(ts_col)).alias("day")).agg(F.count(F.lit(1)).alias("orders"))
