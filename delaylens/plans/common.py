"""Shared building blocks of the registered plans over the fixture tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.features import preprocess
from ..operators.lifecycle import lifecycle_master
from ..operators.master import build_master, select_cohort, with_late_flag
from ..sources.fixtures import load_fixture_tables
from ..sources.tables import Tables

ROUND_DIGITS = 6


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    return load_fixture_tables(spark, sf_dir)


def round_doubles(df: DataFrame, digits: int = ROUND_DIGITS) -> DataFrame:
    """Round every double column (engines sum in different orders)."""
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`"), digits).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def master(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The master table, or only ``columns`` of it from the tables they need."""
    return build_master(tables(spark, sf_dir), columns=columns or None)


def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle_master(tables(spark, sf_dir))


def features(spark: SparkSession, sf_dir: str, rate_mode: str = "global"):
    t = tables(spark, sf_dir)
    return preprocess(build_master(t), geolocation=t.geolocation, rate_mode=rate_mode)


def delivered_item_rows(t: Tables) -> DataFrame:
    """Delivered-cohort item rows without review fan-out (as-of input)."""
    orders = with_late_flag(select_cohort(t.orders, "delivered")).select(
        "order_id", "order_purchase_timestamp", "order_delivered_customer_date", "is_late"
    )
    return orders.join(t.order_items.select("order_id", "seller_id"), "order_id")


def fixture_score(df: DataFrame) -> DataFrame:
    """Deterministic stand-in score over integer ids (metric checks only):
    p = ((order_id*31 + seller_id*17) % 80 + 20*is_late) / 100."""
    p = ((F.col("order_id") * 31 + F.col("seller_id") * 17) % 80 + 20 * F.col("is_late")) / F.lit(100.0)
    return df.select("order_id", "seller_id", F.col("is_late").alias("y"), p.alias("p"))
