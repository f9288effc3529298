"""Map the benchmark star schema onto the logical order-fulfilment tables.

The driver's test data is a TPC-H-like star schema; this module re-labels
it as orders / order_items / products / sellers / customers /
order_reviews / geolocation. Every table is a lazy projection of one or
two parquet scans, so filters and column pruning still reach the files.
The derivation rules (which rows get NULL dates, how lags are spread) are
the documented fixture mapping and must stay exactly as written so the
SQL oracle sees the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Tables


# Types of the benchmark columns that the mapping reads. With them
# a scan needs no look into the files before planning.
COLUMN_TYPES = {
    "n_nationkey": "int", "n_name": "string",
    "c_custkey": "bigint", "c_nationkey": "int",
    "s_suppkey": "bigint", "s_nationkey": "int",
    "p_partkey": "bigint", "p_type": "string", "p_size": "int",
    "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_orderdate": "timestamp_ntz",
    "l_orderkey": "bigint", "l_linenumber": "int", "l_partkey": "bigint", "l_suppkey": "bigint",
    "l_extendedprice": "double", "l_tax": "double",
    "event_id": "bigint",
}


def _scan(spark: SparkSession, sf_dir: str, name: str, columns: list[str]) -> DataFrame:
    """Resolve the table's files anew (a file added meanwhile is seen); only
    ``columns`` are read."""
    schema = ", ".join(f"{c} {COLUMN_TYPES[c]}" for c in columns)
    return spark.read.schema(schema).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _hours_after(ts: str, hours: Column) -> Column:
    return F.timestamp_add("HOUR", hours, F.col(ts))


def fixture_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _scan(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"])
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        key.alias("order_id"),
        cust.alias("customer_id"),
        F.when(F.col("o_orderstatus") == "F", "delivered")
        .when(F.col("o_orderstatus") == "O", "shipped")
        .otherwise("processing")
        .alias("order_status"),
        F.col("o_orderdate").alias("order_purchase_timestamp"),
        _hours_after("o_orderdate", key * 7 % 48).alias("order_approved_at"),
        F.when(key % 97 == 0, F.lit(None))
        .otherwise(_hours_after("o_orderdate", 48 + key * 13 % 150))
        .alias("order_delivered_carrier_date"),
        F.when(key % 53 == 0, F.lit(None))
        .otherwise(_hours_after("o_orderdate", 216 + (cust * 37 + key * 7) % 660))
        .alias("order_delivered_customer_date"),
        F.timestamp_add("DAY", F.lit(34), F.col("o_orderdate")).alias("order_estimated_delivery_date"),
    )


def fixture_order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _scan(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_tax"])
    return li.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        # every 101st product's items name a product that doesn't exist
        F.when(F.col("l_partkey") % 101 == 0, -F.col("l_partkey")).otherwise(F.col("l_partkey")).alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_extendedprice").alias("price"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("freight_value"),
    )


def fixture_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _scan(spark, sf_dir, "part", ["p_partkey", "p_type", "p_size"])
    key = F.col("p_partkey")
    return p.select(
        key.alias("product_id"),
        F.when(key % 61 == 0, F.lit(None).cast("string")).otherwise(F.col("p_type")).alias("product_category_name"),
        F.when(key % 50 == 0, F.lit(None).cast("double"))
        .otherwise(F.col("p_size") * F.lit(100.0))
        .alias("product_weight_g"),
    )


def _nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir, "nation", ["n_nationkey", "n_name"])


def _state(spark: SparkSession, sf_dir: str, nation: str) -> Column:
    """The nation's name, from a map of the 25 rows that the nation dimension
    has by schema. The party stays a plain scan whose size the planner knows."""
    names = _nation(spark, sf_dir).agg(F.map_from_entries(F.collect_list(F.struct("n_nationkey", "n_name")))).scalar()
    return F.try_element_at(names, F.col(nation))


def _zip(key: str, nation: str) -> Column:
    """Every 25th party's zip prefix (1000 up) has no geolocation row."""
    return F.when(F.col(key) % 25 == 24, F.lit(1000) + F.col(nation)).otherwise(F.col(nation)).cast("int")


def state_names(spark: SparkSession, sf_dir: str) -> list[str]:
    """All states of the nation dimension, in order (25 rows by schema)."""
    return [r[0] for r in _nation(spark, sf_dir).select("n_name").distinct().orderBy("n_name").collect()]


def fixture_sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scan(spark, sf_dir, "supplier", ["s_suppkey", "s_nationkey"])
    return s.select(
        F.col("s_suppkey").alias("seller_id"),
        _zip("s_suppkey", "s_nationkey").alias("seller_zip_code_prefix"),
        _state(spark, sf_dir, "s_nationkey").alias("seller_state"),
    )


def fixture_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _scan(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"])
    return c.select(
        F.col("c_custkey").alias("customer_id"),
        _zip("c_custkey", "c_nationkey").alias("customer_zip_code_prefix"),
        _state(spark, sf_dir, "c_nationkey").alias("customer_state"),
    )


def fixture_geolocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _scan(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"])
    nk, jitter = F.col("c_nationkey"), (F.col("c_custkey") % 10) * F.lit(0.01)
    return c.select(
        nk.alias("geolocation_zip_code_prefix"),
        (F.lit(-33.0) + nk * F.lit(1.4) + jitter).alias("geolocation_lat"),
        (F.lit(-73.0) + (nk * 7 % 25) * F.lit(1.6) - jitter).alias("geolocation_lng"),
    )


def fixture_order_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _scan(spark, sf_dir, "events", ["event_id"])
    eid = F.col("event_id")
    return e.select(
        (eid - F.when(eid % 50 == 1, 1).otherwise(0)).alias("order_id"),
        (F.lit(1) + eid % 5).cast("int").alias("review_score"),
    )


class FixtureTables(Tables):
    """The seven logical tables over one scale-factor directory; a table's plan
    is made when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        object.__setattr__(self, "_make", {name: (make, spark, sf_dir) for name, make in MAPPING.items()})

    def __getattr__(self, name: str) -> DataFrame:
        try:
            make, spark, sf_dir = self._make[name]
        except KeyError:
            raise AttributeError(name) from None
        df = make(spark, sf_dir)
        object.__setattr__(self, name, df)
        return df


MAPPING = {
    "orders": fixture_orders,
    "order_items": fixture_order_items,
    "products": fixture_products,
    "sellers": fixture_sellers,
    "customers": fixture_customers,
    "order_reviews": fixture_order_reviews,
    "geolocation": fixture_geolocation,
}


def load_fixture_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """All seven logical tables over one scale-factor directory (lazy plans)."""
    return FixtureTables(spark, sf_dir)
