"""Registered queries of the sources, sinks and artifacts."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.sellers import seller_profile
from ..session import scratch_path
from ..sources.catalog import plan_version
from ..sources.raw import load_raw_zone, read_csv
from ..sources.records import parse_records
from ..sources.store import current, publish
from . import common as c
from .ml import open_order_records

REVIEW_CSV = T.StructType(
    [
        T.StructField("order_id", T.LongType()),
        T.StructField("review_score", T.IntegerType()),
        T.StructField("review_comment_message", T.StringType()),
    ]
)


def q_raw_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: all reviews as CSV files with quotes, doubled quotes and newlines in
    their comments and the columns in another order, read back by name."""
    reviews = c.tables(spark, sf_dir).order_reviews
    text = F.concat(F.lit('so "good", '), F.col("review_score").cast("string"), F.lit("\nor "), F.col("order_id").cast("string"))
    comment = F.when(F.col("order_id") % 7 != 0, text)  # every seventh is missing
    path = scratch_path(spark, "stored", f"reviews-{uuid.uuid4().hex[:12]}")
    written = reviews.select(comment.alias("review_comment_message"), F.lit("x").alias("further"), "review_score", "order_id")
    written.write.option("header", True).option("escape", '"').csv(path)
    return read_csv(spark, path, REVIEW_CSV)


def q_profile_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seller profile, published as a versioned artifact and read back."""
    profile = seller_profile(c.master(spark, sf_dir, "seller_id", "is_late"))
    root = scratch_path(spark, "stored", "profile-" + hashlib.sha256(sf_dir.encode()).hexdigest()[:12])
    version = plan_version(profile)
    folder = current(spark, root, version) or publish(spark, root, version, profile.write.parquet)
    return spark.read.parquet(folder)


PRODUCT_CSV = T.StructType(
    [
        T.StructField("product_id", T.LongType()),
        T.StructField("product_category_name", T.StringType()),
        T.StructField("product_weight_g", T.DoubleType()),
    ]
)
SELLER_CSV = T.StructType([T.StructField("seller_id", T.LongType()), T.StructField("seller_state", T.StringType())])


def q_raw_zone_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: a raw zone of three files, one of them absent, loaded into tables. Every
    ninth product's category holds a newline and every thirteenth weight is no
    number. Per table: rows, rejects and the characters of its text column."""
    t = c.tables(spark, sf_dir)
    zone = scratch_path(spark, "stored", f"zone-{uuid.uuid4().hex[:12]}")
    number = F.col("product_id")
    broken = F.when(number % 9 == 0, F.concat("product_category_name", F.lit("\nsecond line"))).otherwise(F.col("product_category_name"))
    weight = F.when(number % 13 == 0, F.lit("heavy")).otherwise(F.col("product_weight_g").cast("string"))
    products = t.products.select("product_id", broken.alias("product_category_name"), weight.alias("product_weight_g"))
    for name, df in (("products.csv", products), ("sellers.csv", t.sellers.select("seller_state", "seller_id"))):
        df.write.option("header", True).option("escape", '"').csv(f"{zone}/{name}")
    texts = {"products": "product_category_name", "sellers": "seller_state"}
    files = {"products.csv": ("products", PRODUCT_CSV), "sellers.csv": ("sellers", SELLER_CSV), "customers.csv": ("customers", SELLER_CSV)}
    loaded = load_raw_zone(spark, zone, files)
    out = spark.createDataFrame([(name.removesuffix(".csv"), "missing") for name in loaded.missing], "table string, state string")
    out = out.select("*", *[F.lit(None).cast("long").alias(n) for n in ("rows", "rejects", "characters")])
    for name, df in loaded.tables.items():
        rejects = loaded.rejects[name].agg(F.count(F.lit(1)).alias("n")).scalar()  # one row
        facts = df.agg(F.count(F.lit(1)).alias("rows"), rejects.alias("rejects"), F.sum(F.length(texts[name])).cast("long").alias("characters"))
        out = out.unionByName(facts.select(F.lit(name).alias("table"), F.lit("loaded").alias("state"), "*"))
    return out


def q_records_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The open orders as JSON records, bound to the scoring schema. By the last
    digit of the order some lack a price (3), have a price that is no number (7) or
    are cut off (9); records of the last two kinds come with a reason."""
    digit = F.col("order_id") % 10
    price = F.when(digit == 7, F.lit("n/a")).when(digit != 3, F.col("price").cast("string"))
    rows = open_order_records(c.tables(spark, sf_dir))
    text = F.to_json(F.struct(*[price.alias("price") if name == "price" else F.col(name) for name in rows.columns]))
    texts = rows.select(F.when(digit == 9, F.substring(text, 1, 12)).otherwise(text).alias("record"))
    found = parse_records(texts, stored=True)
    kept = found.records.select(
        F.col("order_id").cast("long").alias("order_id"), F.col("seller_id").cast("long").alias("seller_id"),
        "product_weight_g", "freight_value", "price", F.lit("ok").alias("reason"),
    )
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in kept.schema.fields if f.name != "reason"]
    return kept.unionByName(found.rejects.select(*nothing, "reason"))
