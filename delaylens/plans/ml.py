"""Model plans: train once per data directory (artifacts build-if-absent in
the shared checkpoint folder), evaluate, score open orders, importance."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..operators.geo import geo_centroid
from ..operators.joins import dimension_join
from ..operators.metrics import roc_auc
from ..operators.model import (
    DEFAULT_PARAMS,
    Artifacts,
    TrainResult,
    evaluation_frame,
    feature_importance,
    load_artifacts,
    save_artifacts,
    score_orders,
    train_gbt,
    training_stats,
)
from ..schemas import FEATURES, LABEL
from ..sources.catalog import plan_version
from ..sources.store import current, publish
from ..sources.tables import Tables
from ..session import scratch_path
from . import common as c


def artifact_version(spark: SparkSession, sf_dir: str, params: dict) -> str:
    """Library, features, parameters and all input files behind the artifacts."""
    sig = f"{__version__}|{FEATURES}|{sorted(params.items())}|{plan_version(c.master(spark, sf_dir))}"
    return hashlib.sha256(sig.encode()).hexdigest()


def artifact_root(spark: SparkSession, sf_dir: str) -> str:
    return scratch_path(spark, "artifacts", hashlib.sha256(sf_dir.encode()).hexdigest()[:12])


def train_and_store(spark: SparkSession, sf_dir: str, **params) -> tuple[Artifacts, TrainResult]:
    """Train on the full feature chain and publish the artifacts as one version:
    readers see all parts of it or none."""
    params = {**DEFAULT_PARAMS, **params}
    version = artifact_version(spark, sf_dir, params)
    t = c.tables(spark, sf_dir)
    prep = c.features(spark, sf_dir)
    # places in the split by columns whose text is the same in every engine
    rows = prep.features.withColumn("price_cents", F.round(F.col("price") * 100).cast("long"))
    res = train_gbt(rows, ["order_id", "seller_id", "price_cents"], **params)
    centroid = geo_centroid(t.geolocation)
    stats = training_stats(prep.features, prep.seller_profile)
    folder = publish(
        spark, artifact_root(spark, sf_dir), version, lambda to: save_artifacts(res.model, prep.seller_profile, centroid, stats, to)
    )
    return load_artifacts(spark, folder), res


def stored_artifacts(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the artifacts of the present data, trained if absent."""
    root, version = artifact_root(spark, sf_dir), artifact_version(spark, sf_dir, DEFAULT_PARAMS)
    if not current(spark, root, version):
        train_and_store(spark, sf_dir)
    return current(spark, root, version)


def ensure_artifacts(spark: SparkSession, sf_dir: str) -> Artifacts:
    """A6-style build-if-absent for the model artifacts."""
    return load_artifacts(spark, stored_artifacts(spark, sf_dir))


def open_order_records(t: Tables) -> DataFrame:
    """Scoring records for orders not yet delivered (the 'new orders')."""
    orders = t.orders.filter(F.col("order_status") != "delivered").select("order_id", "customer_id")
    orders = dimension_join(orders, t.customers.select("customer_id", "customer_zip_code_prefix"), "customer_id")
    df = orders.join(t.order_items.select("order_id", "product_id", "seller_id", "price", "freight_value"), "order_id")
    df = dimension_join(df, t.products.select("product_id", "product_weight_g"), "product_id")
    df = dimension_join(df, t.sellers.select("seller_id", "seller_zip_code_prefix"), "seller_id")
    return df.select("order_id", "seller_id", "seller_zip_code_prefix", "customer_zip_code_prefix",
                     "product_weight_g", "freight_value", "price")


def training_facts(res: TrainResult) -> DataFrame:
    """Rows of each class in train and in the hold-out, hold-out rows without a
    probability, and what the fit has learned: the area under the curve by which the
    seller's late rate alone ranks the training rows, which any engine can state,
    and whether the model ranks them better. (The fixtures' labels owe next to
    nothing to the other features, so on the hold-out the difference is chance.)"""
    ev = evaluation_frame(res.model, res.test)
    plain = res.train.select(F.col(LABEL).cast("int").alias("y"), F.col("seller_late_rate").alias("p"))
    floor = roc_auc(plain).select("roc_auc").scalar()  # one row each
    own = roc_auc(evaluation_frame(res.model, res.train)).select("roc_auc").scalar()
    held = ev.groupBy("y").agg(F.count(F.lit(1)).alias("test_rows"), F.count_if(~F.col("p").between(0, 1) | F.col("p").isNull()).alias("bad_scores"))
    train = res.train.groupBy(F.col(LABEL).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("train_rows"))
    return train.join(held, "y", "left").select(
        F.col("y").alias("label"),
        "train_rows",
        F.coalesce("test_rows", F.lit(0)).cast("long").alias("test_rows"),
        F.coalesce("bad_scores", F.lit(0)).cast("long").alias("bad_scores"),
        floor.alias("rate_auc"),
        (own > floor).alias("beats_rate"),
    )


def q_train_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2-M5: train with upstream parameters, judge the fit."""
    return training_facts(train_and_store(spark, sf_dir)[1])


def scoring_facts(scored: DataFrame, rejected: DataFrame) -> DataFrame:
    """Per input row: whether it was scored, and whether its outputs agree
    (probability from 0 to 1, strict flag and label of the same side)."""
    p, flag = F.col("delay_risk_probability"), F.col("is_high_risk")
    agree = p.between(0, 1) & (flag == (p > 0.5)) & (F.col("risk_label") == F.when(flag, "HIGH RISK").otherwise("ON TRACK"))
    good = scored.select("order_id", "seller_id", F.lit("scored").alias("outcome"), F.coalesce(agree, F.lit(False)).alias("consistent"))
    return good.unionByName(rejected.select("order_id", "seller_id", F.col("reason").alias("outcome"), F.lit(True).alias("consistent")))


def q_score_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score open orders with the stored artifacts; every order item
    comes out once, scored or rejected with its reason."""
    return scoring_facts(*score_orders(open_order_records(c.tables(spark, sf_dir)), ensure_artifacts(spark, sf_dir)))


def q_feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8/F2: the top features of the stored model by mean gain, with gain and
    number of splits."""
    return feature_importance(spark, stored_artifacts(spark, sf_dir))
