"""Streaming plans: let data from the fixture tables arrive in the shared
folder, slice by slice, run the stream over each arrival with ``availableNow``
and read the sink back as a batch DataFrame."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import dimension_join
from ..operators.master import select_cohort, with_late_flag
from ..schemas import SCORING_RECORD
from ..session import scratch_path
from ..streaming.jobs import compact_monitor, late_rate_monitor, read_monitor, read_scored, score_stream
from . import common as c
from .ml import ensure_artifacts, open_order_records, scoring_facts


def _run_dir(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, "streams", f"{name}-{uuid.uuid4().hex[:10]}")


#: Registered monitor run: years per arrival slice; outcomes of every 41st order,
#: but for a year's last two months, arrive two slices late. (Whether the batch
#: before or the one before that sets the mark for late rows is Spark's affair;
#: rows that far behind are late by either.)
SLICE_YEARS, LATE_EVERY, LATE_SLICES = 2, 41, 2


def delivery_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = c.tables(spark, sf_dir)
    orders = with_late_flag(select_cohort(t.orders, "delivered")).select(
        "order_id", F.col("order_delivered_customer_date").alias("delivered_at"), "is_late")
    items = orders.join(t.order_items.select("order_id", "seller_id"), "order_id")
    out = dimension_join(items, t.sellers.select("seller_id", "seller_state"), "seller_id")
    return out.select(F.col("order_id").cast("long"), "seller_state", "delivered_at", F.col("is_late").cast("int"))


def with_arrival(outcomes: DataFrame) -> DataFrame:
    """The slice in which an outcome arrives: that of its year, or later."""
    year = F.year("delivered_at")
    first = outcomes.agg(F.min(year)).scalar()
    late = F.when((F.col("order_id") % LATE_EVERY == 0) & (F.month("delivered_at") <= 10), LATE_SLICES).otherwise(0)
    return outcomes.withColumn("arrival", F.floor((year - first) / SLICE_YEARS).cast("int") + late)


def q_stream_late_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2 over all delivery outcomes as they arrive: a run of the stream for
    each slice, in time order, on one checkpoint. Windows open and close across
    the runs; outcomes that arrive behind the watermark are dropped."""
    run = _run_dir(spark, "monitor")
    outcomes = with_arrival(delivery_outcomes(spark, sf_dir))
    outcomes.write.partitionBy("arrival").parquet(f"{run}/outcomes")
    stored = spark.read.parquet(f"{run}/outcomes")
    slices = [r.arrival for r in stored.select("arrival").distinct().orderBy("arrival").collect()]  # a few
    for k in slices:
        stored.filter(F.col("arrival") == k).drop("arrival").write.parquet(f"{run}/incoming/slice-{k:04d}")
        late_rate_monitor(spark, f"{run}/incoming/*", f"{run}/sink", f"{run}/checkpoint").awaitTermination()
    compact_monitor(spark, f"{run}/sink")
    return read_monitor(spark, f"{run}/sink")


def q_stream_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 over the open orders: the facts of ``score_orders``, from the published
    epochs."""
    art = ensure_artifacts(spark, sf_dir)
    run = _run_dir(spark, "score")
    records = open_order_records(c.tables(spark, sf_dir)).select(
        *[F.col(f.name).cast(f.dataType) for f in SCORING_RECORD.fields])
    records.write.mode("overwrite").parquet(f"{run}/incoming")
    q = score_stream(spark, f"{run}/incoming", SCORING_RECORD, art, f"{run}/sink", f"{run}/checkpoint")
    q.awaitTermination()
    facts = scoring_facts(*read_scored(spark, f"{run}/sink"))
    return facts.withColumns({k: F.col(k).cast("long") for k in ("order_id", "seller_id")})  # text in records
