"""Structured Streaming jobs.

S1 ``score_stream``: arriving order records (file source) -> stream-static
joins with the stored zip centroid and seller profile -> model -> sink. It
reuses the batch ``score_orders`` transform unchanged, with the fills taken
from the stored training statistics (a stream has no batch mean).

S2 ``late_rate_monitor``: delivery outcomes (file source) -> event-time
watermark -> daily tumbling windows per seller state -> late rate, written
per micro-batch in update mode; ``read_monitor`` resolves the latest value
per window and state. Windows older than the watermark are evicted from
state, and outcomes arriving behind the watermark are dropped, so state
stays bounded by (states x open days).

Every stream checkpoints under the shared checkpoint folder, so a restarted
query resumes exactly where it stopped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions import ntz_as_utc_instant, utc_instant_as_ntz
from ..operators.model import Artifacts, score_orders
from ..sources.raw import file_system
from ..sources.store import latest_version, publish

OUTCOME_SCHEMA = T.StructType(
    [
        T.StructField("order_id", T.LongType()),
        T.StructField("seller_state", T.StringType()),
        T.StructField("delivered_at", T.TimestampNTZType()),
        T.StructField("is_late", T.IntegerType()),
    ]
)


def read_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format("parquet")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def score_stream(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    artifacts: Artifacts,
    sink: str,
    checkpoint: str,
    available_now: bool = True,
    max_files: int | None = None,
) -> StreamingQuery:
    """Score arriving orders.

    Scored and rejected rows of an epoch are two folders of one version, named by
    one pointer that is written last (``sources.store``): a reader
    (``read_scored``) sees both or neither, and a retried epoch replaces its own
    version whole.
    """
    records = read_stream(spark, source, schema, max_files)
    fills = artifacts.fill_values()  # two stored scalars, read once per stream

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        batch = batch.persist()  # two folders read the same micro-batch
        scored, rejected = score_orders(batch, artifacts, fills=fills)
        write_epoch(spark, sink, epoch_id, scored.select(*SCORED), rejected.select(*REJECTED))
        batch.unpersist()

    writer = records.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


SCORED = ("order_id", "seller_id", "delay_risk_probability", "is_high_risk", "risk_label")
REJECTED = ("order_id", "seller_id", "reason")


def write_epoch(spark: SparkSession, sink: str, epoch: int, scored: DataFrame, rejected: DataFrame) -> None:
    """Publish both outputs of an epoch as one version."""

    def write(folder: str) -> None:
        scored.write.parquet(f"{folder}/scored")
        rejected.write.parquet(f"{folder}/rejected")

    publish(spark, f"{sink}/epochs/{epoch}", str(epoch), write)


def _epochs(spark: SparkSession, sink: str) -> dict[int, str]:
    """Folders of the published epochs that are not compacted yet."""
    _, last = _base(spark, sink)
    fs, path = file_system(spark, f"{sink}/epochs")
    numbers = [int(s.getPath().getName()) for s in fs.listStatus(path)] if fs.exists(path) else []
    found = {e: latest_version(spark, f"{sink}/epochs/{e}") for e in sorted(numbers) if e > last}
    return {e: version[0] for e, version in found.items() if version}


def read_scored(spark: SparkSession, sink: str) -> tuple[DataFrame, DataFrame] | None:
    """(scored, rejected) of all published epochs; None before the first."""
    base, _ = _base(spark, sink)
    folders = ([base] if base else []) + list(_epochs(spark, sink).values())
    if not folders:
        return None
    return tuple(spark.read.parquet(*[f"{folder}/{part}" for folder in folders]) for part in ("scored", "rejected"))


def compact_scored(spark: SparkSession, sink: str) -> None:
    """Fold the published epochs into one version of both outputs, then remove
    their folders. A reader that lists the epochs during the switch sees each
    row once: epochs up to the compacted one are left out by number."""
    epochs = _epochs(spark, sink)
    if not epochs:
        return
    scored, rejected = read_scored(spark, sink)

    def write(folder: str) -> None:
        scored.hint("rebalance").write.parquet(f"{folder}/scored")
        rejected.hint("rebalance").write.parquet(f"{folder}/rejected")

    publish(spark, f"{sink}/compacted", str(max(epochs)), write)
    fs, _ = file_system(spark, sink)
    for e in epochs:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sink}/epochs/{e}"), True)


def late_rate_windows(outcomes: DataFrame, watermark: str = "2 days", window: str = "1 day") -> DataFrame:
    """S2 transform (batch or stream): deliveries and late rate per window and state."""
    # watermarks need TIMESTAMP: read the wall clock as UTC (session-zone independent)
    timed = outcomes.withColumn("event_time", ntz_as_utc_instant("delivered_at"))
    if timed.isStreaming:
        timed = timed.withWatermark("event_time", watermark)
    agg = timed.groupBy(F.window("event_time", window).alias("w"), "seller_state").agg(
        F.count(F.lit(1)).alias("deliveries"), F.sum("is_late").cast("long").alias("late")
    )
    return agg.select(
        utc_instant_as_ntz("w.start").alias("window_start"),
        utc_instant_as_ntz("w.end").alias("window_end"),
        "seller_state",
        "deliveries",
        "late",
        (F.col("late") / F.col("deliveries")).alias("late_rate"),
    )


def late_rate_monitor(
    spark: SparkSession,
    source: str,
    sink: str,
    checkpoint: str,
    watermark: str = "2 days",
    available_now: bool = True,
    max_files: int | None = None,
    output_mode: str = "update",
) -> StreamingQuery:
    """Windowed late rate; each micro-batch's rows land in their own
    ``batch_id=`` folder (idempotent on retry).

    ``update`` emits a window whenever it changes (``read_monitor`` keeps the
    latest version); ``append`` emits each window once, when the watermark
    has passed its end, so windows still open at the end of a run stay in
    state until later data closes them."""
    if output_mode not in ("update", "append"):
        raise ValueError(f"unsupported output mode {output_mode!r}")
    windows = late_rate_windows(read_stream(spark, source, OUTCOME_SCHEMA, max_files), watermark)

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch_id={epoch_id}")

    writer = windows.writeStream.outputMode(output_mode).foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def read_monitor(spark: SparkSession, sink: str) -> DataFrame:
    """Latest row per (window, state) across micro-batches (an upsert view): one
    pass over the batches since the last compaction and its result."""
    return _latest(_versions(spark, sink)).drop("batch_id")


def _batches(spark: SparkSession, sink: str) -> list[int]:
    fs, path = file_system(spark, sink)
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n.removeprefix("batch_id=")) for n in names if n.startswith("batch_id="))


def _base(spark: SparkSession, sink: str) -> tuple[str | None, int]:
    """Folder of the last compaction and the last batch in it."""
    found = latest_version(spark, f"{sink}/compacted")
    return (found[0], int(found[1])) if found else (None, -1)


def _versions(spark: SparkSession, sink: str) -> DataFrame:
    base, last = _base(spark, sink)
    fresh = [f"{sink}/batch_id={b}" for b in _batches(spark, sink) if b > last]
    parts = [spark.read.parquet(base)] if base else []
    if fresh:
        parts.append(spark.read.option("basePath", sink).parquet(*fresh).withColumn("batch_id", F.col("batch_id").cast("long")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _latest(versions: DataFrame) -> DataFrame:
    rest = [c for c in versions.columns if c not in ("window_start", "seller_state", "batch_id")]
    top = versions.groupBy("window_start", "seller_state").agg(
        F.max("batch_id").alias("batch_id"), F.max_by(F.struct(*rest), "batch_id").alias("r")
    )
    return top.select("window_start", "r.window_end", "seller_state", *[f"r.{c}" for c in rest if c != "window_end"], "batch_id")


def compact_monitor(spark: SparkSession, sink: str) -> None:
    """Fold all batch folders into one table of latest rows, make it current,
    then remove the folders. A reader sees either side of the switch whole."""
    batches = _batches(spark, sink)
    base, last = _base(spark, sink)
    if not batches or batches[-1] <= last:
        return
    publish(spark, f"{sink}/compacted", str(batches[-1]), _latest(_versions(spark, sink)).write.parquet)
    fs, _ = file_system(spark, sink)
    for b in batches:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sink}/batch_id={b}"), True)
