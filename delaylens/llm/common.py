"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

INTERNAL = "__llm_"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stage(df: DataFrame, name: str, level: int = 3) -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder and read
    it back: lineage ends at files every executor can reach, so a lost
    executor re-reads a table instead of replaying the steps before it."""
    path = scratch_path(df.sparkSession, "llm", f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_by(df: DataFrame, name: str, column: str) -> DataFrame:
    """``stage`` with the rows of one value of ``column`` in one of as many buckets
    as there are shuffle partitions: grouping by it later moves nothing."""
    spark = df.sparkSession
    table = f"llm_{name}_{uuid.uuid4().hex[:12]}".replace("-", "_")
    writer = df.write.option("compression", "zstd").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), column)
    writer.option("path", scratch_path(spark, "llm", table)).saveAsTable(table)
    return spark.table(table)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, not yet existing path under the shared checkpoint folder."""
    return scratch_path(spark, "llm", f"{name}-{uuid.uuid4().hex[:12]}")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def text_key(text: Column) -> Column:
    """Names a text next to its id, so that rows sharing an id stay apart;
    rows equal in both are copies of one row and have equal results."""
    return F.xxhash64(text, F.octet_length(text))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. A text without other characters takes the fast
    built-in; the rest goes through a character map."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def join_on_rows(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on (__id, __key); a null id equals a null id. ``right`` has one row
    for each pair. The key columns of ``left`` stay."""
    r = right.withColumnsRenamed({"__id": "__rid", "__key": "__rkey"})
    joined = left.join(r, left["__id"].eqNullSafe(r["__rid"]) & (left["__key"] == r["__rkey"]), how)
    return joined if how in ("left_semi", "left_anti") else joined.drop("__rid", "__rkey")


_shipped: set[str] = set()


def map_arrow(df: DataFrame, task, schema: str) -> DataFrame:
    """``mapInArrow`` whose tasks can import this package.

    A local session started outside the repository hands the package to its
    Python workers; on a cluster it is installed or passed with --py-files.
    """
    context = df.sparkSession.sparkContext
    if context.master.split("[")[0] == "local" and context.applicationId not in _shipped:
        context.addFile(str(Path(__file__).resolve().parents[1]), recursive=True)
        _shipped.add(context.applicationId)
    return df.mapInArrow(task, schema)
