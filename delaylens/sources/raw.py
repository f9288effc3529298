"""Raw zone: typed CSV scans, the seven-file loader and table sinks."""

from __future__ import annotations

import csv
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import null_if_nan
from ..schemas import RAW_FILES
from .csv_records import csv_records


CORRUPT = "_corrupt_record"


def _scan_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All records of the header CSV files with the files' own columns, typed by
    name, and the text of malformed ones in ``CORRUPT``."""
    head = spark.read.option("lineSep", "\n").text(path).head()
    head = (head.value if head else "").lstrip("\ufeff").rstrip("\r")
    header = [c.strip() for c in next(csv.reader([head]), [])]
    missing = [f.name for f in schema.fields if f.name not in header]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    types = {f.name: f.dataType for f in schema.fields}
    own = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in header] + [T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "escape": '"', "columnNameOfCorruptRecord": CORRUPT, "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss"}
    records = csv_records(spark, path)
    # files of one folder must agree on the header
    same = F.regexp_replace("header", "^\ufeff|\r$", "") == head
    checked = F.when(same, F.col("record")).otherwise(F.raise_error(F.concat(F.lit("another CSV header: "), F.col("header"))))
    parsed = records.select("complete", checked.alias("record"))
    parsed = parsed.select("complete", "record", F.from_csv("record", own.toDDL(), options).alias("row"))
    bad = F.when(~F.col("complete"), F.col("record")).otherwise(F.col("row")[CORRUPT])
    return parsed.select(*[F.col("row")[c].alias(c) for c in header], bad.alias(CORRUPT))


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A1: header CSV with an explicit schema (no inference pass).

    Columns are bound by the header's names in whatever order; a missing one
    raises, further ones are left out. Quoted fields may hold doubled quotes and
    newlines; the files are read in byte ranges all the same (``csv_records``).
    Malformed and unclosed records are left to ``read_csv_rejects``. Timestamps
    parse as timestamp_ntz from ISO text; a UTF-8 byte-order mark in the header is
    ignored. A literal NaN in a double column becomes NULL: downstream means, fills
    and row drops treat both as missing, and Spark would otherwise keep NaN apart
    (``avg`` turns NaN, ``NaN > x`` is true).
    """
    df = _scan_csv(spark, path, schema).filter(F.col(CORRUPT).isNull())
    return df.select(
        *[
            null_if_nan(f.name).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in schema.fields
        ]
    )


def read_csv_rejects(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A1: the text of the records that don't fit the schema, and how many of their
    fields did; a record that is never closed comes line by line."""
    df = _scan_csv(spark, path, schema)
    parsed = F.size(F.array_compact(F.array(*[F.col(c).cast("string") for c in schema.names]))).alias("fields")
    return df.filter(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("row"), parsed)


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of the path's scheme, and the path for it."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, hpath = file_system(spark, path)
    return bool(fs.exists(hpath))


@dataclass
class LoadResult:
    tables: dict[str, DataFrame] = field(default_factory=dict)
    missing: list[str] = field(default_factory=list)
    rejects: dict[str, DataFrame] = field(default_factory=dict)

    def reject_counts(self) -> dict[str, int]:
        """Malformed rows per table."""
        return {name: df.count() for name, df in self.rejects.items()}


def load_raw_zone(spark: SparkSession, raw_dir: str, files: dict | None = None) -> LoadResult:
    """A2: map each raw file to its logical table; a missing file is reported
    (and skipped), not fatal, matching the upstream loader. Malformed rows are
    kept apart per table."""
    result = LoadResult()
    for file_name, (table, schema) in (files or RAW_FILES).items():
        path = f"{raw_dir.rstrip('/')}/{file_name}"
        if path_exists(spark, path):
            result.tables[table] = read_csv(spark, path, schema)
            result.rejects[table] = read_csv_rejects(spark, path, schema)
        else:
            result.missing.append(file_name)
    return result


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, fmt: str = "parquet") -> None:
    """A3: overwrite a table at ``path`` (replace semantics)."""
    writer = df.write.mode("overwrite").format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def parse_timestamps(df: DataFrame, columns: list[str], fmt: str | None = None) -> DataFrame:
    """Text -> timestamp_ntz wall clock; unparseable text becomes NULL.

    Never goes through the session time zone (a local time inside a
    daylight-saving gap keeps its wall clock): ISO text uses ``try_cast``; a
    custom pattern is parsed by ``to_timestamp_ntz`` only where the pattern
    matches (the lazy CASE keeps ANSI parse errors away from bad text).
    """
    out = df
    for c in columns:
        text = F.col(c).cast("string")
        if fmt:
            valid = F.try_to_timestamp(text, F.lit(fmt)).isNotNull()
            parsed = F.when(valid, F.to_timestamp_ntz(text, F.lit(fmt)))
        else:
            parsed = text.try_cast("timestamp_ntz")
        out = out.withColumn(c, parsed)
    return out
