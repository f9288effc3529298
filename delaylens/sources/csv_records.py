"""CSV records from splittable byte ranges, newlines in quoted fields included.

A quoted field may hold newlines, so a line break ends a record only outside
quotes. Whether a line starts inside a quoted field follows from the quotes
before it (a doubled quote counts twice): quotes are counted per byte range of a
file, the parity is run up over a file's ranges, and inside a range over its
lines. So a file is read by as many tasks as it has ranges:

* the lines are scanned once and stored with their ranges and numbers, because
  where Spark cuts a file holds for one scan only;
* a file without such fields (no line with an odd number of quotes) is never
  shuffled: its lines are its records;
* lines of the others meet once per range to find those of records that span
  several lines, which are stored and grouped by the record's first line or, where
  a record runs over the end of a range, by that range. All other lines are
  records as they stand.

A record that is still open at the end of its file, or that is longer than
``max_bytes`` (an opening quote that was never closed swallows what follows), is
given line by line as incomplete; nothing of it is taken for a record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import stored_side

MAX_BYTES = 16 * 1024 * 1024


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, range, line, odd): ``line`` grows along the lines of a range."""
    text = spark.read.option("lineSep", "\n").text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    return text.select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("range"),
        F.monotonically_increasing_id().alias("line"),
        (quotes % 2).alias("odd"),
    )


def _ranges(lines: DataFrame) -> DataFrame:
    """One row a range: whether it starts inside a field, the range of the quote that
    opened it, its quotes, the file's header and whether records span lines."""
    sums = lines.groupBy("file", "range").agg(F.sum("odd").alias("odds"), F.min("line").alias("first"), F.min_by("value", "line").alias("head"))
    along = Window.partitionBy("file").orderBy("range")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(
        F.col("file").alias("of"),
        F.col("range").alias("at"),
        "odds",
        F.when(F.col("range") == 0, F.col("first")).alias("header_line"),
        (F.coalesce(F.sum("odds").over(earlier), F.lit(0)) % 2).alias("opened"),
        F.last(F.when(F.col("odds") > 0, F.col("range")), ignorenulls=True).over(earlier).alias("opener"),
        F.first("head").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("header"),
        (F.max("odds").over(Window.partitionBy("file")) > 0).alias("spans"),
    )


def csv_records(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(record, complete, header): the records of all files of ``path`` with their
    file's first line; the header line itself and blank records are left out."""
    from .catalog import materialize

    lines = materialize(_lines(spark, path), "csv-lines")
    ranges = stored_side(_ranges(lines), "csv-ranges")
    met = lines.join(ranges, (F.col("file") == F.col("of")) & (F.col("range") == F.col("at"))).drop("of", "at")
    met = met.filter(F.col("header_line").isNull() | (F.col("line") != F.col("header_line")))
    before = Window.partitionBy("file", "range").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file", "range").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    run = met.filter("spans").withColumn("quotes", F.coalesce(F.sum("odd").over(before), F.lit(0)))
    run = run.withColumn("inside", (F.col("opened") + F.col("quotes")) % 2)
    run = run.withColumn("start", F.max(F.when(F.col("inside") == 0, F.col("line"))).over(upto))

    continued = (F.col("opened") == 1) & (F.col("quotes") == 0)
    left_open = ((F.col("opened") + F.col("odds")) % 2 == 1) & (F.col("quotes") + F.col("odd") == F.col("odds"))
    spread = run.filter("inside = 1 or odd = 1").select(
        "file", "range", "line", "value", "odd", "header",
        F.when(continued, F.col("opener")).otherwise(F.col("range")).alias("home"),
        F.when(continued | left_open, -1).otherwise(F.col("start")).alias("key"),
    )
    spread = stored_side(spread, "csv-spread")
    single = met.join(spread.select("line"), "line", "left_anti").select(F.col("value").alias("record"), F.lit(True).alias("complete"), "header")

    record = ["file", "home", "key"]
    sizes = spread.groupBy(*record).agg(F.sum(F.octet_length("value") + 1).alias("bytes"), (F.sum("odd") % 2 == 0).alias("closed"))
    sizes = sizes.select(*[F.col(c).alias(f"r_{c}") for c in record], (F.col("closed") & (F.col("bytes") <= max_bytes)).alias("whole"))
    spread = spread.join(sizes, [F.col(c) == F.col(f"r_{c}") for c in record])
    content = F.array_sort(F.collect_list(F.struct("range", "line", "value")))
    joined = spread.filter("whole").groupBy(*record).agg(F.array_join(F.transform(content, lambda x: x["value"]), "\n").alias("record"), F.first("header").alias("header"))
    joined = joined.select("record", F.lit(True).alias("complete"), "header")
    broken = spread.filter("not whole").select(F.col("value").alias("record"), F.lit(False).alias("complete"), "header")

    every = single.unionByName(joined).unionByName(broken)
    every = every.select(F.regexp_replace("record", "\r$", "").alias("record"), "complete", "header")
    return every.filter(F.trim(F.col("record")) != "")
