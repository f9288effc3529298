"""Records to a DataFrame (one dict or a list of dicts, or a table of JSON
texts).

A record is bound to the schema field by field: a missing key or a null is NULL,
further keys are left out. A record that isn't an object, or that has a value of
the wrong type, is given apart with a reason; it fails no other record. Request
-sized input comes as Python objects; batches come as a table of texts and never
pass through the driver.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import null_if_nan
from ..operators.joins import stored_side
from ..schemas import SCORING_RECORD


@dataclass
class RecordResult:
    records: DataFrame  # the schema's columns
    rejects: DataFrame  # record (its text), reason


def parse_records(texts: DataFrame, schema: T.StructType = SCORING_RECORD, column: str = "record", stored: bool = False) -> RecordResult:
    """Bind the JSON texts in ``column`` to ``schema``.

    Reasons: ``not_a_record`` (no JSON object), ``wrong_type:a,b`` (the fields that
    don't fit). Numbers written as text count as numbers. With ``stored`` the bound rows
    are written once, and records and rejects both read them.
    """
    def judge(row: Column, values: Column) -> Column:
        bad = [F.when(F.try_element_at(values, F.lit(n)).isNotNull() & row.getField(n).isNull(), F.lit(n)) for n in schema.names]
        return F.struct(values.isNull().alias("none"), F.array_compact(F.array(*bad)).alias("wrong"), row.alias("row"))

    def bind(values: Column) -> Column:
        typed = F.struct(*[F.try_element_at(values, F.lit(f.name)).try_cast(f.dataType).alias(f.name) for f in schema.fields])
        return F.transform(F.array(typed), lambda row: judge(row, values))[0]

    # A text is parsed and bound once a row: both are variables of a lambda, and a
    # filter doesn't move below a projection that has a non-deterministic column, where
    # each mention of a field would become a copy of the parsing.
    text = F.col(column)
    parsed = texts.select(text.alias("__text"), F.transform(F.array(F.from_json(text, "map<string,string>")), bind)[0].alias("__found"), F.spark_partition_id().alias("__at"))
    reason = F.when(F.col("__found.none"), "not_a_record").when(F.size("__found.wrong") > 0, F.concat(F.lit("wrong_type:"), F.array_join("__found.wrong", ",")))
    bound = parsed.filter(F.col("__at") >= 0).select(reason.alias("__reason"), "__text", "__found.row")
    bound = bound.select("__reason", F.when(F.col("__reason").isNotNull(), F.col("__text")).alias("__text"), "row")
    if stored:
        bound = stored_side(bound, "records")
    values = {f.name: F.col(f"row.{f.name}") for f in schema.fields}
    columns = [null_if_nan(values[f.name]).alias(f.name) if isinstance(f.dataType, T.DoubleType) else values[f.name] for f in schema.fields]
    return RecordResult(
        bound.filter(F.col("__reason").isNull()).select(*columns),
        bound.filter(F.col("__reason").isNotNull()).select(F.col("__text").alias("record"), F.col("__reason").alias("reason")),
    )


def read_records(spark: SparkSession, data, schema: T.StructType = SCORING_RECORD) -> RecordResult:
    """The same for one dict or a list of them; whatever JSON can't write is bound
    by its text."""
    rows = [data] if isinstance(data, dict) else list(data)
    texts = [(json.dumps({k: None if v != v else v for k, v in r.items()} if isinstance(r, dict) else r, default=str),) for r in rows]  # NaN is missing
    return parse_records(spark.createDataFrame(texts, "record string"), schema)


def records_to_df(spark: SparkSession, data, schema: T.StructType = SCORING_RECORD) -> DataFrame:
    """The records that fit the schema."""
    return read_records(spark, data, schema).records
