"""Category name -> English name lookup.

``read_category_csv`` reads the upstream lookup file, keyed on Portuguese
category names. The benchmark tables have other names; ``derive_lookup`` makes
and stores a lookup table of theirs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CATEGORY_TRANSLATION
from ..operators.joins import stored_side
from .raw import read_csv


def read_category_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, CATEGORY_TRANSLATION)


def derive_lookup(products: DataFrame) -> DataFrame:
    """A stored lookup of the catalogue's category names: lower case, for all
    but those that start with an S, which have no translation."""
    name = F.col("product_category_name")
    names = products.filter(name.isNotNull() & ~name.startswith("S")).groupBy("product_category_name").agg(F.first(F.lower(name)).alias("product_category_name_english"))
    return stored_side(names, "category-lookup")


def translate_categories(df: DataFrame, lookup: DataFrame) -> DataFrame:
    """Left join on category name; unmatched names keep the original text."""
    out = df.join(lookup, "product_category_name", "left")
    return out.withColumn(
        "product_category_name_english",
        F.coalesce(F.col("product_category_name_english"), F.col("product_category_name")),
    )
