"""Zip centroids, coordinate lookup and great-circle distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import haversine_km
from .joins import stored_side


def geo_centroid(geolocation: DataFrame) -> DataFrame:
    """Mean latitude / longitude per zip prefix (NULL zips dropped).

    Many raw rows per zip collapse map-side (partial avg) before the shuffle;
    the result has one row per zip, bounded by the zip-prefix domain.
    """
    return (
        geolocation.filter(F.col("geolocation_zip_code_prefix").isNotNull())
        .groupBy(F.col("geolocation_zip_code_prefix").alias("zip"))
        .agg(F.avg("geolocation_lat").alias("lat"), F.avg("geolocation_lng").alias("lng"))
    )


def add_coordinates(df: DataFrame, centroid: DataFrame, zip_col: str, lat_name: str, lng_name: str) -> DataFrame:
    """Left lookup of one role's coordinates by zip.

    The centroid is a stored side (``stored_side``): its files' size decides
    whether it is broadcast.
    """
    c = centroid.select(
        F.col("zip").alias(f"__{zip_col}"), F.col("lat").alias(lat_name), F.col("lng").alias(lng_name)
    )
    joined = df.join(c, df[zip_col] == c[f"__{zip_col}"], "left")
    return joined.drop(f"__{zip_col}")


def with_distance(df: DataFrame) -> DataFrame:
    """H1: distance_km between seller and customer coordinates."""
    return df.withColumn("distance_km", haversine_km("s_lat", "s_lng", "c_lat", "c_lng"))


def geo_enriched(df: DataFrame, geolocation: DataFrame) -> DataFrame:
    """C5 for both roles followed by H1."""
    centroid = stored_side(geo_centroid(geolocation), "geo-centroid")
    df = add_coordinates(df, centroid, "seller_zip_code_prefix", "s_lat", "s_lng")
    df = add_coordinates(df, centroid, "customer_zip_code_prefix", "c_lat", "c_lng")
    return with_distance(df)
