"""The feature chain, in the upstream order:

centroid -> seller coords -> customer coords -> distance -> seller profile
-> profile join -> unknown-seller fill -> weight fill -> drop rows without
distance.

Order matters: the profile is computed before rows without a distance are
dropped. Every step is a plan-time decision on ``df.columns`` (schema
adaptive), never a data-dependent branch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .geo import add_coordinates, geo_centroid, with_distance
from .joins import stored_side
from .sellers import enrich_seller_rate, fill_seller_rate, seller_or_past_rate, seller_profile


@dataclass
class Prepared:
    features: DataFrame
    seller_profile: DataFrame


def fill_weight_from_rows(df: DataFrame, mean_weight=None) -> DataFrame:
    """Weight <- mean weight of the rows at hand (or a stored mean).

    Parity default is the batch mean (a scalar subquery over ``df``); pass a
    stored training mean to make scoring independent of batch composition.
    """
    fill = mean_weight if mean_weight is not None else df.agg(F.avg("product_weight_g")).scalar()
    return df.withColumn("product_weight_g", F.coalesce(F.col("product_weight_g"), F.lit(fill) if isinstance(fill, (int, float)) else fill))


def preprocess(
    df: DataFrame,
    geolocation: DataFrame | None = None,
    profile: DataFrame | None = None,
    centroid: DataFrame | None = None,
    rate_mode: str = "global",
    mean_weight=None,
    materialize: bool = True,
) -> Prepared:
    """Full feature chain. Returns the features and the seller profile used.

    ``rate_mode="global"`` is the upstream behaviour (rate over all rows,
    test rows included); ``"asof"`` uses only outcomes known before each
    purchase (L1): a seller without history gets the rate of all outcomes
    known by then, and NULL if there are none. A supplied ``profile``
    (scoring) is used as-is.

    With ``materialize`` (default) the geo-enriched rows are written once per
    input version to the shared folder, before the profile, the fills and the
    final rows read them; otherwise, or where the session names no shared
    folder, each of those branches recomputes the input joins.
    """
    cols = set(df.columns)
    if centroid is None and geolocation is not None:
        centroid = stored_side(geo_centroid(geolocation), "geo-centroid")
    if centroid is not None:
        if "seller_zip_code_prefix" in cols and "s_lat" not in cols:
            df = add_coordinates(df, centroid, "seller_zip_code_prefix", "s_lat", "s_lng")
        if "customer_zip_code_prefix" in cols and "c_lat" not in cols:
            df = add_coordinates(df, centroid, "customer_zip_code_prefix", "c_lat", "c_lng")
    cols = set(df.columns)
    if {"s_lat", "s_lng", "c_lat", "c_lng"} <= cols:
        df = with_distance(df)
    if "distance_km" not in df.columns:
        raise ValueError(
            "distance_km cannot be computed: supply geolocation (with zip columns) or s_lat/s_lng/c_lat/c_lng"
        )
    if materialize:
        df = stored_side(df, "feature-base")

    row_mean_weight = None
    supplied = profile is not None
    if not supplied:
        # one aggregate serves the profile and the row-mean weight (B7):
        # per-seller partial sums, so the rows are grouped once
        ext = df.groupBy("seller_id").agg(
            F.avg("is_late").alias("seller_late_rate"),
            F.count("is_late").alias("seller_order_count"),
            *([F.sum("product_weight_g").alias("__sw"), F.count("product_weight_g").alias("__cw")]
              if "product_weight_g" in df.columns else []),
        )
        profile = ext.filter(F.col("seller_id").isNotNull()).select(
            "seller_id", "seller_late_rate", "seller_order_count")
        if "product_weight_g" in df.columns:
            row_mean_weight = ext.agg(F.sum("__sw") / F.sum("__cw")).scalar()
    if "seller_late_rate" not in df.columns:
        if rate_mode == "asof":
            if row_mean_weight is not None:  # no profile is read here, so the mean needs no rows per seller
                row_mean_weight = df.agg(F.avg("product_weight_g")).scalar()
            df = seller_or_past_rate(df)
        elif rate_mode == "global":
            if not supplied:
                profile = stored_side(profile, "seller-profile")
            df = fill_seller_rate(enrich_seller_rate(df, profile), profile)
        else:
            raise ValueError(f"unknown rate_mode {rate_mode!r}")
    else:
        df = fill_seller_rate(df, profile)
    if "product_weight_g" in df.columns:
        df = fill_weight_from_rows(df, mean_weight if mean_weight is not None else row_mean_weight)
    return Prepared(df.na.drop(subset=["distance_km"]), profile)


def features_strict(df: DataFrame, geolocation: DataFrame, materialize: bool = True) -> DataFrame:
    """Prototype variant: profile from the rows, no fill of the rate,
    weight filled by the row mean, rows without distance or rate dropped.
    The geo-enriched rows feed three branches, so they are written once
    (see ``preprocess``)."""
    centroid = stored_side(geo_centroid(geolocation), "geo-centroid")
    df = add_coordinates(df, centroid, "seller_zip_code_prefix", "s_lat", "s_lng")
    df = add_coordinates(df, centroid, "customer_zip_code_prefix", "c_lat", "c_lng")
    df = with_distance(df)
    if materialize:
        df = stored_side(df, "feature-base-strict")
    df = enrich_seller_rate(df, stored_side(seller_profile(df), "seller-profile"), with_count=True)
    df = fill_weight_from_rows(df)
    return df.na.drop(subset=["distance_km", "seller_late_rate"])
