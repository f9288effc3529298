"""Route risk: per (origin, destination) statistics, volume threshold,
pivoted matrix, distance bands and carrier-routing segment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lifecycle import avg_days, exact_percentiles


def route_stats(lm: DataFrame) -> DataFrame:
    """Mean transit days, late rate and row count per state pair.

    A plain two-key aggregate: partial aggregation on the map side absorbs
    hot routes before the shuffle.
    """
    return lm.groupBy("seller_state", "customer_state").agg(
        avg_days("time_in_transit").alias("avg_transit_time"),
        F.avg("is_late").alias("late_rate"),
        F.count("order_id").alias("count"),
    )


def major_routes(stats: DataFrame, min_count: int = 50) -> DataFrame:
    """Keep routes with strictly more than ``min_count`` rows."""
    return stats.filter(F.col("count") > min_count)


def route_matrix(stats: DataFrame, destinations: list[str] | None = None) -> DataFrame:
    """Origins as rows, destinations as columns, late rate as cell.

    Pass ``destinations`` to fix the output schema and skip the extra job
    Spark would otherwise run to find the distinct pivot values. Absent
    pairs are NULL. Input is one row per route, so ``first`` is exact.
    """
    grouped = stats.groupBy("seller_state")
    pivoted = grouped.pivot("customer_state", destinations) if destinations else grouped.pivot("customer_state")
    return pivoted.agg(F.first("late_rate"))


def late_by_distance(features: DataFrame, band_km: float = 250.0) -> DataFrame:
    """L4: late rate per distance band, split into same-state and cross-state."""
    same = (F.col("seller_state") == F.col("customer_state"))
    return (
        features.filter(F.col("distance_km").isNotNull())
        .groupBy(
            (F.floor(F.col("distance_km") / F.lit(float(band_km))) * F.lit(float(band_km))).alias("band_start_km"),
            F.coalesce(same, F.lit(False)).alias("same_state"),
        )
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum("is_late").cast("long").alias("late"),
            F.avg("is_late").alias("late_rate"),
            F.avg("distance_km").alias("avg_distance_km"),
        )
    )


def routing_candidates(features: DataFrame, quantile: float = 0.75) -> DataFrame:
    """Long-distance and heavy shipments (both above their ``quantile``).

    The two cut points are exact interpolated quantiles over the whole
    feature table, from one stacked (measure, value) histogram, returned as
    one struct scalar subquery; rows are flagged with a plain ``when`` in a
    single projection.
    """
    stacked = features.select(
        F.expr("stack(2, 'distance_km', distance_km, 'product_weight_g', product_weight_g) as (measure, value)")
    ).filter(F.col("value").isNotNull())
    q = exact_percentiles(stacked, "measure", "value", [quantile], ["q"])
    # one struct-valued scalar subquery carries both cut points
    cuts = q.agg(
        F.struct(
            F.max(F.when(F.col("measure") == "distance_km", F.col("q"))).alias("d"),
            F.max(F.when(F.col("measure") == "product_weight_g", F.col("q"))).alias("w"),
        )
    ).scalar()
    d_cut, w_cut = cuts.getField("d"), cuts.getField("w")
    long_heavy = (F.col("distance_km") > d_cut) & (F.col("product_weight_g") > w_cut)
    return features.select(
        "order_id",
        "seller_id",
        "distance_km",
        "product_weight_g",
        "is_late",
        F.coalesce(long_heavy, F.lit(False)).alias("premium_carrier"),
    )


def routing_summary(candidates: DataFrame) -> DataFrame:
    """L8 report: size and late rate of the premium segment vs the rest."""
    return candidates.groupBy("premium_carrier").agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg("is_late").alias("late_rate"),
        F.avg("distance_km").alias("avg_distance_km"),
        F.avg("product_weight_g").alias("avg_weight_g"),
    )
