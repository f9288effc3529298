"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per
operator of the inventory. Doubles are rounded to 6 places on output so the
SQL oracle comparison is insensitive to summation order."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import geo, lifecycle, master as m, metrics, reports, routes, sellers
from ..operators.features import features_strict, fill_weight_from_rows, preprocess
from ..operators.joins import stored_side
from ..operators.split import stratified_split_counts
from ..session import scratch_path
from ..sources.catalog import bucket_order_tables, ensure_master, read_master, register_master, run_sql, write_master
from ..sources.fixtures import state_names
from ..sources.raw import parse_timestamps
from . import common as c
from .stores import q_profile_roundtrip, q_raw_csv_roundtrip, q_raw_zone_loaded, q_records_parsed
from .ml import q_feature_importance, q_score_orders, q_train_gbt
from .streams import q_stream_late_monitor, q_stream_scored

Query = Callable[[SparkSession, str], DataFrame]

def _delivered_orders(spark, sf):
    o = m.with_late_flag(m.delivered_orders(c.tables(spark, sf).orders))
    return o.select("order_id", "customer_id", "order_purchase_timestamp", "order_delivered_customer_date",
                    "order_estimated_delivery_date", "is_late")


def _lifecycle_orders(spark, sf):
    return m.lifecycle_orders(c.tables(spark, sf).orders).select(
        "order_id", "order_approved_at", "order_delivered_carrier_date", "order_delivered_customer_date")


def _is_late_flag(spark, sf):
    return m.with_late_flag(c.tables(spark, sf).orders).select("order_id", "order_status", "is_late")


def _order_items_joined(spark, sf):
    t = c.tables(spark, sf)
    o = m.with_late_flag(m.delivered_orders(t.orders)).select("order_id", "is_late")
    return m.order_items_joined(o, t.order_items.select("order_id", "product_id", "seller_id", "price", "freight_value"))


def _master_scan(spark, sf):
    register_master(c.master(spark, sf))
    return run_sql(spark)


def _master_inner(spark, sf):
    return m.build_master_inner(c.tables(spark, sf))


def _review_fanout(spark, sf):
    return m.review_fanout(c.tables(spark, sf))


def _weight_filled_catalog(spark, sf):
    t = c.tables(spark, sf)
    o = m.delivered_orders(t.orders).select("order_id")
    items = o.join(t.order_items.select("order_id", "product_id"), "order_id")
    df = items.join(t.products.select("product_id", "product_weight_g"), "product_id", "left")
    return m.fill_weight_from_catalog(df, t.products).select("order_id", "product_id", "product_weight_g")


def _weight_filled_rows(spark, sf):
    df = m.build_master_inner(c.tables(spark, sf))
    return fill_weight_from_rows(df).select("order_id", "seller_id", "price", "product_weight_g")


def _geo_centroid(spark, sf):
    return geo.geo_centroid(c.tables(spark, sf).geolocation)


ZIPS = ["order_id", "seller_id", "seller_zip_code_prefix", "customer_zip_code_prefix"]


def _geo_enriched(spark, sf):
    t = c.tables(spark, sf)
    df = geo.geo_enriched(m.build_master(t, columns=ZIPS), t.geolocation)
    return df.select("order_id", "seller_id", "seller_zip_code_prefix", "customer_zip_code_prefix",
                     "s_lat", "s_lng", "c_lat", "c_lng")


def _order_distance(spark, sf):
    t = c.tables(spark, sf)
    return geo.geo_enriched(m.build_master(t, columns=ZIPS), t.geolocation).select("order_id", "seller_id", "distance_km")


def _seller_profile(spark, sf):
    # D2 over the master rows (the geo lookups of the feature chain keep every row)
    return sellers.seller_profile(c.master(spark, sf, "seller_id", "is_late"))


def _seller_enriched(spark, sf):
    mm = c.master(spark, sf, "order_id", "seller_id", "is_late")
    return sellers.enrich_seller_rate(mm, stored_side(sellers.seller_profile(mm), "seller-profile"), with_count=True).select(
        "order_id", "seller_id", "is_late", "seller_late_rate", "seller_order_count")


def _seller_rate_filled(spark, sf):
    t = c.tables(spark, sf)
    profile = stored_side(sellers.seller_profile(m.build_master(t, columns=["seller_id", "is_late"])), "seller-profile")
    open_orders = t.orders.filter(F.col("order_status") != "delivered").select("order_id")
    items = open_orders.join(t.order_items.select("order_id", "seller_id"), "order_id")
    df = sellers.enrich_seller_rate(items, profile)
    known = F.col("seller_late_rate").isNotNull()
    return sellers.fill_seller_rate(df.withColumn("known_seller", known), profile).select(
        "order_id", "seller_id", "known_seller", "seller_late_rate")


FEATURE_COLUMNS = ["order_id", "seller_id", "distance_km", "seller_late_rate", "product_weight_g",
                   "freight_value", "price", "is_late"]


def _features(spark, sf):
    return c.features(spark, sf).features.select(*FEATURE_COLUMNS)


def _features_asof(spark, sf):
    return c.features(spark, sf, rate_mode="asof").features.select(*FEATURE_COLUMNS)


def _features_preview(spark, sf):
    return reports.preview(c.features(spark, sf).features, ["order_id", "distance_km", "seller_late_rate", "is_late"])


def _features_strict(spark, sf):
    t = c.tables(spark, sf)
    return features_strict(m.build_master_inner(t), t.geolocation).select(*FEATURE_COLUMNS, "seller_order_count")


def _stage_durations(spark, sf):
    return lifecycle.stage_durations(c.tables(spark, sf).orders)


def _stage_averages(spark, sf):
    return lifecycle.stage_averages(c.lifecycle(spark, sf))


def _stage_histogram(spark, sf):
    return lifecycle.stage_histogram(c.lifecycle(spark, sf))


def _stage_density(spark, sf):
    return lifecycle.stage_density(c.lifecycle(spark, sf))


def _route_stats(spark, sf):
    return routes.route_stats(c.lifecycle(spark, sf))


def _major_routes(spark, sf):
    return routes.major_routes(routes.route_stats(c.lifecycle(spark, sf)), 50)


def _route_matrix(spark, sf):
    major = routes.major_routes(routes.route_stats(c.lifecycle(spark, sf)), 50)
    return routes.route_matrix(major, state_names(spark, sf))


def _kpis(spark, sf):
    return reports.kpis(c.master(spark, sf, "order_id", "is_late", "review_score", "freight_value"))


def _late_by_category(spark, sf):
    return reports.late_by_category(c.master(spark, sf, "is_late", "product_category_name"))


def _worst_categories(spark, sf):
    return reports.worst_categories(c.master(spark, sf, "is_late", "product_category_name"), 10)


def _scored(spark, sf):
    return c.fixture_score(c.master(spark, sf, "order_id", "seller_id", "is_late"))


def _confusion(spark, sf):
    return metrics.confusion(_scored(spark, sf), 0.5)


def _risk_flag(spark, sf):
    s = _scored(spark, sf).withColumnRenamed("p", "delay_risk_probability")
    return metrics.with_risk(s).select("order_id", "seller_id", "delay_risk_probability", "is_high_risk", "risk_label")


def _threshold_sweep(spark, sf):
    return metrics.threshold_sweep(_scored(spark, sf))


def _classification_report(spark, sf):
    s = _scored(spark, sf).withColumn("pred", (F.col("p") > 0.5).cast("int"))
    return metrics.classification_report(s)


def _roc_auc(spark, sf):
    return metrics.roc_auc(_scored(spark, sf))


def _ts_parse(spark, sf):
    o = c.tables(spark, sf).orders
    cols = ["order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date"]
    # timestamp_ntz -> ISO text without the session zone (date_format would use it)
    text = o.select("order_id", *[F.col(x).cast("string").alias(x) for x in cols])
    return parse_timestamps(text, cols, "yyyy-MM-dd HH:mm:ss")


def _unscorable_rows(spark, sf):
    from ..operators.model import split_scorable

    t = c.tables(spark, sf)
    base = m.build_master(t, columns=[*ZIPS, "is_late", "product_weight_g", "price", "freight_value"])
    profile = sellers.seller_profile(base)
    _, rejected = split_scorable(base, stored_side(geo.geo_centroid(t.geolocation), "geo-centroid"), profile)
    return rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


def _stratified_split(spark, sf):
    # the split of the feature table as the `features` query exposes it; the
    # hash is over columns whose text is the same in every engine
    cents = F.round(F.col("price") * 100).cast("long").alias("price_cents")
    # every histogram of the split reads the rows again: stored once
    rows = stored_side(c.features(spark, sf).features.select(*FEATURE_COLUMNS, cents), "split-rows")
    return stratified_split_counts(rows, "is_late", 0.2, 42, ["order_id", "seller_id", "price_cents"])


def _seller_rate_asof(spark, sf):
    rows = c.delivered_item_rows(c.tables(spark, sf))
    return sellers.seller_rate_asof(rows).select(
        "order_id", "seller_id", "order_purchase_timestamp", "seller_hist_items", "seller_hist_late",
        "seller_late_rate_asof")


def _order_funnel(spark, sf):
    return lifecycle.order_funnel(c.tables(spark, sf).orders)


def _handover_gap(spark, sf):
    return lifecycle.handover_gap(c.lifecycle(spark, sf))


def _late_by_distance(spark, sf):
    return routes.late_by_distance(c.features(spark, sf).features)


def _late_pareto(spark, sf):
    return sellers.late_pareto(c.master(spark, sf, "seller_id", "is_late"))


def _worst_sellers(spark, sf):
    return sellers.worst_sellers(stored_side(sellers.seller_profile(c.master(spark, sf, "seller_id", "is_late")), "seller-profile"), 0.1)


def _routing_candidates(spark, sf):
    return routes.routing_summary(routes.routing_candidates(c.features(spark, sf).features, 0.75))


def _category_translated(spark, sf):
    from ..sources.lookup import derive_lookup, translate_categories

    lookup = derive_lookup(c.tables(spark, sf).products)
    return translate_categories(c.master(spark, sf, "product_category_name"), lookup).groupBy("product_category_name_english").agg(
        F.count(F.lit(1)).alias("rows"))


def _review_by_late(spark, sf):
    return reports.review_by_late(c.master(spark, sf, "is_late", "review_score"))


def _demand_by_state(spark, sf):
    return reports.demand_by_state(c.features(spark, sf).features)


def _calendar_features(spark, sf):
    return reports.calendar_late_rates(c.master(spark, sf, "order_purchase_timestamp", "is_late"))


def _master_stored(spark, sf):
    path = scratch_path(spark, "stored", f"master-{uuid.uuid4().hex[:12]}")
    write_master(c.master(spark, sf), path)
    return read_master(spark, path)


def _ensure_master(spark, sf):
    path = scratch_path(spark, "stored", "master-" + hashlib.sha256(sf.encode()).hexdigest()[:12])
    return ensure_master(spark, path, lambda: c.tables(spark, sf))


def _review_fanout_bucketed(spark, sf):
    name = uuid.uuid4().hex[:12]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return m.review_fanout(bucket_order_tables(c.tables(spark, sf), scratch_path(spark, "stored", f"bucketed-{name}"), n, f"dl_{name}"))


def _dimension_keys(spark, sf):
    return m.dimension_keys(c.tables(spark, sf))


def _features_adaptive(spark, sf):
    """The chain over rows that bring their coordinates and, but for every
    third seller, a late rate of their own: neither is looked up, only the gaps of
    the rate are filled."""
    t = c.tables(spark, sf)
    placed = geo.geo_enriched(c.master(spark, sf), t.geolocation)
    own = F.when(F.col("seller_id") % 3 != 0, F.col("seller_id") % 20 / F.lit(20.0))
    rows = preprocess(placed.withColumn("seller_late_rate", own)).features
    return rows.select("order_id", "seller_id", "distance_km", "seller_late_rate", "product_weight_g", "is_late")


def _daily_orders(spark, sf):
    return reports.daily_orders(c.tables(spark, sf).orders)


QUERIES: dict[str, Query] = {
    "master": lambda s, sf: c.master(s, sf),
    "delivered_orders": _delivered_orders,
    "lifecycle_orders": _lifecycle_orders,
    "is_late_flag": _is_late_flag,
    "order_items_joined": _order_items_joined,
    "master_scan": _master_scan,
    "master_inner": _master_inner,
    "review_fanout": _review_fanout,
    "weight_filled_catalog": _weight_filled_catalog,
    "weight_filled_rows": _weight_filled_rows,
    "geo_centroid": _geo_centroid,
    "geo_enriched": _geo_enriched,
    "order_distance": _order_distance,
    "seller_profile": _seller_profile,
    "seller_enriched": _seller_enriched,
    "seller_rate_filled": _seller_rate_filled,
    "features": _features,
    "features_preview": _features_preview,
    "features_asof": _features_asof,
    "stage_durations": _stage_durations,
    "stage_averages": _stage_averages,
    "route_stats": _route_stats,
    "major_routes": _major_routes,
    "route_matrix": _route_matrix,
    "kpis": _kpis,
    "late_by_category": _late_by_category,
    "worst_categories": _worst_categories,
    "confusion": _confusion,
    "risk_flag": _risk_flag,
    "threshold_sweep": _threshold_sweep,
    "classification_report": _classification_report,
    "roc_auc": _roc_auc,
    "ts_parse": _ts_parse,
    "features_strict": _features_strict,
    "unscorable_rows": _unscorable_rows,
    "stage_histogram": _stage_histogram,
    "stratified_split": _stratified_split,
    "seller_rate_asof": _seller_rate_asof,
    "order_funnel": _order_funnel,
    "handover_gap": _handover_gap,
    "late_by_distance": _late_by_distance,
    "late_pareto": _late_pareto,
    "review_by_late": _review_by_late,
    "worst_sellers": _worst_sellers,
    "routing_candidates": _routing_candidates,
    "category_translated": _category_translated,
    "stage_density": _stage_density,
    "demand_by_state": _demand_by_state,
    "calendar_features": _calendar_features,
    "daily_orders": _daily_orders,
    "stream_late_monitor": q_stream_late_monitor,
    "master_stored": _master_stored,
    "ensure_master": _ensure_master,
    "review_fanout_bucketed": _review_fanout_bucketed,
    "dimension_keys": _dimension_keys,
    "raw_csv_roundtrip": q_raw_csv_roundtrip,
    "profile_roundtrip": q_profile_roundtrip,
    "raw_zone_loaded": q_raw_zone_loaded,
    "records_parsed": q_records_parsed,
    "features_adaptive": _features_adaptive,
    # model queries return facts about the model's output that SQL can state
    "train_gbt": q_train_gbt,
    "score_orders": q_score_orders,
    "feature_importance": q_feature_importance,
    "stream_scored": q_stream_scored,
}


def registered_queries() -> dict[str, Query]:
    def wrap(fn: Query) -> Query:
        return lambda spark, sf_dir: c.round_doubles(fn(spark, sf_dir))

    return {name: wrap(fn) for name, fn in QUERIES.items()}
