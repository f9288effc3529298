"""Plan checks: no Python UDFs, no cartesian products, dimensions broadcast
when small, one order_id shuffle per input for the item + review joins."""

import re

import pytest

import __spark_entry__ as entry
from delaylens.operators.master import build_master
from delaylens.plans import common as c
from delaylens.plans.registry import registered_queries
from tests.conftest import SF_SMALL
from tests.planutil import plan_text

MODEL = {"train_gbt", "score_orders", "feature_importance", "stream_scored"}
MODEL_FREE = [n for n in registered_queries() if n not in MODEL | {"stream_late_monitor"}]


@pytest.mark.parametrize("name", MODEL_FREE)
def test_no_udf_no_cartesian(spark, name):
    plan = plan_text(entry.queries()[name](spark, SF_SMALL))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan, f"{name}: {bad}"


def test_small_dimensions_are_broadcast(spark):
    plan = plan_text(build_master(c.tables(spark, SF_SMALL)))
    assert plan.count("BroadcastHashJoin") >= 4
    assert "SortMergeJoin" not in plan


def test_large_scale_plan_shuffles_order_id_once_per_input(spark):
    keys = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        plan = plan_text(build_master(c.tables(spark, SF_SMALL)), mode="simple")
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    order_exchanges = re.findall(r"Exchange hashpartitioning\(order_id", plan)
    assert len(order_exchanges) == 3  # orders side, items, reviews
    # customers join at order grain, before the items fan out
    assert plan.index("hashpartitioning(customer_id") > plan.index("hashpartitioning(order_id")
    assert plan.count("SortMergeJoin") >= 5


def test_filters_and_pruning_reach_the_scan(spark):
    plan = plan_text(entry.queries()["geo_centroid"](spark, SF_SMALL))
    assert "ReadSchema: struct<c_custkey:bigint,c_nationkey:int>" in plan
    pushed = re.search(r"PushedFilters: \[(.*)\]", plan).group(1)
    assert "IsNotNull(c_nationkey)" in pushed


def test_a_grown_dimension_is_no_longer_broadcast(spark, tmp_path):
    """The size check reads file statistics at every planning and runs no job."""
    from delaylens.operators.joins import dimension_join

    path = str(tmp_path / "dim")
    fact = spark.range(0, 50).selectExpr("id % 7 AS k")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
        spark.range(0, 10).selectExpr("id AS k", "uuid() AS v").coalesce(1).write.parquet(path)
        before = job_count(spark)
        assert "BroadcastHashJoin" in plan_text(dimension_join(fact, spark.read.schema("k long, v string").parquet(path), "k"))
        spark.range(10, 5000).selectExpr("id AS k", "uuid() AS v").coalesce(1).write.mode("append").parquet(path)
        grown = dimension_join(fact, spark.read.schema("k long, v string").parquet(path), "k")
        assert "BroadcastHashJoin" not in plan_text(grown)
        assert job_count(spark) == before + 1  # only the write
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def job_count(spark) -> int:
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))


# tables of the star that each narrow query reads
NARROW = {
    "kpis": {"orders", "lineitem", "events"},
    "seller_profile": {"orders", "lineitem", "events"},
    "confusion": {"orders", "lineitem", "events"},
    "roc_auc": {"orders", "lineitem", "events"},
    "review_by_late": {"orders", "lineitem", "events"},
    "calendar_features": {"orders", "lineitem", "events"},
    "late_pareto": {"orders", "lineitem", "events"},
    "worst_categories": {"orders", "lineitem", "events", "part"},
}


@pytest.mark.parametrize("name", sorted(NARROW))
def test_narrow_queries_join_only_what_they_need(spark, name):
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        plan = plan_text(entry.queries()[name](spark, SF_SMALL), mode="simple")
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert {t for t in re.findall(r"sf0\.001/(\w+)\.parquet", plan)} == NARROW[name]
    if name not in ("late_pareto", "roc_auc"):  # these join aggregates of their own
        assert len(re.findall(r"Exchange hashpartitioning\(order_id#\d+L?, ", plan)) <= 4  # three inputs, and count(distinct order_id) of kpis
        assert plan.count("SortMergeJoin") == len(NARROW[name]) - 1


def test_building_a_cheap_query_writes_nothing(spark):
    from delaylens.session import scratch_root
    from delaylens.sources.raw import file_system

    def folders():
        fs, path = file_system(spark, scratch_root(spark))
        return fs.getContentSummary(path).getDirectoryCount() if fs.exists(path) else 0

    before = folders()
    for name in ("kpis", "seller_profile", "master", "order_funnel", "unscorable_rows"):
        entry.queries()[name]
    entry.queries()["kpis"](spark, SF_SMALL).collect()
    assert folders() == before


def test_feature_base_is_stored_once_and_released(spark):
    from delaylens.session import release_scratch, scratch_root
    from delaylens.sources.raw import file_system, path_exists

    entry.queries()["features"](spark, SF_SMALL).count()
    fs, path = file_system(spark, scratch_root(spark) + "/tables")
    stored = fs.getContentSummary(path).getDirectoryCount()
    entry.queries()["features_preview"](spark, SF_SMALL).count()
    assert fs.getContentSummary(path).getDirectoryCount() == stored  # the same base and sides
    release_scratch(spark)
    assert not path_exists(spark, scratch_root(spark))


def test_queries_run_without_a_shared_folder(spark, monkeypatch):
    from delaylens import session

    monkeypatch.setattr(session, "_setting", lambda spark, key: None)
    assert not session.has_scratch(spark)
    assert entry.queries()["features_preview"](spark, SF_SMALL).count() == 5
    assert entry.queries()["worst_sellers"](spark, SF_SMALL).count() >= 1
    session.release_scratch(spark)


def test_bucketed_order_tables_remove_order_id_shuffles(spark):
    from delaylens.session import scratch_path
    from delaylens.sources.catalog import bucket_order_tables

    t = c.tables(spark, SF_SMALL)
    bt = bucket_order_tables(t, scratch_path(spark, "bucketed-test"), 8, prefix="dltest")
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # facts are large; dims go through the size check
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        plan = plan_text(build_master(bt, columns=["order_id", "is_late", "review_score"]), mode="simple")
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert "hashpartitioning(order_id" not in plan
    assert plan.count("SortMergeJoin") == 2  # items and reviews joins, no exchange below them
    assert build_master(bt).count() == build_master(t).count()


def test_hot_seller_partition_is_split_by_aqe(spark):
    """One seller holds a third of the rows and the seller side is not
    broadcast: AQE's skew join splits the hot partition (thresholds lowered
    to this data size)."""
    from pyspark.sql import functions as F

    from delaylens.operators.joins import dimension_join

    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10000",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10000",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "0",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        ids = F.col("id")
        fact = spark.range(0, 60000).select(
            F.when(ids % 3 == 0, F.lit(7)).otherwise(ids % 1000).alias("seller_id"), (ids * 1.0).alias("price"))
        dim = spark.range(0, 1000).select(F.col("id").alias("seller_id"), (F.col("id") % 27).alias("seller_state"))
        out = dimension_join(fact, dim, "seller_id", "left")
        assert len(out.collect()) == 60000  # no row lost or duplicated
        final = plan_text(out, mode="simple")
        assert "isFinalPlan=true" in final and "SortMergeJoin(skew=true)" in final
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_no_cartesian_when_every_side_is_large(spark):
    """With every broadcast disabled, no plan may fall back to a cartesian
    product or a nested-loop join (a folded literal join key would)."""
    from tools.plan_report import SKIP, plan_of

    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        for name, fn in registered_queries().items():
            if name in SKIP:
                continue
            plan = plan_of(fn(spark, SF_SMALL))
            for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
                assert bad not in plan, f"{name}: {bad}"
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_asof_chain_shuffles_rows_once(spark):
    """One timeline carries the seller's and the global prefix sum, and its
    branches share their exchanges (adaptive plans share them at run time)."""
    from tools.plan_report import plan_of, shape

    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        counts = shape(plan_of(registered_queries()["features_asof"](spark, SF_SMALL)))
        assert counts["hash exch"] + counts["single exch"] <= 8 and counts["SMJ"] == 2
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
