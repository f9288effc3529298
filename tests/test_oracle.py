"""Every SQL-checked registered query against its DuckDB oracle (sf0.001),
plus fixture anchor values at sf0.01."""

import duckdb
import pytest

import __spark_entry__ as entry
from delaylens.plans.oracle import oracle_queries
from delaylens.plans.registry import registered_queries
from tests.conftest import SF_MED, SF_SMALL
from tools.oracle_check import TABLES, frame_hash

ORACLE = oracle_queries()
QUERIES = registered_queries()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_registered_with_oracle_or_rows_only():
    # the gains of a trained model are beyond SQL: tests recompute them from its nodes
    assert set(ORACLE) == set(QUERIES) - {"feature_importance"}
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    got = QUERIES[name](spark, SF_SMALL).toPandas()
    want = con.execute(ORACLE[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert frame_hash(got) == frame_hash(want)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["seller_state", "customer_state", "avg_transit_time", "late_rate", "count"]


def test_fixture_anchors_sf001(spark):
    """Anchor values published with the fixture mapping (sf0.01)."""
    k = QUERIES["kpis"](spark, SF_MED).first()
    assert (k.rows, k.distinct_orders) == (19726, 4765)
    assert k.late_rate == pytest.approx(0.097435, abs=1e-6)
    assert k.avg_review_score == pytest.approx(2.999306, abs=1e-6)
    assert k.avg_freight == pytest.approx(2130.1108, abs=1e-4)
    f = QUERIES["features"](spark, SF_MED)
    assert f.count() == 18234
    prof = QUERIES["seller_profile"](spark, SF_MED)
    from pyspark.sql import functions as F

    assert prof.agg(F.avg("seller_late_rate")).first()[0] == pytest.approx(0.097256, abs=1e-6)
    top = QUERIES["worst_categories"](spark, SF_MED).first()
    assert (top.category, top.late_count) == ("MEDIUM", 352)
    roc = QUERIES["roc_auc"](spark, SF_MED).first()
    assert roc.roc_auc == pytest.approx(0.725918, abs=1e-6)
    sweep = {r.threshold: (r.caught, r.false_alarms) for r in QUERIES["threshold_sweep"](spark, SF_MED).collect()}
    assert sweep == {0.3: (1684, 11118), 0.4: (1457, 8884), 0.5: (1227, 6644), 0.6: (994, 4377), 0.7: (727, 2177)}
    flags = QUERIES["risk_flag"](spark, SF_MED).filter("is_high_risk").count()
    assert flags == 7624
    asof = QUERIES["seller_rate_asof"](spark, SF_MED)
    assert asof.count() == 19453
    assert asof.filter("seller_hist_items = 0").count() == 268


@pytest.mark.parametrize("name", ["stage_durations", "ts_parse", "route_stats", "seller_rate_asof", "daily_orders"])
def test_results_do_not_depend_on_session_time_zone(spark, con, name):
    """Wall-clock (timestamp_ntz) logic must not pass through the session
    zone; a zone with daylight-saving gaps on fixture dates would shift it."""
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        got = QUERIES[name](spark, SF_SMALL).toPandas()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    want = con.execute(ORACLE[name]).fetchdf()
    assert len(got) == len(want) and frame_hash(got) == frame_hash(want)


def test_auc_agrees_with_spark_ml_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.sql import functions as F

    from delaylens.plans import common as c

    scored = c.fixture_score(c.master(spark, SF_SMALL))
    ours = QUERIES["roc_auc"](spark, SF_SMALL).first().roc_auc
    ml = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="y", numBins=0).evaluate(
        scored.select(F.col("p"), F.col("y").cast("double").alias("y")))
    assert ours == pytest.approx(ml, abs=1e-6)
