"""Operators on hand-made rows with hand-computed answers."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from delaylens.operators import lifecycle, master as m, metrics, reports, routes, sellers
from delaylens.operators.features import preprocess
from delaylens.operators.split import stratified_split_counts
from delaylens.sources.tables import Tables

T0 = datetime(2021, 3, 1, 10, 0, 0)


def h(n):
    return T0 + timedelta(hours=n)


@pytest.fixture(scope="module")
def tiny(spark):
    orders = spark.createDataFrame(
        [
            # id, cust, status, purchase, approved, carrier, delivered, estimated
            ("o1", "c1", "delivered", h(0), h(1), h(20), h(100), h(90)),   # late
            ("o2", "c2", "delivered", h(0), h(2), h(30), h(90), h(90)),    # equal: not late
            ("o3", "c1", "delivered", h(5), h(6), None, h(50), h(90)),     # no carrier date
            ("o4", "c3", "delivered", h(7), h(8), h(9), None, h(90)),      # no delivery date
            ("o5", "c2", "shipped", h(9), h(10), h(11), None, h(90)),      # open
        ],
        "order_id string, customer_id string, order_status string, order_purchase_timestamp timestamp_ntz, "
        "order_approved_at timestamp_ntz, order_delivered_carrier_date timestamp_ntz, "
        "order_delivered_customer_date timestamp_ntz, order_estimated_delivery_date timestamp_ntz",
    )
    items = spark.createDataFrame(
        [("o1", "p1", "s1", 10.0, 1.0), ("o1", "p2", "s2", 20.0, 2.0), ("o2", "p1", "s1", 30.0, 3.0),
         ("o3", "p3", "s9", 40.0, 4.0), ("o4", "p1", "s1", 50.0, 5.0), ("o5", "p2", "s2", 60.0, 6.0)],
        "order_id string, product_id string, seller_id string, price double, freight_value double",
    )
    products = spark.createDataFrame(
        [("p1", 100.0, "toys"), ("p2", None, "books")],  # p3 absent
        "product_id string, product_weight_g double, product_category_name string",
    )
    sellers_ = spark.createDataFrame(
        [("s1", 1, "SP"), ("s2", 2, "RJ")], "seller_id string, seller_zip_code_prefix int, seller_state string"
    )
    customers = spark.createDataFrame(
        [("c1", 1, "SP"), ("c2", 3, "AM"), ("c3", 2, "RJ")],
        "customer_id string, customer_zip_code_prefix int, customer_state string",
    )
    reviews = spark.createDataFrame([("o1", 5), ("o1", 3), ("o2", 4)], "order_id string, review_score int")
    geo = spark.createDataFrame(
        [(1, -23.0, -46.0), (1, -24.0, -47.0), (2, -22.0, -43.0)],  # zip 3 has no coordinates
        "geolocation_zip_code_prefix int, geolocation_lat double, geolocation_lng double",
    )
    return Tables(orders, items, products, sellers_, customers, reviews, geo)


def test_master_left_fanout_and_catalog_fill(tiny):
    df = m.build_master(tiny)
    rows = df.collect()
    # o1: 2 items x 2 reviews; o2: 1 x 1; o3: 1 x none -> 1 row; o4, o5 filtered
    assert len(rows) == 6
    assert sorted(df.columns) == sorted(m.MASTER_COLUMNS)
    o3 = [r for r in rows if r.order_id == "o3"][0]
    assert o3.product_weight_g == pytest.approx(100.0)  # catalogue mean of (100, NULL)
    assert o3.seller_state is None and o3.review_score is None
    late = {r.order_id: r.is_late for r in rows}
    assert late == {"o1": 1, "o2": 0, "o3": 0}


def test_master_inner_drops_unmatched(tiny):
    df = m.build_master_inner(tiny)
    # status-only cohort keeps o4 (no delivery date -> not late); o3 vanishes (no product, no seller)
    ids = sorted(r.order_id for r in df.collect())
    assert ids == ["o1", "o1", "o2", "o4"]
    assert {r.order_id: r.is_late for r in df.collect()}["o4"] == 0


def test_cohorts(tiny):
    assert m.delivered_orders(tiny.orders).count() == 3
    assert m.status_orders(tiny.orders).count() == 4
    assert [r.order_id for r in m.lifecycle_orders(tiny.orders).orderBy("order_id").collect()] == ["o1", "o2"]


def test_kpis_and_categories(tiny):
    mm = m.build_master(tiny)
    k = reports.kpis(mm).first()
    assert k.rows == 6 and k.distinct_orders == 3
    assert k.late_rate == pytest.approx(4 / 6)
    assert k.avg_review_score == pytest.approx((5 + 3 + 5 + 3 + 4) / 5)
    cats = {r.category: r.late_count for r in reports.late_by_category(mm).collect()}
    assert cats == {"toys": 2, "books": 2}
    top = reports.worst_categories(mm, 1).collect()
    assert [r.category for r in top] == ["books"]  # tie broken by name


def test_feature_chain_order_and_fills(tiny):
    mm = m.build_master(tiny)
    prep = preprocess(mm, geolocation=tiny.geolocation)
    prof = {r.seller_id: (r.seller_late_rate, r.seller_order_count) for r in prep.seller_profile.collect()}
    # profile computed before rows without distance are dropped (o2 -> zip 3 has no coordinates)
    assert prof["s1"] == (pytest.approx(2 / 3), 3)
    assert prof["s2"] == (pytest.approx(1.0), 2)
    assert prof["s9"] == (pytest.approx(0.0), 1)
    feats = prep.features.collect()
    assert {r.order_id for r in feats} == {"o1"}  # o2: no customer geo, o3: no seller
    assert all(r.distance_km is not None for r in feats)


def test_unknown_seller_gets_mean_of_rates(spark, tiny):
    profile = spark.createDataFrame([("s1", 0.2, 10), ("s2", 0.6, 1)], "seller_id string, seller_late_rate double, seller_order_count long")
    df = spark.createDataFrame([("sX",), ("s1",)], "seller_id string")
    out = sellers.fill_seller_rate(sellers.enrich_seller_rate(df, profile), profile)
    got = {r.seller_id: r.seller_late_rate for r in out.collect()}
    assert got == {"sX": pytest.approx(0.4), "s1": pytest.approx(0.2)}  # unweighted mean


def test_missing_distance_raises(spark):
    df = spark.createDataFrame([("s1", 1, 0)], "seller_id string, price int, is_late int")
    with pytest.raises(ValueError, match="distance_km"):
        preprocess(df)


def test_asof_rate_excludes_equal_and_future(spark):
    rows = spark.createDataFrame(
        [
            ("a", "s", h(0), h(10), 1),
            ("b", "s", h(10), h(30), 0),   # purchase == a's delivery: a is not yet known
            ("c", "s", h(11), h(40), 1),   # sees a only
            ("d", "s", h(50), h(60), 0),   # sees a, b, c
            ("e", "t", h(50), None, 0),    # other seller, nothing known
        ],
        "order_id string, seller_id string, order_purchase_timestamp timestamp_ntz, "
        "order_delivered_customer_date timestamp_ntz, is_late int",
    )
    got = {r.order_id: (r.seller_hist_items, r.seller_hist_late, r.seller_late_rate_asof)
           for r in sellers.seller_rate_asof(rows).collect()}
    assert got["a"] == (0, 0, None)
    assert got["b"] == (0, 0, None)
    assert got["c"] == (1, 1, 1.0)
    assert got["d"] == (3, 2, pytest.approx(2 / 3))
    assert got["e"] == (0, 0, None)
    # perturbing a later outcome leaves earlier rows unchanged
    changed = rows.withColumn("is_late", F.when(F.col("order_id") == "d", 1).otherwise(F.col("is_late")))
    got2 = {r.order_id: r.seller_late_rate_asof for r in sellers.seller_rate_asof(changed).collect()}
    assert got2["c"] == 1.0 and got2["d"] == pytest.approx(2 / 3)


def test_asof_crosses_day_boundaries(spark):
    base = datetime(2021, 1, 1, 23, 0, 0)
    rows = spark.createDataFrame(
        [("a", "s", base, base + timedelta(hours=2), 1),              # delivered next day 01:00
         ("b", "s", base + timedelta(days=3), base + timedelta(days=4), 0)],
        "order_id string, seller_id string, order_purchase_timestamp timestamp_ntz, "
        "order_delivered_customer_date timestamp_ntz, is_late int",
    )
    got = {r.order_id: r.seller_hist_items for r in sellers.seller_rate_asof(rows).collect()}
    assert got == {"a": 0, "b": 1}


def test_route_threshold_is_strict(spark):
    stats = spark.createDataFrame([("A", "B", 1.0, 0.1, 50), ("A", "C", 2.0, 0.2, 51)],
                                  "seller_state string, customer_state string, avg_transit_time double, late_rate double, count long")
    assert [r.customer_state for r in routes.major_routes(stats, 50).collect()] == ["C"]
    mat = routes.route_matrix(stats, ["B", "C", "D"]).first()
    assert mat["B"] == 0.1 and mat["C"] == 0.2 and mat["D"] is None


def test_metrics_thresholds_and_zero_positives(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "y int, p double")
    c_ge = metrics.confusion(df, 0.5).first()
    c_gt = metrics.confusion(df, 0.5, strict=True).first()
    assert (c_ge.tp, c_ge.fp, c_ge.fn, c_ge.tn) == (2, 1, 0, 1)
    assert (c_gt.tp, c_gt.fp, c_gt.fn, c_gt.tn) == (1, 0, 1, 2)
    sweep = metrics.threshold_sweep(df, (0.95, 0.5, 0.0)).collect()
    top = [r for r in sweep if r.threshold == 0.95][0]
    assert top.precision == 0.0 and top.recall == 0.0 and top.caught == 0  # no predicted positives
    auc = metrics.roc_auc(df).first().roc_auc
    # pairs (pos, neg): (0.5,0.5)=.5, (0.5,0.1)=1, (0.9,0.5)=1, (0.9,0.1)=1 -> 3.5/4
    assert auc == pytest.approx(0.875)


def test_classification_report_matches_hand_values(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0), (0, 1)], "y int, pred int")
    rep = {r["class"]: r for r in metrics.classification_report(df).collect()}
    assert rep["1"].precision == pytest.approx(0.5) and rep["1"].recall == pytest.approx(0.5)
    assert rep["0"].precision == pytest.approx(2 / 3) and rep["0"].recall == pytest.approx(2 / 3)
    assert rep["accuracy"].f1_score == pytest.approx(0.6) and rep["accuracy"].support == 5
    assert rep["macro avg"].f1_score == pytest.approx((0.5 + 2 / 3) / 2)


def test_histogram_max_lands_in_last_bin(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 1, 2, 10]], "time_to_carrier double")
    hist = lifecycle.stage_histogram(df, stages=("time_to_carrier",), bins=5).orderBy("bin").collect()
    assert [r["count"] for r in hist] == [2, 1, 0, 0, 1]
    assert hist[-1].bin_hi == pytest.approx(10.0)


def test_exact_percentiles_match_interpolation(spark):
    vals = [1.0, 2.0, 2.0, 7.0, 10.0]
    df = spark.createDataFrame([("k", v) for v in vals], "k string, v double")
    got = lifecycle.exact_percentiles(df, "k", "v", [0.5, 0.9, 0.25], ["p50", "p90", "p25"]).first()
    assert got.p50 == 2.0
    assert got.p90 == pytest.approx(7.0 + 0.6 * 3.0)
    assert got.p25 == 2.0


def test_stratified_split_exact_counts(spark):
    df = spark.range(0, 1003).select(F.col("id"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    # add many identical copies to exercise the copy handling
    df = df.unionByName(spark.range(0, 400).select(F.lit(-1).cast("long").alias("id"), F.lit(0).alias("y")))
    got = {r.label: (r.train_rows, r.test_rows) for r in stratified_split_counts(df, "y", 0.2, 42).collect()}
    n1 = 101
    n0 = 1403 - n1
    assert got[1] == (n1 - round(0.2 * n1), round(0.2 * n1))
    assert got[0] == (n0 - round(0.2 * n0), round(0.2 * n0))


def test_order_funnel_is_cumulative(tiny):
    got = {r.stage: r.orders for r in lifecycle.order_funnel(tiny.orders).collect()}
    assert got == {"order approved": 5, "handed to carrier": 4, "delivered": 2, "delivered on time": 1}


def test_late_pareto_levels(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("c", 0), ("d", 1)], "seller_id string, is_late int")
    rows = sellers.late_pareto(df).orderBy(F.desc("late_per_seller")).collect()
    assert [(r.late_per_seller, r.sellers, r.cum_late) for r in rows] == [(2, 1, 2), (1, 2, 4), (0, 1, 4)]
    assert rows[0].late_share == pytest.approx(0.5) and rows[-1].seller_share == pytest.approx(1.0)


def test_schema_adaptive_chain_keeps_supplied_columns(spark):
    """Coordinates supplied -> no geo lookup; supplied rate kept."""
    df = spark.createDataFrame(
        [("s1", 0.0, 0.0, 0.0, 1.0, 0.9, 10.0, 1), ("s2", 0.0, 0.0, 0.0, 2.0, None, None, 0)],
        "seller_id string, s_lat double, s_lng double, c_lat double, c_lng double, "
        "seller_late_rate double, product_weight_g double, is_late int",
    )
    prep = preprocess(df)  # no geolocation given: the supplied coordinates are used
    rows = {r.seller_id: r for r in prep.features.collect()}
    assert rows["s1"].seller_late_rate == 0.9  # supplied value kept
    assert rows["s2"].seller_late_rate == pytest.approx(0.5)  # mean of per-seller rates (s1: 1.0, s2: 0.0)
    assert rows["s2"].product_weight_g == pytest.approx(10.0)  # row mean
    assert rows["s2"].distance_km == pytest.approx(2 * 111.19, rel=1e-3)


def test_preview_is_ordered(spark):
    df = spark.createDataFrame([(3, "c"), (1, "z"), (2, "b"), (1, "a")], "k int, v string")
    assert [tuple(r) for r in reports.preview(df, ["k", "v"], 3).collect()] == [(1, "a"), (1, "z"), (2, "b")]


def test_review_mode_mean_removes_fanout(tiny):
    df = m.build_master(tiny, review_mode="mean")
    rows = df.collect()
    assert len(rows) == 4  # o1: 2 items, o2: 1, o3: 1 - one row per item
    o1 = [r for r in rows if r.order_id == "o1"]
    assert all(r.review_score == pytest.approx(4.0) for r in o1)


def test_fanout_invariant_on_fixture(spark):
    """master rows = sum over delivered items of max(1, reviews of the order)."""
    from delaylens.plans import common as c
    from tests.conftest import SF_SMALL

    t = c.tables(spark, SF_SMALL)
    reviews = t.order_reviews.groupBy("order_id").agg(F.count(F.lit(1)).alias("r"))
    items = m.delivered_orders(t.orders).select("order_id").join(t.order_items.select("order_id"), "order_id")
    expected = items.join(reviews, "order_id", "left").agg(
        F.sum(F.greatest(F.coalesce(F.col("r"), F.lit(0)), F.lit(1)))).first()[0]
    assert m.build_master(t).count() == expected == 1973


def test_handover_gap_sketch_close_to_exact(spark):
    from delaylens.plans import common as c
    from tests.conftest import SF_SMALL

    lm = c.lifecycle(spark, SF_SMALL)
    exact = {r.seller_id: r for r in lifecycle.handover_gap(lm).collect()}
    approx = {r.seller_id: r for r in lifecycle.handover_gap(lm, exact=False).collect()}
    assert exact.keys() == approx.keys()
    for k, e in exact.items():
        a = approx[k]
        assert a.orders == e.orders and a.mean_gap_days == pytest.approx(e.mean_gap_days)
        # the sketch returns an observed value within its rank error of the exact one
        assert abs(a.p50_gap_days - e.p50_gap_days) <= 1.0


def test_preprocess_with_stored_profile_and_weight(spark):
    profile = spark.createDataFrame([("s1", 0.25, 4)], "seller_id string, seller_late_rate double, seller_order_count long")
    df = spark.createDataFrame(
        [("s1", 0.0, 0.0, 0.0, 1.0, None, 0), ("s9", 0.0, 0.0, 1.0, 0.0, 5.0, 1)],
        "seller_id string, s_lat double, s_lng double, c_lat double, c_lng double, product_weight_g double, is_late int",
    )
    prep = preprocess(df, profile=profile, mean_weight=123.0, materialize=False)
    rows = {r.seller_id: r for r in prep.features.collect()}
    assert rows["s1"].seller_late_rate == 0.25 and rows["s1"].product_weight_g == 123.0
    assert rows["s9"].seller_late_rate == 0.25  # unknown seller: mean of the stored rates
    assert prep.seller_profile is profile


def test_split_depends_on_the_rows_alone(spark):
    """The same test rows at any partitioning, with or without broadcasts, for
    inputs with many copies of a row."""
    from delaylens.operators.split import stratified_split

    rows = [(i % 37, i // 3 % 5, i % 2) for i in range(900)] + [(1, 1, 1)] * 301
    found = []
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for n, threshold in ((4, old), (7, "-1"), (50, old)):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        df = spark.createDataFrame(rows, "a int, b int, y int").repartition(n)
        split = stratified_split(df, "y", 0.2, 42)
        test, train = sorted(map(tuple, split.test.collect())), sorted(map(tuple, split.train.collect()))
        assert sorted(test + train) == sorted(rows)
        found.append(test)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert found[0] == found[1] == found[2]
    n1 = sum(r[2] for r in rows)
    assert (sum(r[2] for r in found[0]), len(found[0])) == (round(n1 * 0.2), round(n1 * 0.2) + round((len(rows) - n1) * 0.2))


def test_route_matrix_has_a_column_for_every_state(spark):
    from delaylens.operators import routes

    stats = spark.createDataFrame([("A", f"S{i}", 0.1 * i) for i in range(3)], "seller_state string, customer_state string, late_rate double")
    assert routes.route_matrix(stats, [f"S{i}" for i in range(4)]).columns == ["seller_state", "S0", "S1", "S2", "S3"]


def test_files_added_in_session_are_seen(spark, tmp_path):
    import shutil

    from delaylens.plans.registry import registered_queries
    from tests.conftest import SF_SMALL

    for t in ("nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        (tmp_path / f"{t}.parquet").mkdir()
        shutil.copy(f"{SF_SMALL}/{t}.parquet", tmp_path / f"{t}.parquet" / "a.parquet")
    daily = registered_queries()["daily_orders"]
    first = daily(spark, str(tmp_path)).agg(F.sum("orders")).first()[0]
    shutil.copy(f"{SF_SMALL}/orders.parquet", tmp_path / "orders.parquet" / "b.parquet")
    assert daily(spark, str(tmp_path)).agg(F.sum("orders")).first()[0] == 2 * first
