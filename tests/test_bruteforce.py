"""Randomised inputs with a hot key, checked against brute force in Python.

One seller holds over a third of all rows and many rows share timestamps,
the shapes that break naive windowing or tie handling.
"""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from delaylens.operators import lifecycle, metrics, sellers

T0 = datetime(2020, 1, 1)


def _rows(seed: int, n: int = 600):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        seller = "hot" if rnd.random() < 0.4 else f"s{rnd.randrange(12)}"
        purchase = T0 + timedelta(hours=rnd.randrange(0, 24 * 40, 6))  # coarse: many ties
        delivered = None if rnd.random() < 0.1 else purchase + timedelta(hours=rnd.randrange(0, 24 * 10, 6))
        out.append((f"o{i}", seller, purchase, delivered, rnd.randrange(2)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_asof_rate_matches_brute_force(spark, seed):
    data = _rows(seed)
    df = spark.createDataFrame(
        data,
        "order_id string, seller_id string, order_purchase_timestamp timestamp_ntz, "
        "order_delivered_customer_date timestamp_ntz, is_late int",
    ).repartition(5)
    got = {
        r.order_id: (r.seller_hist_items, r.seller_hist_late)
        for r in sellers.seller_rate_asof(df).collect()
    }
    for oid, s, t, _, _ in data:
        n = sum(1 for _, s2, _, d2, _ in data if s2 == s and d2 is not None and d2 < t)
        late = sum(y for _, s2, _, d2, y in data if s2 == s and d2 is not None and d2 < t)
        assert got[oid] == (n, late), oid


@pytest.mark.parametrize("seed", [3, 4])
def test_rate_with_past_fill_matches_brute_force(spark, seed):
    """Rows without a seller or without history take the rate of all; a null
    label is no outcome; repeated rows and ties count as they stand."""
    data = [(o, None if i % 11 == 0 else f"new{i}" if i % 7 == 0 else s, p, d, None if i % 13 == 0 else y) for i, (o, s, p, d, y) in enumerate(_rows(seed, 300))]
    data += [*data[:20], ("x", "hot", None, data[0][3], 1)]
    df = spark.createDataFrame(
        data,
        "order_id string, seller_id string, order_purchase_timestamp timestamp_ntz, "
        "order_delivered_customer_date timestamp_ntz, is_late int",
    ).repartition(5)
    got = sellers.seller_or_past_rate(df).collect()
    assert sorted((r.order_id, str(r.seller_id)) for r in got) == sorted((r[0], str(r[1])) for r in data)
    for r in got:
        known = [(s, y) for _, s, _, d, y in data if r.order_purchase_timestamp and d is not None and d < r.order_purchase_timestamp and y is not None]
        own = [y for s, y in known if r.seller_id is not None and s == r.seller_id]
        of = own or [y for _, y in known]
        assert r.seller_late_rate == (pytest.approx(sum(of) / len(of)) if of else None), r
    assert sellers.seller_or_past_rate(df.limit(0)).collect() == []


def test_auc_matches_pairwise_count(spark):
    rnd = random.Random(7)
    data = [(rnd.randrange(2), rnd.choice([0.1, 0.2, 0.2, 0.5, 0.7, 0.9, rnd.random()])) for _ in range(400)]
    df = spark.createDataFrame(data, "y int, p double")
    pos = [p for y, p in data if y == 1]
    neg = [p for y, p in data if y == 0]
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    assert metrics.roc_auc(df).first().roc_auc == pytest.approx(wins / (len(pos) * len(neg)), rel=1e-12)


def test_exact_percentiles_match_numpy(spark):
    rnd = random.Random(3)
    data = [("hot" if rnd.random() < 0.5 else f"k{rnd.randrange(4)}", float(rnd.randrange(50))) for _ in range(500)]
    df = spark.createDataFrame(data, "k string, v double")
    got = {r.k: (r.p10, r.p50, r.p90) for r in
           lifecycle.exact_percentiles(df, "k", "v", [0.1, 0.5, 0.9], ["p10", "p50", "p90"]).collect()}
    for k in {k for k, _ in data}:
        vals = np.array([v for kk, v in data if kk == k])
        want = tuple(np.percentile(vals, q, method="linear") for q in (10, 50, 90))
        assert got[k] == pytest.approx(want, rel=1e-12)


def test_sweep_invariants(spark):
    rnd = random.Random(11)
    df = spark.createDataFrame([(rnd.randrange(2), rnd.random()) for _ in range(300)], "y int, p double")
    rows = sorted(metrics.threshold_sweep(df, (0.1, 0.3, 0.5, 0.7, 0.9)).collect(), key=lambda r: r.threshold)
    recalls = [r.recall for r in rows]
    assert recalls == sorted(recalls, reverse=True)  # recall never rises with the threshold
    pos = df.filter("y = 1").count()
    for t in (0.1, 0.5, 0.9):
        c = metrics.confusion(df, t).first()
        assert c.tp + c.fp + c.fn + c.tn == 300 and c.tp + c.fn == pos


def test_profile_under_hot_seller_equals_pandas(spark):
    data = _rows(5, 900)
    df = spark.createDataFrame(
        data,
        "order_id string, seller_id string, order_purchase_timestamp timestamp_ntz, "
        "order_delivered_customer_date timestamp_ntz, is_late int",
    )
    got = {r.seller_id: (r.seller_late_rate, r.seller_order_count) for r in sellers.seller_profile(df).collect()}
    for s in {r[1] for r in data}:
        ys = [r[4] for r in data if r[1] == s]
        assert got[s] == (pytest.approx(sum(ys) / len(ys)), len(ys))
    assert got["hot"][1] > len(data) / 3


@pytest.mark.parametrize("seed", [1, 3, 7])
def test_exact_percentiles_hot_key(spark, seed):
    rnd = random.Random(seed)
    data = [("hot" if rnd.random() < 0.5 else f"k{rnd.randrange(3)}", rnd.uniform(-5, 5)) for _ in range(400)]
    df = spark.createDataFrame(data, "k string, v double")
    got = {r.k: (r.a, r.b) for r in
           lifecycle.exact_percentiles(df, "k", "v", [0.37, 0.9], ["a", "b"]).collect()}
    for k in {k for k, _ in data}:
        vals = np.array([v for kk, v in data if kk == k])
        assert got[k] == pytest.approx(tuple(np.percentile(vals, q, method="linear") for q in (37, 90)), rel=1e-12)


def test_exact_percentiles_global_mode(spark):
    rnd = random.Random(99)
    vals = [rnd.choice([0.0, 0.25, 0.5, 1.0, rnd.random()]) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    row = lifecycle.exact_percentiles(df, None, "v", [0.1, 0.9], ["a", "b"]).first()
    want = tuple(np.percentile(np.array(vals), q, method="linear") for q in (10, 90))
    assert (row.a, row.b) == pytest.approx(want, rel=1e-12)


def test_exact_percentiles_with_an_outlier_spread_over_partitions(spark):
    """One huge value moves no bound: no partition holds most of the values."""
    from pyspark.sql import functions as F

    from delaylens.session import scratch_root

    n = 20_000
    df = spark.range(0, n).select(F.when(F.col("id") == 7, F.lit(1e9)).otherwise(F.col("id") / 3).alias("v"))
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false"}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        row = lifecycle.exact_percentiles(df, None, "v", [0.25, 0.9], ["a", "b"]).first()
        want = np.percentile(np.array([1e9 if i == 7 else i / 3 for i in range(n)]), [25, 90])
        assert (row.a, row.b) == pytest.approx(tuple(want), rel=1e-12)
        tables = spark.read.option("recursiveFileLookup", "true").schema("v double, __c long, __b int").parquet(scratch_root(spark) + "/tables/percentiles-*")
        counts = [r["count"] for r in tables.filter("v IS NOT NULL").groupBy("__b").count().collect()]
        assert max(counts) < 0.5 * sum(counts)
    finally:
        for k in conf:
            spark.conf.unset(k)


def test_asof_features_ignore_later_outcomes(spark):
    """A changed later outcome changes no earlier row, nor do rows without
    history see outcomes that come after them."""
    from delaylens.operators.features import preprocess

    data = [(f"o{i}", f"s{i % 4}", 0.0, 0.0, 0.0, 1.0 + i, 100.0, day, day + 3, int(i % 3 == 0)) for i, day in enumerate(range(1, 25))]
    schema = "order_id string, seller_id string, s_lat double, s_lng double, c_lat double, c_lng double, product_weight_g double, bought int, done int, is_late int"

    def rates(rows):
        df = spark.createDataFrame(rows, schema).selectExpr(
            "*", "timestamp_ntz'2020-01-01 00:00:00' + make_interval(0, 0, 0, bought) AS order_purchase_timestamp",
            "timestamp_ntz'2020-01-01 00:00:00' + make_interval(0, 0, 0, done) AS order_delivered_customer_date")
        return {r.order_id: r.seller_late_rate for r in preprocess(df, rate_mode="asof").features.collect()}

    before = rates(data)
    changed = rates([*data[:12], *[(*r[:-1], 1 - r[-1]) for r in data[12:]]])
    limit = data[12][8]  # the first changed outcome's time
    for r in data:
        if r[7] <= limit:
            assert before[r[0]] == changed[r[0]]
    for i, r in enumerate(data):
        own = [x[-1] for x in data if x[1] == r[1] and x[8] < r[7]]
        past = [x[-1] for x in data if x[8] < r[7]]
        want = sum(own) / len(own) if own else sum(past) / len(past) if past else None
        assert before[r[0]] == (pytest.approx(want) if want is not None else None)


def test_past_edge_answers(spark):
    """Empty and one-class inputs have defined answers under ANSI rules."""
    empty = spark.createDataFrame([], "y int, p double, pred int")
    assert metrics.roc_auc(empty).first().roc_auc is None
    assert {r.support for r in metrics.classification_report(empty).collect()} == {0}
    ones = spark.createDataFrame([(1, 0.4, 0), (1, 0.9, 1)], "y int, p double, pred int")
    got = metrics.roc_auc(ones).first()
    assert (got.roc_auc, got.positives, got.negatives) == (None, 2, 0)
    orders = spark.createDataFrame([], "order_approved_at timestamp_ntz, order_delivered_carrier_date timestamp_ntz, "
                                   "order_delivered_customer_date timestamp_ntz, order_estimated_delivery_date timestamp_ntz")
    assert [r.share_of_orders for r in lifecycle.order_funnel(orders).collect()] == [0.0] * 4
    flat = spark.createDataFrame([(2.0, 3.0)] * 4, "time_to_carrier double, time_in_transit double")
    assert all(r.density is None for r in lifecycle.stage_density(flat, grid_points=3).collect())
