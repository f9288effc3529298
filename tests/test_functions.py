"""Unit tests on literal rows: column functions and flags."""

import math
from datetime import datetime

import pytest

from delaylens.functions import days_between, haversine_km, late_flag, risk_flag, risk_label, safe_ratio


def test_haversine_same_point_and_antipodes(spark):
    df = spark.createDataFrame(
        [(10.0, 20.0, 10.0, 20.0), (0.0, 0.0, 0.0, 180.0), (None, 1.0, 2.0, 3.0), (-23.5, -46.6, -22.9, -43.2)],
        "a double, b double, c double, d double",
    )
    rows = df.select(haversine_km("a", "b", "c", "d").alias("km")).collect()
    assert rows[0].km == pytest.approx(0.0, abs=1e-9)
    assert rows[1].km == pytest.approx(math.pi * 6371.0, rel=1e-12)
    assert rows[2].km is None
    # Sao Paulo -> Rio de Janeiro, about 357 km
    assert rows[3].km == pytest.approx(357, abs=5)


def test_late_flag_null_and_equal(spark):
    t = datetime(2020, 1, 1, 12, 0, 0)
    later = datetime(2020, 1, 1, 12, 0, 1)
    df = spark.createDataFrame(
        [(t, t), (later, t), (None, t), (t, None), (t, later)], "d timestamp_ntz, e timestamp_ntz"
    )
    got = [r.f for r in df.select(late_flag("d", "e").alias("f")).collect()]
    assert got == [0, 1, 0, 0, 0]


def test_days_between_minutes_and_seconds(spark):
    df = spark.createDataFrame(
        [(datetime(2020, 1, 1, 0, 0, 0), datetime(2020, 1, 2, 6, 30, 15))], "a timestamp_ntz, b timestamp_ntz"
    )
    (v,) = df.select(days_between("a", "b")).first()
    assert v == pytest.approx(1 + (6 * 3600 + 30 * 60 + 15) / 86400.0, rel=1e-15)


def test_safe_ratio_zero_denominator(spark):
    df = spark.createDataFrame([(1, 0), (3, 4), (0, 0)], "n long, d long")
    got = [r.r for r in df.select(safe_ratio("n", "d").alias("r")).collect()]
    assert got == [0.0, 0.75, 0.0]


def test_risk_flag_is_strict(spark):
    df = spark.createDataFrame([(0.5,), (0.5000001,), (0.2,)], "p double")
    rows = df.select(risk_flag("p").alias("f"), risk_label("p").alias("l")).collect()
    assert [r.f for r in rows] == [False, True, False]
    assert [r.l for r in rows] == ["ON TRACK", "HIGH RISK", "ON TRACK"]


def test_no_python_udf_in_expressions(spark):
    from tests.planutil import plan_text

    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0)], "a double, b double, c double, d double")
    plan = plan_text(df.select(haversine_km("a", "b", "c", "d")))
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "[codegen id" in plan


def test_spans_ignore_session_time_zone(spark):
    """A wall-clock time inside a daylight-saving gap must not shift spans."""
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        df = spark.createDataFrame(
            [(datetime(1995, 10, 15, 0, 0, 0), datetime(1995, 11, 14, 12, 0, 0))], "a timestamp_ntz, b timestamp_ntz"
        )
        (v,) = df.select(days_between("a", "b")).first()
        assert v == pytest.approx(30.5, rel=1e-15)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_haversine_properties(spark):
    """Symmetric, within [0, pi * R], zero on the diagonal, triangle inequality."""
    from hypothesis import given, settings
    from hypothesis import strategies as st

    lat = st.floats(-90, 90, allow_nan=False)
    lon = st.floats(-180, 180, allow_nan=False)
    points = st.lists(st.tuples(lat, lon, lat, lon, lat, lon), min_size=20, max_size=20)

    @settings(max_examples=5, deadline=None)
    @given(points)
    def check(rows):
        df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double")
        out = df.select(
            haversine_km("a", "b", "c", "d").alias("ab"),
            haversine_km("c", "d", "a", "b").alias("ba"),
            haversine_km("c", "d", "e", "f").alias("bc"),
            haversine_km("a", "b", "e", "f").alias("ac"),
            haversine_km("a", "b", "a", "b").alias("aa"),
        ).collect()
        for r in out:
            assert r.ab == pytest.approx(r.ba, abs=1e-6)
            assert 0.0 <= r.ab <= math.pi * 6371.0 + 1e-6
            assert r.aa == pytest.approx(0.0, abs=1e-6)
            assert r.ac <= r.ab + r.bc + 1e-6

    check()
