"""Scalar Column expressions shared by the operators.

Each function returns a ``Column`` built from Spark built-ins, so it stays
inside whole-stage codegen wherever it is used.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: mean Earth radius in kilometres used by the distance feature.
EARTH_RADIUS_KM = 6371.0

MICROS_PER_DAY = 86_400_000_000.0


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def haversine_km(lat1: Column | str, lon1: Column | str, lat2: Column | str, lon2: Column | str) -> Column:
    """Great-circle distance in km; NULL when any input is NULL.

    ``a`` is clamped to [0, 1]: rounding can push it a hair outside, and the
    square root of a tiny negative number would be NaN. The clamp is a CASE,
    not ``least``/``greatest``, because those skip NULLs and would turn a
    missing coordinate into distance 0.
    """
    phi1, phi2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dphi = F.radians(_c(lat2) - _c(lat1))
    dlambda = F.radians(_c(lon2) - _c(lon1))
    a = F.pow(F.sin(dphi / 2), 2) + F.cos(phi1) * F.cos(phi2) * F.pow(F.sin(dlambda / 2), 2)
    a = F.when(a < 0, F.lit(0.0)).when(a > 1, F.lit(1.0)).otherwise(a)
    return F.lit(EARTH_RADIUS_KM) * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def micros_between(start: Column | str, end: Column | str) -> Column:
    """(end - start) in whole microseconds, as bigint.

    Computed from the day-time interval ``end - start`` so wall-clock
    (timestamp_ntz) spans never pass through the session time zone;
    ``timestamp_diff`` does, and shifts spans that touch a daylight-saving gap.
    """
    iv = _c(end) - _c(start)
    part = lambda unit: F.extract(F.lit(unit), iv)
    return (
        part("DAY").cast("long") * F.lit(86_400_000_000)
        + part("HOUR").cast("long") * F.lit(3_600_000_000)
        + part("MINUTE").cast("long") * F.lit(60_000_000)
        + (part("SECOND") * F.lit(1_000_000)).cast("long")
    )


def days_between(start: Column | str, end: Column | str) -> Column:
    """(end - start) in fractional days, exact to the microsecond."""
    return micros_between(start, end) / F.lit(MICROS_PER_DAY)


def late_flag(delivered: Column | str, estimated: Column | str) -> Column:
    """1 if delivered after the promised date, else 0 (NULL compares as 0)."""
    return F.when(_c(delivered) > _c(estimated), F.lit(1)).otherwise(F.lit(0))


def safe_ratio(num: Column | str, den: Column | str) -> Column:
    """num / den as double, 0 when the denominator is 0 (ANSI-safe)."""
    return F.coalesce(F.try_divide(_c(num).cast("double"), _c(den).cast("double")), F.lit(0.0))


def risk_flag(prob: Column | str, threshold: float = 0.5) -> Column:
    """Strict ``prob > threshold``, the serving-side high-risk test."""
    return _c(prob) > F.lit(float(threshold))


def risk_label(prob: Column | str, threshold: float = 0.5) -> Column:
    return F.when(risk_flag(prob, threshold), F.lit("HIGH RISK")).otherwise(F.lit("ON TRACK"))


_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def ntz_as_utc_instant(x: Column | str) -> Column:
    """timestamp_ntz wall clock -> TIMESTAMP instant, read as UTC whatever
    the session time zone (watermarks and windows need TIMESTAMP)."""
    return F.timestamp_micros(micros_between(F.expr(_EPOCH_NTZ), _c(x)))


def utc_instant_as_ntz(x: Column | str) -> Column:
    """Inverse of ``ntz_as_utc_instant``."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(_c(x)), F.expr(_EPOCH_NTZ))


def null_if_nan(x: Column | str) -> Column:
    """Spark keeps NaN apart from NULL; pandas treats both as missing."""
    return F.nanvl(_c(x), F.lit(None).cast("double"))
