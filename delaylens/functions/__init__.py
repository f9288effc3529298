"""Column-level functions (pure expressions; no Python UDFs)."""

from .columns import (
    days_between,
    haversine_km,
    late_flag,
    micros_between,
    ntz_as_utc_instant,
    null_if_nan,
    risk_flag,
    risk_label,
    safe_ratio,
    utc_instant_as_ntz,
)

__all__ = [
    "days_between",
    "haversine_km",
    "late_flag",
    "micros_between",
    "ntz_as_utc_instant",
    "null_if_nan",
    "risk_flag",
    "risk_label",
    "safe_ratio",
    "utc_instant_as_ntz",
]
