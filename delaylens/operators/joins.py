"""Dimension joins whose size check runs no job.

Spark broadcasts a side by the size of its files, read from file statistics
at planning (``spark.sql.autoBroadcastJoinThreshold``), on every planning
anew, so a dimension that has grown past the threshold is shuffled instead.
The size of a *derived* side (a profile, a centroid) is unknown at planning:
``stored_side`` stores it first, and the stored files' size decides the same
way. Beyond the threshold AQE splits hot keys of the shuffle join, and still
turns it into a broadcast if a side proves small at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import has_scratch


def dimension_join(fact: DataFrame, dim: DataFrame, on, how: str = "left") -> DataFrame:
    """Join a fact to a dimension read from files."""
    return fact.join(dim, on, how)


def stored_side(df: DataFrame, name: str) -> DataFrame:
    """An aggregated side as a stored table whose size the planner knows.

    Without a shared folder the side stays a plan and AQE decides alone.
    """
    from ..sources.catalog import materialize

    return materialize(df, name) if has_scratch(df.sparkSession) else df
