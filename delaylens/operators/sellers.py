"""Seller reliability: global profile, as-of (leakage-free) rate, fills,
late concentration and the worst decile."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lifecycle import exact_percentiles


def seller_profile(df: DataFrame) -> DataFrame:
    """Per seller, mean of is_late and its non-null count.

    A single grouped aggregate; partial aggregation makes a seller holding a
    third of all rows cost no more than any other before the shuffle. Rows
    without a seller id form no profile row (grouping drops missing keys
    upstream), so they cannot bias the mean of rates.
    """
    return df.filter(F.col("seller_id").isNotNull()).groupBy("seller_id").agg(
        F.avg("is_late").alias("seller_late_rate"),
        F.count("is_late").alias("seller_order_count"),
    )


def mean_seller_rate(profile: DataFrame):
    """Unweighted mean of per-seller rates (scalar subquery)."""
    return profile.agg(F.avg("seller_late_rate")).scalar()


def enrich_seller_rate(df: DataFrame, profile: DataFrame, with_count: bool = False) -> DataFrame:
    """Left lookup of the profile by seller_id (pass a stored profile, so
    that its size decides on a broadcast)."""
    cols = ["seller_id", "seller_late_rate"] + (["seller_order_count"] if with_count else [])
    return df.join(profile.select(*cols), "seller_id", "left")


def fill_seller_rate(df: DataFrame, profile: DataFrame) -> DataFrame:
    """Unknown sellers get the unweighted mean of per-seller rates."""
    return df.withColumn(
        "seller_late_rate", F.coalesce(F.col("seller_late_rate"), mean_seller_rate(profile))
    )


# --------------------------------------------------------------------------- L1

def seller_rate_asof(
    rows: DataFrame,
    seller_col: str = "seller_id",
    asof_col: str = "order_purchase_timestamp",
    outcome_time_col: str = "order_delivered_customer_date",
    label_col: str = "is_late",
) -> DataFrame:
    """L1: leakage-free seller late rate for every input row.

    For each row, count the seller's outcomes (rows with an outcome time)
    whose outcome time is strictly before the row's as-of time, and how many
    of those were late. An outcome at exactly the as-of instant is not yet
    known. Adds ``seller_hist_items``, ``seller_hist_late`` and
    ``seller_late_rate_asof`` (NULL without history).

    Skew-safe two-level prefix sum, no group ever holds raw rows of a seller:
      1. one pass stacks every row into an as-of point and an outcome and
         aggregates per (seller, instant, kind): outcome counts, distinct
         points (a partial aggregate).
      2. per (seller, day) totals; a running sum over a seller's days gives
         the carry-in of each day (one row per active day of a seller).
      3. inside each (seller, day): carry row, as-of points and outcomes in
         time order (points before equal-time outcomes); a running sum gives
         the history of each point (one row per distinct instant of that
         seller-day).
      4. join the per-point history back to the rows on (seller, instant).
    """
    s, t = F.col(seller_col), F.col("__t")
    kind = F.col("__kind")
    # one pass over the rows: each row is an as-of point (kind 1) at its
    # as-of time and an outcome (kind 2) at its outcome time
    events = rows.select(
        s.alias("__s"),
        F.expr(f"stack(2, `{asof_col}`, 1, `{outcome_time_col}`, 2) as (__t, __kind)"),
        F.col(label_col).alias("__y"),
    ).filter(F.col("__t").isNotNull())
    timed = (
        events.groupBy("__s", "__t", "__kind")
        .agg(
            F.count(F.when(kind == 2, F.col("__y"))).alias("__n"),
            F.coalesce(F.sum(F.when(kind == 2, F.col("__y"))), F.lit(0)).cast("long").alias("__l"),
        )
        .withColumn("__day", F.to_date("__t"))
    )
    day_totals = timed.groupBy("__s", "__day").agg(F.sum("__n").alias("__n"), F.sum("__l").alias("__l"))
    before = Window.partitionBy("__s").orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    carry = day_totals.select(
        "__s",
        "__day",
        F.lit(None).cast(rows.schema[asof_col].dataType).alias("__t"),
        F.lit(0).alias("__kind"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).cast("long").alias("__n"),
        F.coalesce(F.sum("__l").over(before), F.lit(0)).cast("long").alias("__l"),
    )
    timeline = carry.unionByName(timed.select("__s", "__day", "__t", "__kind", "__n", "__l"))
    upto = (
        Window.partitionBy("__s", "__day")
        .orderBy(F.col("__t").asc_nulls_first(), F.col("__kind"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    history = timeline.select(
        "__s", "__t", "__kind",
        F.sum("__n").over(upto).alias("seller_hist_items"),
        F.sum("__l").over(upto).alias("seller_hist_late"),
    ).filter(F.col("__kind") == 1).drop("__kind")
    joined = rows.join(history, (s == F.col("__s")) & (F.col(asof_col) == t), "left").drop("__s", "__t")
    return joined.withColumn(
        "seller_late_rate_asof",
        F.when(F.col("seller_hist_items") > 0, F.col("seller_hist_late") / F.col("seller_hist_items")),
    )


def seller_or_past_rate(
    rows: DataFrame,
    seller_col: str = "seller_id",
    asof_col: str = "order_purchase_timestamp",
    outcome_time_col: str = "order_delivered_customer_date",
    label_col: str = "is_late",
) -> DataFrame:
    """L1 with its fill: adds ``seller_late_rate``, the seller's late rate over
    outcomes known strictly before the row's as-of time; where the seller has
    none (or the row no seller), the rate of all outcomes known by then,
    whoever the seller; NULL before the first outcome.

    One timeline carries both prefix sums of ``seller_rate_asof``: a row counts
    in its seller's scope and in the scope of all, per instant and per day, in
    one aggregation with partial sums. The history of each (seller, instant)
    gets its rate before it meets the rows, so the rows are shuffled once, and
    only instants of sellers without history look up the scope of all.

    ``__k`` (0: a day) and ``__own`` (0: all, 1: a seller, 2: rows without one)
    are aggregates, not grouping keys, so that filters on them stay above the
    aggregation and the windows, whose exchanges the branches then share.
    """
    def key(own: int, seller, t, kind):
        return F.struct(F.lit(own).alias("__scope"), seller.alias("__s"), F.to_date("__t").alias("__day"), t.alias("__t"), kind.alias("__kind"))

    events = rows.select(
        F.col(seller_col).alias("__s"),
        F.expr(f"stack(2, `{asof_col}`, 1, `{outcome_time_col}`, 2) as (__t, __kind)"),
        F.col(label_col).alias("__y"),
    ).filter(F.col("__t").isNotNull())
    nobody = F.lit(None).cast(rows.schema[seller_col].dataType)
    whole_day = F.lit(None).cast(events.schema["__t"].dataType), F.lit(0)
    instant = F.col("__t"), F.col("__kind")
    outcome = F.when(F.col("__kind") == 2, F.col("__y"))
    timed = (
        events.select(
            F.inline(F.array(*(key(own, s, *at) for own, s in ((1, F.col("__s")), (0, nobody)) for at in (instant, whole_day)))),
            outcome.alias("__y"),
        )
        .groupBy("__scope", "__s", "__day", "__t", "__kind")
        .agg(
            F.count("__y").alias("__n"),
            F.coalesce(F.sum("__y"), F.lit(0)).cast("long").alias("__l"),
            F.max("__kind").alias("__k"),
            F.max(F.when(F.col("__s").isNull(), F.col("__scope") * 2).otherwise(F.col("__scope"))).alias("__own"),
        )
    )
    before = Window.partitionBy("__scope", "__s").orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    carry = timed.filter("__k = 0").select(
        "__scope", "__s", "__day", "__t", "__kind",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).cast("long").alias("__n"),
        F.coalesce(F.sum("__l").over(before), F.lit(0)).cast("long").alias("__l"),
        "__k", "__own",
    )
    upto = (
        Window.partitionBy("__scope", "__s", "__day")
        .orderBy(F.col("__t").asc_nulls_first(), F.col("__kind"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    n, late = F.sum("__n").over(upto), F.sum("__l").over(upto)
    points = (
        carry.unionByName(timed.filter("__k > 0"))
        .select("__s", "__t", "__k", "__own", F.when(F.col("__own") < 2, F.try_divide(late, n)).alias("__rate"))
        .filter("__k = 1")
    )
    known = F.col("__rate").isNotNull()
    own = points.filter("__own > 0")
    everyone = points.filter("__own = 0").select(F.col("__t").alias("__at"), F.col("__rate").alias("__past"))
    unknown = own.filter(~known).join(everyone, F.col("__t") == F.col("__at"), "left")
    rated = own.filter(known).select("__s", "__t", "__rate").unionByName(unknown.select("__s", "__t", F.col("__past").alias("__rate")))
    return rows.join(
        rated.withColumnRenamed("__rate", "seller_late_rate"),
        F.col(seller_col).eqNullSafe(F.col("__s")) & (F.col(asof_col) == F.col("__t")), "left",
    ).drop("__s", "__t")


# --------------------------------------------------------------------------- L5, L7

def late_pareto(df: DataFrame) -> DataFrame:
    """Cumulative share of late items held by the sellers with the most.
    Rows without a seller belong to none, as in the profile (D2).

    Sellers are grouped by their late count (a level); the running sum runs
    over levels in descending order. The number of distinct levels is at most
    sqrt(2 x total late items), so the single ordered window stays small
    whatever the data size, and tied sellers share one point of the curve.
    """
    per_seller = df.filter(F.col("seller_id").isNotNull()).groupBy("seller_id").agg(F.sum("is_late").cast("long").alias("late"))
    total_late = per_seller.agg(F.sum("late")).scalar()
    total_sellers = per_seller.agg(F.count(F.lit(1))).scalar()
    levels = per_seller.groupBy(F.col("late").alias("late_per_seller")).agg(F.count(F.lit(1)).alias("sellers"))
    w = Window.orderBy(F.desc("late_per_seller")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum_sellers = F.sum("sellers").over(w)
    cum_late = F.sum(F.col("sellers") * F.col("late_per_seller")).over(w)
    return levels.select(
        "late_per_seller",
        "sellers",
        cum_sellers.alias("cum_sellers"),
        cum_late.alias("cum_late"),
        (cum_sellers / total_sellers).alias("seller_share"),
        F.coalesce(F.try_divide(cum_late.cast("double"), total_late.cast("double")), F.lit(0.0)).alias("late_share"),
    )


def worst_sellers(profile: DataFrame, fraction: float = 0.1) -> DataFrame:
    """Sellers at or above the (1 - fraction) percentile of late rate.

    The cut point is an exact interpolated percentile over sellers (two-level
    method of ``exact_percentiles``), inlined as a scalar subquery.
    """
    cut = exact_percentiles(profile, None, "seller_late_rate", [1.0 - fraction], ["cut"]).select("cut").scalar()
    return profile.filter(F.col("seller_late_rate") >= cut).select(
        "seller_id", "seller_late_rate", "seller_order_count", cut.alias("cut_rate")
    )
