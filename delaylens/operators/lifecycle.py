"""Order lifecycle: stage durations, their averages, histogram, density,
funnel and per-seller handover gap.

Durations are computed once at order grain, before items fan the rows out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import days_between, late_flag, micros_between
from ..functions.columns import MICROS_PER_DAY
from ..sources.tables import Tables
from .joins import dimension_join, stored_side
from .master import lifecycle_orders

STAGES = ("time_to_carrier", "time_in_transit")


def with_stage_durations(orders: DataFrame, keep_micros: bool = False) -> DataFrame:
    """H2: approval->carrier, carrier->customer and purchase->customer in days.

    With ``keep_micros`` the exact integer microsecond spans are kept too
    (``*_us``); averaging those is exact regardless of summation order.
    """
    spans = {
        "time_to_carrier": ("order_approved_at", "order_delivered_carrier_date"),
        "time_in_transit": ("order_delivered_carrier_date", "order_delivered_customer_date"),
        "total_delivery_time": ("order_purchase_timestamp", "order_delivered_customer_date"),
    }
    cols = [days_between(a, b).alias(name) for name, (a, b) in spans.items()]
    if keep_micros:
        cols += [micros_between(a, b).alias(f"{name}_us") for name, (a, b) in spans.items()]
    return orders.select("*", *cols)


def avg_days(stage: str) -> Column:
    """Mean of a stage in days from its exact microsecond sum."""
    return F.avg(f"{stage}_us") / F.lit(MICROS_PER_DAY)


def stage_durations(orders: DataFrame) -> DataFrame:
    """H2 at order grain over the complete-lifecycle cohort."""
    return with_stage_durations(lifecycle_orders(orders)).select(
        "order_id", "time_to_carrier", "time_in_transit", "total_delivery_time"
    )


def lifecycle_master(tables: Tables) -> DataFrame:
    """The EDA master: lifecycle cohort x items x sellers x customers (inner)."""
    orders = with_stage_durations(lifecycle_orders(tables.orders), keep_micros=True).select(
        "order_id",
        "customer_id",
        "order_approved_at",
        "order_delivered_carrier_date",
        "time_to_carrier",
        "time_in_transit",
        "total_delivery_time",
        "time_to_carrier_us",
        "time_in_transit_us",
        "total_delivery_time_us",
        late_flag("order_delivered_customer_date", "order_estimated_delivery_date").alias("is_late"),
    )
    customers = tables.customers.select("customer_id", "customer_zip_code_prefix", "customer_state")
    orders = dimension_join(orders, customers, "customer_id", "inner")
    items = tables.order_items.select("order_id", "seller_id", "price", "freight_value")
    df = orders.join(items, "order_id")
    sellers = tables.sellers.select("seller_id", "seller_zip_code_prefix", "seller_state")
    return dimension_join(df, sellers, "seller_id", "inner")


def stage_averages(lm: DataFrame) -> DataFrame:
    """Mean stage durations over all rows of the lifecycle master."""
    return lm.agg(
        avg_days("time_to_carrier").alias("avg_time_to_carrier"),
        avg_days("time_in_transit").alias("avg_time_in_transit"),
        avg_days("total_delivery_time").alias("avg_total_delivery_time"),
        F.count(F.lit(1)).alias("rows"),
    )


def _stacked(lm: DataFrame, stages) -> DataFrame:
    """(stage, x) rows: every stage value of every row, non-NULL only."""
    body = ", ".join(f"'{st}', `{st}`" for st in stages)
    return lm.select(F.expr(f"stack({len(stages)}, {body}) as (stage, x)")).filter(F.col("x").isNotNull())


def stage_histogram(lm: DataFrame, stages=STAGES, bins: int = 50) -> DataFrame:
    """Equal-width histogram over the full range of each stage.

    All stages are stacked into (stage, x) rows, so the data is read twice in
    total: once for the per-stage bounds (one row per stage, broadcast on the
    stage name) and once for the bin counts. The maximum lands in the last
    bin; empty bins come from a right join to the fixed stages x bins grid.
    """
    long = _stacked(lm, stages)
    bounds = long.groupBy("stage").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    lo, hi, x = F.col("lo"), F.col("hi"), F.col("x")
    width = hi - lo
    raw = F.floor(F.lit(bins) * (x - lo) / width) + 1
    b = F.when(width == 0, F.lit(1)).otherwise(F.least(raw, F.lit(bins))).cast("int")
    # bounds has one row per stage: a proven bound
    counts = long.join(F.broadcast(bounds), "stage").groupBy("stage", b.alias("bin")).agg(
        F.count(F.lit(1)).alias("count")
    )
    spark = lm.sparkSession
    grid = _grid(spark, stages, bins)
    out = grid.join(F.broadcast(bounds), "stage").join(counts, ["stage", "bin"], "left")
    return out.select(
        "stage",
        "bin",
        (lo + width * (F.col("bin") - 1) / bins).alias("bin_lo"),
        (lo + width * F.col("bin") / bins).alias("bin_hi"),
        F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"),
    )


def _grid(spark, stages, bins: int) -> DataFrame:
    """Fixed (stage, bin) grid: len(stages) x bins rows from one generator."""
    names = F.array(*[F.lit(st) for st in stages])
    return spark.range(0, len(stages) * bins).select(
        F.element_at(names, (F.col("id") / bins).cast("int") + 1).alias("stage"),
        ((F.col("id") % bins) + 1).cast("int").alias("bin"),
    )


def stage_density(lm: DataFrame, stages=STAGES, grid_points: int = 200, lost: float = 1e-13) -> DataFrame:
    """Gaussian kernel density curve on ``grid_points`` over [min, max].

    Bandwidth h is Scott's rule (stddev * n^(-1/5)). Stages are stacked into
    (stage, x) rows and counted by distinct value; each distinct value adds its
    weighted kernel to the grid points in its reach, combined on the map side.
    Beyond k = sqrt(2 ln(1 / (lost h sqrt(2 pi)))) bandwidths a value adds less
    than ``lost`` of its share, so what all values leave out at a point is below
    ``lost`` in density. As h falls with n, so does the number of points in reach.
    A stage of one value (or one row) has no bandwidth: its density is NULL.
    """
    counted = _stacked(lm, stages).groupBy("stage", "x").agg(F.count(F.lit(1)).alias("c"))
    lo, hi, x, c, h = F.col("lo"), F.col("hi"), F.col("x"), F.col("c"), F.col("h")
    root = math.sqrt(2 * math.pi)
    # two passes for the spread: no cancellation of large sums
    stats = _stacked(lm, stages).groupBy("stage").agg(
        F.min("x").alias("lo"), F.max("x").alias("hi"), F.stddev_samp("x").alias("sd"), F.count("x").alias("n")
    ).select("stage", "lo", "hi", "n", (F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("h"))
    stats = stored_side(stats, "density-stats")  # one row per stage, read by values and grid
    last = grid_points - 1
    g = lo + (hi - lo) * F.col("i") / F.lit(last)
    # a spread of nothing (one value) has no reach; a wide h reaches no point at all
    reach = F.when(h > 0, h * F.sqrt(2 * F.greatest(F.lit(0.0), -F.ln(F.lit(lost * root) * h))))
    step = (hi - lo) / F.lit(last)
    first, end = F.greatest(F.lit(0), F.ceil((x - reach - lo) / step)), F.least(F.lit(last), F.floor((x + reach - lo) / step))
    met = counted.join(F.broadcast(stats), "stage").filter(h > 0)  # one row per stage
    met = met.select("*", first.cast("int").alias("a"), end.cast("int").alias("z")).filter("a <= z")
    met = met.select("stage", "x", "c", "lo", "hi", "h", F.explode(F.sequence("a", "z")).alias("i"))
    kernel = c * F.exp(-F.pow((g - x) / h, 2) / 2)
    sums = met.groupBy("stage", "i").agg(F.sum(kernel).alias("k"))
    grid = stats.select("*", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("i"))
    return grid.join(sums, ["stage", "i"], "left").select(
        "stage",
        F.col("i").alias("point"),
        g.alias("x"),
        F.when(h > 0, F.coalesce("k", F.lit(0.0)) / (F.col("n") * h * F.lit(root))).alias("density"),
    )


def order_funnel(orders: DataFrame) -> DataFrame:
    """L2: approved -> handed to carrier -> delivered -> delivered on time.

    Each stage requires the previous one; one conditional-count aggregate
    over orders, then ``stack`` into rows.
    """
    approved = F.col("order_approved_at").isNotNull()
    carrier = approved & F.col("order_delivered_carrier_date").isNotNull()
    delivered = carrier & F.col("order_delivered_customer_date").isNotNull()
    on_time = delivered & (
        F.col("order_delivered_customer_date") <= F.col("order_estimated_delivery_date")
    )
    counts = orders.agg(
        F.count(F.lit(1)).alias("n0"),
        F.count_if(approved).alias("n1"),
        F.count_if(carrier).alias("n2"),
        F.count_if(delivered).alias("n3"),
        F.count_if(on_time).alias("n4"),
    )
    stacked = counts.select(
        "n0",
        F.expr(
            "stack(4, 1, 'order approved', n1, 2, 'handed to carrier', n2, "
            "3, 'delivered', n3, 4, 'delivered on time', n4) as (stage_order, stage, orders)"
        ),
    )
    return stacked.select(
        F.col("stage_order").cast("int").alias("stage_order"),
        "stage",
        F.col("orders").cast("long").alias("orders"),
        F.coalesce(F.try_divide(F.col("orders"), F.col("n0")), F.lit(0.0)).alias("share_of_orders"),
    )


def handover_gap(lm: DataFrame, percentiles=(0.5, 0.9), exact: bool = True, accuracy: int = 10000) -> DataFrame:
    """L3: per-seller approval->carrier gap: mean, count and percentiles.

    ``exact=True`` computes interpolated percentiles (same definition as
    ``percentile`` / ``quantile_cont``) from per-(seller, value) counts in range
    partitions, so no task orders a hot seller's values. ``exact=False`` uses the mergeable ``percentile_approx``
    sketch (bounded memory per group).
    """
    gap = F.col("time_to_carrier")
    base = lm.filter(gap.isNotNull()).select("seller_id", gap.alias("gap"), "time_to_carrier_us")
    summary = base.groupBy("seller_id").agg(
        F.count(F.lit(1)).alias("orders"), avg_days("time_to_carrier").alias("mean_gap_days")
    )
    base = base.drop("time_to_carrier_us")
    names = [f"p{int(round(p * 100))}_gap_days" for p in percentiles]
    if not exact:
        q = base.groupBy("seller_id").agg(
            *[F.percentile_approx("gap", p, accuracy).alias(n) for p, n in zip(percentiles, names)]
        )
        return summary.join(q, "seller_id")
    return summary.join(exact_percentiles(base, "seller_id", "gap", percentiles, names), "seller_id")


def exact_percentiles(df: DataFrame, key: str | None, value: str, percentiles, names) -> DataFrame:
    """Interpolated percentiles per key (``key=None``: over all rows, one
    output row): position (n - 1) * p between the sorted values, linear
    interpolation (the ``percentile`` / ``quantile_cont`` definition), exact:

      1. value histogram per (key, value), a partial aggregate, dealt to range
         partitions of (key, value) whose bounds Spark samples from the distinct
         values (an outlier moves no bound), and stored once;
      2. counts per (key, partition); a running sum over the partitions of a
         key finds those holding the needed ranks;
      3. only the distinct values inside these are ordered. No task orders more
         than one range partition, whatever a key's values are.
    """
    from pyspark.sql import Window

    from ..sources.catalog import materialize

    keys = [key] if key else []
    v = F.col(value)
    hist = df.filter(v.isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    # stored, because the number of a range partition holds for one evaluation
    placed = materialize(hist.repartitionByRange(*keys, value).withColumn("__b", F.spark_partition_id()), "percentiles")

    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per_b = placed.groupBy(*keys, "__b").agg(F.sum("__c").alias("__bc")).select(
        *keys, "__b", "__bc", F.sum("__bc").over(upto).alias("__bcum"), F.sum("__bc").over(whole).alias("__n")
    ).withColumn("__before", F.col("__bcum") - F.col("__bc"))

    ranks = []  # (name, k_lo, k_hi, frac) as columns over __n
    for p, name in zip(percentiles, names):
        pos = (F.col("__n") - 1) * F.lit(float(p))
        ranks.append((name, F.floor(pos), F.ceil(pos), pos - F.floor(pos)))
    holds = None
    for _, k_lo, k_hi, _ in ranks:
        for k in (k_lo, k_hi):
            c = (F.col("__before") <= k) & (k < F.col("__bcum"))
            holds = c if holds is None else holds | c
    targets = per_b.filter(holds).select(*keys, "__b", "__before", "__n")

    inner = placed.join(targets, [*keys, "__b"])
    within = Window.partitionBy(*keys, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = inner.withColumn("__cum", F.col("__before") + F.sum("__c").over(within))
    aggs = []
    for name, k_lo, k_hi, frac in ranks:
        v_lo = F.min(F.when(F.col("__cum") > k_lo, v))
        v_hi = F.min(F.when(F.col("__cum") > k_hi, v))
        aggs.append((v_lo + (v_hi - v_lo) * F.max(frac)).alias(name))
    return inner.groupBy(*keys).agg(*aggs)
