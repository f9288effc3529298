"""Classifier metrics as DataFrame aggregates: confusion counts, threshold
sweep, classification report, exact ROC-AUC and the serving risk flag.

All take a label column (0/1) and a score column (probability of 1).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import risk_flag, risk_label, safe_ratio

# upstream's sweep.
DEFAULT_THRESHOLDS = (0.3, 0.4, 0.5, 0.6, 0.7)


def confusion(df: DataFrame, threshold: float = 0.5, label: str = "y", score: str = "p", strict: bool = False) -> DataFrame:
    """Tp / fp / fn / tn at one threshold (``>=`` unless ``strict``)."""
    y, p = F.col(label), F.col(score)
    pred = p > F.lit(float(threshold)) if strict else p >= F.lit(float(threshold))
    return df.agg(
        F.count_if(pred & (y == 1)).alias("tp"),
        F.count_if(pred & (y == 0)).alias("fp"),
        F.count_if(~pred & (y == 1)).alias("fn"),
        F.count_if(~pred & (y == 0)).alias("tn"),
    )


def threshold_sweep(df: DataFrame, thresholds=DEFAULT_THRESHOLDS, label: str = "y", score: str = "p") -> DataFrame:
    """M7: recall / precision / caught / false alarms per threshold, one pass.

    Conditional sums for every threshold live in a single aggregate; the
    one-row result is unpivoted with ``stack``. Rows never meet thresholds.
    """
    y, p = F.col(label), F.col(score)
    aggs = []
    for i, t in enumerate(thresholds):
        pred = p >= F.lit(float(t))
        aggs += [
            F.count_if(pred & (y == 1)).alias(f"tp{i}"),
            F.count_if(pred & (y == 0)).alias(f"fp{i}"),
            F.count_if(~pred & (y == 1)).alias(f"fn{i}"),
        ]
    one = df.agg(*aggs)
    body = ", ".join(f"CAST({float(t)!r} AS DOUBLE), tp{i}, fp{i}, fn{i}" for i, t in enumerate(thresholds))
    rows = one.select(F.expr(f"stack({len(thresholds)}, {body}) as (threshold, tp, fp, fn)"))
    return rows.select(
        "threshold",
        safe_ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        F.col("tp").cast("long").alias("caught"),
        F.col("fp").cast("long").alias("false_alarms"),
    )


def classification_report(df: DataFrame, label: str = "y", prediction: str = "pred") -> DataFrame:
    """M6: per-class precision / recall / f1 / support, accuracy, macro and
    support-weighted averages, from the four cells of one aggregate."""
    y, yhat = F.col(label), F.col(prediction)
    cells = df.agg(
        F.count_if((y == 1) & (yhat == 1)).alias("tp"),
        F.count_if((y == 0) & (yhat == 1)).alias("fp"),
        F.count_if((y == 1) & (yhat == 0)).alias("fn"),
        F.count_if((y == 0) & (yhat == 0)).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def prf(t, f_pos, f_neg):
        pr = safe_ratio(t, t + f_pos)
        rc = safe_ratio(t, t + f_neg)
        return pr, rc, safe_ratio(2 * pr * rc, pr + rc)

    p1, r1, f1 = prf(tp, fp, fn)
    p0, r0, f0 = prf(tn, fn, fp)
    s1, s0 = tp + fn, tn + fp
    n = s1 + s0
    wide = cells.select(
        p0.alias("p0"), r0.alias("r0"), f0.alias("f0"), s0.alias("s0"),
        p1.alias("p1"), r1.alias("r1"), f1.alias("f1"), s1.alias("s1"),
        safe_ratio(tp + tn, n).alias("acc"), n.alias("n"),
    )
    w = lambda a, b: F.try_divide(F.col(a) * F.col("s0") + F.col(b) * F.col("s1"), F.col("n"))
    m = lambda a, b: (F.col(a) + F.col(b)) / 2
    wide = wide.select(
        "*",
        m("p0", "p1").alias("mp"), m("r0", "r1").alias("mr"), m("f0", "f1").alias("mf"),
        F.coalesce(w("p0", "p1"), F.lit(0.0)).alias("wp"),
        F.coalesce(w("r0", "r1"), F.lit(0.0)).alias("wr"),
        F.coalesce(w("f0", "f1"), F.lit(0.0)).alias("wf"),
    )
    return wide.select(
        F.expr(
            "stack(5, "
            "'0', p0, r0, f0, s0, "
            "'1', p1, r1, f1, s1, "
            "'accuracy', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), acc, n, "
            "'macro avg', mp, mr, mf, n, "
            "'weighted avg', wp, wr, wf, n"
            ") as (class, precision, recall, f1_score, support)"
        )
    ).withColumn("support", F.col("support").cast("long"))


def roc_auc(df: DataFrame, label: str = "y", score: str = "p", buckets: int = 1 << 20) -> DataFrame:
    """M5: exact ROC-AUC (ties count half), as a one-row DataFrame.

    AUC = sum over distinct scores s of pos(s) * (neg(< s) + neg(s) / 2),
    divided by P * N. Negatives below a score come from a two-level prefix
    sum: counts per distinct score (partial aggregate), then per fine bucket
    of [0, 1] (at most ``buckets`` rows in one ordered window), then inside
    each bucket over its distinct scores. No group holds raw rows, and the
    input is read once.
    """
    y, p = F.col(label), F.col(score)
    per_score = df.filter(p.isNotNull() & y.isNotNull()).groupBy(p.alias("s")).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg")
    )
    # buckets over the probability range; any monotone bucketing is exact
    # (scores outside [0, 1] fall into the edge buckets, still ordered by s)
    b = F.least(F.greatest(F.floor(F.col("s") * buckets), F.lit(0)), F.lit(buckets - 1))
    per_score = per_score.withColumn("b", b.cast("long"))
    per_bucket = per_score.groupBy("b").agg(F.sum("neg").alias("bneg"))
    carry = per_bucket.select(
        "b",
        F.coalesce(
            F.sum("bneg").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("carry"),
    )
    inner = Window.partitionBy("b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = per_score.select(
        "b", "s", "pos", "neg", F.coalesce(F.sum("neg").over(inner), F.lit(0)).alias("neg_in_bucket")
    ).join(carry, "b")
    return ranked.agg(
        # NULL where a class is missing: there is nothing to rank
        F.try_divide(
            F.sum(F.col("pos").cast("double") * (F.col("carry") + F.col("neg_in_bucket") + F.col("neg") / 2.0)),
            F.sum("pos").cast("double") * F.sum("neg").cast("double"),
        ).alias("roc_auc"),
        F.coalesce(F.sum("pos"), F.lit(0)).cast("long").alias("positives"),
        F.coalesce(F.sum("neg"), F.lit(0)).cast("long").alias("negatives"),
    )


def with_risk(df: DataFrame, score: str = "delay_risk_probability", threshold: float = 0.5) -> DataFrame:
    """Strict ``> threshold`` high-risk flag and its label."""
    return df.withColumn("is_high_risk", risk_flag(score, threshold)).withColumn(
        "risk_label", risk_label(score, threshold)
    )
