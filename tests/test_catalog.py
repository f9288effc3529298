"""Identity of stored tables: a table is found again by the same plan over the
same files, and by no other."""

import os
import tempfile

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from delaylens.operators.lifecycle import exact_percentiles
from delaylens.operators.master import build_master
from delaylens.plans import common as c
from delaylens.sources.catalog import ensure_master, materialize, plan_version
from delaylens.sources.store import latest_version
from delaylens.sources.tables import Tables
from tests.conftest import SF_SMALL


def _read(spark, table="lineitem"):
    return spark.read.parquet(f"{SF_SMALL}/{table}.parquet")


def _same_name(column):
    return lambda df: df.groupBy("l_suppkey").agg(F.avg(column).alias("m"))


PAIRS = {
    "aggregated column": (_same_name("l_extendedprice"), _same_name("l_tax")),
    "aggregate": (lambda d: d.groupBy("l_suppkey").agg(F.max("l_tax").alias("m")), lambda d: d.groupBy("l_suppkey").agg(F.min("l_tax").alias("m"))),
    "filtered column": (lambda d: d.filter("l_tax > 0.05").select("l_orderkey"), lambda d: d.filter("l_discount > 0.05").select("l_orderkey")),
    "filter value": (lambda d: d.filter("l_tax > 0.05"), lambda d: d.filter("l_tax > 0.06")),
    "projected column": (lambda d: d.select(F.col("l_tax").alias("v")), lambda d: d.select(F.col("l_discount").alias("v"))),
    "sort key": (lambda d: d.orderBy("l_tax").limit(3), lambda d: d.orderBy("l_discount").limit(3)),
    "window key": (
        lambda d: d.select("l_orderkey", F.sum("l_tax").over(Window.partitionBy("l_suppkey")).alias("s")),
        lambda d: d.select("l_orderkey", F.sum("l_tax").over(Window.partitionBy("l_partkey")).alias("s")),
    ),
    "group key": (lambda d: d.groupBy(F.col("l_suppkey").alias("k")).count(), lambda d: d.groupBy(F.col("l_partkey").alias("k")).count()),
    "subquery column": (
        lambda d: d.select("l_orderkey", d.agg(F.avg("l_tax")).scalar().alias("s")),
        lambda d: d.select("l_orderkey", d.agg(F.avg("l_discount")).scalar().alias("s")),
    ),
    "the 30th of many columns": (
        lambda d: d.select(*[(F.col("l_tax") + i).alias(f"c{i}") for i in range(40)]),
        lambda d: d.select(*[(F.col("l_discount" if i == 30 else "l_tax") + i).alias(f"c{i}") for i in range(40)]),
    ),
}


@pytest.mark.parametrize("name", PAIRS)
def test_plans_that_differ_get_tables_of_their_own(spark, name):
    a, b = PAIRS[name]
    assert plan_version(a(_read(spark))) == plan_version(a(_read(spark)))
    assert plan_version(a(_read(spark))) != plan_version(b(_read(spark)))
    rows = [sorted(map(str, materialize(f(_read(spark)), "identity").collect())) for f in (a, b)]
    assert rows == [sorted(map(str, f(_read(spark)).collect())) for f in (a, b)]


def test_join_sides_of_equal_shape_are_told_apart(spark):
    root = tempfile.mkdtemp(prefix="delaylens-id-")
    for name, v in (("a", 1), ("b", 2)):
        spark.createDataFrame([(1, v)], "k int, v int").write.parquet(f"{root}/{name}")
    a, b = (lambda: spark.read.parquet(f"{root}/a")), (lambda: spark.read.parquet(f"{root}/b"))

    def left_value(x, y):
        return x.alias("x").join(y.alias("y"), "k").select("k", F.col("x.v").alias("v"))

    first, second = materialize(left_value(a(), b()), "sides"), materialize(left_value(b(), a()), "sides")
    assert (first.first().v, second.first().v) == (1, 2)
    # the side that a value is taken from
    one, other = (a().alias("x").join(b().alias("y"), "k").select("k", F.col(f"{s}.v").alias("v")) for s in "xy")
    assert (materialize(one, "side").first().v, materialize(other, "side").first().v) == (1, 2)
    # a subquery over another table
    sub = [a().select("k", t().agg(F.max("v")).scalar().alias("m")) for t in (a, b)]
    assert [materialize(x, "sub").first().m for x in sub] == [1, 2]


def test_changed_input_makes_a_new_table(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="delaylens-id-"), "t")
    lookup = os.path.join(tempfile.mkdtemp(prefix="delaylens-id-"), "u")
    spark.range(3).write.parquet(path)
    spark.range(3).write.parquet(lookup)
    plan = lambda: spark.read.parquet(path).select("id", spark.read.parquet(lookup).agg(F.max("id")).scalar().alias("m"))
    assert materialize(plan(), "changed").first().m == 2
    spark.range(9).write.mode("overwrite").parquet(lookup)  # only the subquery reads it
    assert materialize(plan(), "changed").first().m == 8
    spark.range(5).write.mode("overwrite").parquet(path)
    assert materialize(plan(), "changed").count() == 5


def test_rows_of_unknown_origin_are_never_reused(spark):
    rows = spark.createDataFrame([(1,)], "k int")
    assert plan_version(rows) != plan_version(rows)
    twice = F.udf(lambda x: 2 * x, "double")
    coded = _read(spark).select(twice("l_tax").alias("v"))
    assert plan_version(coded) != plan_version(coded)
    mapped = _read(spark).select("l_tax").mapInPandas(lambda it: it, "l_tax double")
    assert plan_version(mapped) != plan_version(mapped)


def test_percentiles_of_two_columns_under_one_name(spark):
    items = c.tables(spark, SF_SMALL).order_items
    for column in ("price", "freight_value", "price"):
        got = exact_percentiles(items.select(F.col(column).alias("v")), None, "v", [0.5], ["median"]).first().median
        assert got == pytest.approx(items.agg(F.percentile(column, F.lit(0.5))).first()[0])


def test_ensure_master_rebuilds_for_another_cohort(spark):
    """A master of other rows over the same files is another version."""
    path = os.path.join(tempfile.mkdtemp(prefix="delaylens-id-"), "master")
    t = c.tables(spark, SF_SMALL)
    n = ensure_master(spark, path, lambda: t).count()
    first = latest_version(spark, path)
    less = Tables(**{**t.as_dict(), "order_items": t.order_items.filter("price > 20000")})
    expected = build_master(less).count()
    assert ensure_master(spark, path, lambda: less).count() == expected != n
    assert latest_version(spark, path)[1] != first[1]
    assert ensure_master(spark, path, lambda: c.tables(spark, SF_SMALL)).count() == n
