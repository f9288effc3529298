"""Raw zone loader, CSV scan, master persistence, SQL access, records."""

import os
import tempfile

from pyspark.sql import functions as F

from delaylens.operators.master import build_master
from delaylens.plans import common as c
from delaylens.schemas import ORDERS, RAW_FILES
from delaylens.sources.catalog import ensure_master, read_master, register_master, run_sql, write_master
from delaylens.sources.lookup import read_category_csv, translate_categories
from delaylens.sources.raw import load_raw_zone, parse_timestamps, read_csv, read_csv_rejects
from delaylens.sources.records import records_to_df
from tests.conftest import SF_MED, SF_SMALL


def _tmp():
    return tempfile.mkdtemp(prefix="delaylens-src-")


def test_csv_scan_and_loader_reports_missing(spark):
    raw = _tmp()
    with open(os.path.join(raw, "orders.csv"), "w", encoding="utf-8-sig") as f:
        f.write(",".join(ORDERS.fieldNames()) + "\n")
        f.write("o1,c1,delivered,2018-01-01 10:00:00,2018-01-01 11:00:00,2018-01-02 09:00:00,"
                "2018-01-10 15:30:00,2018-01-09 00:00:00\n")
    res = load_raw_zone(spark, raw)
    assert set(res.tables) == {"orders"}
    assert len(res.missing) == len(RAW_FILES) - 1
    row = res.tables["orders"].first()
    assert row.order_id == "o1" and row.order_delivered_customer_date.hour == 15


def test_category_lookup_csv_with_bom(spark):
    path = os.path.join(_tmp(), "translation.csv")
    with open(path, "w", encoding="utf-8-sig") as f:
        f.write("product_category_name,product_category_name_english\nbeleza_saude,health_beauty\n")
    lk = read_category_csv(spark, path)
    df = spark.createDataFrame([("beleza_saude",), ("other",)], "product_category_name string")
    got = {r.product_category_name: r.product_category_name_english for r in translate_categories(df, lk).collect()}
    assert got == {"beleza_saude": "health_beauty", "other": "other"}


def test_master_write_read_sql_and_ensure(spark):
    path = os.path.join(_tmp(), "master")
    t = c.tables(spark, SF_SMALL)
    m = build_master(t)
    write_master(m, path)
    back = read_master(spark, path)
    assert back.count() == m.count()
    # partition pruning on purchase month
    from tests.planutil import plan_text

    pruned = plan_text(spark.read.parquet(path).filter(F.col("purchase_month") == "1995-01"))
    assert "PartitionFilters: [isnotnull(purchase_month" in pruned
    register_master(back)
    assert run_sql(spark).count() == m.count()
    assert run_sql(spark, "SELECT count(DISTINCT order_id) AS n FROM master_analytics_table").first().n == 468
    fresh = os.path.join(_tmp(), "absent")
    got = ensure_master(spark, fresh, lambda: t)
    assert got.count() == m.count()


def test_csv_nan_becomes_null(spark):
    from delaylens.schemas import GEOLOCATION

    path = os.path.join(_tmp(), "geo.csv")
    with open(path, "w") as f:
        f.write("geolocation_zip_code_prefix,geolocation_lat,geolocation_lng,geolocation_city,geolocation_state\n")
        f.write("1,NaN,-46.5,a,SP\n2,-23.1,,b,SP\n")
    rows = read_csv(spark, path, GEOLOCATION).orderBy("geolocation_zip_code_prefix").collect()
    assert rows[0].geolocation_lat is None and rows[1].geolocation_lng is None


def test_csv_binds_by_name_and_keeps_quoted_text(spark):
    import pytest
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("note", T.StringType())])
    path = os.path.join(_tmp(), "a.csv")
    with open(path, "w") as f:
        f.write('extra,note,id\nx,"said ""no"",\nthen left",1\ny,plain,2\nz,bad,seven\n')
    rows = sorted(map(tuple, read_csv(spark, path, schema).collect()))
    assert rows == [(1, 'said "no",\nthen left'), (2, "plain")]
    assert [r.row for r in read_csv_rejects(spark, path, schema).collect()] == ["z,bad,seven"]
    with pytest.raises(ValueError, match="no column other"):
        read_csv(spark, path, T.StructType([*schema, T.StructField("other", T.StringType())]))


def test_ensure_master_rebuilds_what_is_torn_or_outdated(spark):
    from delaylens.sources.raw import file_system
    from delaylens.sources.store import POINTER, latest_version

    path = os.path.join(_tmp(), "master")
    t = c.tables(spark, SF_SMALL)
    n = ensure_master(spark, path, lambda: t).count()
    first = latest_version(spark, path)
    assert ensure_master(spark, path, lambda: t).count() == n and latest_version(spark, path) == first  # reused
    fs, folder = file_system(spark, first[0])
    part = next(s.getPath() for s in fs.listStatus(folder) if s.isDirectory())
    fs.delete(part, True)  # half of it gone
    assert latest_version(spark, path) is None
    assert ensure_master(spark, path, lambda: t).count() == n
    second = latest_version(spark, path)
    assert second[0] != first[0]
    fs.delete(file_system(spark, f"{path}/{POINTER}")[1], True)  # never committed
    assert ensure_master(spark, path, lambda: t).count() == n
    # other input files: another version
    other = c.tables(spark, SF_MED)
    assert ensure_master(spark, path, lambda: other).count() > n


def test_records_and_timestamp_parse(spark):
    records = [
        {"order_id": "n1", "seller_id": "s7", "seller_zip_code_prefix": 12, "customer_zip_code_prefix": 31, "price": 9.5},
        {"order_id": "n2", "seller_id": None, "product_weight_g": 720.0, "freight_value": 3.25, "further": "left out"},
    ]
    rows = records_to_df(spark, records).orderBy("order_id").collect()
    assert rows[0].product_weight_g is None and rows[0].price == 9.5  # a missing key is NULL
    assert rows[1].seller_id is None and rows[1].freight_value == 3.25
    assert records_to_df(spark, records[0]).count() == 1
    text = spark.createDataFrame([("2018-01-01 10:00:00",), ("garbage",)], "ts string")
    got = [r.ts for r in parse_timestamps(text, ["ts"], "yyyy-MM-dd HH:mm:ss").collect()]
    assert got[0].hour == 10 and got[1] is None


def test_records_with_wrong_types_are_rejects_with_a_reason(spark):
    from delaylens.sources.records import read_records

    good = {"order_id": "a", "price": 1.5, "seller_zip_code_prefix": 7}
    data = [good, {"order_id": "b", "price": "cheap", "seller_zip_code_prefix": 1.5}, {}, 5, "text", None, ["x"], {"price": "2.5", "order_id": None}, {"price": float("nan")}]
    found = read_records(spark, data)
    rows = [(r.order_id, r.price, r.seller_zip_code_prefix) for r in found.records.collect()]
    assert sorted(rows, key=repr) == sorted([("a", 1.5, 7), (None, None, None), (None, 2.5, None), (None, None, None)], key=repr)
    reasons = sorted(r.reason for r in found.rejects.collect())
    assert reasons == ["not_a_record"] * 4 + ["wrong_type:seller_zip_code_prefix,price"]
    assert read_records(spark, []).records.isEmpty() and read_records(spark, good).records.count() == 1


def test_a_text_is_parsed_once(spark):
    from pyspark.sql import functions as F
    from delaylens.sources.records import parse_records
    from tests.planutil import plan_text

    price = F.when(F.col("id") % 5 == 0, F.lit("n/a")).otherwise((F.col("id") / 2).cast("string"))
    text = F.to_json(F.struct(F.col("id").cast("string").alias("order_id"), price.alias("price")))
    texts = spark.range(40).select(F.when(F.col("id") % 7 == 0, F.substring(text, 1, 9)).otherwise(text).alias("record"))
    found = parse_records(texts)
    for part in (found.records, found.rejects):
        assert plan_text(part, "extended").split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0].count("from_json(") == 1
    kept = sorted((int(r.order_id), r.price) for r in found.records.collect())
    assert kept == [(i, i / 2) for i in range(40) if i % 5 and i % 7]
    rejects = sorted((r.record, r.reason) for r in found.rejects.collect())
    assert [r[1] for r in rejects].count("not_a_record") == 6 and [r[1] for r in rejects].count("wrong_type:price") == 6 and len(rejects) == 12
    stored = parse_records(texts, stored=True)
    assert sorted((int(r.order_id), r.price) for r in stored.records.collect()) == kept
    assert sorted((r.record, r.reason) for r in stored.rejects.collect()) == rejects


def test_chain_looks_up_nothing_that_rows_bring(spark):
    """Coordinates and a rate supplied: no geo join, no profile join."""
    from delaylens.operators.features import preprocess
    from tests.planutil import plan_text

    cols = "order_id long, seller_id long, is_late int, s_lat double, s_lng double, c_lat double, c_lng double, seller_late_rate double, product_weight_g double, freight_value double, price double"
    rows = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 0.0, 1.0, 0.25, 5.0, 1.0, 2.0), (2, 2, 1, None, 0.0, 0.0, 1.0, None, 5.0, 1.0, 2.0)], cols)
    prep = preprocess(rows, materialize=False)
    plan = plan_text(prep.features, "extended")
    assert "Join" not in plan.split("== Optimized Logical Plan ==")[1]
    got = prep.features.collect()
    assert [(r.order_id, r.seller_late_rate) for r in got] == [(1, 0.25)] and abs(got[0].distance_km - 111.19) < 0.01
