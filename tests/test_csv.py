"""CSV records that span lines, read in byte ranges."""

import csv
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from delaylens.sources.csv_records import csv_records
from delaylens.sources.raw import load_raw_zone, read_csv, read_csv_rejects

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("note", T.StringType()), T.StructField("score", T.IntegerType())])


def _tmp():
    return tempfile.mkdtemp(prefix="delaylens-csv-")


@pytest.fixture
def small_ranges(spark):
    """Byte ranges of about a kilobyte."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def _multi_line(spark, path):
    """Spark's own reader, a task a file."""
    reader = spark.read.schema(SCHEMA).option("header", True).option("multiLine", True).option("escape", '"')
    return sorted(map(tuple, reader.csv(path).collect()), key=repr)


def _notes(seed, n):
    r = random.Random(seed)
    parts = ["plain", "with, comma", 'a "quoted" word', "two\nlines", "\n", '"', '""', "x" * 400, "end\n\n\nof it", "ümläut", "a\n" * 40, ""]
    return [(i, "".join(r.choice(parts) for _ in range(r.randrange(4))) or None, r.randrange(5)) for i in range(n)]


def _write(path, rows, newline="\n"):
    with open(path, "w", encoding="utf-8", newline="") as f:
        w = csv.writer(f, lineterminator=newline)
        w.writerow(SCHEMA.names)
        w.writerows(rows)


@pytest.mark.parametrize("seed", range(4))
def test_ranges_give_the_rows_of_a_single_task(spark, small_ranges, seed):
    folder = _tmp()
    for k in range(2):
        _write(f"{folder}/{k}.csv", _notes(10 * seed + k, 150))
    _write(f"{folder}/plain.csv", [(i, f"no quotes {i}", 1) for i in range(300)])
    _write(f"{folder}/short.csv", [])
    got = read_csv(spark, folder, SCHEMA)
    assert sorted(map(tuple, got.collect()), key=repr) == _multi_line(spark, folder)
    assert read_csv_rejects(spark, folder, SCHEMA).isEmpty()
    assert spark.read.text(folder).rdd.getNumPartitions() > 20  # ranges, not files


def test_field_over_many_ranges_and_carriage_returns(spark, small_ranges):
    folder = _tmp()
    long = "\r\n".join(f"line {i}, of \"many\"" for i in range(900))
    rows = [(1, "a", 1), (2, long, 2), (3, "b\r\nc", 3), (4, long, 4), (5, None, 5)]
    _write(f"{folder}/a.csv", rows, "\r\n")
    assert sorted(map(tuple, read_csv(spark, folder, SCHEMA).collect())) == rows


def test_records_that_never_close_are_rejects_whole(spark, small_ranges):
    folder = _tmp()
    with open(f"{folder}/a.csv", "w") as f:
        f.write("id,note,score\n1,good,1\n2,\"two\nlines\",2\n3,\"open\n4,looks good,4\n5,looks good,5\n")
    assert [tuple(r) for r in read_csv(spark, folder, SCHEMA).orderBy("id").collect()] == [(1, "good", 1), (2, "two\nlines", 2)]
    assert {r.row for r in read_csv_rejects(spark, folder, SCHEMA).collect()} == {'3,"open', "4,looks good,4", "5,looks good,5"}
    # the same for one that is longer than a record may be
    with open(f"{folder}/a.csv", "w") as f:
        f.write("id,note,score\n1,good,1\n2,\"" + "x\n" * 3000 + "\",2\n3,good,3\n")
    records = csv_records(spark, folder, max_bytes=5000)
    assert {r.record for r in records.filter("complete").collect()} == {"1,good,1", "3,good,3"}
    assert records.filter(~F.col("complete")).count() == 3001  # every line of it


def test_malformed_records_are_rejects(spark):
    folder = _tmp()
    with open(f"{folder}/a.csv", "w") as f:
        f.write('id,note,score\n1,"a\nb",one\n2,too,many,fields\n3\n\n4,fine,4\nx,"c\nd",5\n')
    assert [tuple(r) for r in read_csv(spark, folder, SCHEMA).collect()] == [(4, "fine", 4)]
    rejects = {r.row: r.fields for r in read_csv_rejects(spark, folder, SCHEMA).collect()}
    assert set(rejects) == {'1,"a\nb",one', "2,too,many,fields", "3", 'x,"c\nd",5'}
    assert rejects['1,"a\nb",one'] == 2


def test_files_of_a_folder_agree_on_the_header(spark):
    folder = _tmp()
    _write(f"{folder}/a.csv", [(1, "a", 1)])
    with open(f"{folder}/b.csv", "w") as f:
        f.write("note,id,score\nb,2,2\n")
    with pytest.raises(Exception, match="another CSV header"):
        read_csv(spark, folder, SCHEMA).collect()


def test_raw_zone_reads_newlines_in_any_table(spark):
    """A quoted newline needs no column of a certain name."""
    zone = _tmp()
    files = {"things.csv": ("things", SCHEMA), "others.csv": ("others", SCHEMA), "absent.csv": ("absent", SCHEMA)}
    _write(os.path.join(zone, "things.csv"), [(1, "two\nlines", 1), (2, "x", 2)])
    with open(os.path.join(zone, "others.csv"), "w") as f:
        f.write("id,note,score\n1,ok,1\nbad,ok,1\n")
    loaded = load_raw_zone(spark, zone, files)
    assert loaded.missing == ["absent.csv"]
    assert sorted(map(tuple, loaded.tables["things"].collect())) == [(1, "two\nlines", 1), (2, "x", 2)]
    assert loaded.reject_counts() == {"things": 0, "others": 1}
    # no shuffle of lines where no field spans them
    from tests.planutil import plan_text

    assert "MapIn" not in plan_text(loaded.tables["things"]) and "PythonUDF" not in plan_text(loaded.tables["things"])
