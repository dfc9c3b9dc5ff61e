import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from gridpulse.functions.columns import float_text_to_double, nearest_hour
from gridpulse.session import fresh_dir
from gridpulse.sources import bronze, landing, tables
from gridpulse.catalog import TAG_POINTS

T = lambda s: F.lit(s).cast("timestamp")


def land(spark, values, folder=None):
    folder = folder or fresh_dir(spark, "landing-test")
    path = f"{folder}/asset_id=7/tag=tap_position"
    os.makedirs(path, exist_ok=True)
    items = [{"Timestamp": t, "Value": v} for t, v in values]
    with open(f"{path}/page-{len(os.listdir(path))}.json", "w") as f:
        f.write(json.dumps({"Items": items}, indent=1))
    return folder


def test_value_channels(spark):
    ok = "2024-01-01T00:00:00Z"
    values = [1, 1.5, "1,5", " 2.5 ", "1.234,5", "abc", "nan", "1d", True, False, {"Name": "No Data"}, None, "1e3"]
    folder = land(spark, [(ok, v) for v in values] + [("not a time", 4)])
    rows = landing.to_bronze_rows(landing.read_items(spark, folder)).collect()
    assert len(rows) == len(values) + 1
    got = {r["value_text"]: (r["value"], r["value_bool"]) for r in rows if r["value_text"]}
    assert got["1"] == (1.0, None) and got["1.5"] == (1.5, None) and got["1,5"] == (1.5, None)
    assert got[" 2.5 "] == (2.5, None) and got["1e3"] == (1000.0, None)
    assert got["1.234,5"] == (None, None) and got["abc"] == (None, None) and got["1d"] == (None, None)
    assert got["nan"] == (None, None)  # not a number is a missing number
    assert got["True"] == (None, True) and got["False"] == (None, False)
    assert sum(r["value_text"] is None for r in rows) == 2  # the error object and the null
    late = [r for r in rows if r["timestamp"] is None]
    assert len(late) == 1 and late[0]["date"] == "__missing__" and late[0]["value"] == 4.0
    assert {r["asset_id"] for r in rows} == {7} and {r["tag"] for r in rows} == {"tap_position"}


@pytest.mark.parametrize("text,number", [("1_000", None), ("+3", 3.0), (".5", 0.5), ("5.", 5.0), ("1,2,3", None), ("2f", None), ("", None)])
def test_number_texts(spark, text, number):
    assert spark.range(1).select(float_text_to_double(F.lit(text))).first()[0] == number


def test_load_windows(spark):
    d = spark.range(1).select(T("2024-01-01 00:00:00").alias("start"), T("2024-01-31 00:00:01").alias("end"))
    got = [(str(a), str(b)) for a, b in landing.load_windows(d, 15).orderBy("window_start").collect()]
    assert got == [
        ("2024-01-01 00:00:00", "2024-01-16 00:00:00"),
        ("2024-01-16 00:00:01", "2024-01-31 00:00:01"),
    ]
    assert landing.load_windows(d.withColumn("end", F.col("start")), 15).count() == 0


def test_catalogue(spark):
    assert len(TAG_POINTS) == 94
    row = landing.tag_catalogue(spark).where("tag = 'ventilador_14_mcb'").first()
    assert row["source_path"] == "TR1.Fan 14 MCB"


def readings(spark, rows):
    return spark.createDataFrame(rows, "asset_id long, tag string, t string, value double").select(
        "asset_id", "tag", F.col("t").cast("timestamp").alias("ts"), "value")


def test_marks_and_resume(spark):
    stored = readings(spark, [(1, "a", "2024-01-01 00:00:05.700", 1.0), (1, "a", "2024-01-01 00:00:01", 1.0)])
    assert str(bronze.high_water_marks(stored).first()["mark"]) == "2024-01-01 00:00:05"
    new = readings(spark, [
        (1, "a", "2024-01-01 00:00:05.700", 0.0), (1, "a", "2024-01-01 00:00:05.900", 1.0),
        (1, "a", "2024-01-01 00:00:06", 2.0), (1, "b", "2024-01-01 00:00:00", 3.0), (1, "b", "2023-01-01 00:00:00", 4.0)])
    exact = bronze.resume(new, bronze.exact_marks(stored), T("2024-01-01"))
    assert sorted(r["value"] for r in exact.collect()) == [1.0, 2.0, 3.0]
    second = bronze.resume(new, bronze.high_water_marks(stored), T("2024-01-01"), exact=False)
    assert sorted(r["value"] for r in second.collect()) == [2.0, 3.0]


def test_unify_is_decided_per_tag(spark):
    d = spark.createDataFrame(
        [("texts", None, "1.5", None), ("texts", None, "x", None), ("bools", None, "True", True), ("bools", None, "False", False),
         ("mixed", 9.0, "9.0", None), ("mixed", None, "8", None), ("none", None, "off", None)],
        "tag string, value double, value_text string, value_bool boolean",
    ).withColumns({"asset_id": F.lit(1), "timestamp": T("2024-01-01")})
    got = {}
    for r in bronze.unify_value(d).collect():
        got.setdefault(r["tag"], []).append(r["value"])
    assert sorted(got["texts"], key=str) == [1.5, None] and sorted(got["bools"]) == [0.0, 1.0]
    assert sorted(got["mixed"], key=str) == [9.0, None] and got["none"] == [None]


def test_time_column(spark):
    assert bronze.time_column(spark.range(1).withColumn("ts", F.lit(1))) == "ts"
    with pytest.raises(ValueError):
        bronze.time_column(spark.range(1))


def test_bronze_table_evolves(spark):
    path = fresh_dir(spark, "bronze-test")
    base = readings(spark, [(1, "a", "2024-01-01 00:00:00", 1.0), (1, "b", "2024-01-02 00:00:00", float("nan"))]).withColumnRenamed("ts", "timestamp")
    bronze.append(base, path)
    bronze.append(base.withColumns({"value_text": F.lit("x"), "extra": F.lit(5)}), path)
    back = bronze.read(spark, path, ["b"])
    assert "PartitionFilters: [isnotnull(tag" in back._jdf.queryExecution().toString() or "tag#" in back._jdf.queryExecution().toString()
    assert back.count() == 2 and back.where("value is null").count() == 2 and back.where("extra = 5").count() == 1


@pytest.mark.parametrize("t,hour", [
    ("2024-01-01 00:30:00", "2024-01-01 00:00:00"), ("2024-01-01 01:30:00", "2024-01-01 02:00:00"),
    ("2024-01-01 01:29:59.999999", "2024-01-01 01:00:00"), ("2024-01-01 02:30:00.000001", "2024-01-01 03:00:00"),
])
def test_half_even_hours(spark, t, hour):
    got = spark.range(1).select(F.timestamp_seconds(nearest_hour(T(t)) * 3600).cast("string")).first()[0]
    assert got == hour


def test_reader_fallback_and_anomalies(spark):
    path = fresh_dir(spark, "processed")
    d = spark.createDataFrame([("CRITICO",), ("NORMAL",), ("ALERTA",)], "estado_operacional string")
    d.write.parquet(path)
    back = tables.read_first(spark, ("parquet", path + "-none"), ("parquet", path))
    assert tables.anomalies(spark, back).count() == 2
    assert tables.anomalies(spark, back, path).count() == 3
    assert tables.anomalies(spark, spark.range(3)) is None
    with pytest.raises(FileNotFoundError):
        tables.read_first(spark, ("parquet", path + "-none"))


def test_rewritten_table_drops_old_partitions(spark):
    path = fresh_dir(spark, "silver-test")
    make = lambda day: spark.range(1).select(F.col("id").alias("asset_id"), T(day).alias("ts"))
    tables.write_silver(make("2023-05-01"), path)
    tables.write_silver(make("2024-06-01"), path)
    got = spark.read.parquet(path).collect()
    assert len(got) == 1 and got[0]["year"] == 2024 and got[0]["month"] == 6
