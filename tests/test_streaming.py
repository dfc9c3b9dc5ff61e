from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gridpulse.models.evaluate import smooth_alerts
from gridpulse.session import fresh_dir
from gridpulse.sources import bronze
from gridpulse.streaming.ingest import drain, hourly_mean_stream, land_end_marker, ordered_alerts_stream, smooth_alerts_stream, stream_readings
from tests.helpers import panel_pdf


def test_streamed_alerts_equal_batch_alerts(spark):
    pdf = panel_pdf(200)[["asset_id", "ts"]]
    pdf["flag"] = np.random.default_rng(3).integers(0, 2, len(pdf)).astype("int32")
    src, out, state = (fresh_dir(spark, n) for n in ("flags", "alerts", "state"))
    schema = "asset_id long, ts timestamp, flag int"
    half = pdf["ts"] < pdf["ts"].iloc[90]
    for part in (pdf[half], pdf[~half]):  # second batch continues from the stored state
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        drain(smooth_alerts_stream(stream_readings(spark, src, schema)), out, state)
    got = spark.read.parquet(out).toPandas().sort_values(["asset_id", "ts"]).reset_index(drop=True)
    want = smooth_alerts(spark.createDataFrame(pdf, schema), "flag").toPandas().sort_values(["asset_id", "ts"])
    assert len(got) == len(pdf) and list(got["alert"]) == list(want["alert"])


def files_of(spark, path):
    return sorted(r[0] for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{path}").select("path").collect())


def readings_of(spark, n, tag="hot", start="2024-01-01"):
    return spark.range(n).select(
        (F.col("id") % 3).alias("asset_id"), F.lit(tag).alias("tag"),
        (F.lit(start).cast("timestamp") + F.make_dt_interval(secs=F.col("id") % 5000)).alias("timestamp"), F.col("id").cast("double").alias("value"))


def test_a_batch_run_again_adds_no_row_and_no_file(spark):
    table, marks = fresh_dir(spark, "bronze"), fresh_dir(spark, "marks")
    for number in (0, 1, 1, 0, 1):
        bronze.append_once(readings_of(spark, 2000 + number), table, f"q-{number}", marks)
    assert spark.read.parquet(table).count() == 4001
    before = len(files_of(spark, table))
    bronze.append_once(readings_of(spark, 2001), table, "q-1", marks)
    assert len(files_of(spark, table)) == before and spark.read.parquet(table).count() == 4001
    kept = bronze.stored_marks(spark, marks)
    assert kept.count() == 3 and bronze.wrong_marks(spark.read.parquet(table), kept).count() == 0
    assert "bronze-" not in kept._jdf.queryExecution().toString()  # no reading is looked at
    bronze.append_once(readings_of(spark, 10, start="2030-01-01"), table, "q-2")  # without marks
    wrong = bronze.wrong_marks(spark.read.parquet(table), bronze.stored_marks(spark, marks)).collect()
    assert len(wrong) == 3 and all(r.mark < r.newest for r in wrong)
    small = fresh_dir(spark, "marks")
    bronze.compact_marks(spark, marks, small)
    assert sorted(map(tuple, bronze.stored_marks(spark, small).collect())) == sorted(map(tuple, kept.collect()))
    floored = bronze.stored_marks(spark, marks, exact=False)
    assert sorted(map(tuple, floored.collect())) == sorted(map(tuple, bronze.high_water_marks(readings_of(spark, 2001)).collect()))


def test_a_hot_tag_is_written_by_several_tasks(spark):
    table, key = fresh_dir(spark, "bronze"), "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(key, "64k")
    try:
        bronze.append_once(readings_of(spark, 200_000), table, "q-0")
    finally:
        spark.conf.unset(key)
    assert len([f for f in files_of(spark, table) if "tag=hot" in f]) > 1


def test_end_marker_closes_open_hours_once(spark):
    schema = "asset_id long, tag string, ts timestamp, value double"
    src, out, state = (fresh_dir(spark, n) for n in ("landed", "hours", "state"))
    rows = readings_of(spark, 5000).withColumnRenamed("timestamp", "ts").select("asset_id", "tag", "ts", "value")
    rows.write.parquet(src)
    drain(hourly_mean_stream(stream_readings(spark, src, schema)), out, state)
    read = lambda: spark.read.schema(schema).parquet(out)
    assert read().count() == 0  # nothing is older than the watermark
    land_end_marker(spark, src, rows.agg(F.max("ts")).first()[0], schema)
    for _ in range(2):
        drain(hourly_mean_stream(stream_readings(spark, src, schema)), out, state)
    want = rows.groupBy("asset_id", "tag", F.date_trunc("hour", "ts").alias("ts")).agg(F.avg("value").alias("value"))
    assert sorted(map(tuple, read().collect())) == sorted(map(tuple, want.collect()))


def test_alerts_of_rows_that_come_late_between_batches(spark):
    """Each hour arrives in one of four batches, up to five hours behind; decisions equal those of the ordered series."""
    key, schema = "spark.sql.streaming.stateStore.providerClass", "asset_id long, ts timestamp, flag int"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rng = np.random.default_rng(3)
        pdf = panel_pdf(120)[["asset_id", "ts"]]
        pdf["flag"] = rng.integers(0, 2, len(pdf)).astype("int32")
        hour = pdf.groupby("asset_id").cumcount().to_numpy()
        batch = np.minimum((hour + rng.integers(0, 5, len(pdf))) // 30, 3)
        src, out, state = (fresh_dir(spark, n) for n in ("flags", "alerts", "state"))
        for b in range(4):
            spark.createDataFrame(pdf[batch == b].sample(frac=1, random_state=b), schema).coalesce(1).write.mode("append").parquet(src)
            drain(ordered_alerts_stream(stream_readings(spark, src, schema), late="6 hours"), out, state)
        land_end_marker(spark, src, pdf["ts"].max().to_pydatetime(), schema, timedelta(hours=6))
        drain(ordered_alerts_stream(stream_readings(spark, src, schema), late="6 hours"), out, state)
    finally:
        spark.conf.unset(key)
    got = spark.read.parquet(out).toPandas().sort_values(["asset_id", "ts"], ignore_index=True)
    want = smooth_alerts(spark.createDataFrame(pdf, schema), "flag").toPandas().sort_values(["asset_id", "ts"], ignore_index=True)
    assert len(got) == len(pdf) and (got["ts"] == want["ts"]).all() and (got["alert"] == want["alert"]).all()
