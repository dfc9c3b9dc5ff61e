"""Streaming forms of three batch operators: resumable ingest, hourly means, smoothed alerts."""

from __future__ import annotations

from datetime import datetime, timedelta
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from gridpulse.catalog import DEFAULT_PARAMS
from gridpulse.sources.bronze import append_once


def stream_readings(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", **options) -> DataFrame:
    """Readings as files arrive; the query's checkpoint takes the place of the high-water mark."""
    reader = spark.readStream.format(fmt).schema(schema)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(path)


def append_stream(readings: DataFrame, table: str, checkpoint: str, marks: str | None = None):
    """Typed rows appended to the Bronze layout; restarting with the same checkpoint continues where it stopped.

    Each micro-batch is written by `bronze.append_once` under the name of the query and its number, so a batch that is run
    again after a failure replaces what it wrote before and adds neither rows nor files. With `marks`, the newest
    reading of each tag is kept beside the table.
    """

    def commit(batch: DataFrame, number: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        append_once(batch, table, f"{query}-{number:09d}", marks)

    return readings.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_mean_stream(readings: DataFrame, late: str = "2 hours") -> DataFrame:
    """Mean per asset, tag and hour; an hour is final once the watermark has passed its end.

    A row without asset and tag is an end marker (`land_end_marker`): it only moves the watermark.
    """
    return (
        readings.withWatermark("ts", late)
        .groupBy("asset_id", "tag", F.window("ts", "1 hour"))
        # counted, as a filter on the keys would be moved before the watermark and keep the marker from it
        .agg(F.avg("value").alias("value"), F.count_if(F.col("asset_id").isNotNull() | F.col("tag").isNotNull()).alias("n"))
        .where("n > 0")
        .select("asset_id", "tag", F.col("window.start").alias("ts"), "value")
    )


def land_end_marker(spark: SparkSession, path: str, last: datetime, schema: str, late: timedelta = timedelta(hours=2), fmt: str = "parquet") -> None:
    """Land the end of the input: one row so late that the watermark closes the hour of `last` and all before it.

    Hours are closed once: rows that arrive after the marker for an hour before it are late and left out.
    """
    at = last + late + timedelta(hours=2)
    spark.createDataFrame([(at,)], "ts timestamp").select(
        *[(F.col("ts") if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)]
    ).coalesce(1).write.format(fmt).mode("append").save(path)


def smooth_alerts_stream(flags: DataFrame, k: int = DEFAULT_PARAMS.smooth_k, m: int = DEFAULT_PARAMS.smooth_m) -> DataFrame:
    """(asset_id, ts, flag) to (asset_id, ts, flag, alert). The state of an asset is its last m flags.

    Rows of one asset must arrive in time order between batches; inside a batch they are sorted here. A micro-batch is
    what an asset holds in memory: bound it with `maxFilesPerTrigger` or `maxBytesPerTrigger` on the reader.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = np.array(state.get[0] if state.exists else [], dtype=np.int64)
        parts = list(batches)
        ts, flag = (np.concatenate([p[c].to_numpy() for p in parts]) for c in ("ts", "flag"))
        order = np.argsort(ts, kind="stable")
        flags = np.concatenate([recent, flag[order].astype(np.int64)])
        total = np.concatenate([[0], np.cumsum(flags)])
        end = np.arange(len(recent), len(flags)) + 1
        alerts = total[end] - total[np.maximum(end - m, 0)] >= k
        state.update((flags[-m:].tolist(),))
        yield pd.DataFrame({"asset_id": key[0], "ts": ts[order], "flag": flag[order].astype("int32"), "alert": alerts.astype("int32")})

    return flags.groupBy("asset_id").applyInPandasWithState(
        step, "asset_id long, ts timestamp, flag int, alert int", "recent array<int>", "append", GroupStateTimeout.NoTimeout
    )


class _OrderedAlerts(StatefulProcessor):
    """Holds an asset's rows until the watermark has passed them, then decides them in time order."""

    def __init__(self, k: int, m: int):
        self.k, self.m = k, m

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts timestamp, flag int")
        self.recent = handle.getValueState("recent", "flags array<int>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            pdf = pdf[pdf["flag"].notna()]
            if key[0] is None or not len(pdf):
                continue
            self.waiting.appendList(list(zip(pdf["ts"].dt.to_pydatetime(), pdf["flag"].astype(int).tolist())))
            self.handle.registerTimer(int(pdf["ts"].min().timestamp() * 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms")
        held = sorted((pd.Timestamp(ts).tz_localize(None), flag) for ts, flag in self.waiting.get())
        ready, rest = [r for r in held if r[0] <= now], [r for r in held if r[0] > now]
        if not ready:
            return iter(())
        self.waiting.clear()
        if rest:
            self.waiting.put([(ts.to_pydatetime(), flag) for ts, flag in rest])
            self.handle.registerTimer(int(rest[0][0].timestamp() * 1000))
        before = list(self.recent.get()[0]) if self.recent.exists() else []
        flags = np.array(before + [flag for _, flag in ready], dtype=np.int64)
        total = np.concatenate([[0], np.cumsum(flags)])
        end = np.arange(len(before), len(flags)) + 1
        alerts = total[end] - total[np.maximum(end - self.m, 0)] >= self.k
        self.recent.update((flags[-self.m :].tolist(),))
        out = pd.DataFrame({"asset_id": key[0], "ts": [ts for ts, _ in ready], "flag": flags[len(before):].astype("int32"), "alert": alerts.astype("int32")})
        return iter([out])

    def close(self) -> None:
        pass


def ordered_alerts_stream(flags: DataFrame, k: int = DEFAULT_PARAMS.smooth_k, m: int = DEFAULT_PARAMS.smooth_m, late: str = "2 hours") -> DataFrame:
    """`smooth_alerts_stream` for rows that come late: a row is decided once the watermark has passed it.

    Rows up to `late` behind are put in order; later ones are left out by the watermark. The state of an asset is its last m
    flags and the rows not yet passed; what arrives is stored batch by batch. An end marker decides what still waits. Needs
    the RocksDB state store (`spark.sql.streaming.stateStore.providerClass`).
    """
    return flags.withWatermark("ts", late).groupBy("asset_id").transformWithStateInPandas(
        _OrderedAlerts(k, m), "asset_id long, ts timestamp, flag int, alert int", "Append", "EventTime")


def drain(df: DataFrame, path: str, checkpoint: str):
    """Run over what is there and stop; results are files, not driver memory."""
    q = (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return q
