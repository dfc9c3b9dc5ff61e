"""Readings to a gap-free hourly panel.

Readings are long: (asset_id, tag, ts, value). They are read once and reduced to one row per (asset, tag, hour) with
map-side partial aggregation; ranges, spine and pivot all work on that reduced table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridpulse.catalog import ELECTRICAL, MECHANICAL, SIGNAL_ALIASES, SIGNALS, THERMAL
from gridpulse.functions.columns import epoch_hour, fixed, hour_start, nearest_hour
from gridpulse.functions.joins import attach_by_key
from gridpulse.operators.clean import fill_edges, interpolate
from gridpulse.operators.series import HOURLY, Series


def signal_of(tag: Column) -> Column:
    """Panel signal of a historian alias; names that are no known alias pass through."""
    mapping = F.create_map(*[F.lit(x) for pair in SIGNAL_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(mapping, tag), tag)


def hourly_mean(readings: DataFrame) -> DataFrame:
    return _by_hour(readings).agg(F.avg("value").alias("value")).withColumn("ts", hour_start(F.col("hour"))).drop("hour")


def hourly_last(readings: DataFrame) -> DataFrame:
    """Last non-null value of each hour."""
    return (
        _by_hour(readings)
        .agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.col("ts"))).alias("value"))
        .withColumn("ts", hour_start(F.col("hour")))
        .drop("hour")
    )


def _by_hour(readings: DataFrame):
    return readings.groupBy("asset_id", "tag", epoch_hour(F.col("ts")).alias("hour"))


def hourly_buckets(readings: DataFrame, last_tags: list[str] = MECHANICAL, decimals: int | None = None) -> DataFrame:
    """One row per (asset, tag, hour): mean, or the last value for mechanical tags.

    Also keeps what range clipping needs: first and last reading time, and the value of readings taken exactly on
    the hour (the only part of the closing hour that lies inside a range ending on that hour).
    """
    on_hour = F.col("ts") == F.date_trunc("hour", F.col("ts"))
    is_last = F.col("tag").isin(list(last_tags))
    agg = _by_hour(readings).agg(
        F.avg("value").alias("mean"),
        F.max_by("value", F.when(F.col("value").isNotNull(), F.col("ts"))).alias("last"),
        F.avg(F.when(on_hour, F.col("value"))).alias("on_hour"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )

    def shown(x: Column) -> Column:
        return fixed(x, decimals) if decimals is not None else x

    return agg.select(
        "asset_id",
        "tag",
        "hour",
        shown(F.when(is_last, F.col("last")).otherwise(F.col("mean"))).alias("value"),
        shown(F.col("on_hour")).alias("on_hour"),
        "first_ts",
        "last_ts",
    )


def common_range(buckets: DataFrame, max_days: float | None = None) -> DataFrame:
    """Per asset: latest first reading and earliest last reading over its tags, each to the nearest hour."""
    per_tag = buckets.groupBy("asset_id", "tag").agg(F.min("first_ts").alias("lo"), F.max("last_ts").alias("hi"))
    out = per_tag.groupBy("asset_id").agg(
        nearest_hour(F.max("lo")).alias("lo_hour"), nearest_hour(F.min("hi")).alias("hi_hour")
    )
    if max_days and max_days > 0:
        out = out.withColumn("hi_hour", F.least("hi_hour", F.col("lo_hour") + int(max_days * 24 + 1e-9)))
    return out


def hourly_spine(ranges: DataFrame) -> DataFrame:
    """Every hour of each asset's range. Empty ranges (start after end) give no rows."""
    return ranges.where(F.col("lo_hour") <= F.col("hi_hour")).select(
        "asset_id", F.explode(F.sequence("lo_hour", "hi_hour")).alias("hour")
    )


def clip_to_range(buckets: DataFrame, ranges: DataFrame) -> DataFrame:
    """Keep the part of each bucket inside [start, end]; of the closing hour only its first instant counts."""
    d = attach_by_key(buckets, ranges, ["asset_id"])
    return (
        d.where(F.col("hour").between(F.col("lo_hour"), F.col("hi_hour")))
        .withColumn("value", F.when(F.col("hour") == F.col("hi_hour"), F.col("on_hour")).otherwise(F.col("value")))
        .select("asset_id", "tag", "hour", "value")
    )


def pivot_tags(buckets: DataFrame, tags: list[str]) -> DataFrame:
    """Long to wide with the tag list known up front, so no extra job collects it."""
    return buckets.groupBy("asset_id", "hour").agg(
        *[F.max(F.when(F.col("tag") == t, F.col("value"))).alias(t) for t in tags]
    )


def merge_series(left: DataFrame, right: DataFrame) -> DataFrame:
    """Full outer merge of two aligned per-tag frames on their time key."""
    return left.join(right, ["asset_id", "ts"], "full_outer")


def raw_panel(buckets: DataFrame, tags: list[str] = SIGNALS, max_days: float | None = None) -> DataFrame:
    """Hourly panel over the common range before any filling: (asset_id, ts, one column per tag).

    `buckets` is used three times; hand in a written table (see plans.silver) so readings are scanned only once.
    """
    buckets = buckets.where(F.col("tag").isin(list(tags)) & F.col("asset_id").isNotNull())
    ranges = common_range(buckets, max_days)
    wide = pivot_tags(clip_to_range(buckets, ranges), tags)
    return (
        hourly_spine(ranges)
        .join(wide, ["asset_id", "hour"], "left")
        .select("asset_id", hour_start(F.col("hour")).alias("ts"), *tags)
    )


def consolidate(panel: DataFrame, tags: list[str] = SIGNALS, s: Series = HOURLY) -> DataFrame:
    """Raw panel with the per-kind fill of the consolidation step.

    Thermal tags are interpolated in time, unknown tags linearly by position, the tap is carried forward, electrical
    tags keep their gaps. Values before a tag's first and after its last reading stay missing.
    """
    thermal = [t for t in tags if t in THERMAL]
    tap = [t for t in tags if t in MECHANICAL]
    other = [t for t in tags if t not in {*THERMAL, *ELECTRICAL, *MECHANICAL}]
    panel = fill_edges(panel, time=thermal, forward=tap, s=s)
    return interpolate(panel, other, by="position", edges="inside", s=s) if other else panel


def tag_profile(readings: DataFrame) -> DataFrame:
    """Rows, period, whole days, missing values and value range of each tag."""
    out = readings.groupBy("asset_id", "tag").agg(
        F.count(F.lit(1)).alias("registros"),
        F.min("ts").alias("fecha_inicio"),
        F.max("ts").alias("fecha_fin"),
        F.count_if(F.col("value").isNull()).alias("valores_nulos"),
        F.min("value").alias("valor_min"),
        F.max("value").alias("valor_max"),
        F.avg("value").alias("valor_medio"),
    )
    span = F.unix_micros("fecha_fin") - F.unix_micros("fecha_inicio")
    return out.withColumn("duracion_dias", F.floor(span / F.lit(8.64e10)).cast("long"))
