"""Readings to the classified hourly panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridpulse.catalog import MECHANICAL, SIGNALS
from gridpulse.operators.clean import impute, nullify_implausible
from gridpulse.operators.panel import consolidate, hourly_buckets, raw_panel, signal_of
from gridpulse.operators.rules import classify
from gridpulse.operators.series import HOURLY, Series
from gridpulse.functions.columns import float_text_to_double
from gridpulse.sources.bronze import drop_invalid_time, time_column
from gridpulse.sources.store import materialize


def buckets_table(readings: DataFrame, tags: list[str] = SIGNALS, decimals: int | None = None) -> DataFrame:
    """The only step that touches raw readings; the result is orders of magnitude smaller and is written once."""
    return materialize(hourly_buckets(readings.where(F.col("tag").isin(list(tags))), decimals=decimals), "buckets")


def panel_table(buckets: DataFrame, tags: list[str] = SIGNALS, max_days: float | None = None) -> DataFrame:
    return materialize(raw_panel(buckets, tags, max_days), "panel")


def clean_panel(panel: DataFrame, tags: list[str] = SIGNALS, s: Series = HOURLY) -> DataFrame:
    """Consolidation fill, plausibility, final fill. Written in between: each fill reads its input in two branches."""
    plausible = materialize(nullify_implausible(consolidate(panel, tags, s), tags), "plausible")
    return impute(plausible, tags, s)


def silver(readings: DataFrame, tags: list[str] = SIGNALS, decimals: int | None = None,
           max_days: float | None = None, s: Series = HOURLY) -> DataFrame:
    panel = panel_table(buckets_table(readings, tags, decimals), tags, max_days)
    return classify(clean_panel(panel, tags, s))


CHANNELS = 3  # numbers, texts that read as numbers, booleans


def bronze_buckets(bronze: DataFrame, tags: list[str] = SIGNALS, decimals: int | None = None) -> DataFrame:
    """Bronze rows to hourly buckets, raw data scanned once.

    Every reading counts in each of the three value channels; the channel of a tag (numbers if it has any, else texts,
    else booleans) is chosen from the written buckets, which are small. Rows without a valid time are left out.
    """
    t = time_column(bronze)
    text = F.when(float_text_to_double(F.col("value_text")).isNotNull(), F.col("value_text").try_cast("double"))
    values = F.array(F.col("value"), text, F.col("value_bool").cast("int").cast("double"))
    named = drop_invalid_time(bronze).withColumn("tag", signal_of(F.col("tag"))).where(F.col("tag").isin(list(tags)))
    long = named.select("asset_id", "tag", F.col(t).alias("ts"), F.posexplode(values).alias("channel", "value"))
    joint = F.concat_ws("|", "channel", "tag")
    last = [f"{c}|{m}" for c in range(CHANNELS) for m in MECHANICAL]
    counted = materialize(hourly_buckets(long.withColumn("tag", joint), last, decimals), "channel-buckets").withColumns(
        {"channel": F.substring_index("tag", "|", 1).cast("int"), "tag": F.substring_index("tag", "|", -1)})
    used = counted.groupBy("asset_id", "tag").agg(
        F.coalesce(F.min(F.when(F.col("value").isNotNull() & (F.col("channel") < CHANNELS - 1), F.col("channel"))), F.lit(CHANNELS - 1)).alias("channel"))
    return counted.join(used, ["asset_id", "tag", "channel"]).drop("channel")


def silver_from_bronze(bronze: DataFrame, tags: list[str] = SIGNALS, decimals: int | None = None,
                       max_days: float | None = None, s: Series = HOURLY) -> DataFrame:
    """Stored historian readings to the classified hourly panel."""
    buckets = materialize(bronze_buckets(bronze, tags, decimals), "buckets")
    return classify(clean_panel(panel_table(buckets, tags, max_days), tags, s))
