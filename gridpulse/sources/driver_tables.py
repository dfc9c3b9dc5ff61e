"""Adapter from the generic event table to sensor readings (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridpulse.session import use_utc

PANEL_DECIMALS = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def event_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> (asset_id, tag, ts, value): each event carries one or two readings."""
    ev = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 4).alias("asset_id"),
        F.col("event_type").alias("kind"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("v"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
    )
    v, k = F.col("v"), F.col("k")
    from_value = {
        "view": ("temp_oil_value", 20 + v * 0.8),
        "click": ("temp_spot_hot_value", 30 + v),
        "error": ("temp_ambient_value", v * 0.5),
        "purchase": ("current_load_value", v * 25),
        "signup": ("tap_position_value", F.least(F.floor(v / 5), F.lit(20)).cast("double")),
    }
    from_k = {
        "view": ("temp_oil_oltc_value", 20 + k * 0.5),
        "click": ("temp_bubbling_value", 100 + k),
        "error": ("voltage_value", 120 + k / 5.0),
        "purchase": ("power_apparent_value", k / 2.0),
    }

    def pick(mapping):
        tag = F.lit(None).cast("string")
        val = F.lit(None).cast("double")
        for kind, (name, expr) in mapping.items():
            tag = F.when(F.col("kind") == kind, F.lit(name)).otherwise(tag)
            val = F.when(F.col("kind") == kind, expr).otherwise(val)
        return F.struct(tag.alias("tag"), val.alias("value"))

    return (
        ev.select("asset_id", "ts", F.explode(F.array(pick(from_value), pick(from_k))).alias("r"))
        .select("asset_id", "r.tag", "ts", "r.value")
        .where(F.col("tag").isNotNull())
    )
