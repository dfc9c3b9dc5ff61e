"""Landed historian files and the polymorphic values inside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridpulse.catalog import TAG_POINTS
from gridpulse.functions.columns import float_text_to_double, not_nan, number_text
from gridpulse.functions.joins import attach_bounded

ITEM_SCHEMA = "Items array<struct<Timestamp:string,Value:variant>>"


def read_items(spark: SparkSession, path: str, partitions: str = "asset_id long, tag string",
               page_per_file: bool = True) -> DataFrame:
    """Pages of recorded items under .../asset_id=../tag=../*.json as rows (asset_id, tag, timestamp, value variant).

    A page is one JSON document. The historian bounds its size, so a file per page is a sensible unit of work; files
    with one page per line can be split further.
    """
    pages = spark.read.schema(f"{ITEM_SCHEMA}, {partitions}").option("multiLine", page_per_file).json(path)
    keys = [c for c in pages.columns if c != "Items"]
    return pages.select(*keys, F.explode("Items").alias("i")).select(
        *keys, F.col("i.Timestamp").alias("timestamp"), F.col("i.Value").alias("value")
    )


def split_value(value: Column) -> dict[str, Column]:
    """Numeric, text and boolean channel of a variant.

    Objects (errors, no data) and nulls leave all three empty; booleans have text and boolean; numbers and texts keep
    their text, and texts that read as a number, with dot or decimal comma, also have the number.
    """
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    is_bool = kind == "BOOLEAN"
    is_text = kind == "STRING"
    is_number = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    as_bool = F.when(is_bool, F.try_variant_get(value, "$", "boolean"))
    number = F.when(is_number, F.try_variant_get(value, "$", "double")).when(is_text, float_text_to_double(text))
    return {
        "value": not_nan(number),
        "value_text": F.when(is_bool, F.initcap(as_bool.cast("string")))
        .when(is_number & (kind != "BIGINT"), number_text(number))
        .when(is_number | is_text | kind.startswith("ARRAY"), text),
        "value_bool": as_bool,
    }


def to_bronze_rows(items: DataFrame) -> DataFrame:
    """Items to the Bronze shape; no row is dropped, an unreadable timestamp becomes NULL."""
    channels = split_value(F.col("value"))
    return with_date_partition(
        items.select(
            "asset_id",
            F.try_to_timestamp(F.col("timestamp").cast("string")).alias("timestamp"),
            *[e.alias(n) for n, e in channels.items()],
            F.col("tag").cast("string").alias("tag"),
        )
    )


def with_date_partition(df: DataFrame, time: str = "timestamp") -> DataFrame:
    return df.withColumn("date", F.coalesce(F.date_format(time, "yyyy-MM-dd"), F.lit("__missing__")))


def load_windows(spans: DataFrame, days: int = 15) -> DataFrame:
    """Split each (start, end) row into load windows of at most `days`; the next starts a second after the last end."""
    step = f"interval {days} days 1 second"
    starts = F.expr(f"sequence(start, greatest(start, end - interval 1 microsecond), {step})")
    keys = [c for c in spans.columns if c not in ("start", "end")]
    return (
        spans.where(F.col("start") < F.col("end"))
        .select(*keys, F.explode(starts).alias("window_start"), "end")
        .select(
            *keys, "window_start", F.least(F.col("window_start") + F.expr(f"interval {days} days"), "end").alias("window_end")
        )
    )


def tag_catalogue(spark: SparkSession, prefix: str = "TR1") -> DataFrame:
    """alias, source path: a fixed table of under a hundred rows."""
    return spark.createDataFrame(
        [(alias, f"{prefix}.{point}") for alias, point in TAG_POINTS.items()], "tag string, source_path string"
    )


def with_source_path(df: DataFrame, prefix: str = "TR1") -> DataFrame:
    return attach_bounded(df, tag_catalogue(df.sparkSession, prefix), ["tag"])
