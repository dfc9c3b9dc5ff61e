"""Registry of the checked queries and the derived tables they share."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridpulse.catalog import SIGNALS
from gridpulse.functions.columns import fixed
from gridpulse.operators.rules import classify
from gridpulse.operators.panel import hourly_buckets, raw_panel
from gridpulse.plans.silver import clean_panel
from gridpulse.sources.driver_tables import PANEL_DECIMALS, event_readings
from gridpulse.sources.store import once

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: comparable(fn(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def comparable(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, times without zone, as the SQL side states them."""
    out = []
    for c, t in df.dtypes:
        x = F.col(f"`{c}`")
        out.append((fixed(x) if t == "double" else x.cast("timestamp_ntz") if t == "timestamp" else x).alias(c))
    return df.select(*out)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_readings(spark, sf_dir)


def buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly reduction of all readings, written once per application."""
    return once(spark, ("buckets", sf_dir), lambda: hourly_buckets(readings(spark, sf_dir), decimals=PANEL_DECIMALS))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, ("panel", sf_dir), lambda: raw_panel(buckets(spark, sf_dir)))


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap-free panel, values at six decimals so both engines start features from equal numbers."""
    def make():
        d = clean_panel(panel(spark, sf_dir))
        return d.select("asset_id", "ts", *[fixed(F.col(c), PANEL_DECIMALS).alias(c) for c in SIGNALS])

    return once(spark, ("clean", sf_dir), make)


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(clean(spark, sf_dir))
