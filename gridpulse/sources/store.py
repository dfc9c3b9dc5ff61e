"""Intermediate tables in the cluster's shared folder.

Used where a result feeds several branches: it is written once as Parquet and read back, which cuts the lineage and
survives the loss of executors.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from gridpulse.session import fresh_dir

_written: dict[tuple, str] = {}


def materialize(df: DataFrame, label: str, partition_by: list[str] = ()) -> DataFrame:
    """Write df to a new folder and return a DataFrame reading it."""
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
    return spark.read.parquet(path)


def once(spark: SparkSession, key: tuple, build: Callable[[], DataFrame]) -> DataFrame:
    """Build and write a derived table the first time it is asked for in this application; read it afterwards."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _written:
        path = fresh_dir(spark, "-".join(str(k) for k in key[1:] if "/" not in str(k)))
        build().write.mode("errorifexists").parquet(path)
        _written[key] = path
    return spark.read.parquet(_written[key])
