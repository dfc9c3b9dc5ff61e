"""Silver and Gold tables, exports and snapshots."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridpulse.catalog import ALERT, CRITICAL


def with_year_month(df: DataFrame, time: str = "ts") -> DataFrame:
    return df.withColumns({"year": F.year(time).cast("int"), "month": F.month(time).cast("tinyint")})


def write_silver(df: DataFrame, path: str, fmt: str = "parquet", time: str = "ts") -> None:
    _write(with_year_month(df, time), path, fmt, ["year", "month"])


def write_gold(df: DataFrame, path: str, fmt: str = "parquet", time: str = "ts") -> None:
    """Train and validation rows in one table; the split column is a partition, so either part is a pruned read."""
    _write(with_year_month(df, time), path, fmt, ["split", "year", "month"])


def _write(df: DataFrame, path: str, fmt: str, parts: list[str]) -> None:
    # static overwrite: a rewritten table must not keep partitions of its former content
    (
        df.hint("rebalance", *parts)
        .write.format(fmt)
        .mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .partitionBy(*parts)
        .save(path)
    )


def read_gold(spark: SparkSession, path: str, split: str | None = None, fmt: str = "parquet") -> DataFrame:
    df = spark.read.format(fmt).load(path)
    return df.where(F.col("split") == split) if split else df


def read_first(spark: SparkSession, *paths: tuple[str, str]) -> DataFrame:
    """The first (format, path) that can be read; an error naming all of them when none can."""
    from pyspark.errors import AnalysisException

    for fmt, path in paths:
        try:
            return spark.read.format(fmt).load(path)
        except AnalysisException:
            continue
    raise FileNotFoundError(f"none of these tables can be read: {[p for _, p in paths]}")


def anomalies(spark: SparkSession, silver: DataFrame, path: str | None = None, fmt: str = "parquet") -> DataFrame | None:
    """The stored anomaly table, else the rows of Silver in alert or critical state, else nothing."""
    if path:
        try:
            return read_first(spark, (fmt, path))
        except FileNotFoundError:
            pass
    if "estado_operacional" not in silver.columns:
        return None
    return silver.where(F.col("estado_operacional").isin(ALERT, CRITICAL))


def export_snapshot(df: DataFrame, folder: str, stamp: str, csv: bool = True) -> dict[str, str]:
    """Complete, train and validation sets as Parquet, the complete set also as CSV, in time-stamped folders."""
    made = {"complete": f"{folder}/features_complete_{stamp}.parquet"}
    df.drop("split").write.mode("errorifexists").option("compression", "snappy").parquet(made["complete"])
    for part in ("train", "validation"):
        made[part] = f"{folder}/features_{part}_{stamp}.parquet"
        df.where(F.col("split") == part).drop("split").write.mode("errorifexists").parquet(made[part])
    if csv:
        made["csv"] = f"{folder}/features_complete_{stamp}.csv"
        df.drop("split").write.mode("errorifexists").option("header", True).csv(made["csv"])
    return made


def newest_snapshot(spark: SparkSession, folder: str, prefix: str = "features_complete_") -> DataFrame:
    """Newest exported complete set, CSV preferred over Parquet. Only file metadata is looked at to choose.

    A CSV takes its types from the Parquet export of the same stamp; without one all columns are text.
    """
    from pyspark.errors import AnalysisException

    def read_csv(path: str) -> DataFrame:
        reader = spark.read.option("header", True)
        try:
            reader = reader.schema(spark.read.parquet(path.removesuffix(".csv") + ".parquet").schema)
        except AnalysisException:
            pass
        return reader.csv(path)

    readers: list[tuple[str, Callable[[str], DataFrame]]] = [
        ("csv", read_csv),
        ("parquet", lambda p: spark.read.parquet(p)),
    ]
    for suffix, read in readers:
        pattern = f"{folder}/{prefix}*.{suffix}"
        try:
            files = (
                spark.read.format("binaryFile").option("recursiveFileLookup", True).load(pattern)
                .select("path", "modificationTime")
            )
            newest = files.agg(F.max_by("path", "modificationTime")).first()[0]
        except AnalysisException:
            continue
        if newest:
            return read(newest.rsplit("/", 1)[0])
    raise FileNotFoundError(f"no snapshot below {folder}")


def read_variables(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def variables_per_category(variables: DataFrame) -> DataFrame:
    return variables.groupBy("categoria_tecnica").agg(F.count("variable").alias("variables"))


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Small metric tables: thresholds, scaling values, evaluation rows, documentation."""
    df.write.mode("overwrite").format(fmt).save(path)
