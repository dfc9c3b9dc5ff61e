"""The Bronze table: typed, append-only readings partitioned by tag and date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType, TimestampType

from gridpulse.functions.columns import not_nan
from gridpulse.functions.joins import attach_by_key
from gridpulse.sources.landing import with_date_partition

BRONZE_SCHEMA = StructType(
    [
        StructField("timestamp", TimestampType()),
        StructField("value", DoubleType()),
        StructField("value_text", StringType()),
        StructField("value_bool", BooleanType()),
        StructField("tag", StringType()),
    ]
)


def conform(df: DataFrame) -> DataFrame:
    """Cast to the declared types without dropping rows; absent channels become NULL columns."""
    exprs = []
    for f in BRONZE_SCHEMA:
        kind = f.dataType.simpleString()
        if f.name not in df.columns:
            exprs.append(F.lit(None).cast(kind).alias(f.name))
        elif kind == "timestamp" and dict(df.dtypes)[f.name] == "string":
            exprs.append(F.try_to_timestamp(F.col(f.name)).alias(f.name))
        else:
            x = F.col(f.name).try_cast(kind)
            exprs.append((not_nan(x) if kind == "double" else x).alias(f.name))
    rest = [c for c in df.columns if c not in BRONZE_SCHEMA.names and c != "date"]
    return with_date_partition(df.select(*rest, *exprs))


def append(df: DataFrame, path: str, fmt: str = "parquet", max_rows_per_file: int = 5_000_000) -> None:
    """Append partitioned by tag and date.

    Rows are rebalanced by partition value: adaptive execution merges small partitions, so a directory gets few files,
    and splits a very large one, so a tag with very many rows is still written by many tasks.
    """
    (
        conform(df)
        .hint("rebalance", "tag", "date")
        .write.format(fmt)
        .mode("append")
        .option("maxRecordsPerFile", max_rows_per_file)
        .partitionBy("tag", "date")
        .save(path)
    )


def append_once(df: DataFrame, path: str, batch: str, marks: str | None = None) -> None:
    """Append the rows of one batch, once: the same batch written again takes the place of what it wrote before.

    The batch is the innermost partition, so only its own directories are replaced. Rows are rebalanced as in `append`.
    With `marks`, a folder, the batch's newest reading per asset and tag is kept there as well.
    """
    rows = conform(df).withColumn("batch", F.lit(batch))
    _replace(rows.hint("rebalance", "tag", "date"), path, ["tag", "date", "batch"])
    if marks:
        keys = [k for k in ("asset_id", "tag") if k in rows.columns]
        _replace(exact_marks(rows, keys).withColumn("batch", F.lit(batch)), marks, ["batch"])


def _replace(df: DataFrame, path: str, by: list[str]) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def stored_marks(spark: SparkSession, marks: str, keys: list[str] = ("asset_id", "tag"), exact: bool = True) -> DataFrame:
    """Newest reading per tag from the marks kept at append time; no reading is looked at.

    exact=False floors to the second, as `high_water_marks` does.
    """
    newest = spark.read.parquet(marks).groupBy(*keys).agg(F.max("mark").alias("mark"))
    return newest if exact else newest.withColumn("mark", F.date_trunc("second", "mark"))


def compact_marks(spark: SparkSession, marks: str, into: str, keys: list[str] = ("asset_id", "tag")) -> None:
    """One row per tag in a new folder, for marks of very many batches."""
    _replace(stored_marks(spark, marks, keys).withColumn("batch", F.lit("compacted")), into, ["batch"])


def wrong_marks(table: DataFrame, marks: DataFrame, keys: list[str] = ("asset_id", "tag")) -> DataFrame:
    """(keys, mark, newest) where stored marks and the stored readings disagree, found by scanning the readings."""
    newest = exact_marks(table, keys).withColumnRenamed("mark", "newest")
    both = marks.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    joined = both.join(newest, same, "full").where(~F.col("mark").eqNullSafe(F.col("newest")))
    return joined.select(*[F.coalesce(k, f"__{k}").alias(k) for k in keys], "mark", "newest")


def read(spark: SparkSession, path: str, tags: list[str] | None = None, fmt: str = "parquet") -> DataFrame:
    """Scan with merged schema; a tag list becomes a partition filter."""
    df = spark.read.format(fmt).option("mergeSchema", True).load(path)
    return df.where(F.col("tag").isin(list(tags))) if tags is not None else df


def time_column(df: DataFrame) -> str:
    for name in ("timestamp", "ts"):
        if name in df.columns:
            return name
    raise ValueError("no time column: expected 'timestamp' or 'ts'")


def distinct_tags(df: DataFrame) -> DataFrame:
    return df.where(F.col("tag").isNotNull()).select("tag").distinct()


def keep_tags(df: DataFrame, allowed: list[str]) -> DataFrame:
    return df.where(F.col("tag").isin(list(allowed)))


def invalid_time_report(df: DataFrame) -> DataFrame:
    t = time_column(df)
    return df.groupBy("tag").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col(t).isNull()).alias("invalid_timestamps")
    )


def drop_invalid_time(df: DataFrame) -> DataFrame:
    return df.where(F.col(time_column(df)).isNotNull())


def high_water_marks(df: DataFrame, keys: list[str] = ("asset_id", "tag")) -> DataFrame:
    """Newest valid reading per tag, floored to the second."""
    t = time_column(df)
    return (
        df.where(F.col(t).isNotNull())
        .groupBy(*keys)
        .agg(F.date_trunc("second", F.max(t)).alias("mark"))
    )


def exact_marks(df: DataFrame, keys: list[str] = ("asset_id", "tag")) -> DataFrame:
    """Newest valid reading per tag to the microsecond, for resuming without losing readings inside a second."""
    t = time_column(df)
    return df.where(F.col(t).isNotNull()).groupBy(*keys).agg(F.max(t).alias("mark"))


def resume(new: DataFrame, marks: DataFrame, start: Column, keys: list[str] = ("asset_id", "tag"),
           exact: bool = True) -> DataFrame:
    """Rows not yet stored: after the tag's mark, or from `start` for a tag without one.

    exact=True resumes strictly after the mark; exact=False keeps the historian's rule of one second after it.
    """
    t = F.col(time_column(new))
    d = attach_by_key(new, marks, list(keys))
    later = t > F.col("mark") if exact else t >= F.col("mark") + F.expr("interval 1 second")
    return d.where(F.coalesce(later, t >= start)).drop("mark")


def unify_value(df: DataFrame, keys: list[str] = ("asset_id", "tag")) -> DataFrame:
    """One numeric value per row; which channel is used is decided per tag, not per row.

    Numbers if the tag has any, else texts that parse, else booleans as 0/1. The decision is one small row per tag,
    aggregated map-side and attached by key, so a tag owning most rows does not end up in one task.
    """
    from gridpulse.functions.columns import float_text_to_double

    text = F.col("value_text").try_cast("double")
    text = F.when(float_text_to_double(F.col("value_text")).isNotNull(), text)
    choice = df.groupBy(*keys).agg(
        F.count("value").alias("__numbers"), F.count(text).alias("__texts")
    )
    d = attach_by_key(df, choice, list(keys))
    unified = (
        F.when(F.col("__numbers") > 0, F.col("value"))
        .when(F.col("__texts") > 0, text)
        .otherwise(F.col("value_bool").cast("int").cast("double"))
    )
    return d.withColumn("value", unified).drop("__numbers", "__texts", "value_text", "value_bool")


def combine_batches(first: DataFrame, *others: DataFrame) -> DataFrame:
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first
