"""From the Gold panel to a modelling dataset: split, column choice, types, feature groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from gridpulse.catalog import DEFAULT_PARAMS, LABEL_COLUMNS, LEAK_COLUMNS, SIGNALS, STATE_COLUMNS, Params
from gridpulse.operators.features import ELECTRICAL_FEATURES, THERMAL_FEATURES
from gridpulse.operators.ranking import distinct_counts, split_position, value_at_rank
from gridpulse.operators.rules import numeric_columns
from gridpulse.operators.series import HOURLY, Series, with_position

TRAIN, VALIDATION = "train", "validation"


def temporal_split(df: DataFrame, ratio: float = DEFAULT_PARAMS.split_ratio, s: Series = HOURLY) -> DataFrame:
    """Add `split`: the first floor(n * ratio) rows of each series are for training."""
    d = with_position(df, s, "__pos", length="__len")
    train = F.col("__pos") < F.floor(F.col("__len") * F.lit(float(ratio)))
    return d.withColumn("split", F.when(train, TRAIN).otherwise(VALIDATION)).drop("__pos", "__len")


def fleet_cut(df: DataFrame, ratio: float = DEFAULT_PARAMS.split_ratio, s: Series = HOURLY) -> DataFrame:
    """One row: the time at which `ratio` of all rows of the fleet lie before."""
    times = df.select(F.unix_micros(F.col(s.time)).alias("us"))
    cut = value_at_rank(times, "us", split_position(df.count(), ratio))
    return cut.select(F.timestamp_micros("us").alias("cut"))


def split_at(df: DataFrame, cut: DataFrame, s: Series = HOURLY) -> DataFrame:
    """Split the whole fleet at one time; `cut` is a single row, as made by fleet_cut."""
    micros = cut.select(F.unix_micros("cut")).first()[0]
    return df.withColumn("split", F.when(F.col(s.time) < F.timestamp_micros(F.lit(micros)), TRAIN).otherwise(VALIDATION))


def split_summary(df: DataFrame, s: Series = HOURLY, label: str = "falla_30d") -> DataFrame:
    """Rows, share, period and failure rate of each part."""
    out = df.groupBy("split").agg(
        F.count(F.lit(1)).alias("registros"),
        F.min(s.time).alias("desde"),
        F.max(s.time).alias("hasta"),
        *([F.avg(F.col(label).cast("double")).alias("tasa_fallas")] if label in df.columns else []),
    )
    both_parts = Window.partitionBy(F.lit(1))  # two rows
    return out.withColumn("proporcion", F.col("registros") / F.sum("registros").over(both_parts))


def final_label_stats(df: DataFrame) -> DataFrame:
    return df.agg(
        F.avg(F.col("falla_30d").cast("double")).alias("tasa_positivos"),
        F.avg("rul_dias").alias("rul_medio"),
        F.min("rul_dias").alias("rul_min"),
        F.max("rul_dias").alias("rul_max"),
        F.avg("severidad_futura").alias("severidad_media"),
    )


# ---- column choice ----------------------------------------------------------------------------------------------

def column_profile(df: DataFrame, cols: list[str] | None = None, exact_distinct: bool = True) -> DataFrame:
    """(column, null_ratio, min, max, distinct_values, keep_model): what the column choice is based on."""
    cols = cols or [c for c in numeric_columns(df) if c not in LEAK_COLUMNS]
    stats = []
    for c in cols:
        x = F.col(c).cast("double")
        stats.append(
            F.struct(
                F.lit(c).alias("column"),
                F.avg(x.isNull().cast("double")).alias("null_ratio"),
                F.min(x).alias("min"),
                F.max(x).alias("max"),
            )
        )
    d = df.agg(F.array(*stats).alias("a")).select(F.inline("a"))
    if exact_distinct:
        counts = distinct_counts(df, cols)
        d = d.join(counts, "column", "left").withColumn("distinct_values", F.coalesce("distinct_values", F.lit(0)))
    varies = F.coalesce(F.col("min") < F.col("max"), F.lit(False))
    return d.withColumn("keep_model", varies & (F.col("null_ratio") <= DEFAULT_PARAMS.max_null_ratio))


def select_columns(df: DataFrame, p: Params = DEFAULT_PARAMS) -> list[str]:
    """Numeric, not a label or state, not constant, at most 30% missing; in schema order. One aggregation pass."""
    cols = [c for c in numeric_columns(df) if c not in LEAK_COLUMNS]
    kept = {r["column"] for r in column_profile(df, cols, exact_distinct=False).where("keep_model").collect()}
    return [c for c in cols if c in kept]


def align_columns(df: DataFrame, order: list[str], keep: tuple = ("asset_id", "ts")) -> DataFrame:
    """Model input in the model's column order; absent features are NULL."""
    have = set(df.columns)
    return df.select(
        *[c for c in keep if c in have],
        *[F.col(c).cast("double").alias(c) if c in have else F.lit(None).cast("double").alias(c) for c in order],
    )


# ---- types ------------------------------------------------------------------------------------------------------

def downcast_bounds(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, min, max, type): narrowest type that holds the observed values, from one pass over the data."""
    kinds = dict(df.dtypes)
    cols = cols or [c for c in df.columns if kinds[c] in ("double", "bigint")]
    stats = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.lit(kinds[c]).alias("from_type"),
                F.min(c).cast("double").alias("min"),
                F.max(c).cast("double").alias("max"),
            )
            for c in cols
        ]
    )
    lo, hi = F.col("min"), F.col("max")
    is_double = F.col("from_type") == "double"
    narrow = (F.abs(lo) < 1e37) & (F.abs(hi) < 1e37)
    to = (
        F.when(lo.isNull(), F.col("from_type"))
        .when(is_double & narrow, F.lit("float"))
        .when(is_double, F.lit("double"))
        .when((lo >= -128) & (hi <= 127), F.lit("tinyint"))
        .when((lo >= -32768) & (hi <= 32767), F.lit("smallint"))
        .when((lo >= -(2**31)) & (hi < 2**31), F.lit("int"))
        .otherwise(F.lit("bigint"))
    )
    return df.agg(stats.alias("a")).select(F.inline("a")).withColumn("to_type", to)


def downcast(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Cast to the types found by downcast_bounds (one small row per column is fetched)."""
    plan = {r["column"]: r["to_type"] for r in downcast_bounds(df, cols).collect()}
    return df.withColumns({c: F.col(c).cast(t) for c, t in plan.items()})


def feature_groups(df: DataFrame) -> DataFrame:
    """(position, column, grupo) for the documentation of the dataset."""
    groups = {
        "Variables Originales": SIGNALS + STATE_COLUMNS,
        "Features Térmicos": THERMAL_FEATURES,
        "Features Eléctricos": ELECTRICAL_FEATURES,
        "Etiquetas de Predicción": LABEL_COLUMNS,
    }
    where = {c: g for g, cols in groups.items() for c in cols}
    rows = [(i, c, where.get(c, "Otros Features")) for i, c in enumerate(df.columns) if c not in ("asset_id", "ts")]
    return df.sparkSession.createDataFrame(rows, "position int, column string, grupo string")
