"""Physical plausibility checks, completeness and documentation tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from gridpulse.catalog import OPERATING, REPORT_CATEGORIES, DEFAULT_PARAMS, Params
from gridpulse.functions.columns import ratio
from gridpulse.operators.clean import _null_counts
from gridpulse.operators.series import HOURLY, Series, fill_across

HOT, OIL, CURRENT, POWER = "temp_spot_hot_value", "temp_oil_value", "current_load_value", "power_apparent_value"


def thermal_coherence(df: DataFrame, p: Params = DEFAULT_PARAMS) -> DataFrame:
    """Share of rows with hot spot at or above oil, mean and maximum gradient, and whether they raise an alert."""
    both = df.where(F.col(HOT).isNotNull() & F.col(OIL).isNotNull())
    gap = F.col(HOT) - F.col(OIL)
    return both.agg(
        (F.avg((gap >= 0).cast("double")) * 100).alias("coherencia_termica"),
        F.avg(gap).alias("gradiente_medio"),
        F.max(gap).alias("gradiente_max"),
    ).withColumns(
        {
            "alerta_coherencia": F.coalesce(F.col("coherencia_termica") < 95.0, F.lit(False)),
            "alerta_gradiente": F.coalesce(F.col("gradiente_max") > p.gradient_limit, F.lit(False)),
        }
    )


def power_current_ratio(df: DataFrame) -> DataFrame:
    """Mean and variation (sample) of power per ampere under load."""
    r = ratio(F.col(POWER), F.col(CURRENT))
    loaded = df.where((F.col(CURRENT) > 10) & (F.col(POWER) > 1))
    return loaded.agg(F.count(F.lit(1)).alias("n"), F.avg(r).alias("ratio_medio"), F.stddev_samp(r).alias("__sd")).select(
        "n",
        "ratio_medio",
        F.when(F.col("ratio_medio") > 0, F.col("__sd") / F.col("ratio_medio"))
        .when(F.col("n") > 0, F.lit(0.0))
        .alias("variabilidad_ratio"),
    )


def operating_ranges(df: DataFrame, ranges: dict = OPERATING) -> DataFrame:
    """Percent of present values inside the operating range, one row per variable; one pass over the data."""
    cols = [c for c in ranges if c in df.columns]
    aggs = []
    for c in cols:
        lo, hi = ranges[c]
        aggs += [F.count(c).alias(f"{c}__n"), F.count_if(F.col(c).between(lo, hi)).alias(f"{c}__ok")]
    one = df.agg(*aggs)
    items = F.array(
        *[F.struct(F.lit(c).alias("variable"), F.col(f"{c}__n").alias("n"), F.col(f"{c}__ok").alias("ok")) for c in cols]
    )
    return (
        one.select(F.inline(items))
        .where(F.col("n") > 0)
        .withColumn("porcentaje_ok", F.col("ok") * 100.0 / F.col("n"))
        .withColumn("alerta", F.col("porcentaje_ok") < 90)
    )


def gaps(df: DataFrame, s: Series = HOURLY, limit_hours: float = 1.5) -> DataFrame:
    """Rows that follow their predecessor by more than the limit, with the gap length in hours.

    Works on panels with holes: the predecessor comes from the chunk or, at its start, from the carried last time.
    """
    d = fill_across(df.select(*s.keys, s.time), last={"__prev": F.unix_micros(F.col(s.time))}, s=s, strict=True)
    hours = (F.unix_micros(F.col(s.time)) - F.col("__prev")) / F.lit(3.6e9)
    return d.withColumn("gap_hours", hours).drop("__prev").where(F.col("gap_hours") > limit_hours)


def time_continuity(df: DataFrame, s: Series = HOURLY, by_asset: bool = True) -> DataFrame:
    """Number of gaps and percent of rows not preceded by one."""
    keys = list(s.keys) if by_asset else []
    marked = df.select(*keys, F.lit(0).alias("g")).unionByName(gaps(df, s).select(*keys, F.lit(1).alias("g")))
    d = marked.groupBy(*keys).agg(F.count_if(F.col("g") == 0).alias("registros"), F.count_if(F.col("g") == 1).alias("numero_gaps"))
    n = F.col("numero_gaps")
    return d.withColumns(
        {
            "continuidad_temporal": F.try_divide((F.col("registros") - n) * 100.0, F.col("registros")),
            "alerta": n > F.col("registros") * 0.05,
        }
    )


def validation_verdict(df: DataFrame, p: Params = DEFAULT_PARAMS, s: Series = HOURLY) -> DataFrame:
    """All checks folded into one row: verdict and list of alerts. Every input here is a one-row summary."""
    th = thermal_coherence(df, p).select(
        F.array_compact(
            F.array(
                F.when(F.col("alerta_coherencia"), F.lit("coherencia_termica")),
                F.when(F.col("alerta_gradiente"), F.lit("gradiente_termico")),
            )
        ).alias("a")
    )
    rg = operating_ranges(df).agg(
        F.sort_array(F.collect_list(F.when(F.col("alerta"), F.concat(F.lit("rango_"), F.col("variable"))))).alias("a")
    )
    ct = time_continuity(df, s, by_asset=False).select(
        F.array_compact(F.array(F.when(F.col("alerta"), F.lit("continuidad_temporal")))).alias("a")
    )
    every = reduce(DataFrame.unionByName, [th, rg, ct])
    return every.agg(F.sort_array(F.flatten(F.collect_list("a"))).alias("l")).select(
        F.when(F.size("l") > 0, "ADVERTENCIAS").otherwise("EXITOSO").alias("estado_validacion"),
        F.size("l").alias("numero_alertas"),
        F.array_join("l", ", ").alias("alertas"),
    )


def quality_report(before: DataFrame, after: DataFrame, cols: list[str]) -> DataFrame:
    """Completeness, missing values before and after filling, filled values and variables per category."""
    def totals(df, name):
        n = _null_counts(df, [c for c in cols if c in df.columns])
        return n.agg(F.sum("missing").alias(name), F.sum("total").alias(f"{name}_of"))

    def max_of_all(df):
        return df.agg(*[F.max(c).alias(c) for c in df.columns])

    per_cat = {
        k: sum(any(part in c.lower() for part in parts) for c in after.columns) for k, parts in REPORT_CATEGORIES.items()
    }
    # two one-row summaries laid over each other
    d = max_of_all(
        totals(before, "missing_original").unionByName(totals(after, "missing_final"), allowMissingColumns=True)
    )
    return d.select(
        "missing_original",
        (F.col("missing_original") - F.col("missing_final")).alias("interpolated"),
        "missing_final",
        F.col("missing_final_of").alias("total_valores"),
        (F.try_divide((F.col("missing_final_of") - F.col("missing_final")) * 100.0, F.col("missing_final_of"))).alias(
            "completitud_total"
        ),
        *[F.lit(n).alias(f"variables_{'termica electrica mecanica'.split()[i]}") for i, n in enumerate(per_cat.values())],
    )


def describe_dataset(df: DataFrame, cols: list[str], time: str = "ts") -> DataFrame:
    """Documentation table: per column its rows, missing values, minimum, maximum and mean, with the covered period."""
    parts = []
    for c in cols:
        x = F.col(c).cast("double")
        parts.append(
            F.struct(
                F.lit(c).alias("variable"),
                F.count(F.lit(1)).alias("registros"),
                F.count_if(F.col(c).isNull()).alias("faltantes"),
                F.min(x).alias("minimo"),
                F.max(x).alias("maximo"),
                F.avg(x).alias("media"),
                F.min(time).alias("desde"),
                F.max(time).alias("hasta"),
            )
        )
    return df.agg(F.array(*parts).alias("a")).select(F.inline("a"))
