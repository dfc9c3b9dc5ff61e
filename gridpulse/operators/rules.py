"""Operating-state classification by technical rules, compiled to one set of column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridpulse.catalog import (
    ALERT, COMBINED_RULES, CRITICAL, GRADIENT_LIMIT, GRADIENT_TEXT, NORMAL, OVERLOAD_CURRENT, OVERLOAD_OIL,
    OVERLOAD_TEXT, RULES, Rule,
)
from gridpulse.functions.columns import any_of, flag, one_decimal
from gridpulse.operators.series import HOURLY, Series, over_chunks, rows

NOT_DATA = {"asset_id", "ts"}


def rule_columns(columns: list[str], variable: str) -> list[str]:
    """A rule applies to every column whose name contains all parts of the rule's name."""
    parts = variable.split("_")
    return [c for c in columns if all(p in c.lower() for p in parts)]


def _inside(x: Column, band: tuple) -> Column:
    return F.coalesce((x >= band[0]) & (x < band[1]), F.lit(False))


def _critical(x: Column, rule: Rule, bands: str) -> Column:
    if bands == "outside" and rule.variable == "tap_position_value":
        return F.coalesce(~((x >= rule.alert[0]) & (x < rule.alert[1])), F.lit(False)) & x.isNotNull()
    return _inside(x, rule.critical)


def _alert(x: Column, rule: Rule, bands: str) -> Column:
    if bands == "outside" and rule.variable == "tap_position_value":
        in_alert = _inside(x, rule.alert)
        return in_alert & ~_inside(x, rule.normal)
    return _inside(x, rule.alert)


def numeric_columns(df: DataFrame) -> list[str]:
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    return [c for c, t in df.dtypes if t.startswith(numeric) and c not in NOT_DATA]


def classify(df: DataFrame, rules: list[Rule] = RULES, bands: str = "parity") -> DataFrame:
    """Add estado_operacional, nivel_severidad, variables_anomalas and descripcion_anomalia.

    Rules are applied in order: a critical hit always counts, an alert only while no critical was seen before. The
    sequential rule folds into a closed form, so the result is a projection without any shuffle.
    bands="outside" reads the tap bands as nested ranges (critical outside of them) instead of the given intervals.
    """
    cols = numeric_columns(df)
    names, texts, criticals, alerts = [], [], [], []
    for rule in rules:
        for c in rule_columns(cols, rule.variable):
            crit = _critical(F.col(c), rule, bands)
            criticals.append(crit)
            alert = _alert(F.col(c), rule, bands) & ~any_of(criticals)
            alerts.append(alert)
            names.append(F.when(crit | alert, F.lit(c)))
            texts.append(F.when(crit, F.lit(f"{rule.description} CRÍTICO")).when(alert, F.lit(f"{rule.description} ALERTA")))

    currents = [c for c in cols if "current" in c.lower()]
    oils = [c for c in cols if "oil" in c.lower() and "temp" in c.lower()]
    hots = [c for c in cols if "hot" in c.lower()]
    overload = F.coalesce(
        any_of([(F.col(i) > OVERLOAD_CURRENT) & (F.col(o) > OVERLOAD_OIL) for i in currents for o in oils]), F.lit(False)
    )
    critical = any_of(criticals) | overload
    steep = [F.when(F.col(h) - F.col(o) > GRADIENT_LIMIT, F.col(h) - F.col(o)) for h in hots for o in oils]
    gradient = F.when(~critical, F.coalesce(*steep)) if steep else F.lit(None).cast("double")
    alert = any_of(alerts) | gradient.isNotNull()
    gradient_text = F.concat(F.lit(f"{GRADIENT_TEXT} ("), one_decimal(gradient), F.lit("°C)"))
    return df.withColumns(
        {
            "estado_operacional": F.when(critical, CRITICAL).when(alert, ALERT).otherwise(NORMAL),
            "nivel_severidad": F.when(critical, 2).when(alert, 1).otherwise(0),
            "variables_anomalas": F.concat_ws(", ", *names) if names else F.lit(""),
            "descripcion_anomalia": F.concat_ws(
                "; ",
                *texts,
                F.when(overload, F.lit(OVERLOAD_TEXT)),
                F.when(gradient.isNotNull(), gradient_text),
            ),
        }
    )


def rules_table(spark, rules: list[Rule] = RULES) -> DataFrame:
    """The rule set as rows: variable, band, min, max, description."""
    data = [
        (r.variable, band, float(lo), float(hi), r.description)
        for r in rules
        for band, (lo, hi) in (("normal", r.normal), ("alerta", r.alert), ("critico", r.critical))
    ]
    return spark.createDataFrame(data, "variable string, band string, min double, max double, descripcion string")


def combined_rules_table(spark) -> DataFrame:
    return spark.createDataFrame(
        COMBINED_RULES, "regla string, variables string, condicion string, severidad string, descripcion string"
    )


def unstable_regulation(df: DataFrame, limit: float, window: int = 24, s: Series = HOURLY) -> DataFrame:
    """Alert flag where the tap moved more than `limit` steps within the last `window` hours."""
    tap = F.col("tap_position_value")
    return over_chunks(
        df,
        [
            lambda w: {"__step": F.abs(tap - F.lag(tap).over(w))},
            lambda w: {"tap_moves": F.sum("__step").over(rows(w, window))},
            lambda w: {"regulacion_inestable": flag(F.col("tap_moves") > limit)},
        ],
        s,
        before=window + 1,
        drop=["__step"],
    )


def state_counts(df: DataFrame, col: str = "estado_operacional") -> DataFrame:
    """Rows and percent per state; missing states form their own row. The total runs over at most one row per state."""
    from pyspark.sql import Window

    everything = Window.partitionBy(F.lit(1))
    return (
        df.groupBy(col)
        .agg(F.count(F.lit(1)).alias("registros"))
        .withColumn("porcentaje", F.col("registros") * 100.0 / F.sum("registros").over(everything))
    )
