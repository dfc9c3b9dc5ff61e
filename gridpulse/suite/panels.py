"""Checked queries: hourly panel, cleaning, classification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from gridpulse.catalog import CATEGORIES, SIGNALS, category_of
from gridpulse.functions.columns import hour_start
from gridpulse.operators import clean as cleaning, panel as panels, quality, rules
from gridpulse.suite.base import buckets, clean, panel, query, readings, silver
from gridpulse.suite.sql import (
    CONSOLIDATED, PLAUSIBLE_CTE, RANGES, READINGS, TAP, TO_BUCKETS, TO_CLEAN, TO_PANEL, TO_SILVER, fill, hour_ts,
    r, with_,
)

_ALL = ", ".join(r(c, c) for c in SIGNALS)


@query("hourly_mean", with_([READINGS], f"SELECT asset_id, tag, date_trunc('hour', ts) AS ts, {r('avg(value)', 'value')} FROM readings GROUP BY ALL"))
def hourly_mean(spark, sf):
    return panels.hourly_mean(readings(spark, sf))


@query(
    "hourly_last_tap",
    with_([READINGS], f"""SELECT asset_id, tag, date_trunc('hour', ts) AS ts, {r('arg_max(value, ts)', 'value')}
        FROM readings WHERE tag = '{TAP}' GROUP BY asset_id, tag, date_trunc('hour', ts)"""),
)
def hourly_last_tap(spark, sf):
    return panels.hourly_last(readings(spark, sf).where(F.col("tag") == TAP))


@query(
    "supplier_hourly_mean",
    f"""SELECT l_suppkey AS asset_id, l_returnflag AS tag, date_trunc('hour', l_shipdate) AS ts, {r('avg(l_quantity)', 'value')}
        FROM lineitem GROUP BY ALL""",
)
def supplier_hourly_mean(spark, sf):
    """The same reduction over the largest table, with many assets."""
    from gridpulse.sources.driver_tables import table

    li = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("asset_id"), F.col("l_returnflag").alias("tag"),
        F.col("l_shipdate").cast("timestamp").alias("ts"), F.col("l_quantity").alias("value"),
    )
    return panels.hourly_mean(li)


@query(
    "tag_profile",
    with_([READINGS], f"""SELECT asset_id, tag, count(*) AS registros, min(ts) AS fecha_inicio, max(ts) AS fecha_fin,
        count(*) FILTER (WHERE value IS NULL) AS valores_nulos, {r('min(value)', 'valor_min')}, {r('max(value)', 'valor_max')},
        {r('avg(value)', 'valor_medio')}, (epoch_us(max(ts)) - epoch_us(min(ts))) // 86400000000 AS duracion_dias
        FROM readings GROUP BY ALL"""),
)
def tag_profile(spark, sf):
    return panels.tag_profile(readings(spark, sf))


@query("common_range", with_([*TO_BUCKETS, RANGES], f"SELECT asset_id, {hour_ts('lo_hour')} AS desde, {hour_ts('hi_hour')} AS hasta FROM ranges"))
def common_range(spark, sf):
    c = panels.common_range(buckets(spark, sf))
    return c.select("asset_id", hour_start(F.col("lo_hour")).alias("desde"), hour_start(F.col("hi_hour")).alias("hasta"))


@query(
    "common_range_capped",
    with_([*TO_BUCKETS, RANGES], f"""SELECT asset_id, {hour_ts('lo_hour')} AS desde, {hour_ts('least(hi_hour, lo_hour + 241)')} AS hasta FROM ranges"""),
)
def common_range_capped(spark, sf):
    c = panels.common_range(buckets(spark, sf), max_days=10.07)  # 241.68 hours
    return c.select("asset_id", hour_start(F.col("lo_hour")).alias("desde"), hour_start(F.col("hi_hour")).alias("hasta"))


@query("pivot_panel", with_(TO_PANEL, f"SELECT asset_id, {hour_ts('hour')} AS ts, {_ALL} FROM panel"))
def pivot_panel(spark, sf):
    return panel(spark, sf)


@query(
    "hourly_spine_join",
    with_([*TO_PANEL, "tags AS (SELECT DISTINCT tag FROM buckets)"], f"""SELECT s.asset_id, t.tag, {hour_ts('s.hour')} AS ts, {r('c.value', 'value')}
        FROM spine s CROSS JOIN tags t LEFT JOIN clipped c ON c.asset_id = s.asset_id AND c.hour = s.hour AND c.tag = t.tag"""),
)
def hourly_spine_join(spark, sf):
    b = buckets(spark, sf)
    ranges = panels.common_range(b)
    tags = F.explode(F.array(*[F.lit(t) for t in SIGNALS])).alias("tag")
    d = panels.hourly_spine(ranges).select("*", tags).join(panels.clip_to_range(b, ranges), ["asset_id", "tag", "hour"], "left")
    return d.select("asset_id", "tag", hour_start(F.col("hour")).alias("ts"), "value")


def _merged_sql() -> str:
    joined = "(SELECT asset_id, hour, value AS {0} FROM buckets WHERE tag = '{0}') t{1}"
    out = joined.format(SIGNALS[0], 0)
    for i, c in enumerate(SIGNALS[1:], 1):
        out += f" FULL JOIN {joined.format(c, i)} USING (asset_id, hour)"
    return f"SELECT asset_id, {hour_ts('hour')} AS ts, {_ALL} FROM {out}"


@query("merge_series", with_(TO_BUCKETS, _merged_sql()))
def merge_series(spark, sf):
    b = buckets(spark, sf).withColumn("ts", hour_start(F.col("hour")))
    one = [b.where(F.col("tag") == c).select("asset_id", "ts", F.col("value").alias(c)) for c in SIGNALS]
    return reduce(panels.merge_series, one)


@query(
    "series_overlap",
    with_(TO_BUCKETS, f"""SELECT asset_id, count(*) AS common_hours FROM (SELECT asset_id, hour FROM buckets WHERE value IS NOT NULL
        GROUP BY asset_id, hour HAVING count(DISTINCT tag) = {len(SIGNALS)}) GROUP BY ALL"""),
)
def series_overlap(spark, sf):
    """Hours at which all series have a value."""
    b = buckets(spark, sf).where(F.col("value").isNotNull())
    hours = [b.where(F.col("tag") == t).select("asset_id", "hour") for t in SIGNALS]
    return reduce(lambda x, y: x.intersect(y), hours).groupBy("asset_id").agg(F.count(F.lit(1)).alias("common_hours"))


@query("consolidated_panel", with_([*TO_PANEL, CONSOLIDATED], f"SELECT asset_id, {hour_ts('hour')} AS ts, {_ALL} FROM consolidated"))
def consolidated_panel(spark, sf):
    return panels.consolidate(panel(spark, sf))


_ACCENTS = "translate({x}, 'áéíóúñ', 'aeioun')"


def _name_sql() -> str:
    from gridpulse.catalog import NAME_TOKENS, SIGNAL_ALIASES

    x = "lower(raw)"
    for old, new in NAME_TOKENS.items():
        x = f"replace({x}, '{old}', '{new}')"
    x = _ACCENTS.format(x=x)
    for pattern, new in ((r"\s+", "_"), ("[^a-z0-9_]", ""), ("_+", "_"), ("^_|_$", "")):
        x = f"regexp_replace({x}, '{pattern}', '{new}', 'g')"
    known = " ".join(f"WHEN raw = '{a}_value' THEN '{s}'" for a, s in SIGNAL_ALIASES.items())
    return f"CASE {known} ELSE coalesce(nullif({x}, ''), 'var_transformador') END"


_RAW_NAME = {
    "view": "temperatura_aceite", "click": "Corriente  Fásica", "error": "Ñandú Posición-Punto", "purchase": "voltaje",
    "signup": "__Carga (Total)__",
}


@query(
    "standard_names",
    with_(
        ["names AS (SELECT CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _RAW_NAME.items())
         + " END || CASE WHEN event_id % 3 = 0 THEN '' ELSE ' ' || CAST(event_id % 3 AS VARCHAR) END || '_value' AS raw FROM events)"],
        f"SELECT raw, {_name_sql()} AS name, count(*) AS rows FROM names GROUP BY ALL",
    ),
)
def standard_names(spark, sf):
    from gridpulse.sources.driver_tables import table

    kinds = F.create_map(*[F.lit(x) for kv in _RAW_NAME.items() for x in kv])
    tail = F.when(F.col("event_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(" "), (F.col("event_id") % 3).cast("string")))
    tags = table(spark, sf, "events").select(F.concat(kinds[F.col("event_type")], tail).alias("tag"))
    counted = tags.groupBy("tag").agg(F.count(F.lit(1)).alias("rows"))
    return counted.select(
        F.concat("tag", F.lit("_value")).alias("raw"), cleaning.standard_name_column(F.col("tag")).alias("name"), "rows"
    )


# ---- cleaning ---------------------------------------------------------------------------------------------------

@query("range_nullify", with_([*TO_PANEL, CONSOLIDATED, PLAUSIBLE_CTE], f"SELECT asset_id, {hour_ts('hour')} AS ts, {_ALL} FROM plausible"))
def range_nullify(spark, sf):
    return cleaning.nullify_implausible(panels.consolidate(panel(spark, sf)))


@query(
    "interpolate_time",
    with_([*TO_PANEL, fill("panel", "f", SIGNALS, "inside")], f"SELECT asset_id, {hour_ts('hour')} AS ts, {_ALL} FROM f"),
)
def interpolate_time(spark, sf):
    return cleaning.interpolate(panel(spark, sf), SIGNALS, edges="inside")


@query(
    "interpolate_linear",
    with_([*TO_PANEL, fill("panel", "f", SIGNALS, "both")], f"SELECT asset_id, {hour_ts('hour')} AS ts, {_ALL} FROM f"),
)
def interpolate_linear(spark, sf):
    """By row position; on the gap-free spine this equals the time-weighted form of the SQL."""
    return cleaning.interpolate(panel(spark, sf), SIGNALS, by="position", edges="both")


@query(
    "ffill_bfill_tap",
    with_([*TO_PANEL, fill("panel", "f", [], "both", backward=[TAP])], f"SELECT asset_id, {hour_ts('hour')} AS ts, {r(TAP, TAP)} FROM f"),
)
def ffill_bfill_tap(spark, sf):
    return cleaning.fill_forward(panel(spark, sf).select("asset_id", "ts", TAP), [TAP], then_back=True)


@query("clean_panel", with_(TO_CLEAN, f"SELECT asset_id, ts, {_ALL} FROM clean"))
def clean_panel(spark, sf):
    return clean(spark, sf)


def _missing_sql() -> str:
    parts = []
    for cat in [*CATEGORIES, "__global__"]:
        cols = [c for c in SIGNALS if cat == "__global__" or cat in category_of(c)]
        if cols:
            missing = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in cols)
            affected = " + ".join(f"CAST(count(*) FILTER (WHERE {c} IS NULL) > 0 AS BIGINT)" for c in cols)
            parts.append(
                f"SELECT '{cat}' AS category, CAST({len(cols)} AS BIGINT) AS columns, {missing} AS missing, "
                f"count(*) * {len(cols)} AS total, {affected} AS affected, {r(f'({missing}) * 100.0 / (count(*) * {len(cols)})', 'percent')} FROM panel"
            )
    return " UNION ALL ".join(parts)


@query("missing_by_category", with_(TO_PANEL, _missing_sql()))
def missing_by_category(spark, sf):
    return cleaning.missing_by_category(panel(spark, sf), SIGNALS)


def _quality_sql() -> str:
    def nulls(t):
        return "(SELECT " + " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in SIGNALS) + f" FROM {t})"

    before, after, n = nulls("plausible"), nulls("clean"), len(SIGNALS)
    return f"""SELECT {before} AS missing_original, {before} - {after} AS interpolated, {after} AS missing_final,
        (SELECT count(*) * {n} FROM clean) AS total_valores,
        {r(f'((SELECT count(*) * {n} FROM clean) - {after}) * 100.0 / (SELECT count(*) * {n} FROM clean)', 'completitud_total')},
        5 AS variables_termica, 3 AS variables_electrica, 1 AS variables_mecanica"""


@query("quality_report", with_(TO_CLEAN, _quality_sql()))
def quality_report(spark, sf):
    before = cleaning.nullify_implausible(panels.consolidate(panel(spark, sf)))
    return quality.quality_report(before, clean(spark, sf), SIGNALS)


# ---- classification ---------------------------------------------------------------------------------------------

@query(
    "classify_states",
    with_(TO_SILVER, "SELECT asset_id, ts, estado_operacional, nivel_severidad, variables_anomalas, descripcion_anomalia FROM silver"),
)
def classify_states(spark, sf):
    cols = ["asset_id", "ts", "estado_operacional", "nivel_severidad", "variables_anomalas", "descripcion_anomalia"]
    return silver(spark, sf).select(*cols)


@query("state_counts", with_(TO_SILVER, f"SELECT estado_operacional, count(*) AS registros, {r('count(*) * 100.0 / sum(count(*)) OVER ()', 'porcentaje')} FROM silver GROUP BY ALL"))
def state_counts(spark, sf):
    return rules.state_counts(silver(spark, sf))


@query(
    "anomalous_variables",
    with_(TO_SILVER, "SELECT variable, count(*) AS hours FROM (SELECT unnest(string_split(variables_anomalas, ', ')) AS variable FROM silver) WHERE variable <> '' GROUP BY ALL"),
)
def anomalous_variables(spark, sf):
    d = silver(spark, sf).select(F.explode(F.split("variables_anomalas", ", ")).alias("variable"))
    return d.where("variable <> ''").groupBy("variable").agg(F.count(F.lit(1)).alias("hours"))


@query(
    "combined_overload",
    with_(TO_CLEAN, f"""SELECT asset_id, ts, {r('current_load_value', 'current_load_value')}, 'CRITICO' AS estado_operacional FROM clean
        WHERE current_load_value > 2000 AND (temp_oil_value > 70 OR temp_oil_oltc_value > 70)"""),
)
def combined_overload(spark, sf):
    from gridpulse.catalog import OVERLOAD_TEXT

    d = silver(spark, sf).where(F.col("descripcion_anomalia").contains(OVERLOAD_TEXT))
    return d.select("asset_id", "ts", "current_load_value", "estado_operacional")


@query(
    "thermal_stress_rule",
    with_(TO_SILVER, """SELECT asset_id, ts, estado_operacional FROM silver
        WHERE nivel_severidad < 2 AND greatest(temp_spot_hot_value - temp_oil_value, temp_spot_hot_value - temp_oil_oltc_value) > 25"""),
)
def thermal_stress_rule(spark, sf):
    from gridpulse.catalog import GRADIENT_TEXT

    d = silver(spark, sf).where(F.col("descripcion_anomalia").contains(GRADIENT_TEXT))
    return d.select("asset_id", "ts", "estado_operacional")


@query(
    "load_factor_rule",
    with_([*TO_CLEAN, f"lf AS (SELECT asset_id, ts, current_load_value / 1508.1 AS factor_carga FROM clean)"],
          """SELECT CASE WHEN factor_carga >= 1.2 THEN 'CRITICO' WHEN factor_carga >= 1.0 THEN 'ALERTA' ELSE 'NORMAL' END AS estado_operacional,
          count(*) AS registros FROM lf GROUP BY ALL"""),
)
def load_factor_rule(spark, sf):
    """A rule whose column only exists when supplied."""
    d = clean(spark, sf).select("asset_id", "ts", (F.col("current_load_value") / 1508.1).alias("factor_carga"))
    return rules.classify(d).groupBy("estado_operacional").agg(F.count(F.lit(1)).alias("registros"))


@query(
    "classify_outside_bands",
    with_(TO_CLEAN, f"""SELECT CASE WHEN {TAP} < 3 OR {TAP} >= 15 THEN 'CRITICO' WHEN {TAP} < 6 OR {TAP} >= 12 THEN 'ALERTA' ELSE 'NORMAL' END
        AS estado_operacional, count(*) AS registros FROM clean GROUP BY ALL"""),
)
def classify_outside_bands(spark, sf):
    d = clean(spark, sf).select("asset_id", "ts", TAP)
    return rules.classify(d, bands="outside").groupBy("estado_operacional").agg(F.count(F.lit(1)).alias("registros"))


def _bands_sql() -> str:
    from gridpulse.catalog import RULES
    from gridpulse.operators.rules import rule_columns

    parts = []
    for rule in RULES:
        for c in rule_columns(SIGNALS, rule.variable):
            for band, (lo, hi) in (("normal", rule.normal), ("alerta", rule.alert), ("critico", rule.critical)):
                top = f" AND {c} < {hi}" if hi != float("inf") else ""
                parts.append(f"SELECT '{c}' AS columna, '{band}' AS band, count(*) AS horas FROM clean WHERE {c} >= {lo}{top} HAVING count(*) > 0")
    return " UNION ALL ".join(parts)


@query("rule_band_hours", with_(TO_CLEAN, _bands_sql()))
def rule_band_hours(spark, sf):
    """The rule table joined to the long panel by range: hours of each column inside each band."""
    from gridpulse.catalog import RULES

    table = rules.rules_table(spark)
    use = spark.createDataFrame(
        [(r.variable, c) for r in RULES for c in rules.rule_columns(SIGNALS, r.variable)], "variable string, columna string"
    )
    bands = F.broadcast(table.join(use, "variable"))  # one row per rule, column and band: fixed by the rule set
    long = clean(spark, sf).unpivot(["asset_id", "ts"], SIGNALS, "columna", "valor")
    inside = (F.col("valor") >= F.col("min")) & (F.col("valor") < F.col("max"))
    return long.join(bands, "columna").where(inside).groupBy("columna", "band").agg(F.count(F.lit(1)).alias("horas"))


@query(
    "silver_from_bronze",
    with_(TO_SILVER, f"SELECT asset_id, ts, {_ALL}, estado_operacional, nivel_severidad, variables_anomalas FROM silver"),
)
def silver_from_bronze(spark, sf):
    """The same panel from Bronze rows: historian aliases, numbers in two channels, rows without a valid time, unknown tags."""
    from gridpulse.catalog import SIGNAL_ALIASES
    from gridpulse.plans.silver import silver_from_bronze as plan
    from gridpulse.suite.base import PANEL_DECIMALS

    alias = F.create_map(*[F.lit(x) for a, s in SIGNAL_ALIASES.items() for x in (s, a)])
    as_text = F.col("tag").isin("temp_ambient_value", "tap_position_value")
    rows = readings(spark, sf).select(
        "asset_id", alias[F.col("tag")].alias("tag"), F.col("ts").alias("timestamp"), F.when(~as_text, F.col("value")).alias("value"),
        F.when(as_text, F.col("value").cast("string")).alias("value_text"), F.lit(None).cast("boolean").alias("value_bool"),
    )
    untimed = rows.withColumns({"timestamp": F.lit(None).cast("timestamp"), "value": F.lit(999.0)})
    unknown = rows.withColumn("tag", F.concat(F.lit("other_"), "tag"))
    found = plan(rows.unionByName(untimed).unionByName(unknown), decimals=PANEL_DECIMALS)
    return found.select("asset_id", "ts", *SIGNALS, "estado_operacional", "nivel_severidad", "variables_anomalas")
