"""Checked queries: validation, split, column choice, tables, model preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridpulse.catalog import OPERATING, SIGNALS, category_of
from gridpulse.models import prep
from gridpulse.operators import dataset as ds, quality, series
from gridpulse.plans.gold import gold
from gridpulse.session import fresh_dir
from gridpulse.sources import tables
from gridpulse.sources.store import once
from gridpulse.sources.bronze import distinct_tags
from gridpulse.suite.base import clean, panel, query, readings, silver
from gridpulse.suite.labels import LIMIT, _EV, _SEV, timed
from gridpulse.suite.sql import READINGS, TO_CLEAN, TO_PANEL, TO_SILVER, hour_ts, r, with_

HOT, OIL, CUR, POW = "temp_spot_hot_value", "temp_oil_value", "current_load_value", "power_apparent_value"

# ---- validation -------------------------------------------------------------------------------------------------

_COH = f"avg(CASE WHEN {HOT} >= {OIL} THEN 1.0 ELSE 0.0 END) * 100"
_BOTH = f"FROM clean WHERE {HOT} IS NOT NULL AND {OIL} IS NOT NULL"


@query(
    "thermal_coherence",
    with_(TO_CLEAN, f"""SELECT {r(_COH, 'coherencia_termica')}, {r(f'avg({HOT} - {OIL})', 'gradiente_medio')},
        {r(f'max({HOT} - {OIL})', 'gradiente_max')}, {_COH} < 95.0 AS alerta_coherencia, max({HOT} - {OIL}) > 25 AS alerta_gradiente {_BOTH}"""),
)
def thermal_coherence(spark, sf):
    return quality.thermal_coherence(clean(spark, sf))


@query(
    "power_current_ratio",
    with_(TO_CLEAN, f"""SELECT count(*) AS n, {r(f'avg({POW} / {CUR})', 'ratio_medio')},
        {r(f'stddev_samp({POW} / {CUR}) / avg({POW} / {CUR})', 'variabilidad_ratio')} FROM clean WHERE {CUR} > 10 AND {POW} > 1"""),
)
def power_current_ratio(spark, sf):
    return quality.power_current_ratio(clean(spark, sf))


@query(
    "operating_ranges",
    with_(TO_PANEL, " UNION ALL ".join(
        f"""SELECT '{c}' AS variable, count({c}) AS n, count(*) FILTER (WHERE {c} BETWEEN {lo} AND {hi}) AS ok,
        {r(f'count(*) FILTER (WHERE {c} BETWEEN {lo} AND {hi}) * 100.0 / count({c})', 'porcentaje_ok')},
        count(*) FILTER (WHERE {c} BETWEEN {lo} AND {hi}) * 100.0 / count({c}) < 90 AS alerta FROM panel"""
        for c, (lo, hi) in OPERATING.items())),
)
def operating_ranges(spark, sf):
    return quality.operating_ranges(panel(spark, sf))


_HOLES = "present AS (SELECT asset_id, hour FROM panel WHERE voltage_value IS NOT NULL)"
_GAPS = "gaps AS (SELECT *, hour - lag(hour) OVER (PARTITION BY asset_id ORDER BY hour) AS g FROM present)"


def _present(spark, sf):
    return panel(spark, sf).where(F.col("voltage_value").isNotNull()).select("asset_id", "ts")


@query(
    "time_continuity",
    with_([*TO_PANEL, _HOLES, _GAPS], f"""SELECT asset_id, count(*) AS registros, count(*) FILTER (WHERE g > 1.5) AS numero_gaps,
        {r('(count(*) - count(*) FILTER (WHERE g > 1.5)) * 100.0 / count(*)', 'continuidad_temporal')},
        count(*) FILTER (WHERE g > 1.5) > count(*) * 0.05 AS alerta FROM gaps GROUP BY asset_id"""),
)
def time_continuity(spark, sf):
    return quality.time_continuity(_present(spark, sf))


@query("time_gaps", with_([*TO_PANEL, _HOLES, _GAPS], f"SELECT asset_id, {hour_ts('hour')} AS ts, {r('g', 'gap_hours')} FROM gaps WHERE g > 1.5"))
def time_gaps(spark, sf):
    return quality.gaps(_present(spark, sf))


_ALERTS = " UNION ALL ".join(
    [f"SELECT 'coherencia_termica' AS a {_BOTH} HAVING {_COH} < 95", f"SELECT 'gradiente_termico' {_BOTH} HAVING max({HOT} - {OIL}) > 25"]
    + [f"SELECT 'rango_{c}' FROM clean HAVING count(*) FILTER (WHERE {c} BETWEEN {lo} AND {hi}) * 100.0 / count({c}) < 90" for c, (lo, hi) in OPERATING.items()]
)


@query(
    "validation_verdict",
    with_([*TO_CLEAN, f"alerts AS ({_ALERTS})"], """SELECT CASE WHEN count(*) > 0 THEN 'ADVERTENCIAS' ELSE 'EXITOSO' END AS estado_validacion,
        CAST(count(*) AS INTEGER) AS numero_alertas, coalesce(string_agg(a, ', ' ORDER BY a), '') AS alertas FROM alerts"""),
)
def validation_verdict(spark, sf):
    return quality.validation_verdict(clean(spark, sf))


# ---- split and columns ------------------------------------------------------------------------------------------

_SPLIT = """parts AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY asset_id ORDER BY ts) - 1 < floor(count(*) OVER (PARTITION BY asset_id) * 0.8)
    THEN 'train' ELSE 'validation' END AS split FROM {src})"""


@query("temporal_split", with_([*TO_CLEAN, _SPLIT.format(src="clean")], "SELECT asset_id, ts, split FROM parts"))
def temporal_split(spark, sf):
    return ds.temporal_split(clean(spark, sf).select("asset_id", "ts"))


@query(
    "split_summary",
    with_([*TO_CLEAN, *_EV, _SPLIT.format(src="rul")], f"""SELECT split, count(*) AS registros, min(ts) AS desde, max(ts) AS hasta,
        {r('avg(falla)', 'tasa_fallas')}, {r('count(*) / sum(count(*)) OVER ()', 'proporcion')} FROM parts GROUP BY split"""),
)
def split_summary(spark, sf):
    return ds.split_summary(ds.temporal_split(timed(spark, sf)))


_CUT = "cut AS (SELECT ts AS cut FROM clean ORDER BY ts LIMIT 1 OFFSET (SELECT CAST(floor(count(*) * 0.8) AS BIGINT) FROM clean))"


@query("fleet_cut", with_([*TO_CLEAN, _CUT], "SELECT cut FROM cut"))
def fleet_cut(spark, sf):
    return ds.fleet_cut(clean(spark, sf))


@query(
    "fleet_split",
    with_([*TO_CLEAN, _CUT], "SELECT asset_id, CASE WHEN ts < cut THEN 'train' ELSE 'validation' END AS split, count(*) AS registros FROM clean, cut GROUP BY ALL"),
)
def fleet_split(spark, sf):
    d = clean(spark, sf).select("asset_id", "ts")
    return ds.split_at(d, ds.fleet_cut(d)).groupBy("asset_id", "split").agg(F.count(F.lit(1)).alias("registros"))


@query(
    "final_label_stats",
    with_([*TO_CLEAN, *_EV], f"""SELECT {r('avg(falla)', 'tasa_positivos')}, {r('avg(rul)', 'rul_medio')}, {r('min(rul)', 'rul_min')},
        {r('max(rul)', 'rul_max')}, {r(f'avg({_SEV})', 'severidad_media')} FROM rul"""),
)
def final_label_stats(spark, sf):
    return ds.final_label_stats(timed(spark, sf))


def _profile_sql() -> str:
    one = """SELECT '{c}' AS column, {nr}, {lo}, {hi}, count(DISTINCT {c}) AS distinct_values,
        coalesce(count(DISTINCT {c}) > 1, false) AND avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) <= 0.30 AS keep_model FROM wide_cols"""
    return " UNION ALL ".join(
        one.format(c=c, nr=r(f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)", "null_ratio"), lo=r(f"min({c})", "min"), hi=r(f"max({c})", "max"))
        for c in [*SIGNALS, "constant", "rare"]
    )


@query(
    "column_selection",
    with_([*TO_PANEL, "wide_cols AS (SELECT *, 7.0::DOUBLE AS constant, CASE WHEN hour % 10 = 0 THEN voltage_value END AS rare FROM panel)"], _profile_sql()),
)
def column_selection(spark, sf):
    d = panel(spark, sf).withColumn("constant", F.lit(7.0)).withColumn(
        "rare", F.when(series.HOURLY.hour() % 10 == 0, F.col("voltage_value"))
    )
    return ds.column_profile(d)


@query(
    "downcast_bounds",
    with_([*TO_CLEAN, "typed AS (SELECT *, hour * 1000 AS big, hour % 200 AS small, hour % 2 AS bit FROM clean)"], " UNION ALL ".join(
        f"SELECT '{c}' AS column, '{f}' AS from_type, {r(f'CAST(min({c}) AS DOUBLE)', 'min')}, {r(f'CAST(max({c}) AS DOUBLE)', 'max')}, '{t}' AS to_type FROM typed"
        for c, f, t in [*[(s, "double", "float") for s in SIGNALS], ("big", "bigint", "int"), ("small", "bigint", "smallint"), ("bit", "bigint", "tinyint")])),
)
def downcast_bounds(spark, sf):
    h = series.HOURLY.hour()
    d = clean(spark, sf).select(*SIGNALS, (h * 1000).alias("big"), (h % 200).alias("small"), (h % 2).alias("bit"))
    return ds.downcast_bounds(d)


_GROUPED = {**dict.fromkeys(SIGNALS, "Variables Originales"), "gradient_hot_oil": "Features Térmicos", "load_factor_power": "Features Eléctricos",
            "falla_30d": "Etiquetas de Predicción", "hora": "Otros Features"}
_ADDED = f"""widened AS (SELECT *, {HOT} - {OIL} AS gradient_hot_oil, power_apparent_value / 100000.0 AS load_factor_power, CAST({HOT} >= 100 AS INTEGER) AS falla_30d,
    hour % 24 AS hora FROM clean)"""


@query("feature_groups", with_([*TO_CLEAN, _ADDED], " UNION ALL ".join(
    f"SELECT '{c}' AS column, '{g}' AS grupo, count({c}) AS filled FROM widened" for c, g in _GROUPED.items())))
def feature_groups(spark, sf):
    """Columns by group (originals, thermal, electrical, labels, all others) and how many values each holds."""
    hot = F.col(HOT)
    wide = clean(spark, sf).withColumns({
        "gradient_hot_oil": hot - F.col(OIL), "load_factor_power": F.col("power_apparent_value") / 100000.0,
        "falla_30d": (hot >= 100).cast("int"), "hora": F.hour("ts")})
    groups = ds.feature_groups(wide).drop("position")
    filled = wide.agg(*[F.count(c).alias(c) for c in _GROUPED]).unpivot([], list(_GROUPED), "column", "filled")
    return groups.join(F.broadcast(filled), "column")  # one row per column


_N = 24


@query(
    "latest_rows",
    with_(TO_CLEAN, f"""SELECT asset_id, ts, {', '.join(r(c, c) for c in SIGNALS)} FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY ts DESC) AS rn FROM clean) WHERE rn <= {_N}"""),
)
def latest_rows(spark, sf):
    return series.latest_rows(clean(spark, sf), _N)


@query("align_columns", with_(TO_CLEAN, f"SELECT asset_id, ts, {r(CUR, CUR)}, CAST(NULL AS DOUBLE) AS absent_feature, {r(OIL, OIL)} FROM clean"))
def align_columns(spark, sf):
    return ds.align_columns(clean(spark, sf), [CUR, "absent_feature", OIL])


@query(
    "describe_dataset",
    with_(TO_PANEL, " UNION ALL ".join(
        f"""SELECT '{c}' AS variable, count(*) AS registros, count(*) FILTER (WHERE {c} IS NULL) AS faltantes, {r(f'min({c})', 'minimo')},
        {r(f'max({c})', 'maximo')}, {r(f'avg({c})', 'media')}, {hour_ts('min(hour)')} AS desde, {hour_ts('max(hour)')} AS hasta FROM panel""" for c in SIGNALS)),
)
def describe_dataset(spark, sf):
    return quality.describe_dataset(panel(spark, sf), SIGNALS)


# ---- tables -----------------------------------------------------------------------------------------------------

@query(
    "silver_table",
    with_(TO_SILVER, """SELECT CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, estado_operacional, count(*) AS registros,
        min(ts) AS desde, max(ts) AS hasta FROM silver GROUP BY ALL"""),
)
def silver_table(spark, sf):
    """Written with year and month partitions, overwritten once, read back."""
    path = fresh_dir(spark, "silver")
    d = silver(spark, sf)
    tables.write_silver(d, path)
    tables.write_silver(d, path)
    back = tables.read_first(spark, ("parquet", path + "-absent"), ("parquet", path))
    return back.groupBy(F.col("year").cast("int").alias("year"), F.col("month").cast("int").alias("month"), "estado_operacional").agg(
        F.count(F.lit(1)).alias("registros"), F.min("ts").alias("desde"), F.max("ts").alias("hasta")
    )


_CATS = "CASE WHEN tag LIKE 'temp%' THEN 'Térmica' WHEN tag LIKE 'tap%' THEN 'Mecánica' ELSE 'Eléctrica' END"


@query("variables_per_category", with_([READINGS], f"SELECT {_CATS} AS categoria_tecnica, count(DISTINCT tag) AS variables FROM readings GROUP BY 1"))
def variables_per_category(spark, sf):
    """A catalogue of the tags present, written as CSV and read back."""
    kinds = F.create_map(*[F.lit(x) for c in SIGNALS for x in (c, category_of(c)[0])])
    found = distinct_tags(readings(spark, sf)).select(F.col("tag").alias("variable"), kinds[F.col("tag")].alias("categoria_tecnica"))
    path = fresh_dir(spark, "variables")
    found.write.option("header", True).csv(path)
    return tables.variables_per_category(tables.read_variables(spark, path))


@query("event_period", with_([*TO_CLEAN, *_EV], "SELECT asset_id, count(*) AS eventos, " + hour_ts("min(hour)") + " AS primero, " + hour_ts("max(hour)") + " AS ultimo FROM ev GROUP BY asset_id"))
def event_period(spark, sf):
    hit = clean(spark, sf).where(F.col(HOT) >= LIMIT)
    return hit.groupBy("asset_id").agg(F.count(F.lit(1)).alias("eventos"), F.min("ts").alias("primero"), F.max("ts").alias("ultimo"))


@query("anomaly_subset", with_(TO_SILVER, "SELECT asset_id, ts, estado_operacional FROM silver WHERE estado_operacional IN ('ALERTA', 'CRITICO')"))
def anomaly_subset(spark, sf):
    return tables.anomalies(spark, silver(spark, sf)).select("asset_id", "ts", "estado_operacional")


def gold_table(spark, sf):
    """The complete dataset: 9 signals, 4 state columns, 48 features, 7 labels, split."""
    def make():
        return gold(silver(spark, sf), event=F.col(HOT) >= LIMIT)

    return once(spark, ("gold", sf), make)


def _gold_sql() -> str:
    """Every column of the dataset, put together from the statements of the single features and labels."""
    from gridpulse.operators.features import ELECTRICAL_FEATURES, THERMAL_FEATURES
    from gridpulse.suite import features as f
    from gridpulse.suite.sql import diff, roll

    rolled = {
        **{f"{c}_rate": f"{c}_rate" for c in f.TEMPS},
        **{f"{c}_accel": diff(f"{c}_rate") for c in f.TEMPS},
        **{f"{c}_rate_smooth": roll("avg", f"{c}_rate", 6) for c in f.TEMPS},
        "gradient_hot_oil": f"{f.HOT} - {f.OIL}",
        "gradient_normalized": f"({f.HOT} - {f.OIL}) / ({f.OIL} - {f.AMB} + 1e-6)",
        "temp_rise_hot": f"{f.HOT} - {f.AMB}",
        "temp_rise_oil": f"{f.OIL} - {f.AMB}",
        "thermal_efficiency": f"({f.OIL} - {f.AMB}) / ({f.CUR} + 1e-6)",
        "thermal_loading_factor": f"({f.OIL} - {f.AMB}) / 25.0",
        "thermal_cycles_7d": f"CAST(sum(peak) OVER ({f.W} ROWS BETWEEN 168 PRECEDING AND CURRENT ROW) AS DOUBLE)",
        "thermal_stress_index": f"0.7 * ({f.HOT} / 100.0) + 0.3 * (({f.HOT} - {f.OIL}) / 25.0)",
        "overheating_trend": f._TREND,
        "bubbling_anomaly": f"({f.BUB} - {roll('avg', f.BUB, 168, 24)}) / ({roll('stddev_samp', f.BUB, 168, 24)} + 1e-6)",
        "gas_formation_trend": f"{roll('avg', f.BUB, 720, 168)} - {roll('avg', f.BUB, 168, 24)}",
        "load_factor_current": f._LOAD, "load_factor_power": f._LOADP,
        "efficiency_indicator": "eff", "relative_losses": "1.0 - eff",
        "power_factor_estimated": f"({f.POW} * 0.9) / ({f.POW} + 1e-6)",
        **{f"tap_operations_{n // 24}d": roll("sum", "step", n) for n in (24, 168, 720)},
        "tap_deviation_center": f"abs({f.TAP} - 8.5)", "tap_instability": roll("stddev_samp", "step", 24),
        **{f"{c}_stability": f"{roll('stddev_samp', c, 24, 6)} / ({roll('avg', c, 24, 6)} + 1e-6)" for c in (f.CUR, f.VOL, f.POW)},
        "electrical_stress_index": f"0.6 * {f._LOAD} + 0.4 * (1.0 - eff)",
        "efficiency_degradation_trend": "trend", "efficiency_degradation_accel": diff("trend"),
    }
    flags = {
        "overload_indicator": f"coalesce({f._LOAD} > 1.2, false) OR coalesce({f._LOADP} > 1.2, false)",
        "tap_extreme_position": f"{f.TAP} <= 2 OR {f.TAP} >= 15",
        **{f"{c}_transient": f"coalesce(abs({diff(c)}) > {roll('stddev_samp', c, 168, 168)} * 2, false)" for c in (f.CUR, f.VOL, f.POW)},
        "suboptimal_operation": f"coalesce({f._LOAD} < 0.3 OR {f._LOAD} > 1.1, false) OR coalesce(eff < 0.95, false)",
    }
    cols = [
        r(rolled[c], c) if c in rolled else f"CAST({flags[c]} AS INTEGER) AS {c}" for c in THERMAL_FEATURES + ELECTRICAL_FEATURES
    ]
    steps = ", ".join(f"{diff(c)} AS {c}_rate" for c in f.TEMPS)
    ctes = [
        *TO_SILVER,
        *f._PEAKS,
        f"""g1 AS (SELECT s.*, m.peak, {steps.replace("PARTITION BY asset_id ORDER BY hour", "PARTITION BY s.asset_id ORDER BY s.hour")},
            abs({diff(f.TAP)}) AS step, {f._EFF} AS eff FROM silver s JOIN marked m USING (asset_id, hour, ts))""".replace(
            "OVER (PARTITION BY asset_id ORDER BY hour)", "OVER (PARTITION BY s.asset_id ORDER BY s.hour)"),
        f"g2 AS (SELECT *, {roll('avg', 'eff', 720, 168)} - {roll('avg', 'eff', 24, 12)} AS trend FROM g1)",
        f"feats AS (SELECT asset_id, hour, ts, {', '.join(r(c, c) for c in SIGNALS)}, estado_operacional, nivel_severidad, variables_anomalas, descripcion_anomalia, {', '.join(cols)} FROM g2)",
        *_EV,
        """nxt AS (SELECT c.asset_id, c.hour, least(coalesce((e.hour - c.hour) / 24.0, 30.0), 30.0) AS days
            FROM clean c ASOF LEFT JOIN ev e ON c.asset_id = e.asset_id AND c.hour < e.hour)""",
        """risk0 AS (SELECT c.asset_id, c.hour, coalesce(sum(exp(-abs(c.hour - e.hour) / 360.0)), 0) AS risk
            FROM clean c LEFT JOIN ev e ON e.asset_id = c.asset_id GROUP BY c.asset_id, c.hour)""",
        "risk AS (SELECT *, max(risk) OVER (PARTITION BY asset_id) AS top FROM risk0)",
        _SPLIT.format(src="clean"),
    ]
    state = "CASE WHEN rul <= 7 THEN 'CRITICO' WHEN rul <= 15 THEN 'ALERTA' ELSE 'NORMAL' END"
    return with_(ctes, f"""SELECT feats.* EXCLUDE (hour), falla AS falla_30d, {state} AS estado_futuro, {r('rul', 'rul_dias')},
        {r(_SEV, 'severidad_futura')}, {r('days', 'dias_proximo_evento')}, {r('exp(-days / 10.0)', 'proximidad_evento')},
        {r('CASE WHEN top > 0 THEN risk / top ELSE risk END', 'riesgo_acumulativo')}, split
        FROM feats JOIN (SELECT asset_id, hour, falla, rul FROM rul) USING (asset_id, hour) JOIN nxt USING (asset_id, hour)
        JOIN risk USING (asset_id, hour) JOIN (SELECT asset_id, hour, split FROM parts) USING (asset_id, hour)""")


@query("gold_dataset", _gold_sql())
def gold_dataset(spark, sf):
    return gold_table(spark, sf)


@query(
    "gold_partitions",
    with_([*TO_CLEAN, *_EV, _SPLIT.format(src="rul")], f"""SELECT split, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month,
        count(*) AS registros, {r('avg(falla)', 'tasa_fallas')} FROM parts GROUP BY ALL"""),
)
def gold_partitions(spark, sf):
    path = fresh_dir(spark, "gold")
    tables.write_gold(gold_table(spark, sf), path)
    back = tables.read_gold(spark, path, split="train").unionByName(tables.read_gold(spark, path, split="validation"))
    return back.groupBy("split", F.col("year").cast("int").alias("year"), F.col("month").cast("int").alias("month")).agg(
        F.count(F.lit(1)).alias("registros"), F.avg("falla_30d").alias("tasa_fallas")
    )


@query(
    "snapshot_export",
    with_([*TO_CLEAN, _SPLIT.format(src="clean")], f"SELECT asset_id, count(*) AS registros, {', '.join(r(f'sum({c})', c) for c in SIGNALS)} FROM parts GROUP BY asset_id"),
)
def snapshot_export(spark, sf):
    """Two time-stamped exports; the newest one is found and read (CSV first)."""
    folder = fresh_dir(spark, "snapshots")
    for stamp, source in (("20240101_0000", panel(spark, sf)), ("20240201_0000", clean(spark, sf))):
        tables.export_snapshot(ds.temporal_split(source), folder, stamp)
    back = tables.newest_snapshot(spark, folder)
    return back.groupBy(F.col("asset_id").cast("bigint").alias("asset_id")).agg(
        F.count(F.lit(1)).alias("registros"), *[F.sum(c).alias(c) for c in SIGNALS]
    )


# ---- model preparation ------------------------------------------------------------------------------------------

_PANEL_TS = f"pts AS (SELECT *, {hour_ts('hour')} AS ts FROM panel)"
_MED = ", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in SIGNALS)


@query(
    "median_impute",
    with_([*TO_PANEL, _PANEL_TS, _SPLIT.format(src="pts"), f"med AS (SELECT {_MED} FROM parts WHERE split = 'train')"],
          f"SELECT p.asset_id, p.ts, {', '.join(r(f'coalesce(p.{c}, med.{c})', c) for c in SIGNALS)} FROM parts p, med"),
)
def median_impute(spark, sf):
    d = ds.temporal_split(panel(spark, sf))
    med = prep.train_medians(d.where("split = 'train'"), SIGNALS)
    return prep.impute_medians(d, med).drop("split")


@query(
    "scale_on_normal",
    with_([*TO_SILVER, f"sc AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in SIGNALS)} FROM silver WHERE estado_operacional = 'NORMAL')"],
          f"SELECT asset_id, ts, {', '.join(r(f'({c} - m_{c}) / (CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END)', c) for c in SIGNALS)} FROM silver, sc"),
)
def scale_on_normal(spark, sf):
    d = silver(spark, sf)
    return prep.scale(d, prep.fit_scaler(d, SIGNALS, F.col("estado_operacional") == "NORMAL")).select("asset_id", "ts", *SIGNALS)


@query(
    "label_encode",
    with_(TO_SILVER, """SELECT estado_operacional, CAST(dense_rank() OVER (ORDER BY estado_operacional) - 1 AS INTEGER) AS label_id,
        CASE WHEN estado_operacional <> 'NORMAL' THEN 1 ELSE 0 END AS y, count(*) AS registros FROM silver GROUP BY estado_operacional"""),
)
def label_encode(spark, sf):
    d, _ = prep.encode_labels(silver(spark, sf), "estado_operacional")
    normal = prep.normal_class(d, "estado_operacional")
    d = d.withColumn("y", (F.col("estado_operacional") != normal).cast("int"))
    return d.groupBy("estado_operacional", "label_id", "y").agg(F.count(F.lit(1)).alias("registros"))


_SEQ_W = "OVER (PARTITION BY asset_id ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"


@query(
    "lookback_sequences",
    with_(TO_CLEAN, f"""SELECT asset_id, ts, CAST(n AS INTEGER) AS steps, {r('first_oil', 'first_oil')}, {r('last_cur', 'last_cur')}, {r('sum_oil', 'sum_oil')} FROM (
        SELECT asset_id, ts, count(*) {_SEQ_W} AS n, first_value({OIL}) {_SEQ_W} AS first_oil, {CUR} AS last_cur, sum({OIL}) {_SEQ_W} AS sum_oil,
        row_number() OVER (PARTITION BY asset_id ORDER BY ts) AS rn, count(*) OVER (PARTITION BY asset_id) AS total FROM clean)
        WHERE n = 24 AND rn <= total - 12"""),
)
def lookback_sequences(spark, sf):
    d = prep.sequences(clean(spark, sf), [OIL, CUR])
    return d.select(
        "asset_id", "ts", F.size("seq").alias("steps"), F.col("seq")[0][0].alias("first_oil"),
        F.element_at("seq", -1)[1].alias("last_cur"), F.aggregate("seq", F.lit(0.0), lambda a, x: a + x[0]).alias("sum_oil"),
    )
