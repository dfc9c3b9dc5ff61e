"""Checked queries: time-to-event labels. Events: hours with a hot spot of 150 degrees or more."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridpulse.operators import labels as lb
from gridpulse.suite.base import clean, query, silver
from gridpulse.suite.sql import TO_CLEAN, TO_SILVER, r, with_

LIMIT = 150
EVENT = f"temp_spot_hot_value >= {LIMIT}"
_H = 720

_EV = [
    f"ev AS (SELECT asset_id, hour FROM clean WHERE {EVENT})",
    f"""ahead AS (SELECT c.asset_id, c.hour, c.ts,
        (SELECT max(e.hour) FROM ev e WHERE e.asset_id = c.asset_id AND e.hour > c.hour AND e.hour <= c.hour + {_H}) AS latest,
        (SELECT min(e.hour) FROM ev e WHERE e.asset_id = c.asset_id AND e.hour > c.hour AND e.hour <= c.hour + {_H}) AS nearest
        FROM clean c)""",
    "rul AS (SELECT asset_id, hour, ts, CASE WHEN latest IS NULL THEN 0 ELSE 1 END AS falla, coalesce((latest - hour) / 24.0, 30.0) AS rul FROM ahead)",
]
_STATE = "CASE WHEN rul <= 7 THEN 'CRITICO' WHEN rul <= 15 THEN 'ALERTA' ELSE 'NORMAL' END"
_SEV = "least(100.0, greatest(0.0, 100.0 * (1.0 - rul / 30.0)))"
# Nearest later event at any distance.
_NEXT = [
    f"ev AS (SELECT asset_id, hour AS at FROM clean WHERE {EVENT})",
    """nxt AS (SELECT c.asset_id, c.ts, least(coalesce((e.at - c.hour) / 24.0, 30.0), 30.0) AS days
        FROM clean c ASOF LEFT JOIN ev e ON c.asset_id = e.asset_id AND c.hour < e.at)""",
]


def rows(spark, sf):
    return clean(spark, sf).select("asset_id", "ts", (F.col("temp_spot_hot_value") >= LIMIT).alias("ev"))


def timed(spark, sf, **kw):
    return lb.time_to_event(rows(spark, sf), F.col("ev"), **kw).drop("ev")


@query("failure_within_horizon", with_([*TO_CLEAN, *_EV], "SELECT asset_id, ts, falla AS falla_30d FROM rul"))
def failure_within_horizon(spark, sf):
    return timed(spark, sf).select("asset_id", "ts", "falla_30d")


@query("rul_latest", with_([*TO_CLEAN, *_EV], f"SELECT asset_id, ts, {r('rul', 'rul_dias')} FROM rul"))
def rul_latest(spark, sf):
    return timed(spark, sf).select("asset_id", "ts", "rul_dias")


@query("rul_nearest", with_([*TO_CLEAN, *_EV], f"SELECT asset_id, ts, {r('coalesce((nearest - hour) / 24.0, 30.0)', 'rul_dias')} FROM ahead"))
def rul_nearest(spark, sf):
    return timed(spark, sf, policy="nearest").select("asset_id", "ts", "rul_dias")


@query("future_state", with_([*TO_CLEAN, *_EV], f"SELECT {_STATE} AS estado_futuro, count(*) AS registros FROM rul GROUP BY ALL"))
def future_state(spark, sf):
    return timed(spark, sf).groupBy("estado_futuro").agg(F.count(F.lit(1)).alias("registros"))


@query("future_severity", with_([*TO_CLEAN, *_EV], f"SELECT asset_id, ts, {_STATE} AS estado_futuro, {r(_SEV, 'severidad_futura')} FROM rul"))
def future_severity(spark, sf):
    return timed(spark, sf).select("asset_id", "ts", "estado_futuro", "severidad_futura")


@query("days_to_next_event", with_([*TO_CLEAN, *_NEXT], f"SELECT asset_id, ts, {r('days', 'dias_proximo_evento')} FROM nxt"))
def days_to_next_event(spark, sf):
    return lb.next_event(rows(spark, sf), F.col("ev")).select("asset_id", "ts", "dias_proximo_evento")


@query("event_proximity", with_([*TO_CLEAN, *_NEXT], f"SELECT asset_id, ts, {r('exp(-days / 10.0)', 'proximidad_evento')} FROM nxt"))
def event_proximity(spark, sf):
    return lb.next_event(rows(spark, sf), F.col("ev")).select("asset_id", "ts", "proximidad_evento")


@query(
    "cumulative_risk",
    with_(
        [*TO_CLEAN, f"ev AS (SELECT asset_id, hour AS at FROM clean WHERE {EVENT})",
         """risk AS (SELECT c.asset_id, c.ts, coalesce(sum(exp(-abs(c.hour - e.at) / 360.0)), 0) AS risk
            FROM clean c LEFT JOIN ev e ON e.asset_id = c.asset_id GROUP BY c.asset_id, c.ts)"""],
        f"""SELECT asset_id, ts, {r('CASE WHEN max(risk) OVER (PARTITION BY asset_id) > 0 THEN risk / max(risk) OVER (PARTITION BY asset_id) ELSE risk END', 'riesgo_acumulativo')} FROM risk""",
    ),
)
def cumulative_risk(spark, sf):
    return lb.cumulative_risk(rows(spark, sf), F.col("ev")).drop("ev")


@query(
    "label_balance",
    with_([*TO_CLEAN, *_EV], f"""SELECT count(*) AS registros, {r('avg(falla)', 'tasa_positivos')},
        {r('avg(CASE WHEN rul BETWEEN 0 AND 30 THEN 1.0 ELSE 0.0 END)', 'rul_valido')}, {r(f'avg({_SEV})', 'severidad_media')},
        {r(f'max({_SEV})', 'severidad_max')},
        CASE WHEN avg(falla) < 0.01 THEN 'POCOS_POSITIVOS' WHEN avg(falla) > 0.5 THEN 'DEMASIADOS_POSITIVOS' ELSE 'ADECUADO' END AS balance
        FROM rul"""),
)
def label_balance(spark, sf):
    return lb.label_balance(timed(spark, sf))


@query(
    "critical_state_labels",
    with_(
        [*TO_SILVER,
         f"""cs AS (SELECT asset_id, hour, ts, (SELECT max(e.hour) FROM silver e WHERE e.asset_id = s.asset_id
            AND e.estado_operacional = 'CRITICO' AND e.hour > s.hour AND e.hour <= s.hour + {_H}) AS latest FROM silver s)"""],
        f"SELECT asset_id, ts, CASE WHEN latest IS NULL THEN 0 ELSE 1 END AS falla_30d, {r('coalesce((latest - hour) / 24.0, 30.0)', 'rul_dias')} FROM cs",
    ),
)
def critical_state_labels(spark, sf):
    """Events from the operating state of the panel, the default of the pipeline."""
    d = silver(spark, sf).select("asset_id", "ts", "estado_operacional")
    return lb.time_to_event(d, lb.critical_event(d)).select("asset_id", "ts", "falla_30d", "rul_dias")


_RAW = [
    "raw_ev AS (SELECT DISTINCT user_id % 4 AS asset_id, ts AS at FROM events WHERE event_type = 'click' AND value >= 250)",
]


@query(
    "labels_from_event_table",
    with_(
        [*TO_CLEAN, *_RAW,
         """near AS (SELECT c.asset_id, c.ts, e.at FROM clean c ASOF LEFT JOIN raw_ev e ON c.asset_id = e.asset_id AND c.ts < e.at)""",
         """far AS (SELECT c.asset_id, c.ts, e.at FROM clean c ASOF LEFT JOIN raw_ev e ON c.asset_id = e.asset_id AND c.ts + INTERVAL 30 DAY >= e.at)"""],
        f"""SELECT n.asset_id, n.ts, CASE WHEN f.at > f.ts THEN 1 ELSE 0 END AS falla_30d,
            {r('CASE WHEN f.at > f.ts THEN (epoch_us(f.at) - epoch_us(f.ts)) / 86400000000.0 ELSE 30.0 END', 'rul_dias')},
            {r('least(coalesce((epoch_us(n.at) - epoch_us(n.ts)) / 86400000000.0, 30.0), 30.0)', 'dias_proximo_evento')}
            FROM near n JOIN far f ON n.asset_id = f.asset_id AND n.ts = f.ts""",
    ),
)
def labels_from_event_table(spark, sf):
    """Events of another table, at any time between the hours."""
    from gridpulse.sources.driver_tables import table

    ev = table(spark, sf, "events").where((F.col("event_type") == "click") & (F.col("value") >= 250))
    ev = ev.select((F.col("user_id") % 4).alias("asset_id"), F.col("ts").cast("timestamp").alias("ts"))
    d = lb.add_labels(clean(spark, sf).select("asset_id", "ts"), events=ev)
    return d.select("asset_id", "ts", "falla_30d", "rul_dias", "dias_proximo_evento")
