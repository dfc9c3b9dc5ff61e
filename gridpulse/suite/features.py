"""Checked queries: thermal, electrical and generic features."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gridpulse.catalog import SIGNALS
from gridpulse.operators import features as ft
from gridpulse.operators.peaks import peak_counts
from gridpulse.operators.rules import unstable_regulation
from gridpulse.suite.base import clean, query
from gridpulse.suite.sql import TO_CLEAN, W, diff, lag, r, roll, with_

OIL, HOT, AMB = "temp_oil_value", "temp_spot_hot_value", "temp_ambient_value"
OLTC, BUB = "temp_oil_oltc_value", "temp_bubbling_value"
CUR, VOL, POW, TAP = "current_load_value", "voltage_value", "power_apparent_value", "tap_position_value"
TEMPS = [OIL, HOT, AMB, OLTC, BUB]
ROOT3 = repr(math.sqrt(3))
AMPS = repr(100000.0 / (138.0 * math.sqrt(3)))


def select(cols: dict[str, str], ctes: list[str] = (), src: str = "clean") -> str:
    body = ", ".join(r(e, n) if not n.startswith("#") else f"{e} AS {n[1:]}" for n, e in cols.items())
    return with_([*TO_CLEAN, *ctes], f"SELECT asset_id, ts, {body} FROM {src}")


def block(spark, sf, *blocks):
    d = clean(spark, sf)
    out = ft.build(d, list(blocks))
    return out.select("asset_id", "ts", *[c for c in out.columns if c not in d.columns])


@query(
    "thermal_gradients",
    select({
        "gradient_hot_oil": f"{HOT} - {OIL}",
        "gradient_normalized": f"({HOT} - {OIL}) / ({OIL} - {AMB} + 1e-6)",
        "temp_rise_hot": f"{HOT} - {AMB}",
        "temp_rise_oil": f"{OIL} - {AMB}",
    }),
)
def thermal_gradients(spark, sf):
    return block(spark, sf, ft.gradients)


_RATES = f"rates AS (SELECT *, {', '.join(f'{diff(c)} AS {c}_rate' for c in TEMPS)} FROM clean)"


@query(
    "thermal_inertia",
    select(
        {
            **{f"{c}_rate": f"{c}_rate" for c in TEMPS},
            **{f"{c}_accel": diff(f"{c}_rate") for c in TEMPS},
            **{f"{c}_rate_smooth": roll("avg", f"{c}_rate", 6) for c in TEMPS},
        },
        [_RATES], "rates",
    ),
)
def thermal_inertia(spark, sf):
    return block(spark, sf, ft.inertia)


@query(
    "thermal_efficiency",
    select({"thermal_efficiency": f"({OIL} - {AMB}) / ({CUR} + 1e-6)", "thermal_loading_factor": f"({OIL} - {AMB}) / 25.0"}),
)
def thermal_efficiency(spark, sf):
    return block(spark, sf, ft.thermal_efficiency)


_TREND = f"{roll('avg', OIL, 720, 168)} - {roll('avg', OIL, 24, 12)}"


@query("thermal_stress_index", select({"thermal_stress_index": f"0.7 * ({HOT} / 100.0) + 0.3 * (({HOT} - {OIL}) / 25.0)"}))
def thermal_stress_index(spark, sf):
    return block(spark, sf, ft.thermal_stress).drop("overheating_trend")


@query("overheating_trend", select({"overheating_trend": _TREND}))
def overheating_trend(spark, sf):
    return block(spark, sf, ft.thermal_stress).drop("thermal_stress_index")


@query(
    "bubbling_anomaly",
    select({"bubbling_anomaly": f"({BUB} - {roll('avg', BUB, 168, 24)}) / ({roll('stddev_samp', BUB, 168, 24)} + 1e-6)"}),
)
def bubbling_anomaly(spark, sf):
    return block(spark, sf, ft.bubbling).drop("gas_formation_trend")


@query("gas_formation_trend", select({"gas_formation_trend": f"{roll('avg', BUB, 720, 168)} - {roll('avg', BUB, 168, 24)}"}))
def gas_formation_trend(spark, sf):
    return block(spark, sf, ft.bubbling).drop("bubbling_anomaly")


# Peaks: runs of equal values, their middle when higher than both neighbours, then greedy suppression by height.
_PEAKS = [
    f"steps AS (SELECT asset_id, hour, {OIL} AS x, CASE WHEN {lag(OIL)} = {OIL} THEN 0 ELSE 1 END AS new_run FROM clean)",
    "numbered AS (SELECT *, sum(new_run) OVER (PARTITION BY asset_id ORDER BY hour) AS run FROM steps)",
    "runs AS (SELECT asset_id, run, min(hour) AS a, max(hour) AS b, any_value(x) AS x FROM numbered GROUP BY asset_id, run)",
    """tops AS (SELECT asset_id, (a + b) // 2 AS pos, x FROM (
        SELECT *, lag(x) OVER (PARTITION BY asset_id ORDER BY run) AS p, lead(x) OVER (PARTITION BY asset_id ORDER BY run) AS n FROM runs)
        WHERE p < x AND n < x)""",
    f"means AS (SELECT asset_id, avg({OIL}) AS m, count({OIL}) AS n FROM clean GROUP BY asset_id)",
    """ranked AS (SELECT asset_id, list([pos] ORDER BY x DESC, pos DESC) AS c FROM tops JOIN means USING (asset_id)
        WHERE x >= m AND n > 48 GROUP BY asset_id)""",
    """kept AS (SELECT asset_id, unnest(list_reduce(c, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: abs(y - x[1]) < 12)) > 0
        THEN acc ELSE list_concat(acc, x) END)) AS pos FROM ranked)""",
    "marked AS (SELECT c.asset_id, c.hour, c.ts, CASE WHEN k.pos IS NULL THEN 0 ELSE 1 END AS peak FROM clean c LEFT JOIN kept k ON k.asset_id = c.asset_id AND k.pos = c.hour)",
]


@query("thermal_cycles_7d", select({"thermal_cycles_7d": f"CAST(sum(peak) OVER ({W} ROWS BETWEEN 168 PRECEDING AND CURRENT ROW) AS DOUBLE)"}, _PEAKS, "marked"))
def thermal_cycles_7d(spark, sf):
    return peak_counts(clean(spark, sf).select("asset_id", "ts", OIL)).drop(OIL)


# ---- electrical -------------------------------------------------------------------------------------------------

_LOAD = f"({CUR} / ({AMPS} + 1e-6))"
_LOADP = f"({POW} / (100000.0 + 1e-6))"
_EFF = f"({POW} / (({ROOT3} * {VOL} * {CUR}) / 1000.0 + 1e-6))"


@query(
    "load_factors",
    select({"load_factor_current": _LOAD, "load_factor_power": _LOADP,
            "#overload_indicator": f"CAST(coalesce({_LOAD} > 1.2, false) OR coalesce({_LOADP} > 1.2, false) AS INTEGER)"}),
)
def load_factors(spark, sf):
    return block(spark, sf, ft.load_factors)


@query(
    "efficiency",
    select({"efficiency_indicator": _EFF, "power_factor_estimated": f"({POW} * 0.9) / ({POW} + 1e-6)", "relative_losses": f"1.0 - {_EFF}"}),
)
def efficiency(spark, sf):
    return block(spark, sf, ft.efficiency)


_STEP = f"taps AS (SELECT *, abs({diff(TAP)}) AS step FROM clean)"


@query("tap_operations", select({f"tap_operations_{n // 24}d": roll("sum", "step", n) for n in (24, 168, 720)}, [_STEP], "taps"))
def tap_operations(spark, sf):
    return block(spark, sf, ft.tap_changer).select("asset_id", "ts", *[f"tap_operations_{n}d" for n in (1, 7, 30)])


@query(
    "tap_position_flags",
    select({"tap_deviation_center": f"abs({TAP} - 8.5)", "#tap_extreme_position": f"CAST({TAP} <= 2 OR {TAP} >= 15 AS INTEGER)"}),
)
def tap_position_flags(spark, sf):
    return block(spark, sf, ft.tap_changer).select("asset_id", "ts", "tap_deviation_center", "tap_extreme_position")


@query("tap_instability", select({"tap_instability": roll("stddev_samp", "step", 24)}, [_STEP], "taps"))
def tap_instability(spark, sf):
    return block(spark, sf, ft.tap_changer).select("asset_id", "ts", "tap_instability")


@query(
    "stability",
    select({f"{c}_stability": f"{roll('stddev_samp', c, 24, 6)} / ({roll('avg', c, 24, 6)} + 1e-6)" for c in (CUR, VOL, POW)}),
)
def stability(spark, sf):
    return block(spark, sf, ft.stability).select("asset_id", "ts", *[f"{c}_stability" for c in (CUR, VOL, POW)])


@query(
    "transient",
    select({f"#{c}_transient": f"CAST(coalesce(abs({diff(c)}) > {roll('stddev_samp', c, 168, 168)} * 2, false) AS INTEGER)" for c in (CUR, VOL, POW)}),
)
def transient(spark, sf):
    return block(spark, sf, ft.stability).select("asset_id", "ts", *[f"{c}_transient" for c in (CUR, VOL, POW)])


@query(
    "electrical_stress",
    select({"electrical_stress_index": f"0.6 * {_LOAD} + 0.4 * (1.0 - {_EFF})",
            "#suboptimal_operation": f"CAST(coalesce({_LOAD} < 0.3 OR {_LOAD} > 1.1, false) OR coalesce({_EFF} < 0.95, false) AS INTEGER)"}),
)
def electrical_stress(spark, sf):
    d = block(spark, sf, ft.load_factors, ft.efficiency, ft.electrical_stress)
    return d.select("asset_id", "ts", "electrical_stress_index", "suboptimal_operation")


_EFFS = [
    f"effs AS (SELECT *, {_EFF} AS eff FROM clean)",
    f"trends AS (SELECT *, {roll('avg', 'eff', 720, 168)} - {roll('avg', 'eff', 24, 12)} AS trend FROM effs)",
]


@query(
    "efficiency_degradation",
    select({"efficiency_degradation_trend": "trend", "efficiency_degradation_accel": diff("trend")}, _EFFS, "trends"),
)
def efficiency_degradation(spark, sf):
    d = block(spark, sf, ft.efficiency, ft.degradation)
    return d.select("asset_id", "ts", "efficiency_degradation_trend", "efficiency_degradation_accel")


# ---- generic ----------------------------------------------------------------------------------------------------

@query(
    "lag_features",
    select({f"{c}_lag_{n}h": lag(c, n) for c in SIGNALS for n in (1, 6, 12, 24, 48, 72, 168, 336, 720)}),
)
def lag_features(spark, sf):
    return ft.lag_features(clean(spark, sf), SIGNALS).drop(*SIGNALS)


_KINDS = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}


@query("rolling_stats", select({f"{c}_{k}_{n}h": roll(f, c, n) for c in SIGNALS for n in (24, 72, 168, 720) for k, f in _KINDS.items()}))
def rolling_stats(spark, sf):
    return ft.rolling_stats(clean(spark, sf), SIGNALS).drop(*SIGNALS)


@query(
    "unstable_regulation",
    select({"tap_moves": roll("sum", "step", 24), "#regulacion_inestable": f"CAST(coalesce({roll('sum', 'step', 24)} > 120, false) AS INTEGER)"}, [_STEP], "taps"),
)
def unstable_regulation_query(spark, sf):
    return unstable_regulation(clean(spark, sf).select("asset_id", "ts", TAP), 120.0).drop(TAP)
