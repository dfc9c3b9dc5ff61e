"""Thermal and electrical features of the hourly panel.

Each block declares its columns only when its inputs exist. Blocks are collected in stages (a later stage may read an
earlier one), and `build` runs all stages of all blocks over one shuffle and one sort.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add
from typing import Callable

from pyspark.sql import Column, DataFrame, WindowSpec, functions as F

from gridpulse.catalog import DEFAULT_PARAMS, Params
from gridpulse.functions.columns import flag, ratio
from gridpulse.operators.series import HOURLY, Series, over_chunks, rows, running

OIL, HOT, AMBIENT = "temp_oil_value", "temp_spot_hot_value", "temp_ambient_value"
OLTC, BUBBLING = "temp_oil_oltc_value", "temp_bubbling_value"
CURRENT, VOLTAGE, POWER, TAP = "current_load_value", "voltage_value", "power_apparent_value", "tap_position_value"
DAY, WEEK, MONTH = 24, 168, 720

# Column order of the recorded Gold schema.
THERMAL_FEATURES = [
    "gradient_hot_oil", "gradient_normalized", "temp_rise_hot", "temp_rise_oil",
    *[f"{v}_{k}" for v in (OIL, HOT, AMBIENT, OLTC, BUBBLING) for k in ("rate", "accel", "rate_smooth")],
    "thermal_efficiency", "thermal_loading_factor", "thermal_cycles_7d", "thermal_stress_index",
    "overheating_trend", "bubbling_anomaly", "gas_formation_trend",
]
ELECTRICAL_FEATURES = [
    "load_factor_current", "load_factor_power", "overload_indicator", "efficiency_indicator",
    "power_factor_estimated", "relative_losses", "tap_operations_1d", "tap_operations_7d", "tap_operations_30d",
    "tap_deviation_center", "tap_extreme_position", "tap_instability",
    *[f"{v}_{k}" for v in (CURRENT, VOLTAGE, POWER) for k in ("stability", "transient")],
    "electrical_stress_index", "suboptimal_operation", "efficiency_degradation_trend", "efficiency_degradation_accel",
]

Block = list[Callable[[WindowSpec], dict[str, Column]]]


# ---- rolling helpers --------------------------------------------------------------------------------------------

def rolling(agg: Column, x: Column, w: WindowSpec, window: int, min_periods: int) -> Column:
    """Aggregate over the last `window` rows, NULL while fewer than `min_periods` of them hold a value."""
    frame = rows(w, window)
    if min_periods <= 1:
        return agg.over(frame)
    return F.when(F.count(x).over(frame) >= min_periods, agg.over(frame))


def rolling_mean(x: Column, w: WindowSpec, window: int, min_periods: int) -> Column:
    return rolling(F.avg(x), x, w, window, min_periods)


def rolling_std(x: Column, w: WindowSpec, window: int, min_periods: int) -> Column:
    return rolling(F.stddev_samp(x), x, w, window, min_periods)


def totals(cols: list[str], w: WindowSpec) -> dict[str, Column]:
    """Running sum and count of each column inside the chunk.

    A sliding frame is evaluated anew for every row, at a cost of its length. Long means and sums are taken as
    differences of these running totals instead, at the same cost for any length. Totals restart with each chunk, so
    they stay small enough not to lose digits.
    """
    upto = running(w)
    return {
        f"__{k}_{c}": f(F.col(c)).over(upto) for c in cols for k, f in (("sum", F.sum), ("cnt", F.count))
    }


def _last(kind: str, col: str, w: WindowSpec, window: int) -> Column:
    total = F.coalesce(F.col(f"__{kind}_{col}"), F.lit(0))
    return total - F.coalesce(F.lag(f"__{kind}_{col}", window).over(w), F.lit(0))


def total_sum(col: str, w: WindowSpec, window: int) -> Column:
    """Sum over the last `window` rows from running totals; NULL while no value was seen."""
    return F.when(_last("cnt", col, w, window) > 0, _last("sum", col, w, window))


def total_mean(col: str, w: WindowSpec, window: int, min_periods: int) -> Column:
    n = _last("cnt", col, w, window)
    return F.when(n >= min_periods, F.try_divide(_last("sum", col, w, window), n))


def day_moments(cols: list[str], w: WindowSpec) -> dict[str, Column]:
    """Count, mean and squared deviation of the last day, as one struct per column."""
    day = rows(w, DAY)
    return {
        f"__day_{c}": F.struct(
            F.count(c).over(day).alias("n"),
            F.avg(c).over(day).alias("m"),
            (F.var_pop(c).over(day) * F.count(c).over(day)).alias("q"),
        )
        for c in cols
    }


def earlier_days(cols: list[str], w: WindowSpec, days: int) -> dict[str, Column]:
    return {f"__day{k}_{c}": F.lag(f"__day_{c}", DAY * k).over(w) for c in cols for k in range(1, days)}


def day_std(col: str) -> Column:
    n = F.col(f"__day_{col}.n")
    return F.when(n > 1, F.sqrt(F.col(f"__day_{col}.q") / (n - 1)))


def merged_days(cols: list[str], days: int) -> dict[str, Column]:
    """Count and mean over several days, merged from the moments of disjoint day windows."""
    out = {}
    for c in cols:
        parts = [f"__day_{c}", *[f"__day{k}_{c}" for k in range(1, days)]]
        n = reduce(add, [F.coalesce(F.col(f"{x}.n"), F.lit(0)) for x in parts])
        total = reduce(add, [F.coalesce(F.col(f"{x}.n") * F.col(f"{x}.m"), F.lit(0.0)) for x in parts])
        out[f"__n_{c}"], out[f"__mean_{c}"] = n, F.try_divide(total, n)
    return out


def merged_std(col: str, days: int) -> Column:
    """Sample deviation over several days.

    The last 168 rows are seven windows of a day that do not overlap, so the deviation follows from their moments:
    only squares are added, no digits are lost, and no frame longer than a day is evaluated.
    """
    parts = [f"__day_{col}", *[f"__day{k}_{col}" for k in range(1, days)]]
    n, mean = F.col(f"__n_{col}"), F.col(f"__mean_{col}")
    spread = reduce(
        add,
        [
            F.coalesce(F.col(f"{x}.q") + F.col(f"{x}.n") * (F.col(f"{x}.m") - mean) * (F.col(f"{x}.m") - mean), F.lit(0.0))
            for x in parts
        ],
    )
    return F.when(n > 1, F.sqrt(spread / (n - 1)))


def diff(x: Column, w: WindowSpec) -> Column:
    return x - F.lag(x).over(w)


# ---- thermal ----------------------------------------------------------------------------------------------------

def gradients(have: set, p: Params = DEFAULT_PARAMS) -> Block:
    hot, oil, amb = F.col(HOT), F.col(OIL), F.col(AMBIENT)
    out = {}
    if {HOT, OIL} <= have:
        out["gradient_hot_oil"] = hot - oil
        if AMBIENT in have:
            out["gradient_normalized"] = ratio(hot - oil, oil - amb + p.eps)
            out["temp_rise_hot"] = hot - amb
            out["temp_rise_oil"] = oil - amb
    return [lambda w: out]


def inertia(have: set, p: Params = DEFAULT_PARAMS) -> Block:
    temps = [v for v in (OIL, HOT, AMBIENT, OLTC, BUBBLING) if v in have]

    def smooth(w):
        out = {}
        for v in temps:
            rate = F.col(f"{v}_rate")
            out[f"{v}_accel"] = diff(rate, w)
            out[f"{v}_rate_smooth"] = rolling_mean(rate, w, 6, 1)
        return out

    return [lambda w: {f"{v}_rate": diff(F.col(v), w) for v in temps}, smooth]


def thermal_efficiency(have: set, p: Params = DEFAULT_PARAMS) -> Block:
    if not {OIL, CURRENT, AMBIENT} <= have:
        return []
    rise = F.col(OIL) - F.col(AMBIENT)
    return [
        lambda w: {
            "thermal_efficiency": ratio(rise, F.col(CURRENT) + p.eps),
            "thermal_loading_factor": rise / (p.nominal_oil - p.nominal_ambient),
        }
    ]


def thermal_stress(have: set, p: Params = DEFAULT_PARAMS) -> Block:
    if not {HOT, OIL} <= have:
        return []
    index = 0.7 * (F.col(HOT) / p.nominal_hot) + 0.3 * ((F.col(HOT) - F.col(OIL)) / p.gradient_limit)
    return [
        lambda w: {"thermal_stress_index": index, **totals([OIL], w)},
        lambda w: {"overheating_trend": total_mean(OIL, w, MONTH, WEEK) - total_mean(OIL, w, DAY, 12)},
    ]


def bubbling(have: set, p: Params = DEFAULT_PARAMS) -> Block:
    if BUBBLING not in have:
        return []
    x, one = F.col(BUBBLING), [BUBBLING]
    n = F.col(f"__n_{BUBBLING}")

    def stage(w):
        week = F.when(n >= DAY, F.col(f"__mean_{BUBBLING}"))
        return {
            "bubbling_anomaly": (x - week) / (merged_std(BUBBLING, WEEK // DAY) + p.eps),
            "gas_formation_trend": total_mean(BUBBLING, w, MONTH, WEEK) - week,
        }

    return [
        lambda w: {**totals(one, w), **day_moments(one, w)},
        lambda w: earlier_days(one, w, WEEK // DAY),
        lambda w: merged_days(one, WEEK // DAY),
        stage,
    ]


# ---- electrical -------------------------------------------------------------------------------------------------

def load_factors(have: set, p: Params = DEFAULT_PARAMS) -> Block:
    if not {CURRENT, POWER} <= have:
        return []
    kva = p.nominal_mva * 1000.0
    amps = kva / (p.nominal_kv * math.sqrt(3))
    by_current = F.col(CURRENT) / (amps + p.eps)
    by_power = F.col(POWER) / (kva + p.eps)
    return [
        lambda w: {
            "load_factor_current": by_current,
            "load_factor_power": by_power,
            "overload_indicator": flag(
                F.coalesce(by_current > p.overload_limit, F.lit(False))
                | F.coalesce(by_power > p.overload_limit, F.lit(False))
            ),
        }
    ]


def efficiency(have: set, p: Params = DEFAULT_PARAMS) -> Block:
    if not {CURRENT, VOLTAGE, POWER} <= have:
        return []
    power = F.col(POWER)
    expected = (math.sqrt(3) * F.col(VOLTAGE) * F.col(CURRENT)) / 1000.0
    eff = ratio(power, expected + p.eps)
    return [
        lambda w: {
            "efficiency_indicator": eff,
            "power_factor_estimated": ratio(power * p.power_factor, power + p.eps),
            "relative_losses": 1.0 - eff,
        }
    ]


def tap_changer(have: set, p: Params = DEFAULT_PARAMS) -> Block:
    if TAP not in have:
        return []
    tap, step = F.col(TAP), F.col("__tap_step")
    return [
        lambda w: {
            "__tap_step": F.abs(diff(tap, w)),
            "tap_deviation_center": F.abs(tap - p.tap_center),
            "tap_extreme_position": flag((tap <= 2) | (tap >= 15)),
        },
        lambda w: {"tap_instability": rolling_std(step, w, DAY, 1), **totals(["__tap_step"], w)},
        lambda w: {
            f"tap_operations_{n // DAY}d": total_sum("__tap_step", w, n) for n in (DAY, WEEK, MONTH)
        },
    ]


def stability(have: set, p: Params = DEFAULT_PARAMS) -> Block:
    cols = [v for v in (CURRENT, VOLTAGE, POWER) if v in have]
    days = WEEK // DAY

    def daily(w):
        out = earlier_days(cols, w, days)
        for v in cols:
            enough = F.col(f"__day_{v}.n") >= 6
            out[f"{v}_stability"] = F.when(enough, ratio(day_std(v), F.col(f"__day_{v}.m") + p.eps))
            out[f"__step_{v}"] = F.abs(diff(F.col(v), w))
        return out

    def weekly(w):
        full = {v: F.col(f"__n_{v}") >= WEEK for v in cols}
        return {f"{v}_transient": flag(full[v] & (F.col(f"__step_{v}") > merged_std(v, days) * 2)) for v in cols}

    return [lambda w: day_moments(cols, w), daily, lambda w: merged_days(cols, days), weekly]


def electrical_stress(have: set, p: Params = DEFAULT_PARAMS) -> Block:
    """Needs the columns of load_factors and efficiency from the first stage."""
    if not {CURRENT, VOLTAGE, POWER} <= have:
        return []
    load, eff = F.col("load_factor_current"), F.col("efficiency_indicator")
    low_or_high = F.coalesce((load < 0.3) | (load > 1.1), F.lit(False))
    return [
        lambda w: {},
        lambda w: {
            "electrical_stress_index": 0.6 * load + 0.4 * (1.0 - eff),
            "suboptimal_operation": flag(low_or_high | F.coalesce(eff < 0.95, F.lit(False))),
        },
    ]


def degradation(have: set, p: Params = DEFAULT_PARAMS) -> Block:
    if not {CURRENT, VOLTAGE, POWER} <= have:
        return []
    eff, trend = "efficiency_indicator", F.col("efficiency_degradation_trend")
    return [
        lambda w: {},
        lambda w: totals([eff], w),
        lambda w: {"efficiency_degradation_trend": total_mean(eff, w, MONTH, WEEK) - total_mean(eff, w, DAY, 12)},
        lambda w: {"efficiency_degradation_accel": diff(trend, w)},
    ]


THERMAL_BLOCKS = [gradients, inertia, thermal_efficiency, thermal_stress, bubbling]
ELECTRICAL_BLOCKS = [load_factors, efficiency, tap_changer, stability, electrical_stress, degradation]

ROW_BLOCKS = [gradients, thermal_efficiency, load_factors, efficiency]


def build(df: DataFrame, blocks: list = THERMAL_BLOCKS + ELECTRICAL_BLOCKS, p: Params = DEFAULT_PARAMS,
          s: Series = HOURLY) -> DataFrame:
    """Run feature blocks over the panel in one pass. The halo covers the longest frame plus two chained differences.

    Blocks made of row formulas alone need no window and are a plain projection.
    """
    have = set(df.columns)
    made = [block(have, p) for block in blocks]
    if all(block in ROW_BLOCKS for block in blocks):
        return df.withColumns({name: expr for b in made for step in b for name, expr in step(None).items()})

    def stage(i):
        return lambda w: {name: expr for b in made if i < len(b) for name, expr in b[i](w).items()}

    depth = max((len(b) for b in made), default=0)
    out = over_chunks(df, [stage(i) for i in range(depth)], s, before=MONTH + 2)
    return out.drop(*[c for c in out.columns if c.startswith("__")])


# ---- generic lags and rolling statistics ------------------------------------------------------------------------

def lag_features(df: DataFrame, cols: list[str], lags=DEFAULT_PARAMS.lags, s: Series = HOURLY) -> DataFrame:
    return over_chunks(
        df, [lambda w: {f"{c}_lag_{n}h": F.lag(c, n).over(w) for c in cols for n in lags}], s, before=max(lags)
    )


def _levels(windows: tuple[int, ...], base: int = DAY, most: int = 12) -> dict[int, list[tuple[int, int]]]:
    """Window -> its tiles (shorter window, rows back); windows of at most `base` rows have none and are plain frames.

    A window is tiled by the longest ones before it without overlap. Where that takes more than `most` of them, a
    window in between is added.
    """
    plain, made = {n for n in windows if n <= base} | {base}, {}
    todo = sorted(n for n in set(windows) if n > base)
    while todo:
        n, known = todo.pop(0), sorted(plain | set(made), reverse=True)
        if n // known[0] > most:
            todo = sorted({n, known[0] * most, *todo})
            continue
        tiles, back = [], 0
        for size in known:
            while back + size <= n:
                tiles.append((size, back))
                back += size
        if back < n:
            plain.add(n - back)
            tiles.append((n - back, back))
        made[n] = tiles
    return {**{n: [] for n in sorted(plain)}, **made}


def _merged(parts: list[str], out: str) -> list[dict[str, str]]:
    """Count, mean, squared deviation and extrema of disjoint frames taken together, in two steps."""
    total = " + ".join(f"coalesce({p}.n * {p}.m, 0D)" for p in parts)
    spread = " + ".join(f"coalesce({p}.q + {p}.n * ({p}.m - {out}_m) * ({p}.m - {out}_m), 0D)" for p in parts)
    many = " + ".join(f"coalesce({p}.n, 0)" for p in parts)
    low, high = (", ".join(f"{p}.{k}" for p in parts) for k in ("lo", "hi"))
    whole = f"named_struct('n', {out}_n, 'm', {out}_m, 'q', {spread}, 'lo', least({low}), 'hi', greatest({high}))"
    return [{f"{out}_n": many, f"{out}_m": f"try_divide({total}, {many})"}, {out: whole}]


def rolling_stats(df: DataFrame, cols: list[str], windows=DEFAULT_PARAMS.rolling_windows, min_periods: int = 1,
                  s: Series = HOURLY) -> DataFrame:
    """Mean, sample deviation, minimum and maximum over each window.

    Only frames of up to a day are evaluated row by row. A longer window is tiled by shorter ones that end earlier: its
    moments are merged and its extrema compared, so its cost is that of a few lags, whatever its length. Expressions
    are SQL text, as there are hundreds of them.
    """
    levels = _levels(tuple(windows))
    order = f"PARTITION BY {', '.join(f'`{k}`' for k in s.by_chunk)} ORDER BY `{s.time}`"
    name = lambda c, n, back=0: f"`__w{n}_{back}_{c}`"
    step = lambda made: lambda w: {k.replace("`", ""): F.expr(e) for k, e in made.items()}
    base = [n for n, tiles in levels.items() if not tiles]

    def plain(c: str, n: int) -> str:
        frame = f"OVER ({order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        return (f"named_struct('n', count(`{c}`) {frame}, 'm', avg(`{c}`) {frame}, 'q', var_pop(`{c}`) {frame} * count(`{c}`) {frame}, "
                f"'lo', min(`{c}`) {frame}, 'hi', max(`{c}`) {frame})")

    stages = [step({name(c, n): plain(c, n) for c in cols for n in base})]
    have, lagged = set(base), set()
    while ready := {n: t for n, t in levels.items() if n not in have and {size for size, _ in t} <= have}:
        shifts = {x for t in ready.values() for x in t if x[1]} - lagged
        stages.append(step({name(c, n, b): f"lag({name(c, n)}, {b}) OVER ({order})" for c in cols for n, b in sorted(shifts)}))
        merged = [_merged([name(c, *x) for x in t], f"__w{n}_0_{c}") for c in cols for n, t in ready.items()]
        stages += [step({out: e for m in merged for out, e in m[k].items()}) for k in (0, 1)]
        have, lagged = have | set(ready), lagged | shifts

    results = {}
    for c in cols:
        for n in windows:
            x = name(c, n)
            kinds = {"mean": f"{x}.m", "std": f"if({x}.n > 1, sqrt({x}.q / ({x}.n - 1)), NULL)", "min": f"{x}.lo", "max": f"{x}.hi"}
            results |= {f"{c}_{k}_{n}h": f"if({x}.n >= {min_periods}, {v}, NULL)" for k, v in kinds.items()}
    helpers = [name(c, n).strip("`") for c in cols for n in levels] + [name(c, n, b).strip("`") for c in cols for n, b in lagged]
    helpers += [f"__w{n}_0_{c}_{k}" for c in cols for n, tiles in levels.items() if tiles for k in "nm"]
    return over_chunks(df, [*stages, step(results)], s, before=max(windows), drop=helpers)
