"""Time-to-event labels over the hourly panel.

Events are rows of the panel itself (a flag column) or another table, whose times are merged in as marker rows. No row
is ever joined to its events: every label is a running frame, so cost does not grow with the number of events.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridpulse.catalog import ALERT, CRITICAL, DEFAULT_PARAMS, NORMAL, Params
from gridpulse.functions.joins import attach_by_key
from gridpulse.sources.store import materialize
from gridpulse.operators.series import CHUNK, HOURLY, HOME, Series, by_chunk, fill_across, running, with_halo

MICROS_DAY, MICROS_HOUR = 8.64e10, 3.6e9


def critical_event(df: DataFrame) -> Column:
    """State CRITICO where states exist, severity 2 or more otherwise."""
    if "estado_operacional" in df.columns:
        return F.col("estado_operacional") == CRITICAL
    if "nivel_severidad" in df.columns:
        return F.col("nivel_severidad") >= 2
    return F.lit(False)


def mark_events(panel: DataFrame, events: DataFrame, s: Series = HOURLY) -> DataFrame:
    """Panel rows plus one marker row per event time that is not a panel row; `__row` tells them apart.

    The result has an `is_event` flag. Labels computed on it see events between the hours as well.
    """
    key = [*s.keys, s.time]
    times = events.select(*key).where(F.col(s.time).isNotNull()).distinct().withColumn("is_event", F.lit(True))
    merged = panel.withColumn("__row", F.lit(True)).join(times, key, "full_outer")
    return merged.withColumns(
        {"__row": F.coalesce("__row", F.lit(False)), "is_event": F.coalesce("is_event", F.lit(False))}
    )


def time_to_event(df: DataFrame, event: Column, p: Params = DEFAULT_PARAMS, policy: str = "latest",
                  s: Series = HOURLY) -> DataFrame:
    """Add falla_30d, rul_dias, estado_futuro and severidad_futura.

    policy="latest" measures to the last event inside the horizon (the last one written wins), "nearest" to the first.
    The last event at or before t+H is a running frame shifted ahead, so it is found in linear time.
    """
    horizon = p.horizon_hours
    micros = F.unix_micros(F.col(s.time))
    size = int(horizon * MICROS_HOUR)
    ev = F.when(F.coalesce(event, F.lit(False)), F.col("__us"))
    if policy == "latest":
        ahead = s.ahead().orderBy("__us").rangeBetween(Window.unboundedPreceding, size)
        hit = F.last(ev, ignorenulls=True).over(ahead)
    else:
        back = s.ahead().orderBy(F.col("__us").desc()).rangeBetween(Window.unboundedPreceding, -1)
        hit = F.last(ev, ignorenulls=True).over(back)
    d = with_halo(df, s, 0, horizon + 1).withColumn("__us", micros).withColumn("__hit", hit)
    d = d.where(F.col(CHUNK) == F.col(HOME)).drop(CHUNK, HOME)
    inside = (F.col("__hit") > F.col("__us")) & (F.col("__hit") - F.col("__us") <= size)
    found = F.coalesce(inside, F.lit(False))
    rul = F.when(found, F.greatest(F.lit(0.0), (F.col("__hit") - F.col("__us")) / F.lit(MICROS_DAY))).otherwise(
        F.lit(float(p.horizon_days))
    )
    d = d.withColumns({"falla_30d": found.cast("int"), "rul_dias": rul}).drop("__us", "__hit")
    return with_rul_states(d, p)


def with_rul_states(d: DataFrame, p: Params = DEFAULT_PARAMS) -> DataFrame:
    left = F.col("rul_dias")
    return d.withColumns(
        {
            "estado_futuro": F.when(left <= p.critical_days, CRITICAL).when(left <= p.alert_days, ALERT).otherwise(NORMAL),
            "severidad_futura": F.least(
                F.lit(100.0), F.greatest(F.lit(0.0), F.lit(100.0) * (F.lit(1.0) - left / F.lit(float(p.horizon_days))))
            ),
        }
    )


def next_event(df: DataFrame, event: Column, p: Params = DEFAULT_PARAMS, s: Series = HOURLY) -> DataFrame:
    """Add dias_proximo_evento (nearest event strictly ahead, any distance, capped) and proximidad_evento."""
    mark = F.when(F.coalesce(event, F.lit(False)), F.unix_micros(F.col(s.time)))
    d = fill_across(df, first={"__next": mark}, s=s, strict=True)
    cap = F.lit(float(p.horizon_days))
    days = F.least(F.coalesce((F.col("__next") - F.unix_micros(F.col(s.time))) / F.lit(MICROS_DAY), cap), cap)
    return d.withColumns(
        {"dias_proximo_evento": days, "proximidad_evento": F.exp(-days / F.lit(p.proximity_days))}
    ).drop("__next")


def cumulative_risk(df: DataFrame, event: Column, p: Params = DEFAULT_PARAMS, s: Series = HOURLY,
                    normalize: bool = True) -> DataFrame:
    """Add riesgo_acumulativo: sum over all events of exp(-|distance| / (H/2)), divided by the series maximum.

    The kernel factorises, so inside a chunk two running sums anchored at the chunk replace all row-event pairs.
    Chunks exchange their decayed totals. Terms beyond 745 decay lengths are exactly zero in double precision, which
    bounds how many neighbouring chunks contribute.
    """
    tau = p.horizon_hours / 2.0
    reach = int(math.ceil(745 * tau / s.chunk_hours)) + 1
    start = F.col(CHUNK) * s.chunk_hours
    hours = F.unix_micros(F.col(s.time)) / F.lit(MICROS_HOUR)
    e = F.coalesce(event, F.lit(False)).cast("double")
    d = by_chunk(df, s).withColumns({"__z": (hours - start) / tau, "__e": e})
    size = s.chunk_hours / tau
    totals = d.groupBy(*s.by_chunk).agg(
        F.sum(F.col("__e") * F.exp(F.col("__z") - size)).alias("to_end"),
        F.sum(F.col("__e") * F.exp(-F.col("__z"))).alias("to_start"),
    )
    order = Window.partitionBy(*s.keys).orderBy(CHUNK)
    seen = F.struct(F.col(CHUNK).alias("c"), "to_end", "to_start")
    here = F.col(CHUNK)

    def pull(frame, side, gap):
        items = F.collect_list(seen).over(frame)
        return F.aggregate(items, F.lit(0.0), lambda acc, x: acc + x[side] * F.exp(-(gap(x["c"]).cast("double")) * size))

    carry = totals.select(
        *s.by_chunk,
        pull(order.rangeBetween(-reach, -1), "to_end", lambda c: here - c - 1).alias("__past"),
        pull(order.rangeBetween(1, reach), "to_start", lambda c: c - here - 1).alias("__future"),
    )
    d = d.join(carry, s.by_chunk)
    z = F.col("__z")
    upto = F.sum(F.col("__e") * F.exp(z)).over(running(s.ahead()))
    after = F.coalesce(
        F.sum(F.col("__e") * F.exp(-z)).over(s.back().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)
    )
    risk = F.exp(-z) * (upto + F.col("__past")) + F.exp(z) * after + F.exp(z - size) * F.col("__future")
    d = d.withColumn("riesgo_acumulativo", risk).drop(CHUNK, "__z", "__e", "__past", "__future")
    return scale_to_max(d, "riesgo_acumulativo", s) if normalize else d


def scale_to_max(d: DataFrame, col: str, s: Series = HOURLY) -> DataFrame:
    d = materialize(d, "to-scale")  # both the maximum and the rows are read from it; the labels are computed once
    top = d.groupBy(*s.keys).agg(F.max(col).alias("__top"))
    d = attach_by_key(d, top, list(s.keys))
    return d.withColumn(col, F.when(F.col("__top") > 0, F.col(col) / F.col("__top")).otherwise(F.col(col))).drop("__top")


def add_labels(df: DataFrame, event: Column | None = None, events: DataFrame | None = None,
               p: Params = DEFAULT_PARAMS, policy: str = "latest", s: Series = HOURLY) -> DataFrame:
    """All seven labels.

    Events are a condition on the panel (default: its critical state) or the rows of another table. Without events:
    no failures, full horizon left, no risk.
    """
    if events is not None:
        d = mark_events(df, events, s).withColumnRenamed("is_event", "__ev")
    else:
        d = df.withColumns(
            {"__row": F.lit(True), "__ev": F.coalesce(event if event is not None else critical_event(df), F.lit(False))}
        )
    ev = F.col("__ev")
    d = next_event(time_to_event(d, ev, p, policy, s), ev, p, s)
    d = cumulative_risk(d, ev, p, s, normalize=False).where("__row").drop("__row", "__ev")
    return scale_to_max(d, "riesgo_acumulativo", s)


def label_balance(df: DataFrame, p: Params = DEFAULT_PARAMS) -> DataFrame:
    rate = F.avg(F.col("falla_30d").cast("double"))
    valid = F.avg(F.col("rul_dias").between(0, p.horizon_days).cast("double"))
    return df.agg(
        F.count(F.lit(1)).alias("registros"),
        F.coalesce(rate, F.lit(0.0)).alias("tasa_positivos"),
        F.coalesce(valid, F.lit(1.0)).alias("rul_valido"),
        F.coalesce(F.avg("severidad_futura"), F.lit(0.0)).alias("severidad_media"),
        F.coalesce(F.max("severidad_futura"), F.lit(0.0)).alias("severidad_max"),
    ).withColumn(
        "balance",
        F.when(F.col("tasa_positivos") < 0.01, "POCOS_POSITIVOS")
        .when(F.col("tasa_positivos") > 0.5, "DEMASIADOS_POSITIVOS")
        .otherwise("ADECUADO"),
    )
