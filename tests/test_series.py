"""Chunked windows must equal one window over the whole series, for chunks shorter than frames and gaps."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridpulse.operators import clean, features, labels, peaks
from gridpulse.operators.series import Series, fill_across, latest_rows, with_position
from tests.helpers import SHORT, collect, panel_pdf, same, to_spark


def per_asset(pdf, fn):
    return pd.concat([fn(g.reset_index(drop=True)) for _, g in pdf.groupby("asset_id")], ignore_index=True)


def test_position_and_length(spark):
    pdf = panel_pdf(137)
    got = collect(with_position(to_spark(spark, pdf), SHORT, "pos", "n"))
    assert (got["pos"] == got.groupby("asset_id").cumcount()).all()
    assert (got["n"] == 137).all()


def test_fill_across_chunks(spark):
    pdf = panel_pdf(260, gaps=0.97)
    got = collect(fill_across(to_spark(spark, pdf), {"l": F.col("voltage_value")}, {"f": F.col("voltage_value")}, SHORT))
    same(got["l"], per_asset(pdf, lambda g: g["voltage_value"].ffill()))
    same(got["f"], per_asset(pdf, lambda g: g["voltage_value"].bfill()))


@pytest.mark.parametrize("edges,kw", [("forward", {}), ("both", {"limit_direction": "both"})])
@pytest.mark.parametrize("by", ["time", "position"])
def test_interpolation(spark, edges, kw, by):
    pdf = panel_pdf(260, gaps=0.9)
    got = collect(clean.interpolate(to_spark(spark, pdf), ["temp_oil_value"], by, edges, SHORT))
    want = per_asset(pdf, lambda g: g.set_index("ts")["temp_oil_value"].interpolate(
        method="time" if by == "time" else "linear", **kw))
    same(got["temp_oil_value"], want)


def test_impute_kinds(spark):
    pdf = panel_pdf(220, gaps=0.8)
    got = collect(clean.impute(to_spark(spark, pdf), s=SHORT))
    same(got["tap_position_value"], per_asset(pdf, lambda g: g["tap_position_value"].ffill().bfill()))
    want = per_asset(pdf, lambda g: g.set_index("ts")["voltage_value"].interpolate(method="time", limit_direction="both"))
    same(got["voltage_value"], want)
    assert not got.isna().any().any()


def restated_features(g: pd.DataFrame) -> pd.DataFrame:
    out = pd.DataFrame(index=g.index)
    oil, eff_den = g["temp_oil_value"], np.sqrt(3) * g["voltage_value"] * g["current_load_value"] / 1000 + 1e-6
    rate = oil.diff()
    out["temp_oil_value_accel"] = rate.diff()
    out["temp_oil_value_rate_smooth"] = rate.rolling(6, min_periods=1).mean()
    out["overheating_trend"] = oil.rolling(720, min_periods=168).mean() - oil.rolling(24, min_periods=12).mean()
    b = g["temp_bubbling_value"]
    m = b.rolling(168, min_periods=24).mean()
    out["bubbling_anomaly"] = (b - m) / (b.rolling(168, min_periods=24).std() + 1e-6)
    out["gas_formation_trend"] = b.rolling(720, min_periods=168).mean() - m
    step = g["tap_position_value"].diff().abs()
    out["tap_operations_30d"] = step.rolling(720, min_periods=1).sum()
    out["tap_instability"] = step.rolling(24, min_periods=1).std()
    v = g["voltage_value"]
    out["voltage_value_stability"] = v.rolling(24, min_periods=6).std() / (v.rolling(24, min_periods=6).mean() + 1e-6)
    out["voltage_value_transient"] = (v.diff().abs() > 2 * v.rolling(168).std()).astype(int)
    eff = g["power_apparent_value"] / eff_den
    trend = eff.rolling(720, min_periods=168).mean() - eff.rolling(24, min_periods=12).mean()
    out["efficiency_degradation_accel"] = trend.diff()
    load = g["current_load_value"] / (100000 / (138 * np.sqrt(3)) + 1e-6)
    out["electrical_stress_index"] = 0.6 * load + 0.4 * (1 - eff)
    out["suboptimal_operation"] = ((load < 0.3) | (load > 1.1) | (eff < 0.95)).astype(int)
    return out


def test_features_over_long_series(spark):
    pdf = panel_pdf(1000)
    got = collect(features.build(to_spark(spark, pdf), s=Series(chunk_hours=200)))
    want = per_asset(pdf, restated_features)
    for c in want.columns:
        same(got[c], want[c], 1e-6)
    have = set(got.columns) - set(pdf.columns)
    expected = set(features.THERMAL_FEATURES + features.ELECTRICAL_FEATURES) - {"thermal_cycles_7d"}
    assert have == expected


def test_features_without_inputs(spark):
    pdf = panel_pdf(30)[["asset_id", "ts", "temp_oil_value", "tap_position_value"]]
    got = features.build(to_spark(spark, pdf), s=SHORT)
    assert set(got.columns) - set(pdf.columns) == {
        "temp_oil_value_rate", "temp_oil_value_accel", "temp_oil_value_rate_smooth", "tap_operations_1d",
        "tap_operations_7d", "tap_operations_30d", "tap_deviation_center", "tap_extreme_position", "tap_instability"}


def greedy_peaks(x: np.ndarray, distance: int = 12) -> list[int]:
    found, i, n = [], 1, len(x)
    while i < n - 1:
        j = i
        while j < n - 1 and x[j + 1] == x[i]:
            j += 1
        if j < n - 1 and x[i - 1] < x[i] and x[j + 1] < x[i]:
            found.append((i + j) // 2)
        i = j + 1
    found = [p for p in found if x[p] >= x.mean()]
    kept: list[int] = []
    for p in sorted(found, key=lambda p: (-x[p], -p)):
        if all(abs(p - k) >= distance for k in kept):
            kept.append(p)
    return sorted(kept)


@pytest.mark.parametrize("kind", ["noise", "plateaus", "rising"])
def test_peaks(spark, kind):
    pdf = panel_pdf(400, seed=7)
    if kind == "plateaus":
        pdf["temp_oil_value"] = (pdf["temp_oil_value"] / 6).round() * 6
    if kind == "rising":  # long chains: every second row a candidate, each higher than the one before
        i = pdf.groupby("asset_id").cumcount()
        pdf["temp_oil_value"] = i * 0.5 + (i % 2) * 3.0
    df = to_spark(spark, pdf)
    got = collect(peaks.peak_counts(df, s=SHORT))
    for a, g in pdf.groupby("asset_id"):
        kept = greedy_peaks(g["temp_oil_value"].to_numpy())
        want = [sum(max(0, i - 168) <= p <= i for p in kept) for i in range(len(g))]
        same(got[got["asset_id"] == a]["thermal_cycles_7d"], pd.Series(want))


def test_peaks_count_rows_of_the_non_null_series(spark):
    """Gaps of missing values do not move peaks apart."""
    pdf = panel_pdf(400, seed=9, gaps=0.3)
    got = collect(peaks.peaks(to_spark(spark, pdf), "temp_oil_value", s=SHORT))
    for a, g in pdf.groupby("asset_id"):
        g = g[g["temp_oil_value"].notna()]
        kept = greedy_peaks(g["temp_oil_value"].to_numpy())
        assert got[got["asset_id"] == a]["pos"].tolist() == kept
        assert got[got["asset_id"] == a]["ts"].tolist() == g["ts"].iloc[kept].tolist()


@pytest.mark.parametrize("direction", [1, -1])
def test_peaks_of_twenty_rising_years(spark, direction):
    """One chain over all chunks: every second row a candidate that waits for the next one."""
    n = 20 * 8766
    x = (np.arange(n) * 0.5 + (np.arange(n) % 2) * 3.0)[::direction]
    df = spark.range(n).select(
        F.lit(1).alias("asset_id"), (F.timestamp_seconds(F.lit(1_000_000_800) + 3600 * F.col("id"))).alias("ts"),
        (F.lit(0.5) * (F.col("id") if direction == 1 else n - 1 - F.col("id"))
         + 3.0 * ((F.col("id") if direction == 1 else n - 1 - F.col("id")) % 2)).alias("temp_oil_value"))
    got = collect(peaks.peaks(df, "temp_oil_value"))
    high = np.flatnonzero(x >= x.mean())
    cand = [i for i in range(1, n - 1) if x[i - 1] < x[i] > x[i + 1] and high[0] <= i <= high[-1] and x[i] >= x.mean()]
    kept, last = [], None
    for p in sorted(cand, key=lambda p: -x[p]):  # the chain runs one way, so the last survivor is the nearest
        if last is None or abs(p - last) >= 12:
            kept.append(p)
            last = p
    assert got["pos"].tolist() == sorted(kept)


@pytest.mark.parametrize("seed", range(30))
def test_agreement_of_chunks_equals_greedy_suppression(seed):
    """Tables and their agreement alone, with chunks barely longer than the distance, ties and empty chunks."""
    r = np.random.default_rng(seed)
    distance, chunk = int(r.integers(2, 8)), int(r.integers(16, 25))
    n = 400
    pos = np.flatnonzero(r.random(n) < r.choice([0.05, 0.3, 0.9]))
    height = r.choice([r.integers(0, 4, n), np.arange(n), -np.arange(n), r.integers(0, 1000, n)])[pos].astype(float)
    parts = {}
    for c in sorted(set((pos // chunk).tolist())):
        near = (pos >= c * chunk - distance + 1) & (pos < (c + 1) * chunk + distance - 1)
        parts[c] = peaks._Chunk(pd.DataFrame({"pos": pos[near], "height": height[near], "own": pos[near] // chunk == c}), distance)
    got = [p for c, left, right in peaks._agree([(c, x.table()) for c, x in parts.items()], chunk, distance)
           for p in parts[c].survivors(left, right)]
    kept = []
    for h, p in sorted(zip(height.tolist(), pos.tolist()), reverse=True):
        if all(abs(p - k) >= distance for k in kept):
            kept.append(p)
    assert sorted(got) == sorted(kept)


def test_peaks_need_more_than_48_rows(spark):
    got = collect(peaks.peak_counts(to_spark(spark, panel_pdf(48)), s=SHORT))
    assert got["thermal_cycles_7d"].isna().all()


def restated_labels(g: pd.DataFrame, events: pd.Series) -> pd.DataFrame:
    us = lambda x: x.astype("datetime64[us]").astype("int64").to_numpy()
    t, ev = us(g["ts"]), us(events)
    H, day = 720 * 3600 * 10**6, 86400 * 10**6
    fall, rul, near, risk = [], [], [], []
    for x in t:
        ahead = ev[(ev > x) & (ev <= x + H)]
        fall.append(int(len(ahead) > 0))
        rul.append((ahead.max() - x) / day if len(ahead) else 30.0)
        later = ev[ev > x]
        near.append(min((later.min() - x) / day, 30.0) if len(later) else 30.0)
        risk.append(np.exp(-np.abs(x - ev) / 3.6e9 / 360).sum())
    out = pd.DataFrame({"falla_30d": fall, "rul_dias": rul, "dias_proximo_evento": near, "riesgo_acumulativo": risk})
    top = out["riesgo_acumulativo"].max()
    if top > 0:
        out["riesgo_acumulativo"] /= top
    return out


@pytest.mark.parametrize("share", [0.003, 0.2, 0.0])
def test_labels_against_event_loops(spark, share):
    pdf = panel_pdf(1500, seed=3)
    rng = np.random.default_rng(5)
    pdf["hit"] = (rng.random(len(pdf)) < share).astype(int)
    got = collect(labels.add_labels(to_spark(spark, pdf), F.col("hit") == 1, s=Series(chunk_hours=300)))
    want = per_asset(pdf, lambda g: restated_labels(g, g["ts"][g["hit"] == 1]))
    for c in want.columns:
        same(got[c], want[c], 1e-9)
    later = got["falla_30d"] == 1
    assert (got["rul_dias"][later] >= got["dias_proximo_evento"][later] - 1e-12).all()
    assert got["riesgo_acumulativo"].between(0, 1 + 1e-12).all()


def test_labels_with_events_between_hours(spark):
    pdf = panel_pdf(900, assets=1, seed=4)
    times = pd.Series(pd.to_datetime(["2024-01-05 10:20:30", "2024-01-20 00:00:00", "2024-02-03 23:59:59"]))
    ev = spark.createDataFrame(pd.DataFrame({"asset_id": 0, "ts": times}))
    got = collect(labels.add_labels(to_spark(spark, pdf), events=ev, s=Series(chunk_hours=300)))
    want = restated_labels(pdf, times)
    assert len(got) == len(pdf)
    for c in want.columns:
        same(got[c], want[c], 1e-9)


def test_nearest_policy(spark):
    pdf = panel_pdf(200, assets=1)
    pdf["hit"] = [1 if i in (50, 120) else 0 for i in range(200)]
    got = collect(labels.time_to_event(to_spark(spark, pdf), F.col("hit") == 1, policy="nearest", s=SHORT))
    want = [(50 - i) / 24 if i < 50 else (120 - i) / 24 if i < 120 else 30 for i in range(200)]
    same(got["rul_dias"], pd.Series(want))
    assert got["estado_futuro"].iloc[40] == "CRITICO" and got["estado_futuro"].iloc[150] == "NORMAL"


def test_generic_lags_and_rolling(spark):
    pdf = panel_pdf(180)
    df = to_spark(spark, pdf)
    lag = collect(features.lag_features(df, ["voltage_value"], (1, 72), SHORT))
    same(lag["voltage_value_lag_72h"], per_asset(pdf, lambda g: g["voltage_value"].shift(72)))
    roll = collect(features.rolling_stats(df, ["voltage_value"], (24, 72), 12, SHORT))
    same(roll["voltage_value_std_72h"], per_asset(pdf, lambda g: g["voltage_value"].rolling(72, min_periods=12).std()))
    same(roll["voltage_value_max_24h"], per_asset(pdf, lambda g: g["voltage_value"].rolling(24, min_periods=12).max()))


def test_latest_rows(spark):
    pdf = panel_pdf(60)
    got = collect(latest_rows(to_spark(spark, pdf), 24))
    want = per_asset(pdf, lambda g: g.tail(24))
    assert list(got["ts"]) == list(want["ts"])


def test_attached_facts_beyond_the_broadcast_bound(spark):
    from gridpulse.functions.joins import attach_by_key

    df = spark.range(1000).select(F.when(F.col("id") < 700, 0).otherwise(F.col("id") % 7).alias("k"), "id")
    facts = df.groupBy("k").agg(F.count("*").alias("n")).where("k <> 3")
    small = attach_by_key(df, facts, ["k"])
    large = attach_by_key(df, facts, ["k"], broadcast_bytes=0)
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, small.collect()), key=str) == sorted(map(tuple, large.collect()), key=str)
    assert large.count() == 1000


def test_rolling_features_with_gaps_and_flat_stretches(spark):
    pdf = panel_pdf(900, seed=21)
    i = pdf.groupby("asset_id").cumcount()
    for c in ("temp_bubbling_value", "voltage_value", "tap_position_value", "temp_oil_value"):
        pdf.loc[(i > 300) & (i < 560), c] = 130.0  # a stuck sensor
        pdf.loc[(i % 37 == 5) & (i > 600), c] = np.nan
    got = collect(features.build(to_spark(spark, pdf), s=Series(chunk_hours=250)))
    want = per_asset(pdf, restated_features)
    for c in ("overheating_trend", "gas_formation_trend", "tap_operations_30d", "voltage_value_transient"):
        same(got[c], want[c], 1e-6)
    # inside the stuck stretch the true deviation is 0
    stuck = (i > 300 + 170) & (i < 560)
    assert (got["bubbling_anomaly"][stuck].abs() < 1e-6).all()
    same(got["voltage_value_stability"], want["voltage_value_stability"], 1e-6)
    moving = ~((i > 300) & (i < 740))
    same(got["bubbling_anomaly"][moving], want["bubbling_anomaly"][moving], 1e-6)


@pytest.mark.parametrize("windows", [(24, 72, 168, 720), (1, 2, 25, 100), (1000,), (7,)])
@pytest.mark.parametrize("min_periods", [1, 12])
def test_rolling_stats_of_any_window(spark, windows, min_periods):
    """Tiles of shorter windows equal plain frames, with missing values and chunks shorter than the frames."""
    pdf = panel_pdf(1100, assets=1, seed=11, gaps=0.4)
    got = collect(features.rolling_stats(to_spark(spark, pdf), ["voltage_value"], windows, min_periods, SHORT))
    for n in windows:
        r = pdf["voltage_value"].rolling(n, min_periods=min(min_periods, n))
        enough = pdf["voltage_value"].rolling(n, min_periods=0).count() >= min_periods
        for k in ("mean", "std", "min", "max"):
            same(got[f"voltage_value_{k}_{n}h"], getattr(r, k)().where(enough), 1e-9)


def test_levels_tile_without_overlap():
    for windows in [(24, 72, 168, 720), (5, 99, 100), (8760,), (24 * 365 * 20,)]:
        levels = features._levels(windows)
        assert set(windows) <= set(levels)
        for n, tiles in levels.items():
            assert n <= 24 if not tiles else sum(size for size, _ in tiles) == n and len(tiles) <= 40
            assert [b for _, b in tiles] == [sum(size for size, _ in tiles[:i]) for i in range(len(tiles))]
