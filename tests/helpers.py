"""Small synthetic series and brute-force restatements used by the tests."""

from __future__ import annotations

import numpy as np
import pandas as pd

from gridpulse.catalog import SIGNALS
from gridpulse.operators.series import Series

SHORT = Series(chunk_hours=50)
HOUR = pd.Timedelta(hours=1)


def panel_pdf(n: int = 300, assets: int = 2, seed: int = 1, gaps: float = 0.0) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    frames = []
    for a in range(assets):
        t = np.arange(n)
        pdf = pd.DataFrame({"asset_id": a, "ts": pd.Timestamp("2024-01-01") + t * HOUR})
        wave = np.sin(t / 24 * 2 * np.pi)
        pdf["temp_oil_value"] = np.round(55 + 12 * wave + rng.normal(0, 3, n), 3)
        pdf["temp_oil_oltc_value"] = np.round(45 + 5 * wave + rng.normal(0, 2, n), 3)
        pdf["temp_ambient_value"] = np.round(25 + 10 * wave + rng.normal(0, 2, n), 3)
        pdf["temp_bubbling_value"] = np.round(130 + rng.normal(0, 6, n), 3)
        pdf["temp_spot_hot_value"] = np.round(pdf["temp_oil_value"] + 12 + rng.normal(0, 8, n), 3)
        pdf["voltage_value"] = np.round(130 + rng.normal(0, 3, n), 3)
        pdf["current_load_value"] = np.round(1100 + 500 * wave + rng.normal(0, 150, n), 3)
        pdf["power_apparent_value"] = np.round(25 + 10 * wave + rng.normal(0, 2, n), 3)
        pdf["tap_position_value"] = rng.integers(0, 18, n).astype(float)
        if gaps:
            for c in SIGNALS:
                pdf.loc[rng.random(n) < gaps, c] = np.nan
        frames.append(pdf)
    return pd.concat(frames, ignore_index=True)


def to_spark(spark, pdf: pd.DataFrame):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(pdf)
    return df.select(*[F.nanvl(c, F.lit(None).cast("double")).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def collect(df, by=("asset_id", "ts")) -> pd.DataFrame:
    return df.toPandas().sort_values(list(by)).reset_index(drop=True)


def same(got: pd.Series, want: pd.Series, tol: float = 1e-6):
    g, w = got.astype(float).to_numpy(), np.asarray(want, dtype=float)
    assert (np.isnan(g) == np.isnan(w)).all(), (np.isnan(g).sum(), np.isnan(w).sum())
    ok = ~np.isnan(g)
    np.testing.assert_allclose(g[ok], w[ok], rtol=tol, atol=tol)
