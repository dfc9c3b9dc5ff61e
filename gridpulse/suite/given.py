"""Models with given parameters, and what they compute as SQL.

Fitting draws and optimises, which SQL cannot state. Applying a model is plain arithmetic, so the registered queries of the
scorers use the parameters written here: a forest of three small trees, a reconstruction whose components are axes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession

from gridpulse.catalog import SIGNALS
from gridpulse.models.iforest import NODE_SCHEMA, Forest, average_path
from gridpulse.models.reconstruction import Reconstruction
from gridpulse.plans.training import TrainedModel

SAMPLE = 256
NORM = average_path(SAMPLE)

#: (feature, threshold, subtree below, subtree at or above) or a leaf's path length
Tree = tuple | float


def nodes(trees: list[Tree]) -> list[tuple]:
    rows: list[tuple] = []

    def add(tree: int, node: Tree, at: int, free: int) -> int:
        if not isinstance(node, tuple):
            rows.append((tree, at, -1, 0.0, -1, -1, float(node)))
            return free
        feature, cut, low, high = node
        rows.append((tree, at, feature, float(cut), free, free + 1, 0.0))
        after = add(tree, low, free, free + 2)
        return add(tree, high, free + 1, after)

    for t, tree in enumerate(trees):
        add(t, tree, 0, 1)
    return rows


def forest(spark: SparkSession, trees: list[Tree]) -> Forest:
    return Forest(spark.createDataFrame(nodes(trees), NODE_SCHEMA), SAMPLE)


def path_sql(tree: Tree, feature) -> str:
    """Path length of a row; feature(i) names the i-th feature."""
    if not isinstance(tree, tuple):
        return f"CAST({tree} AS DOUBLE)"
    i, cut, low, high = tree
    return f"(CASE WHEN {feature(i)} < {cut} THEN {path_sql(low, feature)} ELSE {path_sql(high, feature)} END)"


def forest_sql(trees: list[Tree], feature) -> str:
    total = " + ".join(path_sql(t, feature) for t in trees)
    return f"power(2.0, -(({total}) / {len(trees)}) / {NORM!r})"


VECTOR_TREES: list[Tree] = [
    (0, 0.0, (5, 0.05, 3.5, 6.25), (1, -0.02, 2.0, 8.5)),
    (10, 0.01, 5.0, (11, 0.0, (12, 0.1, 4.0, 1.0), 9.0)),
    (63, -0.01, (30, 0.0, 7.0, 2.5), 6.0),
]
PANEL_TREES: list[Tree] = [
    (0, 0.1, (5, 0.0, 3.5, 6.25), (1, -0.2, 2.0, 8.5)),
    (4, 0.0, 5.0, (2, 0.0, (6, 0.1, 4.0, 1.0), 9.0)),
    (8, -0.1, (7, 0.0, 7.0, 2.5), 6.0),
]
SCALER = {c: (50.0 + 10 * i, 20.0 + 5 * i) for i, c in enumerate(SIGNALS)}
STEPS = 24
AXES = [STEPS * len(SIGNALS) - len(SIGNALS) + f for f in (0, 3)]  # two signals of the newest row are reproduced exactly
META = {"ae_score_min": 0.5, "ae_score_max": 9.0, "if_score_min": 0.4, "if_score_max": 0.8, "operate_thr": 0.25, "model_version": "given"}


def reconstruction() -> Reconstruction:
    width = STEPS * len(SIGNALS)
    return Reconstruction(SIGNALS, STEPS, np.zeros(width), np.eye(width)[:, AXES])


def model(spark: SparkSession) -> TrainedModel:
    return TrainedModel(SIGNALS, {}, SCALER, reconstruction(), forest(spark, PANEL_TREES), dict(META))


SCALED = "scaled AS (SELECT asset_id, ts, hour, " + ", ".join(f"({c} - {m}) / {sd} AS {c}" for c, (m, sd) in SCALER.items()) + " FROM clean)"


def contribution_sql(i: int, c: str) -> str:
    """Mean squared error of a signal over the window that closes at a row."""
    newest = f" - power({c}, 2)" if AXES[0] % len(SIGNALS) == i or AXES[1] % len(SIGNALS) == i else ""
    frame = f"OVER (PARTITION BY asset_id ORDER BY hour ROWS BETWEEN {STEPS - 1} PRECEDING AND CURRENT ROW)"
    return f"(sum(power({c}, 2)) {frame}{newest}) / {STEPS}"


ERRORS = (
    "errors AS (SELECT asset_id, ts, hour, row_number() OVER (PARTITION BY asset_id ORDER BY hour) AS rn, count(*) OVER (PARTITION BY asset_id) AS n, "
    + ", ".join(f"{contribution_sql(i, c)} AS e_{c}" for i, c in enumerate(SIGNALS))
    + f", {forest_sql(PANEL_TREES, lambda i: SIGNALS[i])} AS if_score FROM scaled),\n"
    + "scores AS (SELECT *, (" + " + ".join(f"e_{c}" for c in SIGNALS) + f") / {len(SIGNALS)} AS recon_error FROM errors)"
)
