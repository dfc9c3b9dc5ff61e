"""Isolation forest after Liu, Ting and Zhou (2008), grown and applied by Spark tasks.

Every tree sees a random sample of at most `sample` rows, so one task grows one tree from a bounded group. The forest
has at most trees x (2 x sample) nodes whatever the data size; that table is what scoring tasks receive.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

NODE_SCHEMA = "tree int, node int, feature int, threshold double, lower int, upper int, path double"
SAMPLE = 256


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n <= 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


CELLS = 64


def draw_samples(df: DataFrame, features: str, key: list[str], trees: int, sample: int, seed: int, n: int) -> DataFrame:
    """(tree, x): `sample` distinct rows per tree, by one rule at every size.

    Rows lie on a circle by the hash of their key, so a recomputed task draws the same ones. Each tree owns an arc from a
    random start on; the arc is long enough for about 1.5 x `sample` of the n rows (the whole circle where there are
    fewer), and the tree takes the first `sample` rows of it. Arcs overlap by chance, as independent draws do. The circle is
    divided into cells, so that a row meets only the arcs that touch its cell.
    """
    length = min(1.0, (1.5 * sample + 32) / n)
    starts = np.random.default_rng(seed).random(trees)
    touched = []
    for tree, start in enumerate(starts.tolist()):
        first, last = int(start * CELLS), int((start + length) * CELLS)
        touched += [(c % CELLS, tree, start) for c in range(first, min(last, first + CELLS - 1) + 1)]
    arcs = df.sparkSession.createDataFrame(touched, "__cell int, tree int, __start double")  # at most trees x CELLS rows
    at = F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(2**53)) / F.lit(float(2**53))
    offset = F.col("__at") - F.col("__start")
    d = (
        df.withColumn("__at", at).withColumn("__cell", F.floor(F.col("__at") * CELLS).cast("int"))
        .join(F.broadcast(arcs), "__cell")
        .withColumn("__far", F.when(offset < 0, offset + 1).otherwise(offset))
        .where(F.col("__far") < length)
    )
    w = Window.partitionBy("tree").orderBy("__far", *key)
    return d.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= sample).select("tree", F.col(features).alias("x"))


def _grow(seed: int, sample: int):
    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = np.stack([np.asarray(v, dtype=float) for v in pdf["x"]])
        x = x[np.lexsort(x.T)]  # row order must not depend on the shuffle
        rng = np.random.default_rng([seed, tree])
        limit = math.ceil(math.log2(max(sample, 2)))
        nodes, todo, made = [], [(0, x, 0)], 1
        while todo:
            node, part, depth = todo.pop()
            spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(part) > 1 else []
            if depth >= limit or not len(spread):
                nodes.append((tree, node, -1, 0.0, -1, -1, depth + average_path(len(part))))
                continue
            f = int(rng.choice(spread))
            cut = float(rng.uniform(part[:, f].min(), part[:, f].max()))
            left = part[:, f] < cut
            if not left.any():
                left = part[:, f] == part[:, f].min()
                cut = float(np.nextafter(part[:, f].min(), np.inf))
            nodes.append((tree, node, f, cut, made, made + 1, 0.0))
            todo += [(made, part[left], depth + 1), (made + 1, part[~left], depth + 1)]
            made += 2
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "lower", "upper", "path"])

    return grow


@dataclass
class Forest:
    nodes: DataFrame
    sample: int

    def scores(self, df: DataFrame, features: str = "features", out: str = "if_score") -> DataFrame:
        """Add 2^(-mean path / c): in (0, 1], higher is more anomalous."""
        pdf = self.nodes.toPandas().sort_values(["tree", "node"])  # bounded by trees x 2 x sample rows
        width = int(pdf["node"].max()) + 1
        trees = pdf["tree"].nunique()
        rank = pdf["tree"].rank(method="dense").astype(int).to_numpy() - 1
        at = rank * width + pdf["node"].to_numpy()

        def column(name, fill, kind):
            flat = np.full(trees * width, fill, dtype=kind)
            flat[at] = pdf[name].to_numpy()
            return flat

        shipped = df.sparkSession.sparkContext.broadcast(
            (
                column("feature", -1, np.int32), column("threshold", 0.0, float), column("lower", -1, np.int32),
                column("upper", -1, np.int32), column("path", 0.0, float),
            )
        )
        norm = average_path(self.sample) or 1.0

        @F.pandas_udf("double")
        def score(batch: pd.Series) -> pd.Series:
            if not len(batch):
                return pd.Series([], dtype=float)
            feature, threshold, lower, upper, path = shipped.value
            x = np.stack([np.asarray(v, dtype=float) for v in batch])
            total = np.zeros(len(x))
            every = np.arange(len(x))
            for t in range(trees):
                base = t * width
                here = np.full(len(x), base)
                live = every
                while len(live):
                    f = feature[here[live]]
                    live = live[f >= 0]
                    if not len(live):
                        break
                    h = here[live]
                    goes_low = x[live, feature[h]] < threshold[h]
                    here[live] = base + np.where(goes_low, lower[h], upper[h])
                total += path[here]
            return pd.Series(np.power(2.0, -(total / trees) / norm))

        return df.withColumn(out, score(F.col(features)))


def fit_forest(df: DataFrame, key: list[str], features: str = "features", trees: int = 400, sample: int = SAMPLE,
               seed: int = 42) -> Forest:
    """Grow the forest on `df` (scaled rows of normal operation). `key` identifies a row."""
    from gridpulse.sources.store import materialize

    n = df.count()
    if n == 0:
        raise ValueError("no rows to grow the forest from")
    size = min(sample, n)
    picked = draw_samples(df, features, key, trees, size, seed, n)
    nodes = picked.groupBy("tree").applyInPandas(_grow(seed, size), NODE_SCHEMA)
    return Forest(materialize(nodes, "forest"), size)


def feature_vector(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    return df.withColumn(out, F.array(*[F.col(c).cast("double") for c in cols]))
