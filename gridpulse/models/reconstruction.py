"""Reconstruction model on lookback windows: principal components of normal operation.

A linear stand-in for a neural autoencoder with the same contract: vector in, reconstruction out, mean squared error
as the score. Fitting uses the distributed PCA of Spark ML; its matrix depends on the width of a window only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


@dataclass
class Reconstruction:
    features: list[str]
    steps: int
    mean: np.ndarray
    components: np.ndarray

    def errors(self, df: DataFrame, seq: str = "seq") -> DataFrame:
        """Add per_feature (squared error averaged over time) and recon_error (averaged over features as well)."""
        mean, comp, steps = self.mean, self.components, self.steps

        @F.pandas_udf("array<double>")
        def by_feature(batch: pd.Series) -> pd.Series:
            if not len(batch):
                return pd.Series([], dtype=object)
            x = np.stack([np.asarray(v, dtype=float) for v in batch]) - mean
            err = (x - (x @ comp) @ comp.T) ** 2
            return pd.Series(list(err.reshape(len(x), steps, -1).mean(axis=1)))

        d = df.withColumn("per_feature", by_feature(F.flatten(seq)))
        total = F.aggregate("per_feature", F.lit(0.0), lambda acc, v: acc + v)
        return d.withColumn("recon_error", total / F.size("per_feature"))

    def to_frame(self, spark) -> DataFrame:
        """(component, index, weight) rows plus the mean as component -1."""
        rows = [(-1, i, float(v)) for i, v in enumerate(self.mean)]
        rows += [(j, i, float(v)) for i, line in enumerate(self.components) for j, v in enumerate(line)]
        return spark.createDataFrame(rows, "component int, position int, weight double")


def fit_reconstruction(seqs: DataFrame, features: list[str], k: int = 8, seq: str = "seq") -> Reconstruction:
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    vec = seqs.select(array_to_vector(F.flatten(seq)).alias("x"))
    first = vec.select(Summarizer.metrics("mean", "count").summary(F.col("x")).alias("r")).first()["r"]
    mean = first["mean"].toArray()
    k = min(k, len(mean))
    pc = PCA(k=k, inputCol="x", outputCol="z").fit(vec).pc.toArray()
    return Reconstruction(list(features), len(mean) // len(features), mean, pc)


def feature_contributions(errors: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """(keys, feature, contribution) rows from the per_feature arrays."""
    names = F.array(*[F.lit(f) for f in features])
    return errors.select(*keys, F.posexplode("per_feature").alias("i", "contribution")).select(
        *keys, F.element_at(names, F.col("i") + 1).alias("feature"), "contribution"
    )
