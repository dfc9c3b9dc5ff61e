"""A small decision tree that imitates the alerts, for its feature importances."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def surrogate_importances(df: DataFrame, cols: list[str], target: str, depth: int = 3, seed: int = 42) -> DataFrame:
    """(feature, importance) of every feature. A missing value in a feature is an error: impute before."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=cols, outputCol="x", handleInvalid="error").transform(
        df.select(F.col(target).cast("double").alias("label"), *[F.col(c).cast("double").alias(c) for c in cols])
    )
    model = DecisionTreeClassifier(featuresCol="x", labelCol="label", maxDepth=depth, seed=seed).fit(data)
    weights = model.featureImportances.toArray()
    table = df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(cols, weights)], "feature string, importance double")
    return table.orderBy(F.col("importance").desc(), F.col("feature"))
