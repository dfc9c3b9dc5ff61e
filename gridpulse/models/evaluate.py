"""Threshold-free and threshold metrics from a table of distinct scores.

Scores are grouped first: equal scores share a threshold, and the table shrinks to (score, positives, negatives).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridpulse.catalog import DEFAULT_PARAMS
from gridpulse.operators.ranking import exact_quantiles, running_totals
from gridpulse.operators.series import HOURLY, Series, over_chunks, rows, with_position


def score_table(df: DataFrame, score: str = "score", truth: str = "y") -> DataFrame:
    y = F.col(truth).cast("int")
    return (
        df.where(F.col(score).isNotNull() & y.isNotNull())
        .groupBy(F.col(score).cast("double").alias("score"))
        .agg(F.sum((y == 1).cast("long")).alias("pos"), F.sum((y != 1).cast("long")).alias("neg"))
    )


def threshold_table(df: DataFrame, score: str = "score", truth: str = "y") -> DataFrame:
    """score, pos, neg, and the counts tp, fp of rows at or above the score."""
    return running_totals(score_table(df, score, truth), "score", ["pos", "neg"], descending=True).withColumnsRenamed(
        {"cum_pos": "tp", "cum_neg": "fp"}
    )


def _precision() -> Column:
    return F.col("tp") / (F.col("tp") + F.col("fp"))


def roc_auc(thresholds: DataFrame) -> DataFrame:
    """Area under the ROC curve; tied scores count half (trapezoid)."""
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / F.lit(2.0)))
    total = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return thresholds.agg(F.try_divide(area, total).alias("roc_auc"))


def average_precision(thresholds: DataFrame) -> DataFrame:
    """Sum of precision weighted by the recall each distinct score adds."""
    weighted = F.sum(F.col("pos") * _precision())
    return thresholds.agg(F.try_divide(weighted, F.sum("pos")).alias("average_precision"))


def min_precision_threshold(thresholds: DataFrame, target: float = DEFAULT_PARAMS.precision_target) -> DataFrame:
    """Lowest score whose rows at or above it reach the precision; the highest score where none does."""
    ok = F.min(F.when(_precision() >= target, F.col("score")))
    return thresholds.agg(F.coalesce(ok, F.max("score")).alias("threshold"))


def best_fbeta(table: DataFrame, beta: float = 2.0, grid: int = 400) -> DataFrame:
    """First of `grid` evenly spaced thresholds with the highest F-beta for score > threshold.

    Each score falls into one grid cell, so the scores are counted per cell and only the grid itself is cumulated.
    Without any positive F-beta the result is beta 0 and an empty threshold.
    """
    spark = table.sparkSession
    seen = table.agg(F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    low, high = (seen["lo"] or 0.0), (seen["hi"] or 0.0)
    lo, hi, step = F.lit(low), F.lit(high), F.lit((high - low) / (grid - 1))

    def at(i: Column) -> Column:
        return F.when(i == grid - 1, hi).otherwise(i * step + lo)

    guess = F.greatest(F.lit(0), F.least(F.lit(grid - 1), F.floor(F.coalesce(F.try_divide(F.col("score") - lo, step), F.lit(0.0)))))
    # number of thresholds below the score: exact comparison around the guessed cell
    below = (guess - 1) + sum(
        ((guess + k >= 0) & (guess + k <= grid - 1) & (at(guess + k) < F.col("score"))).cast("int") for k in (-1, 0, 1)
    ) + (guess == 0).cast("int")
    cells = (
        table.withColumn("cell", below.cast("int"))
        .groupBy("cell")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    # score > threshold i  <=>  at least i + 1 thresholds lie below the score
    axis = spark.range(grid + 1).select(F.col("id").cast("int").alias("cell"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(F.lit(0))
    filled = axis.join(cells, "cell", "left").fillna(0, ["pos", "neg"])  # grid + 1 rows from here on
    counted = filled.select(
        (F.col("cell") - 1).alias("i"), F.sum("pos").over(w).alias("tp"), F.sum("neg").over(w).alias("fp"),
        F.sum("pos").over(every).alias("p"),
    ).where(F.col("i") >= 0)
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("p")), F.lit(0.0))
    b2 = float(beta) * float(beta)
    fb = F.coalesce(F.try_divide((1 + b2) * F.col("precision") * F.col("recall"), b2 * F.col("precision") + F.col("recall")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    best = (
        counted.withColumns({"threshold": at(F.col("i")), "precision": prec, "recall": rec})
        .withColumns({"fbeta": fb, "f1": f1})
        .orderBy(F.col("fbeta").desc(), F.col("i"))
        .limit(1)
    )
    some = F.col("fbeta") > 0
    return best.select(
        "fbeta",
        *[F.when(some, F.col(c)).alias(c) for c in ("threshold", "precision", "recall", "f1")],
    )


def operating_threshold(df: DataFrame, score: str = "score", truth: str = "y", beta: float = DEFAULT_PARAMS.beta,
                        target: float = DEFAULT_PARAMS.precision_target) -> DataFrame:
    """The greater of the F-beta and the minimum-precision threshold."""
    t = threshold_table(df, score, truth)
    f = best_fbeta(t, beta).select(F.col("threshold").alias("thr_fbeta"), "fbeta")
    lowest = min_precision_threshold(t, target).first()["threshold"]
    return f.withColumn("thr_precision", F.lit(lowest).cast("double")).withColumn(
        "operate_thr", F.greatest("thr_fbeta", "thr_precision")
    )


def quantile_threshold(df: DataFrame, score: str = "score", q: float = 0.95) -> DataFrame:
    return exact_quantiles(df, [score], [q]).select(F.col("quantile").alias("threshold"))


def confusion(df: DataFrame, truth: str = "y", predicted: str = "yhat") -> DataFrame:
    """All four cells, also empty ones."""
    y, yh = F.col(truth).cast("int"), F.col(predicted).cast("int")
    one = df.agg(
        *[F.count_if((y == a) & (yh == b)).alias(f"c{a}{b}") for a in (0, 1) for b in (0, 1)]
    )
    cells = F.array(
        *[F.struct(F.lit(a).alias("y_true"), F.lit(b).alias("y_pred"), F.col(f"c{a}{b}").alias("n")) for a in (0, 1) for b in (0, 1)]
    )
    return one.select(F.inline(cells))


def classification_report(df: DataFrame, truth: str = "y", predicted: str = "yhat") -> DataFrame:
    """Precision, recall, F1 and support per class; 0 where a denominator is empty."""
    m = confusion(df, truth, predicted)
    t, p, n = F.col("y_true"), F.col("y_pred"), F.col("n")
    one = m.agg(*[F.sum(F.when((t == a) & (p == b), n)).alias(f"c{a}{b}") for a in (0, 1) for b in (0, 1)])

    def zero(num, den):
        return F.coalesce(F.try_divide(num, den), F.lit(0.0))

    out = []
    for c, name in ((0, "NORMAL"), (1, "NO-NORMAL")):
        hit, support = F.col(f"c{c}{c}"), F.col(f"c{c}{c}") + F.col(f"c{c}{1 - c}")
        prec, rec = zero(hit, F.col(f"c{c}{c}") + F.col(f"c{1 - c}{c}")), zero(hit, support)
        out.append(
            F.struct(
                F.lit(name).alias("clase"), prec.alias("precision"), rec.alias("recall"),
                zero(2 * prec * rec, prec + rec).alias("f1"), support.alias("support"),
            )
        )
    return one.select(F.inline(F.array(*out)))


def smooth_alerts(df: DataFrame, flag: str, k: int = DEFAULT_PARAMS.smooth_k, m: int = DEFAULT_PARAMS.smooth_m,
                  out: str = "alert", s: Series = HOURLY) -> DataFrame:
    """1 where at least k of the last m rows are flagged, whatever hours are missing; fewer rows at the start of a series."""
    at = Series(s.keys, "__at", s.chunk_hours)  # one row position an "hour"
    d = with_position(df, s, "__pos").withColumn("__at", F.timestamp_seconds(F.col("__pos") * 3600))
    return over_chunks(
        d, [lambda w: {out: (F.coalesce(F.sum(flag).over(rows(w, m)), F.lit(0)) >= k).cast("int")}], at, before=m
    ).drop("__pos", "__at")


def decide(score: Column, threshold: Column | float, inclusive: bool = False) -> Column:
    thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    hit = score >= thr if inclusive else score > thr
    return F.when(F.coalesce(hit, F.lit(False)), "ANOMALY").otherwise("NORMAL")
