"""Batch scoring with a trained model: newest window per asset, or all given rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridpulse.functions.columns import batch_scale, min_max_scale, weighted_score
from gridpulse.models.evaluate import decide
from gridpulse.models.iforest import feature_vector
from gridpulse.models.prep import sequences
from gridpulse.operators.dataset import align_columns
from gridpulse.operators.series import HOURLY, Series, latest_rows
from gridpulse.plans.training import TrainedModel


def score_latest_window(gold: DataFrame, model: TrainedModel, s: Series = HOURLY) -> DataFrame:
    """(keys, time, score, pred, label, basis, model_version): the newest `lookback` rows of each asset as one window.

    An asset with fewer rows has a row of its newest time with a NULL score, no alarm and basis `too_short`.
    """
    meta = model.meta
    steps = model.recon.steps
    recent = latest_rows(align_columns(gold, model.columns, (*s.keys, s.time)), steps, s)
    windows = sequences(model.prepare(recent), model.columns, steps, 0, allow_gaps=True, s=s)
    newest = recent.groupBy(*s.keys).agg(F.max(s.time).alias(s.time))
    scored = newest.join(model.recon.errors(windows), [*s.keys, s.time], "left")
    score = min_max_scale(F.col("recon_error"), F.lit(meta["ae_score_min"]), F.lit(meta["ae_score_max"]))
    return scored.select(
        *s.keys,
        s.time,
        score.alias("score"),
        F.coalesce(score > F.lit(meta["operate_thr"]), F.lit(False)).cast("int").alias("pred"),
        decide(score, meta["operate_thr"]).alias("label"),
        F.when(F.col("recon_error").isNull(), "too_short").otherwise("window").alias("basis"),
        F.lit(meta.get("model_version", "unknown")).alias("model_version"),
    )


def score_rows(df: DataFrame, model: TrainedModel, threshold: float = 0.6, weight: float = 0.5,
               within_batch: bool = False, s: Series = HOURLY) -> DataFrame:
    """Both scores per row, scaled with the trained bounds (or within the batch), averaged and labelled.

    The reconstruction part needs a full window of consecutive hours. `basis` says what a score rests on: `both`, or
    `forest` for rows that close no such window; only scores of one basis are comparable.
    """
    key = [*s.keys, s.time]
    x = model.prepare(align_columns(df, model.columns, (*s.keys, s.time)))
    forest = model.forest.scores(feature_vector(x, model.columns).select(*key, "features")).select(*key, "if_score")
    recon = model.recon.errors(sequences(x, model.columns, model.recon.steps, 0, s=s)).select(*key, "recon_error")
    both = forest.join(recon, key, "left")
    scaled = min_max_scale
    if within_batch:
        scaled = batch_scale
        bounds = both.agg(F.min("if_score"), F.max("if_score"), F.min("recon_error"), F.max("recon_error")).first()
        il, ih, al, ah = (F.lit(v).cast("double") for v in bounds)
    else:
        il, ih, al, ah = (F.lit(model.meta[k]) for k in ("if_score_min", "if_score_max", "ae_score_min", "ae_score_max"))
    s_if = scaled(F.col("if_score"), il, ih)
    s_ae = scaled(F.col("recon_error"), al, ah)
    score = F.coalesce(weighted_score(s_ae, s_if, weight), s_if)
    basis = F.when(s_ae.isNull(), "forest").otherwise("both")
    return both.select(*key, "if_score", "recon_error", score.alias("score"), basis.alias("basis"), decide(score, threshold, True).alias("label"))


def score_table_file(spark, path: str, model: TrainedModel, newest: int | None = None, s: Series = HOURLY, **kw) -> DataFrame:
    """Score a Parquet table: all rows, or the `newest` of each asset where that is asked for."""
    df = spark.read.parquet(path)
    return score_rows(df if newest is None else latest_rows(df, newest, s), model, s=s, **kw)
