"""Gold to a trained anomaly model: preparation, two scorers, thresholds, alert policy, explanations."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridpulse.catalog import DEFAULT_PARAMS, Params
from gridpulse.functions.columns import min_max_scale, weighted_score
from gridpulse.models import evaluate
from gridpulse.models.explain import surrogate_importances
from gridpulse.models.iforest import Forest, feature_vector, fit_forest
from gridpulse.models.prep import encode_labels, fit_scaler, impute_medians, normal_class, scale, train_medians
from gridpulse.models.reconstruction import Reconstruction
from gridpulse.models.windows import fit_windows, window_errors
from gridpulse.operators.dataset import TRAIN, select_columns
from gridpulse.operators.ranking import exact_quantiles
from gridpulse.operators.series import HOURLY, Series
from gridpulse.sources.store import materialize

TARGET = "estado_futuro"


@dataclass
class TrainedModel:
    columns: list[str]
    medians: dict[str, float]
    scaler: dict[str, tuple[float, float]]
    recon: Reconstruction
    forest: Forest
    meta: dict = field(default_factory=dict)
    evaluation: DataFrame | None = None
    importances: DataFrame | None = None
    forest_evaluation: DataFrame | None = None

    def prepare(self, df: DataFrame) -> DataFrame:
        return scale(impute_medians(df, self.medians), self.scaler)

    def save(self, path: str) -> None:
        """Parameters as JSON rows, component and node tables as Parquet, evaluation rows as Parquet."""
        spark = self.forest.nodes.sparkSession
        params = {
            "columns": self.columns, "medians": self.medians, "scaler": self.scaler, "meta": self.meta,
            "steps": self.recon.steps, "sample": self.forest.sample,
        }
        spark.createDataFrame([(json.dumps(params),)], "params string").write.mode("overwrite").json(f"{path}/params")
        self.recon.to_frame(spark).write.mode("overwrite").parquet(f"{path}/components")
        self.forest.nodes.write.mode("overwrite").parquet(f"{path}/forest")
        if self.evaluation is not None:
            self.evaluation.write.mode("overwrite").parquet(f"{path}/evaluation")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "TrainedModel":
        params = json.loads(spark.read.json(f"{path}/params").first()["params"])
        weights = spark.read.parquet(f"{path}/components").toPandas()  # window width x components
        mean = weights[weights["component"] == -1].sort_values("position")["weight"].to_numpy()
        table = weights[weights["component"] >= 0].pivot(index="position", columns="component", values="weight")
        recon = Reconstruction(params["columns"], params["steps"], mean, table.sort_index().to_numpy(dtype=float))
        forest = Forest(spark.read.parquet(f"{path}/forest"), params["sample"])
        scaler = {c: tuple(v) for c, v in params["scaler"].items()}
        return TrainedModel(params["columns"], params["medians"], scaler, recon, forest, params["meta"])


def train(gold: DataFrame, p: Params = DEFAULT_PARAMS, components: int = 8, ae_only: bool = True,
          windows: str = "positions", s: Series = HOURLY) -> TrainedModel:
    """Fit both scorers on the normal training rows and evaluate them on the validation rows.

    windows="positions" forms training windows over the positions of each asset's normal rows, whatever hours lie
    between them; windows="consecutive" only where the hours follow each other. The forest's own metrics rest on all
    validation rows, those of the reconstruction and of the ensemble on the rows that close a window.
    """
    if windows not in ("positions", "consecutive"):
        raise ValueError(f"windows: {windows}")
    key = [*s.keys, s.time]
    cols = select_columns(gold, p)
    raw = gold.select(*key, "split", TARGET, *cols)
    medians = train_medians(raw.where(F.col("split") == TRAIN), cols)
    filled = materialize(impute_medians(raw, medians), "model-input")
    encoded, classes = encode_labels(filled, TARGET)
    normal = normal_class(encoded.where(F.col("split") == TRAIN), TARGET)
    is_normal = F.col(TARGET) == normal
    train_normal = encoded.where((F.col("split") == TRAIN) & is_normal)

    scaler = fit_scaler(train_normal, cols)
    scaled = scale(encoded, scaler).withColumn("y", (~is_normal).cast("int"))
    valid = scaled.where(F.col("split") != TRAIN)
    normal_scaled = materialize(
        scaled.where((F.col("split") == TRAIN) & is_normal).select(*key, *cols), "normal-scaled"
    )

    # a window repeats its rows `lookback` times, so none is built: the normal rows are read once to fit, once for the errors
    gaps = windows == "positions"
    recon = fit_windows(normal_scaled, cols, components, p.lookback, p.horizon_shift, gaps, s)
    err_train = materialize(window_errors(normal_scaled, recon, p.horizon_shift, gaps, s).select(*key, "recon_error"), "errors-train")
    err_valid = window_errors(valid, recon, p.horizon_shift, s=s).select(*key, "recon_error", "per_feature")

    forest = fit_forest(feature_vector(normal_scaled, cols).select(*key, "features"), key, trees=p.trees, seed=p.seed)
    if_train = materialize(
        forest.scores(feature_vector(normal_scaled, cols).select(*key, "features")).select(*key, "if_score"), "if-train"
    )
    if_valid = materialize(
        forest.scores(feature_vector(valid, cols).select(*key, "y", "features")).select(*key, "y", "if_score"), "if-valid"
    )

    def low_high(df, c):
        r = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi")).first()
        return float(r["lo"]), float(r["hi"])

    ae_lo, ae_hi = low_high(err_train, "recon_error")
    if_lo, if_hi = low_high(if_train, "if_score")
    ae = min_max_scale(F.col("recon_error"), F.lit(ae_lo), F.lit(ae_hi))
    fo = min_max_scale(F.col("if_score"), F.lit(if_lo), F.lit(if_hi))
    both = if_valid.join(err_valid, key)  # windows end at a row, so scores align by time
    joined = both.withColumns({"ae_norm": ae, "if_norm": fo}).withColumn(
        "ens_score", weighted_score(F.col("ae_norm"), F.col("if_norm"), p.alpha)
    )
    joined = joined.withColumn("operate_score", F.col("ae_norm") if ae_only else F.col("ens_score"))
    valid_scores = materialize(joined, "scores-valid")

    meta = {
        "lookback": p.lookback, "horizon_shift": p.horizon_shift, "classes": classes, "normal": normal,
        "normal_id": classes.index(normal), "alpha": p.alpha, "ae_score_min": ae_lo, "ae_score_max": ae_hi,
        "if_score_min": if_lo, "if_score_max": if_hi, "operate_with_ae_only": ae_only,
        "operate_f_beta": p.beta, "operate_precision_target": p.precision_target,
        "smoothing_k": p.smooth_k, "smoothing_m": p.smooth_m, "model_version": "pca_windows_v1",
    }
    for name, frame, col in (("ae", err_train, "recon_error"), ("if", if_train, "if_score")):
        meta[f"{name}_thr_p95"] = exact_quantiles(frame, [col], [0.95]).first()["quantile"]
    for name, frame, col in (("ae", valid_scores, "recon_error"), ("if", if_valid, "if_score"), ("ens", valid_scores, "ens_score")):
        meta.update({f"{name}_{k}": v for k, v in score_metrics(frame, col).items()})
    thr = evaluate.operating_threshold(valid_scores, "operate_score", "y", p.beta, p.precision_target).first()
    meta["operate_thr"] = thr["operate_thr"]

    rows = materialize(evaluation_table(valid_scores, meta["operate_thr"], p, s), "alerts")
    importances = surrogate_importances(
        encoded.select(*key, *cols).join(rows.select(*key, "operate_pred_smooth"), key), cols, "operate_pred_smooth"
    )
    return TrainedModel(cols, medians, scaler, recon, forest, meta, rows, importances, if_valid.withColumnRenamed("y", "y_true"))


def score_metrics(scores: DataFrame, col: str, truth: str = "y") -> dict[str, float]:
    """Area under both curves and the best F2 threshold of one score."""
    table = materialize(evaluate.threshold_table(scores, col, truth), "thresholds")
    return {
        "roc_auc": evaluate.roc_auc(table).first()[0],
        "pr_auc": evaluate.average_precision(table).first()[0],
        "thr_f2": evaluate.best_fbeta(table, 2.0).first()["threshold"],
    }


def evaluation_table(scores: DataFrame, threshold: float, p: Params = DEFAULT_PARAMS, s: Series = HOURLY) -> DataFrame:
    """keys, time, y_true, operate_score, operate_pred_raw, operate_pred_smooth of rows with y and operate_score."""
    flagged = scores.withColumn("operate_pred_raw", (F.col("operate_score") > F.lit(threshold)).cast("int"))
    alerts = evaluate.smooth_alerts(flagged, "operate_pred_raw", p.smooth_k, p.smooth_m, "operate_pred_smooth", s)
    return alerts.select(*s.keys, s.time, F.col("y").alias("y_true"), "operate_score", "operate_pred_raw", "operate_pred_smooth")


def metrics_frame(spark: SparkSession, meta: dict) -> DataFrame:
    return spark.createDataFrame([(json.dumps(meta),)], "meta string")


def model_info(spark: SparkSession, model: TrainedModel) -> DataFrame:
    """One row: version, feature order, and which parts are present."""
    return spark.createDataFrame(
        [(model.meta.get("model_version", "unknown"), model.columns, model.forest is not None, model.recon is not None)],
        "model_version string, feature_order array<string>, forest_loaded boolean, reconstruction_loaded boolean",
    )
