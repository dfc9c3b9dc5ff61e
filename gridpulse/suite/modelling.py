"""Checked queries: scorers, metrics, decisions, training run, streams."""

from __future__ import annotations

from datetime import timedelta

import numpy as np
from pyspark.sql import functions as F

from gridpulse.catalog import SIGNALS, Params
from gridpulse.functions.columns import min_max_scale, weighted_score
from gridpulse.models import evaluate as ev
from gridpulse.models.explain import surrogate_importances
from gridpulse.models.iforest import draw_samples, fit_forest
from gridpulse.models.prep import scale, sequences
from gridpulse.models.reconstruction import Reconstruction, feature_contributions, fit_reconstruction
from gridpulse.plans.scoring import score_latest_window, score_rows, score_table_file
from gridpulse.plans.training import TrainedModel, evaluation_table, metrics_frame, model_info, score_metrics, train
from gridpulse.session import fresh_dir
from gridpulse.sources.bronze import stored_marks, wrong_marks
from gridpulse.sources.driver_tables import table
from gridpulse.sources.tables import write_report
from gridpulse.streaming.ingest import append_stream, drain, hourly_mean_stream, land_end_marker, ordered_alerts_stream, smooth_alerts_stream, stream_readings
from gridpulse.suite import given
from gridpulse.suite.base import clean, query, readings
from gridpulse.suite.datasets import _SPLIT, gold_table
from gridpulse.suite.labels import _EV
from gridpulse.suite.sql import READINGS, TO_CLEAN, W, r, with_

HOT = "temp_spot_hot_value"

# ---- metrics over a scored table: score = length of a document, truth = its quality label -------------------------

_SCORED = ["scored AS (SELECT doc_id, n_chars AS score, quality AS y, n_chars > 900 AS hit FROM labels JOIN documents USING (doc_id))"]
_ST = "st AS (SELECT score, sum(y) AS pos, count(*) - sum(y) AS neg FROM scored GROUP BY score)"
_TT = "tt AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp FROM st)"
_TO_TT = [*_SCORED, _ST, _TT]


def scored(spark, sf):
    d = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return d.select("doc_id", F.col("n_chars").cast("double").alias("score"), F.col("quality").alias("y"))


@query("threshold_table", with_(_TO_TT, f"SELECT {r('CAST(score AS DOUBLE)', 'score')}, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp FROM tt"))
def threshold_table(spark, sf):
    return ev.threshold_table(scored(spark, sf)).select("score", "tp", "fp")


@query("roc_auc", with_(_TO_TT, f"SELECT {r('sum(neg * (tp - pos / 2.0)) / (CAST(sum(pos) AS DOUBLE) * sum(neg))', 'roc_auc')} FROM tt"))
def roc_auc(spark, sf):
    return ev.roc_auc(ev.threshold_table(scored(spark, sf)))


@query("average_precision", with_(_TO_TT, f"SELECT {r('sum(CAST(pos AS DOUBLE) * tp / (tp + fp)) / sum(pos)', 'average_precision')} FROM tt"))
def average_precision(spark, sf):
    return ev.average_precision(ev.threshold_table(scored(spark, sf)))


_MINP = "CAST(coalesce(min(score) FILTER (WHERE CAST(tp AS DOUBLE) / (tp + fp) >= {t}), max(score)) AS DOUBLE)"


@query("min_precision_threshold", with_(_TO_TT, f"SELECT {r(_MINP.format(t=0.6), 'threshold')} FROM tt"))
def min_precision_threshold(spark, sf):
    return ev.min_precision_threshold(ev.threshold_table(scored(spark, sf)), 0.6)


@query("unreachable_precision", with_(_TO_TT, f"SELECT {r(_MINP.format(t=1.01), 'threshold')} FROM tt"))
def unreachable_precision(spark, sf):
    return ev.min_precision_threshold(ev.threshold_table(scored(spark, sf)), 1.01)


def _fbeta(b: float) -> list[str]:
    return [
        *_SCORED,
        "b AS (SELECT CAST(min(score) AS DOUBLE) AS lo, CAST(max(score) AS DOUBLE) AS hi, (max(score) - min(score)) / 399.0 AS step, sum(y) AS p FROM scored)",
        "grid AS (SELECT i, CASE WHEN i = 399 THEN hi ELSE i * step + lo END AS thr, p FROM range(400) t(i), b)",
        """counted AS (SELECT i, thr, p, count(*) FILTER (WHERE y = 1 AND score > thr) AS tp, count(*) FILTER (WHERE y = 0 AND score > thr) AS fp
            FROM grid, scored GROUP BY i, thr, p)""",
        """pr AS (SELECT i, thr, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END AS prec,
            CASE WHEN p > 0 THEN tp / CAST(p AS DOUBLE) ELSE 0 END AS rec FROM counted)""",
        f"""f AS (SELECT *, CASE WHEN {b * b} * prec + rec > 0 THEN (1 + {b * b}) * prec * rec / ({b * b} * prec + rec) ELSE 0 END AS fb,
            CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END AS f1 FROM pr)""",
        "best AS (SELECT * FROM f ORDER BY round(fb, 12) DESC, i LIMIT 1)",
    ]


@query("best_fbeta_threshold", with_(_fbeta(2.0), f"SELECT {r('fb', 'fbeta')}, {r('thr', 'threshold')}, {r('prec', 'precision')}, {r('rec', 'recall')}, {r('f1', 'f1')} FROM best"))
def best_fbeta_threshold(spark, sf):
    return ev.best_fbeta(ev.threshold_table(scored(spark, sf)), 2.0)


@query(
    "operating_threshold",
    with_([*_fbeta(1.0), _ST, _TT, f"mp AS (SELECT {_MINP.format(t=0.6)} AS m FROM tt)"],
          f"SELECT {r('thr', 'thr_fbeta')}, {r('fb', 'fbeta')}, {r('m', 'thr_precision')}, {r('greatest(thr, m)', 'operate_thr')} FROM best, mp"),
)
def operating_threshold(spark, sf):
    return ev.operating_threshold(scored(spark, sf), beta=1.0, target=0.6)


@query("quantile_threshold", with_(_SCORED, f"SELECT {r('quantile_cont(CAST(score AS DOUBLE), 0.95)', 'threshold')} FROM scored"))
def quantile_threshold(spark, sf):
    return ev.quantile_threshold(scored(spark, sf))


@query(
    "confusion_matrix",
    with_(_SCORED, """SELECT y_true, y_pred, count(doc_id) AS n FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) c(y_true, y_pred)
        LEFT JOIN scored ON y = y_true AND CAST(hit AS INTEGER) = y_pred GROUP BY ALL"""),
)
def confusion_matrix(spark, sf):
    return ev.confusion(scored(spark, sf).withColumn("yhat", (F.col("score") > 900).cast("int")))


_REPORT = " UNION ALL ".join(
    f"""SELECT '{name}' AS clase, {r(f'count(*) FILTER (WHERE y = {c} AND hit = {h}) / CAST(count(*) FILTER (WHERE hit = {h}) AS DOUBLE)', 'precision')},
    {r(f'count(*) FILTER (WHERE y = {c} AND hit = {h}) / CAST(count(*) FILTER (WHERE y = {c}) AS DOUBLE)', 'recall')},
    {r(f'2.0 * count(*) FILTER (WHERE y = {c} AND hit = {h}) / (count(*) FILTER (WHERE hit = {h}) + count(*) FILTER (WHERE y = {c}))', 'f1')},
    count(*) FILTER (WHERE y = {c}) AS support FROM scored"""
    for c, h, name in ((0, "false", "NORMAL"), (1, "true", "NO-NORMAL"))
)


@query("classification_report", with_(_SCORED, _REPORT))
def classification_report(spark, sf):
    return ev.classification_report(scored(spark, sf).withColumn("yhat", (F.col("score") > 900).cast("int")))


_MM = "(score - min(score) OVER ()) / greatest(max(score) OVER () - min(score) OVER (), 1e-12)"


def _normalised(spark, sf):
    d = scored(spark, sf).withColumn("other", (F.col("doc_id") % 97).cast("double"))
    lo, hi, lo2, hi2 = d.agg(F.min("score"), F.max("score"), F.min("other"), F.max("other")).first()
    return d.select(
        "doc_id", min_max_scale(F.col("score"), F.lit(lo), F.lit(hi)).alias("ae_norm"),
        min_max_scale(F.col("other"), F.lit(lo2), F.lit(hi2)).alias("if_norm"),
    )


@query("minmax_score", with_(_SCORED, f"SELECT doc_id, {r(_MM, 'ae_norm')} FROM scored"))
def minmax_score(spark, sf):
    return _normalised(spark, sf).select("doc_id", "ae_norm")


_OTHER = "(CAST(doc_id % 97 AS DOUBLE) - min(doc_id % 97) OVER ()) / greatest(max(doc_id % 97) OVER () - min(doc_id % 97) OVER (), 1e-12)"
_ENS = f"0.9 * ({_MM}) + 0.1 * ({_OTHER})"


@query(
    "ensemble_score",
    with_(_SCORED, f"""SELECT doc_id, {r('s', 'score')}, CASE WHEN s > 0.25 THEN 'ANOMALY' ELSE 'NORMAL' END AS window_label,
        CASE WHEN s >= 0.6 THEN 'ANOMALY' ELSE 'NORMAL' END AS batch_label FROM (SELECT doc_id, {_ENS} AS s FROM scored)"""),
)
def ensemble_score(spark, sf):
    d = _normalised(spark, sf).select("doc_id", weighted_score(F.col("ae_norm"), F.col("if_norm"), 0.9).alias("score"))
    return d.withColumns({"window_label": ev.decide(F.col("score"), 0.25), "batch_label": ev.decide(F.col("score"), 0.6, True)})


@query(
    "smooth_alerts",
    with_([*TO_CLEAN, f"flags AS (SELECT *, CAST({HOT} >= 90 AS INTEGER) AS flag FROM clean)"],
          f"""SELECT asset_id, ts, flag, CASE WHEN sum(flag) OVER ({W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) >= 4 THEN 1 ELSE 0 END AS alert FROM flags"""),
)
def smooth_alerts(spark, sf):
    d = clean(spark, sf).select("asset_id", "ts", (F.col(HOT) >= 90).cast("int").alias("flag"))
    return ev.smooth_alerts(d, "flag")


# ---- scorers ----------------------------------------------------------------------------------------------------

def _vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("features"))


@query("isolation_forest_score", f"""SELECT vec_id, label, {r(given.forest_sql(given.VECTOR_TREES, lambda i: f"CAST(embedding[{i + 1}] AS DOUBLE)"), "if_score")} FROM embeddings""")
def isolation_forest_score(spark, sf):
    """A given forest applied to all vectors."""
    return given.forest(spark, given.VECTOR_TREES).scores(_vectors(spark, sf)).select("vec_id", "label", "if_score")


@query(
    "isolation_forest_fit",
    """SELECT tree, CAST(count(DISTINCT vec_id) >= 256 AS BIGINT) AS full_sample, CAST(1 AS BIGINT) AS roots
       FROM embeddings, range(50) t(tree) WHERE label = 0 GROUP BY tree""",
)
def isolation_forest_fit(spark, sf):
    """Shape of a fitted forest: every tree has one root, every inner node two children, and a sample of 256 where there are as many rows."""
    d = _vectors(spark, sf).where("label = 0")
    grown = fit_forest(d, ["vec_id"], trees=50)
    drawn = draw_samples(d, "features", ["vec_id"], 50, grown.sample, 42, d.count()).groupBy(F.col("tree").cast("long").alias("tree")).agg(
        (F.count(F.lit(1)) >= 256).cast("long").alias("full_sample"))
    per_tree = grown.nodes.groupBy(F.col("tree").cast("long").alias("tree")).agg(
        F.count_if(F.col("node") == 0).alias("roots"),
        F.count_if(F.col("feature") < 0).alias("leaves"), F.count_if(F.col("feature") >= 0).alias("inner"),
    )
    whole = per_tree.where(F.col("leaves") == F.col("inner") + 1)  # a tree that is not whole is missing from the result
    return whole.join(drawn, "tree").select("tree", "full_sample", "roots")


_WIDTH = 64
_MEAN = [0.001 * (i % 7) for i in range(_WIDTH)]
_KEPT = 8


@query("pca_reconstruction_error", f"""SELECT vec_id, label, {r(" + ".join(f"power(CAST(embedding[{i + 1}] AS DOUBLE) - {_MEAN[i]!r}, 2)" for i in range(_KEPT, _WIDTH)), "squares")},
    {r("(" + " + ".join(f"power(CAST(embedding[{i + 1}] AS DOUBLE) - {_MEAN[i]!r}, 2)" for i in range(_KEPT, _WIDTH)) + f") / {_WIDTH}", "recon_error")} FROM embeddings""")
def pca_reconstruction_error(spark, sf):
    """A given mean and eight axes as components: what remains is the squared rest."""
    d = _vectors(spark, sf).withColumn("seq", F.array("features"))
    model = Reconstruction([f"x{i}" for i in range(_WIDTH)], 1, np.array(_MEAN), np.eye(_WIDTH)[:, :_KEPT])
    total = F.aggregate("per_feature", F.lit(0.0), lambda a, v: a + v)
    return model.errors(d).select("vec_id", "label", total.alias("squares"), "recon_error")


@query("pca_full_rank", "SELECT vec_id, CAST(0 AS DOUBLE) AS recon_error FROM embeddings")
def pca_full_rank(spark, sf):
    """Fitted with as many components as columns, the reconstruction is exact."""
    d = _vectors(spark, sf).withColumn("seq", F.array("features"))
    model = fit_reconstruction(d, [f"x{i}" for i in range(_WIDTH)], k=_WIDTH)
    return model.errors(d).select("vec_id", F.abs(F.round("recon_error", 9)).alias("recon_error"))


_TO_SCORES = [*TO_CLEAN, given.SCALED, given.ERRORS]


@query(
    "feature_contributions",
    with_(_TO_SCORES, " UNION ALL ".join(
        f"SELECT asset_id, ts, '{c}' AS feature, {r(f'e_{c}', 'contribution')} FROM scores WHERE rn >= {given.STEPS} AND rn <= n - 12" for c in SIGNALS)),
)
def contributions(spark, sf):
    seqs = sequences(scale(clean(spark, sf), given.SCALER), SIGNALS, given.STEPS, 12)
    return feature_contributions(given.reconstruction().errors(seqs), SIGNALS, ["asset_id", "ts"])


@query("surrogate_tree_importances", " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({int(c == HOT)} AS DOUBLE) AS importance" for c in SIGNALS))
def surrogate_tree_importances(spark, sf):
    """Alerts that one feature splits exactly: it has all the importance, the others none."""
    hot = (F.col(HOT) >= 90).cast("double")
    d = clean(spark, sf).withColumn("alert", hot.cast("int")).withColumn(HOT, hot)
    return surrogate_importances(d, SIGNALS, "alert")


# ---- complete training run --------------------------------------------------------------------------------------

_models: dict = {}


def trained(spark, sf):
    key = (spark.sparkContext.applicationId, sf)
    if key not in _models:
        _models[key] = train(gold_table(spark, sf), Params(trees=100))
    return _models[key]


@query(
    "training_metrics",
    with_([*_fbeta(2.0), _ST, _TT], f"""SELECT 'roc_auc' AS metric, {r('sum(neg * (tp - pos / 2.0)) / (CAST(sum(pos) AS DOUBLE) * sum(neg))', 'value')} FROM tt
        UNION ALL SELECT 'pr_auc', {r('sum(CAST(pos AS DOUBLE) * tp / (tp + fp)) / sum(pos)')} FROM tt
        UNION ALL SELECT 'thr_f2', {r('thr')} FROM best"""),
)
def training_metrics(spark, sf):
    """The metrics that a training run records, of a given score."""
    found = score_metrics(scored(spark, sf), "score")
    return spark.createDataFrame([(k, float(v)) for k, v in found.items()], "metric string, value double")


@query(
    "training_report",
    with_([*TO_CLEAN, *_EV, _SPLIT.format(src="rul")],
          """SELECT 'validation_rows' AS item, count(*) AS n FROM parts WHERE split = 'validation'
             UNION ALL SELECT 'validation_positive', count(*) FROM parts WHERE split = 'validation' AND rul <= 15
             UNION ALL SELECT 'components', CAST(8 AS BIGINT) UNION ALL SELECT 'trees', CAST(100 AS BIGINT)"""),
)
def training_report(spark, sf):
    """Counts of the fitted model that SQL can state."""
    m = trained(spark, sf)
    seen = m.forest_evaluation.agg(F.count(F.lit(1)), F.sum("y_true")).first()
    rows = [("validation_rows", seen[0]), ("validation_positive", int(seen[1] or 0)), ("components", m.recon.components.shape[1]),
            ("trees", m.forest.nodes.select("tree").distinct().count())]
    return spark.createDataFrame(rows, "item string, n long")


@query(
    "forest_evaluation_rows",
    with_([*TO_CLEAN, *_EV, _SPLIT.format(src="rul")],
          "SELECT asset_id, ts, CASE WHEN rul <= 15 THEN 1 ELSE 0 END AS y_true FROM parts WHERE split = 'validation'"),
)
def forest_evaluation_rows(spark, sf):
    """The forest is judged on every validation hour."""
    return trained(spark, sf).forest_evaluation.select("asset_id", "ts", "y_true")


@query(
    "evaluation_rows",
    with_([*TO_CLEAN, f"given AS (SELECT asset_id, ts, hour, CAST({HOT} >= 100 AS INTEGER) AS y_true, {HOT} / 150.0 AS operate_score FROM clean)",
           "raw AS (SELECT *, CAST(operate_score > 0.6 AS INTEGER) AS operate_pred_raw FROM given)"],
          f"""SELECT asset_id, ts, y_true, {r('operate_score', 'operate_score')}, operate_pred_raw,
              CASE WHEN sum(operate_pred_raw) OVER ({W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) >= 4 THEN 1 ELSE 0 END AS operate_pred_smooth FROM raw"""),
)
def evaluation_rows(spark, sf):
    """Decisions and smoothed alerts of a given score at a given threshold."""
    d = clean(spark, sf).select("asset_id", "ts", (F.col(HOT) >= 100).cast("int").alias("y"), (F.col(HOT) / 150.0).alias("operate_score"))
    return evaluation_table(d, 0.6)


@query(
    "evaluation_truth",
    with_(
        [*TO_CLEAN, *_EV, _SPLIT.format(src="rul"),
         """valid AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY ts) AS rn, count(*) OVER (PARTITION BY asset_id) AS n
            FROM parts WHERE split = 'validation')"""],
        "SELECT asset_id, ts, CASE WHEN rul <= 15 THEN 1 ELSE 0 END AS y_true FROM valid WHERE rn >= 24 AND rn <= n - 12",
    ),
)
def evaluation_truth(spark, sf):
    """Which validation hours close a window, and their true class, as the training run aligned them."""
    return trained(spark, sf).evaluation.select("asset_id", "ts", "y_true")


_AE = f"(recon_error - {given.META['ae_score_min']}) / {given.META['ae_score_max'] - given.META['ae_score_min']}"
_IF = f"(if_score - {given.META['if_score_min']}) / {given.META['if_score_max'] - given.META['if_score_min']!r}"


@query(
    "latest_window_scores",
    with_(_TO_SCORES, f"""SELECT asset_id, ts, {r(_AE, 'score')}, CAST({_AE} > {given.META['operate_thr']} AS INTEGER) AS pred,
        CASE WHEN {_AE} > {given.META['operate_thr']} THEN 'ANOMALY' ELSE 'NORMAL' END AS label, 'window' AS basis, 'given' AS model_version
        FROM scores WHERE rn = n AND n >= {given.STEPS}
        UNION ALL SELECT asset_id, ts, NULL, 0, 'NORMAL', 'too_short', 'given' FROM scores WHERE rn = n AND n < {given.STEPS}"""),
)
def latest_window_scores(spark, sf):
    return score_latest_window(clean(spark, sf), given.model(spark))


_BOTH = f"(CASE WHEN rn >= {given.STEPS} THEN 0.5 * {_AE} + 0.5 * {_IF} ELSE {_IF} END)"


@query(
    "batch_scores",
    with_(_TO_SCORES, f"""SELECT asset_id, ts, {r('if_score', 'if_score')}, {r(f'CASE WHEN rn >= {given.STEPS} THEN recon_error END', 'recon_error')},
        {r(_BOTH, 'score')}, CASE WHEN rn >= {given.STEPS} THEN 'both' ELSE 'forest' END AS basis,
        CASE WHEN {_BOTH} >= 0.6 THEN 'ANOMALY' ELSE 'NORMAL' END AS label FROM scores"""),
)
def batch_scores(spark, sf):
    return score_rows(clean(spark, sf), given.model(spark))


# ---- streams ----------------------------------------------------------------------------------------------------

_STREAM_SCHEMA = "asset_id long, tag string, ts timestamp, value double"


def _landed(spark, sf):
    path = fresh_dir(spark, "arrivals")
    readings(spark, sf).write.parquet(path)
    return stream_readings(spark, path, _STREAM_SCHEMA)


@query(
    "stream_hourly_mean",
    with_([READINGS], f"""SELECT asset_id, tag, date_trunc('hour', ts) AS ts, {r('avg(value)', 'value')} FROM readings
        GROUP BY asset_id, tag, date_trunc('hour', ts)
        HAVING date_trunc('hour', readings.ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM readings) - INTERVAL 2 HOUR"""),
)
def stream_hourly_mean(spark, sf):
    """Hours the watermark has closed; equals the batch result for them."""
    out = fresh_dir(spark, "stream-hourly")
    drain(hourly_mean_stream(_landed(spark, sf)), out, fresh_dir(spark, "stream-state"))
    return spark.read.schema(_STREAM_SCHEMA).parquet(out)


@query("stream_hourly_mean_closed", with_([READINGS], f"""SELECT asset_id, tag, date_trunc('hour', ts) AS ts, {r('avg(value)', 'value')} FROM readings
        GROUP BY asset_id, tag, date_trunc('hour', ts)"""))
def stream_hourly_mean_closed(spark, sf):
    """All hours: an end marker lands after the readings and closes what was open. Equals the batch result."""
    landed, out, state = (fresh_dir(spark, n) for n in ("arrivals", "stream-hourly", "stream-state"))
    readings(spark, sf).write.parquet(landed)
    last = readings(spark, sf).agg(F.max("ts")).first()[0]
    drain(hourly_mean_stream(stream_readings(spark, landed, _STREAM_SCHEMA)), out, state)
    land_end_marker(spark, landed, last, _STREAM_SCHEMA)
    drain(hourly_mean_stream(stream_readings(spark, landed, _STREAM_SCHEMA)), out, state)
    return spark.read.schema(_STREAM_SCHEMA).parquet(out)


@query(
    "stream_smooth_alerts",
    with_([*TO_CLEAN, f"flags AS (SELECT *, CAST({HOT} >= 90 AS INTEGER) AS flag FROM clean)"],
          f"""SELECT asset_id, ts, flag, CASE WHEN sum(flag) OVER ({W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) >= 4 THEN 1 ELSE 0 END AS alert FROM flags"""),
)
def stream_smooth_alerts(spark, sf):
    """Flags arriving in two batches; the state carries the last ones over. The result equals the batch form."""
    flags = clean(spark, sf).select("asset_id", "ts", (F.col(HOT) >= 90).cast("int").alias("flag"))
    source, out, state = (fresh_dir(spark, n) for n in ("flags", "stream-alerts", "stream-state"))
    early = F.col("ts") < F.lit("2024-01-15").cast("timestamp")
    for part in (early, ~early):
        flags.where(part).write.mode("append").parquet(source)
        drain(smooth_alerts_stream(stream_readings(spark, source, "asset_id long, ts timestamp, flag int")), out, state)
    return spark.read.schema("asset_id long, ts timestamp, flag int, alert int").parquet(out)


_ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@query(
    "stream_ordered_alerts",
    with_([*TO_CLEAN, f"flags AS (SELECT *, CAST({HOT} >= 90 AS INTEGER) AS flag FROM clean)"],
          f"""SELECT asset_id, ts, flag, CASE WHEN sum(flag) OVER ({W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) >= 4 THEN 1 ELSE 0 END AS alert FROM flags"""),
)
def stream_ordered_alerts(spark, sf):
    """Flags of which some arrive up to five hours late, in a later batch; decided in time order behind the watermark."""
    flags = clean(spark, sf).select("asset_id", "ts", (F.col(HOT) >= 90).cast("int").alias("flag"))
    schema, late = "asset_id long, ts timestamp, flag int", timedelta(hours=6)
    source, out, state = (fresh_dir(spark, n) for n in ("flags", "stream-alerts", "stream-state"))
    early = F.col("ts") + F.make_dt_interval(hours=F.hour("ts") % 6) < F.lit("2024-01-15").cast("timestamp")
    before = spark.conf.get(_ROCKS[0])
    spark.conf.set(*_ROCKS)
    try:
        for part in (early, ~early, None):
            if part is None:
                land_end_marker(spark, source, flags.agg(F.max("ts")).first()[0], schema, late)
            else:
                flags.where(part).write.mode("append").parquet(source)
            drain(ordered_alerts_stream(stream_readings(spark, source, schema), late="6 hours"), out, state)
    finally:
        spark.conf.set(_ROCKS[0], before)
    return spark.read.schema("asset_id long, ts timestamp, flag int, alert int").parquet(out)


@query("stream_append", with_([READINGS], f"SELECT tag, strftime(ts, '%Y-%m-%d') AS date, count(*) AS rows, {r('sum(value)', 'total')} FROM readings GROUP BY ALL"))
def stream_append(spark, sf):
    """Streamed into the Bronze layout; a second run with the same checkpoint finds nothing new."""
    out, state = fresh_dir(spark, "stream-bronze"), fresh_dir(spark, "stream-state")
    arrivals = _landed(spark, sf).withColumnRenamed("ts", "timestamp")
    for _ in range(2):
        append_stream(arrivals, out, state).awaitTermination()
    back = spark.read.parquet(out)
    return back.groupBy("tag", F.col("date").cast("string").alias("date")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("value").alias("total")
    )


@query("stored_marks", with_([READINGS], "SELECT asset_id, tag, max(ts) AS mark, CAST(0 AS BIGINT) AS wrong FROM readings GROUP BY asset_id, tag"))
def stored_marks_query(spark, sf):
    """Marks kept while readings arrive in two streams, and how many of them a scan of the readings contradicts."""
    out, marks = fresh_dir(spark, "stream-bronze"), fresh_dir(spark, "marks")
    for part in (F.col("asset_id") % 2 == 0, F.coalesce(F.col("asset_id") % 2 != 0, F.lit(True))):
        path = fresh_dir(spark, "arrivals")
        readings(spark, sf).where(part).withColumnRenamed("ts", "timestamp").write.parquet(path)
        arrivals = stream_readings(spark, path, _STREAM_SCHEMA.replace("ts timestamp", "timestamp timestamp"))
        append_stream(arrivals, out, fresh_dir(spark, "stream-state"), marks).awaitTermination()
    kept = stored_marks(spark, marks)
    wrong = wrong_marks(spark.read.parquet(out), kept).agg(F.count(F.lit(1)).alias("wrong"))
    return kept.crossJoin(F.broadcast(wrong))  # one row


# ---- files, bundles, inventory ----------------------------------------------------------------------------------

_NEWEST = "newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY hour DESC) AS back FROM clean) WHERE back <= 200)"


@query(
    "file_scores",
    with_([*TO_CLEAN, _NEWEST, given.SCALED.replace("FROM clean", "FROM newest"), given.ERRORS],
          f"""SELECT asset_id, ts, {r('if_score', 'if_score')}, {r(f'CASE WHEN rn >= {given.STEPS} THEN recon_error END', 'recon_error')},
        {r(_BOTH, 'score')}, CASE WHEN rn >= {given.STEPS} THEN 'both' ELSE 'forest' END AS basis,
        CASE WHEN {_BOTH} >= 0.6 THEN 'ANOMALY' ELSE 'NORMAL' END AS label FROM scores"""),
)
def file_scores(spark, sf):
    """A Parquet file scored by its newest 200 rows per asset."""
    path = fresh_dir(spark, "to-score")
    clean(spark, sf).write.parquet(path)
    return score_table_file(spark, path, given.model(spark), newest=200)


@query(
    "model_inventory",
    with_(
        [*TO_CLEAN, *_EV, _SPLIT.format(src="rul"),
         """valid AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY ts) AS rn, count(*) OVER (PARTITION BY asset_id) AS n
            FROM parts WHERE split = 'validation')"""],
        f"""SELECT 'pca_windows_v1' AS model_version, true AS forest_loaded, true AS reconstruction_loaded, '{Params().beta}' AS f_beta,
           count(*) AS evaluation_rows, sum(CAST(rul <= 15 AS BIGINT))::BIGINT AS positive FROM valid WHERE rn >= 24 AND rn <= n - 12""",
    ),
)
def model_inventory(spark, sf):
    """Version and parts of a saved model that was read back, its stored settings, and its stored evaluation counted."""
    path, report = fresh_dir(spark, "model"), fresh_dir(spark, "report")
    made = trained(spark, sf)
    made.save(path)
    write_report(metrics_frame(spark, made.meta), report)
    info = model_info(spark, TrainedModel.load(spark, path)).drop("feature_order")
    settings = spark.read.json(report).select(F.get_json_object("meta", "$.operate_f_beta").alias("f_beta"))
    seen = spark.read.parquet(f"{path}/evaluation").agg(F.count(F.lit(1)).alias("evaluation_rows"), F.sum(F.col("y_true").cast("long")).alias("positive"))
    return info.crossJoin(settings).crossJoin(seen)  # one row each
