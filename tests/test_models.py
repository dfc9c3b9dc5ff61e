import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridpulse.catalog import Params
from gridpulse.models import evaluate
from gridpulse.models.iforest import average_path, feature_vector, fit_forest
from gridpulse.models.prep import encode_labels, fit_scaler, impute_medians, scale, sequences, train_medians
from gridpulse.models.reconstruction import feature_contributions, fit_reconstruction
from gridpulse.operators.dataset import (
    downcast, downcast_bounds, fleet_cut, select_columns, split_at, split_summary, temporal_split,
)
from gridpulse.operators.ranking import distinct_counts, exact_quantiles, running_totals
from gridpulse.plans.gold import gold
from gridpulse.plans.scoring import score_latest_window, score_rows
from gridpulse.plans.training import TrainedModel, train
from gridpulse.operators.rules import classify
from gridpulse.session import fresh_dir
from tests.helpers import SHORT, collect, panel_pdf, to_spark


def scored(n=500, seed=0, levels=40):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.3).astype(int)
    s = np.round(rng.normal(0, 1, n) + y, 1 if levels else 9)
    return pd.DataFrame({"score": s, "y": y})


def restated_thresholds(pdf):
    out = []
    for t in sorted(pdf["score"].unique(), reverse=True):
        hit = pdf["score"] >= t
        out.append((t, int((pdf["y"][hit] == 1).sum()), int((pdf["y"][hit] == 0).sum())))
    return out


@pytest.mark.parametrize("levels", [40, 0])
def test_threshold_table_and_curves(spark, levels):
    pdf = scored(levels=levels)
    t = evaluate.threshold_table(spark.createDataFrame(pdf))
    got = t.toPandas().sort_values("score", ascending=False)
    want = restated_thresholds(pdf)
    assert [tuple(r) for r in got[["score", "tp", "fp"]].to_numpy()] == [tuple(map(float, w)) for w in want]
    pos, neg = pdf["score"][pdf["y"] == 1].to_numpy(), pdf["score"][pdf["y"] == 0].to_numpy()
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / len(pos) / len(neg)
    assert evaluate.roc_auc(t).first()[0] == pytest.approx(auc, abs=1e-12)
    ap, seen = 0.0, 0
    for _, tp, fp in want:
        ap += (tp - seen) / len(pos) * tp / (tp + fp)
        seen = tp
    assert evaluate.average_precision(t).first()[0] == pytest.approx(ap, abs=1e-12)
    ok = [s for s, tp, fp in want if tp / (tp + fp) >= 0.6]
    assert evaluate.min_precision_threshold(t, 0.6).first()[0] == min(ok)
    assert evaluate.min_precision_threshold(t, 1.1).first()[0] == pdf["score"].max()


@pytest.mark.parametrize("beta,levels", [(1.0, 40), (2.0, 40), (2.0, 0)])
def test_best_fbeta(spark, beta, levels):
    pdf = scored(seed=3, levels=levels)
    t = evaluate.threshold_table(spark.createDataFrame(pdf))
    best, where = 0.0, None
    for th in np.linspace(pdf["score"].min(), pdf["score"].max(), 400):
        hit = pdf["score"] > th
        tp, fp, fn = (hit & (pdf["y"] == 1)).sum(), (hit & (pdf["y"] == 0)).sum(), (~hit & (pdf["y"] == 1)).sum()
        p, r = tp / (tp + fp) if tp + fp else 0, tp / (tp + fn) if tp + fn else 0
        f = (1 + beta**2) * p * r / (beta**2 * p + r) if beta**2 * p + r else 0
        if f > best + 1e-15:
            best, where = f, th
    got = evaluate.best_fbeta(t, beta).first()
    assert got["fbeta"] == pytest.approx(best) and got["threshold"] == pytest.approx(where)


def test_fbeta_without_positives_and_single_score(spark):
    t = evaluate.threshold_table(spark.createDataFrame([(0.1, 0), (0.2, 0)], "score double, y int"))
    assert evaluate.best_fbeta(t).first()["threshold"] is None
    t = evaluate.threshold_table(spark.createDataFrame([(0.5, 0), (0.5, 1)], "score double, y int"))
    assert evaluate.best_fbeta(t).first()["fbeta"] == 0
    assert evaluate.roc_auc(t).first()[0] == 0.5


def test_confusion_and_report(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "y int, yhat int")
    cells = {(r[0], r[1]): r[2] for r in evaluate.confusion(df).collect()}
    assert cells == {(0, 0): 2, (0, 1): 0, (1, 0): 1, (1, 1): 1}
    rep = {r["clase"]: r for r in evaluate.classification_report(df).collect()}
    assert rep["NO-NORMAL"]["recall"] == 0.5 and rep["NORMAL"]["precision"] == pytest.approx(2 / 3)
    none = {r["clase"]: r for r in evaluate.classification_report(df.withColumn("yhat", F.lit(0))).collect()}
    assert none["NO-NORMAL"]["precision"] == 0


def test_smooth_alerts(spark):
    pdf = panel_pdf(130)[["asset_id", "ts"]]
    pdf["flag"] = np.random.default_rng(1).integers(0, 2, len(pdf))
    got = collect(evaluate.smooth_alerts(spark.createDataFrame(pdf), "flag", 4, 7, s=SHORT))
    want = pdf.groupby("asset_id")["flag"].transform(lambda x: x.rolling(7, min_periods=1).sum() >= 4).astype(int)
    assert list(got["alert"]) == list(want)


def test_exact_quantiles_and_counts(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"a": rng.normal(size=997), "b": rng.integers(0, 5, 997).astype(float)})
    df = spark.createDataFrame(pdf)
    got = {(r[0], r[1]): r[2] for r in exact_quantiles(df, ["a", "b"], [0.0, 0.5, 0.95, 1.0]).collect()}
    for c in "ab":
        for q in (0.0, 0.5, 0.95, 1.0):
            assert got[c, q] == pytest.approx(np.quantile(pdf[c], q), abs=1e-12)
    assert {r[0]: r[1] for r in distinct_counts(df, ["a", "b"]).collect()} == {"a": 997, "b": 5}


def test_running_totals_one_dominant_value(spark):
    df = spark.createDataFrame([(float(i), 1000 if i == 5 else 1) for i in range(20)], "v double, n long")
    got = running_totals(df, "v", ["n"]).toPandas().sort_values("v")
    assert list(got["cum_n"]) == list(got["n"].cumsum())


def test_split_and_summary(spark):
    pdf = panel_pdf(103)
    df = to_spark(spark, pdf)
    d = temporal_split(df, 0.8, SHORT)
    counts = {(r[0], r[1]): r[2] for r in d.groupBy("asset_id", "split").count().collect()}
    assert counts[0, "train"] == int(103 * 0.8) and counts[0, "validation"] == 103 - int(103 * 0.8)
    edge = d.groupBy("asset_id").agg(
        F.max(F.when(F.col("split") == "train", F.col("ts"))).alias("a"),
        F.min(F.when(F.col("split") != "train", F.col("ts"))).alias("b"),
    )
    assert edge.where("a >= b").count() == 0
    assert split_summary(d).agg(F.sum("proporcion")).first()[0] == pytest.approx(1.0)
    cut = fleet_cut(df, 0.8)
    assert cut.first()[0] == sorted(pdf["ts"])[int(len(pdf) * 0.8)].to_pydatetime()
    assert split_at(df, cut).where("split = 'train'").count() == (pdf["ts"] < pd.Timestamp(cut.first()[0])).sum()


def test_columns_and_types(spark):
    df = spark.createDataFrame(
        [(1, 2.0, None, 5.0, 300, 1e39), (2, 2.0, 3.0, 6.0, 1, 0.0), (3, 2.0, None, 7.0, 0, 1.0)],
        "a long, const double, holes double, fine double, wide long, huge double",
    )
    assert select_columns(df) == ["a", "fine", "wide", "huge"]
    types = {r["column"]: r["to_type"] for r in downcast_bounds(df).collect()}
    assert types == {"a": "tinyint", "const": "float", "holes": "float", "fine": "float", "wide": "smallint", "huge": "double"}
    assert dict(downcast(df).dtypes)["wide"] == "smallint"


def test_prep(spark):
    pdf = panel_pdf(120, gaps=0.1)
    df = to_spark(spark, pdf).withColumn("voltage_value", F.when(F.hour("ts") == 3, float("inf")).otherwise(F.col("voltage_value")))
    med = train_medians(df, ["voltage_value", "temp_oil_value"])
    assert med["temp_oil_value"] == pytest.approx(pdf["temp_oil_value"].median())
    filled = impute_medians(df, med)
    assert filled.where(F.col("voltage_value").isNull() | (F.col("voltage_value") > 1e9)).count() == 0
    sc = fit_scaler(filled.withColumn("k", F.lit(1.0)), ["temp_oil_value", "k"])
    assert sc["k"] == (1.0, 1.0)
    z = scale(filled, {"temp_oil_value": sc["temp_oil_value"]}).agg(F.avg("temp_oil_value"), F.stddev_pop("temp_oil_value")).first()
    assert z[0] == pytest.approx(0, abs=1e-9) and z[1] == pytest.approx(1)
    enc, labels = encode_labels(spark.createDataFrame([("NORMAL",), ("ALERTA",), ("CRITICO",)], "l string"), "l")
    assert labels == ["ALERTA", "CRITICO", "NORMAL"] and enc.where("l = 'NORMAL'").first()["label_id"] == 2


@pytest.mark.parametrize("allow_gaps", [False, True])
def test_sequences(spark, allow_gaps):
    pdf = panel_pdf(90)
    pdf = pdf.drop(pdf.index[(pdf["asset_id"] == 0) & (pdf.groupby("asset_id").cumcount() == 40)])
    got = collect(sequences(to_spark(spark, pdf), ["voltage_value", "tap_position_value"], 24, 12, allow_gaps, SHORT))
    want = []
    for a, g in pdf.groupby("asset_id"):
        g = g.reset_index(drop=True)
        for t in range(23, len(g) - 12):
            if allow_gaps or g["ts"][t] - g["ts"][t - 23] == pd.Timedelta(hours=23):
                want.append((a, g["ts"][t], g.loc[t - 23 : t, "voltage_value"].tolist()))
    assert [(r.asset_id, r.ts) for r in got.itertuples()] == [(a, t) for a, t, _ in want]
    for r, (_, _, v) in zip(got.itertuples(), want):
        assert [x[0] for x in r.seq] == v


def planted(spark, n=3000, dims=6):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, dims))
    x[:20] += 8
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, features array<double>")


def test_forest_finds_planted_outliers(spark):
    df = planted(spark)
    forest = fit_forest(df.where("id >= 20"), ["id"], trees=60)
    assert forest.nodes.select("tree").distinct().count() == 60
    got = forest.scores(df).toPandas()
    cut = got["if_score"].quantile(0.95)
    assert (got["if_score"].between(0, 1)).all() and (got[got["id"] < 20]["if_score"] > cut).all()
    again = fit_forest(df.where("id >= 20").repartition(5), ["id"], trees=60).scores(df).toPandas()
    merged = got.merge(again, on="id")
    assert np.allclose(merged["if_score_x"], merged["if_score_y"])
    assert average_path(256) == pytest.approx(10.2448, abs=1e-3)


def test_forest_with_fewer_rows_than_a_sample(spark):
    df = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(10)], "id long, features array<double>")
    assert fit_forest(df, ["id"], trees=5).scores(df).where("if_score between 0 and 1").count() == 10


def test_reconstruction(spark):
    pdf = panel_pdf(150, assets=1)
    cols = ["temp_oil_value", "temp_ambient_value"]
    df = to_spark(spark, pdf)
    df = scale(df, fit_scaler(df, cols))
    seqs = sequences(df, cols, 12, 0, s=SHORT)
    full = fit_reconstruction(seqs, cols, k=24).errors(seqs)
    assert full.agg(F.max("recon_error")).first()[0] < 1e-18
    model = fit_reconstruction(seqs, cols, k=2)
    err = model.errors(seqs)
    x = np.stack([np.concatenate(v) for v in seqs.toPandas()["seq"]])
    c = x - x.mean(axis=0)
    _, sv, _ = np.linalg.svd(c, full_matrices=False)
    assert err.agg(F.sum("recon_error")).first()[0] * 24 == pytest.approx((sv[2:] ** 2).sum(), rel=1e-6)
    parts = feature_contributions(err, cols, ["asset_id", "ts"])
    per_row = parts.groupBy("asset_id", "ts").agg(F.avg("contribution").alias("m")).join(err, ["asset_id", "ts"])
    assert per_row.where("abs(m - recon_error) > 1e-12").count() == 0


def test_gold_train_score_roundtrip(spark):
    pdf = panel_pdf(1400, assets=2, seed=11)
    event = (F.col("temp_spot_hot_value") - F.col("temp_oil_value")) > 30
    silver = classify(to_spark(spark, pdf), bands="outside")
    p = Params(trees=20, horizon_days=5, critical_days=1, alert_days=2)
    g = gold(silver, event=event, p=p)
    assert len([c for c in g.columns if c not in ("asset_id", "ts", "split")]) == 68  # 70 of the dataset without year, month
    from gridpulse.sources.store import materialize

    g = materialize(g, "gold")
    assert g.count() == len(pdf)
    m = train(g, p)
    assert m.evaluation.count() > 0 and 0 <= m.meta["ae_roc_auc"] <= 1
    assert m.meta["operate_thr"] is not None and m.importances.count() == len(m.columns)
    assert m.forest_evaluation.count() == g.where("split <> 'train'").count()
    path = fresh_dir(spark, "model")
    m.save(path)
    back = TrainedModel.load(spark, path)
    a, b = score_latest_window(g, m).toPandas(), score_latest_window(g, back).toPandas()
    assert len(a) == 2 and np.allclose(sorted(a["score"]), sorted(b["score"]))
    rows = score_rows(g, back, within_batch=True)
    assert rows.count() == len(pdf) and set(r[0] for r in rows.select("label").distinct().collect()) <= {"ANOMALY", "NORMAL"}


def test_normal_class_falls_back_to_the_most_frequent(spark):
    from gridpulse.models.prep import normal_class

    make = lambda xs: spark.createDataFrame([(x,) for x in xs], "l string")
    assert normal_class(make(["B", "A", "B"]), "l") == "B"
    assert normal_class(make(["B", "B", "NORMAL"]), "l") == "NORMAL"


@pytest.mark.parametrize("ranges", [None, 1, 1500])
@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_over_ranges(spark, ranges, descending):
    """Keys that span ranges, ranges that span keys, more than a thousand ranges, missing numbers, sums of both kinds."""
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"k": np.repeat(["a", "b", "c"], [1500, 3, 700]), "v": rng.permutation(2203) / 7.0})
    pdf["n"], pdf["x"] = rng.integers(0, 9, len(pdf)), np.where(rng.random(len(pdf)) < 0.1, None, 0.5)
    df = spark.createDataFrame([tuple(r) for r in pdf.astype(object).itertuples(index=False)], "k string, v double, n long, x double").repartition(5)
    got = running_totals(df, "v", ["n", "x"], ["k"], descending, ranges).toPandas().sort_values(["k", "v"], ignore_index=True)
    pdf = pdf.sort_values(["k", "v"], ascending=[True, not descending])
    pdf["x"] = pdf["x"].astype(float).fillna(0.0)
    pdf["cum_n"], pdf["cum_x"] = pdf.groupby("k")["n"].cumsum(), pdf.groupby("k")["x"].cumsum()
    want = pdf.sort_values(["k", "v"], ignore_index=True)
    assert (got["cum_n"] == want["cum_n"]).all() and np.allclose(got["cum_x"], want["cum_x"])
    assert got.columns.tolist() == ["k", "v", "n", "x", "cum_n", "cum_x"]


def test_running_totals_of_nothing(spark):
    empty = spark.createDataFrame([], "v double, n long")
    assert running_totals(empty, "v", ["n"]).count() == 0


@pytest.mark.parametrize("lookback,width,seed", [(1, 2, 0), (3, 1, 1), (6, 3, 2), (24, 2, 3)])
def test_lagged_products_equal_those_of_windows(lookback, width, seed):
    from gridpulse.models.windows import add_products

    rng = np.random.default_rng(seed)
    x = rng.normal(size=(150, width))
    full = np.zeros(150, dtype=bool)
    full[lookback - 1 :] = rng.random(151 - lookback) < 0.7
    total, sums = np.zeros((lookback, lookback, width, width)), np.zeros((lookback, width))
    add_products(total, sums, x, full, lookback)
    w = np.stack([x[e - lookback + 1 : e + 1] for e in np.flatnonzero(full)])
    np.testing.assert_allclose(sums, w.sum(0), atol=1e-9)
    for a in range(lookback):
        for b in range(a, lookback):
            np.testing.assert_allclose(total[a, b], w[:, a].T @ w[:, b], atol=1e-9)


@pytest.mark.parametrize("allow_gaps", [False, True])
def test_window_components_without_windows(spark, allow_gaps):
    """Components to 1e-9 and errors of the row-wise form; missing hours, several assets, chunks little longer than a window."""
    from gridpulse.models.windows import fit_windows, window_errors

    pdf = panel_pdf(400, assets=3, seed=5)
    pdf = pdf[np.random.default_rng(1).random(len(pdf)) > 0.02]
    cols = ["temp_oil_value", "temp_ambient_value", "voltage_value"]
    df = to_spark(spark, pdf)
    df = scale(df, fit_scaler(df, cols))
    seqs = sequences(df, cols, 12, 5, allow_gaps, s=SHORT)
    want, got = fit_reconstruction(seqs, cols, k=6), fit_windows(df, cols, 6, 12, 5, allow_gaps, SHORT)
    np.testing.assert_allclose(got.mean, want.mean, atol=1e-12)
    np.testing.assert_allclose(np.abs(np.sum(got.components * want.components, axis=0)), 1.0, atol=1e-9)
    a = window_errors(df, got, 5, allow_gaps, SHORT).toPandas().sort_values(["asset_id", "ts"], ignore_index=True)
    b = want.errors(seqs).toPandas().sort_values(["asset_id", "ts"], ignore_index=True)
    assert len(a) == len(b) > 100 and (a[["asset_id", "ts"]] == b[["asset_id", "ts"]]).all().all()
    np.testing.assert_allclose(a["recon_error"], b["recon_error"], rtol=1e-9)
    np.testing.assert_allclose(np.stack(a["per_feature"]), np.stack(b["per_feature"]), rtol=1e-8, atol=1e-10)


def test_window_components_need_windows(spark):
    from gridpulse.models.windows import fit_windows

    with pytest.raises(ValueError, match="full windows"):
        fit_windows(to_spark(spark, panel_pdf(10, assets=1)), ["voltage_value"], 2, 24, 0)
