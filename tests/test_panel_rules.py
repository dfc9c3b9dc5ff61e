import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridpulse.catalog import COMBINED_RULES, RULES, SIGNALS
from gridpulse.operators import clean, panel, quality, rules
from gridpulse.operators.dataset import feature_groups
from gridpulse.plans.silver import silver
from tests.helpers import SHORT, collect, panel_pdf, same, to_spark


def to_readings(spark, rows):
    return spark.createDataFrame(rows, "asset_id long, tag string, t string, value double").select(
        "asset_id", "tag", F.col("t").cast("timestamp").alias("ts"), "value")


def test_names(spark):
    names = ["temperatura_aceite_OLTC_value", "Corriente  Fásica Ñ!", "%%%", "a", "b", "a", "a"]
    d = spark.createDataFrame(list(enumerate(names)), "position int, name string")
    standard = d.select("position", clean.standard_name_of(F.col("name")).alias("name"))
    got = [r["name"] for r in clean.numbered_names(standard).orderBy("position").collect()]
    assert got == ["temp_oil_oltc_value", "current_fasica_n", "var_transformador", "a", "b", "a_1", "a_2"]


def test_rename_columns(spark):
    d = spark.range(1).select(F.lit(1).alias("asset_id"), F.lit(2).alias("ts"), F.lit(3).alias("voltaje_value"), F.lit(4).alias("Voltaje.value!"))
    assert clean.rename_columns(d).columns == ["asset_id", "ts", "voltage_value", "voltagevalue"]


def test_names_by_column_match_names_by_value(spark):
    tags = ["temperatura_aceite", "Tensión  Primaria", "voltaje_fase_1", "__x__", "posicion punto caliente"]
    d = spark.createDataFrame([(t,) for t in tags], "tag string")
    got = [r[0] for r in d.select(clean.standard_name_column(F.col("tag"))).collect()]
    assert got == ["temp_oil_value", "tension_primaria_value", "voltage_phase_1_value", "x_value", "temp_spot_hot_value"] or got == [
        r[0] for r in d.select(clean.standard_name_of(F.concat("tag", F.lit("_value")))).collect()]


def test_plausible_range_uses_first_fragment(spark):
    d = spark.createDataFrame([(199.0, 21.0, "7", float("nan"))], "temp_oil_value double, tap_position_value double, oil_level string, voltage_value double")
    got = clean.nullify_implausible(d).first()
    assert got["temp_oil_value"] == 199.0  # the wide temp rule applies, not the oil rule
    assert got["tap_position_value"] is None and got["oil_level"] == 7.0 and got["voltage_value"] is None


def test_clipping_at_the_closing_hour(spark):
    rows = [
        (1, "temp_oil_value", "2024-01-01 00:10:00", 10.0), (1, "temp_oil_value", "2024-01-01 03:00:00", 13.0),
        (1, "temp_oil_value", "2024-01-01 03:20:00", 99.0),
        (1, "voltage_value", "2024-01-01 00:40:00", 1.0), (1, "voltage_value", "2024-01-01 00:50:00", 2.0),
        (1, "voltage_value", "2024-01-01 02:15:00", 4.0), (1, "voltage_value", "2024-01-01 05:00:00", 8.0),
    ]
    b = panel.hourly_buckets(to_readings(spark, rows))
    r = panel.common_range(b).select("lo_hour", "hi_hour").first()
    assert (r["hi_hour"] - r["lo_hour"]) == 2  # 00:40 -> 01:00 and 03:20 -> 03:00
    got = collect(panel.raw_panel(b, ["temp_oil_value", "voltage_value"]))
    same(got["temp_oil_value"], pd.Series([np.nan, np.nan, 13.0]))  # 03:20 lies after the end
    same(got["voltage_value"], pd.Series([np.nan, 4.0, np.nan]))


def test_disjoint_series_give_no_panel(spark):
    rows = [(1, "temp_oil_value", "2024-01-01 00:00:00", 1.0), (1, "voltage_value", "2024-01-03 00:00:00", 1.0)]
    assert panel.raw_panel(panel.hourly_buckets(to_readings(spark, rows)), ["temp_oil_value", "voltage_value"]).count() == 0


def test_last_value_skips_missing(spark):
    rows = [(1, "tap_position_value", "2024-01-01 00:10:00", 5.0), (1, "tap_position_value", "2024-01-01 00:50:00", None)]
    assert panel.hourly_last(to_readings(spark, rows)).first()["value"] == 5.0


def classify_by_loop(pdf, crits):
    """Row by row in rule order, as a restatement of the sequential definition."""
    out = []
    for _, row in pdf.iterrows():
        level, names, texts = 0, [], []
        for rule in crits:
            for c in rules.rule_columns(SIGNALS, rule.variable):
                v = row[c]
                if rule.critical[0] <= v < rule.critical[1]:
                    level = 2
                    names.append(c)
                    texts.append(f"{rule.description} CRÍTICO")
                if rule.alert[0] <= v < rule.alert[1] and level < 2:
                    level = 1
                    names.append(c)
                    texts.append(f"{rule.description} ALERTA")
        oils = [row["temp_oil_value"], row["temp_oil_oltc_value"]]
        if row["current_load_value"] > 2000 and any(o > 70 for o in oils):
            level = 2
            texts.append("SOBRECARGA TÉRMICA COMBINADA")
        steep = [row["temp_spot_hot_value"] - o for o in oils if row["temp_spot_hot_value"] - o > 25]
        if level < 2 and steep:
            level = 1
            texts.append(f"GRADIENTE TÉRMICO EXCESIVO ({steep[0]:.1f}°C)")
        out.append((["NORMAL", "ALERTA", "CRITICO"][level], level, ", ".join(names), "; ".join(texts)))
    return pd.DataFrame(out, columns=["estado_operacional", "nivel_severidad", "variables_anomalas", "descripcion_anomalia"])


def test_classifier_matches_the_loop(spark):
    pdf = panel_pdf(400, seed=9, gaps=0.05)
    rng = np.random.default_rng(1)
    for c, edges in {"temp_oil_value": [65.3, 75.0, 65.2], "temp_spot_hot_value": [76.2, 100.0], "current_load_value": [1508.1, 1809.7, 2100.0],
                     "tap_position_value": [0, 3, 15, 17, 18, 19], "temp_ambient_value": [40, 50]}.items():
        at = rng.random(len(pdf)) < 0.4
        pdf.loc[at, c] = rng.choice(edges, at.sum())
    # tap values outside every band let the thermal rules decide
    pdf.loc[rng.random(len(pdf)) < 0.5, "tap_position_value"] = 17.0
    got = collect(rules.classify(to_spark(spark, pdf)))
    want = classify_by_loop(pdf, RULES)
    assert set(want["estado_operacional"]) == {"NORMAL", "ALERTA", "CRITICO"}
    for c in want.columns:
        bad = got[c].astype(str) != want[c].astype(str)
        assert not bad.any(), (c, got[c][bad].head(3).tolist(), want[c][bad].head(3).tolist())


def test_tap_bands(spark):
    taps = [0.0, 3.0, 7.0, 15.0, 16.9, 17.0, 20.0]
    d = spark.createDataFrame([(t,) for t in taps], "tap_position_value double")
    state = lambda x: [r[0] for r in x.orderBy("tap_position_value").select("estado_operacional").collect()]
    assert state(rules.classify(d)) == ["CRITICO"] * 5 + ["NORMAL"] * 2
    assert state(rules.classify(d, bands="outside")) == ["CRITICO", "ALERTA", "NORMAL", "CRITICO", "CRITICO", "CRITICO", "CRITICO"]


def test_classify_is_a_projection(spark):
    d = rules.classify(to_spark(spark, panel_pdf(10)))
    assert "Exchange" not in d._jdf.queryExecution().executedPlan().toString()


def test_rule_tables(spark):
    assert rules.rules_table(spark).count() == 18 and rules.combined_rules_table(spark).count() == len(COMBINED_RULES)


def test_state_counts_include_missing(spark):
    d = spark.createDataFrame([("NORMAL",), (None,), ("NORMAL",), ("CRITICO",)], "estado_operacional string")
    got = {r[0]: (r[1], r[2]) for r in rules.state_counts(d).collect()}
    assert got[None] == (1, 25.0) and got["NORMAL"] == (2, 50.0)


def test_missing_and_quality(spark):
    pdf = panel_pdf(100, gaps=0.3)
    df = to_spark(spark, pdf)
    got = {r["category"]: r for r in clean.missing_by_category(df).collect()}
    assert got["__global__"]["missing"] == pdf[SIGNALS].isna().sum().sum() and got["Térmica"]["columns"] == 5
    rep = quality.quality_report(df, clean.impute(df, s=SHORT), SIGNALS).first()
    assert rep["missing_final"] == 0 and rep["completitud_total"] == 100.0
    assert rep["interpolated"] == pdf[SIGNALS].isna().sum().sum()


def test_gaps_across_chunks(spark):
    pdf = panel_pdf(300)
    keep = ~pdf.groupby("asset_id").cumcount().isin([49, 50, 51, 120, 200, 201])
    df = to_spark(spark, pdf[keep])
    got = quality.gaps(df, SHORT).groupBy("asset_id").agg(F.count("*").alias("n"), F.max("gap_hours").alias("m")).collect()
    assert all(r["n"] == 3 and r["m"] == 4.0 for r in got)
    tc = quality.time_continuity(df, SHORT).first()
    assert tc["numero_gaps"] == 3 and tc["continuidad_temporal"] == pytest.approx((294 - 3) * 100 / 294)


def test_verdict(spark):
    good = panel_pdf(100)
    good["temp_spot_hot_value"] = good["temp_oil_value"] + 5
    assert quality.validation_verdict(to_spark(spark, good)).first()["estado_validacion"] == "EXITOSO"
    bad = good.assign(temp_spot_hot_value=good["temp_oil_value"] - 1, voltage_value=10.0)
    row = quality.validation_verdict(to_spark(spark, bad)).first()
    assert row["estado_validacion"] == "ADVERTENCIAS" and row["alertas"] == "coherencia_termica, rango_voltage_value"


def test_silver_end_to_end(spark):
    pdf = panel_pdf(80, assets=1)
    long = pdf.melt(["asset_id", "ts"], SIGNALS, "tag", "value")
    long = long.drop(long.index[(long["tag"] == "voltage_value") & (long.index % 3 == 0)])
    got = collect(silver(to_spark(spark, long), s=SHORT))
    assert len(got) == 80 and not got[SIGNALS].isna().any().any()
    same(got["temp_oil_value"], pdf["temp_oil_value"])


def test_feature_groups(spark):
    d = spark.createDataFrame([(1, 2, 3, 4)], "asset_id int, temp_oil_value int, gradient_hot_oil int, year int")
    assert {r["column"]: r["grupo"] for r in feature_groups(d).collect()} == {
        "temp_oil_value": "Variables Originales", "gradient_hot_oil": "Features Térmicos", "year": "Otros Features"}


def test_one_decimal_rounds_like_the_binary_value(spark):
    from gridpulse.functions.columns import one_decimal

    rng = np.random.default_rng(0)
    xs = list(np.round(rng.uniform(25, 400, 3000), 2)) + list(np.round(rng.uniform(25, 400, 500), 6)) + [25.25, 25.75, 30.0, 29.95, 29.949999999999996]
    got = spark.createDataFrame([(float(x),) for x in xs], "x double").select("x", one_decimal(F.col("x")).alias("t")).collect()
    assert [r["t"] for r in got] == [f"{r['x']:.1f}" for r in got]
