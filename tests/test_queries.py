"""Registered queries against their SQL at the smallest scale factor."""

import math
import os

import pytest

import __spark_entry__ as e

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v + 0.0) if isinstance(v, float) else str(v)


def sorted_rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(e.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = e.queries()[name](spark, SF)
    rel = duck.execute(e.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted_rows(df.columns, df.collect()) == sorted_rows(cols, rel.fetchall())


def test_entry_and_registry(spark):
    assert set(e.oracle_sql()) <= set(e.queries())
    got = {r["estado_operacional"]: r["registros"] for r in e.entry(spark).collect()}
    assert set(got) == {"NORMAL", "ALERTA", "CRITICO"}


def test_models_on_given_tables(spark):
    q = e.queries()
    scores = q["isolation_forest_score"](spark, SF)
    assert scores.where("if_score <= 0 or if_score > 1 or if_score is null").count() == 0
    errors = q["pca_reconstruction_error"](spark, SF)
    assert errors.where("recon_error < 0 or recon_error is null").count() == 0
