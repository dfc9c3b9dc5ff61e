import random

import numpy as np
import pytest

from gridpulse.llm import langid
from tests.llm.conftest import SCHEMA

SOUNDS = {"aa": "the and ing tion er on in".split(), "bb": "der die ung keit sch über".split(), "cc": "le des que éa oui eaux".split()}


def text(r, lang, n):
    return " ".join("".join(r.choice(SOUNDS[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(2)
    rows = []
    for i in range(600):
        lang = r.choice("aa aa aa bb cc".split())
        rows.append((i, text(r, lang, r.randint(3, 60)), lang, "s", 0, 0, "", 0, 0))
    rows += [(600, None, "aa", "", 0, 0, "", 0, 0), (601, "", "bb", "", 0, 0, "", 0, 0), (602, "123 --- 45!", "cc", "", 0, 0, "", 0, 0),
             (603, "the and", None, "", 0, 0, "", 0, 0), (None, text(r, "bb", 30), "bb", "", 0, 0, "", 0, 0), (604, text(r, "cc", 30000), "cc", "", 0, 0, "", 0, 0)]
    return spark.createDataFrame(rows + rows[:2], SCHEMA)


def test_held_out_accuracy_and_edges(docs):
    model = langid.fit(langid.learnable(docs))
    assert model.languages == ["aa", "bb", "cc"]
    assert 0 < np.count_nonzero(model.weights[:-1]) < model.weights[:-1].size / 2  # sparse
    out = langid.identify(docs.withColumnRenamed("source", "score"), model)
    assert out.columns == [*[c for c in docs.columns if c != "source"], "lang_pred", "score"]
    rows = out.collect()
    assert len(rows) == docs.count()
    und = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert und == {600, 601, 602} and all(r.score == 0 for r in rows if r.doc_id in und)
    held = {r.doc_id for r in docs.collect()} - {r.doc_id for r in langid.learnable(docs).collect()}
    judged = [r for r in rows if r.doc_id in held and r.doc_id not in und and r.lang]
    assert len(judged) > 80 and np.mean([r.lang_pred == r.lang for r in judged]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_labels_of_held_out_rows_do_not_matter(docs, spark):
    from pyspark.sql import functions as F

    fooled = docs.withColumn("lang", F.when(langid.fold("doc_id", 5) == 0, F.lit("zz")).otherwise(F.col("lang")))
    a, b = langid.fit(langid.learnable(docs)), langid.fit(langid.learnable(fooled))
    assert a.languages == b.languages and np.array_equal(a.weights, b.weights) and a.temperature == b.temperature


def test_sample_bound(docs):
    model = langid.fit(docs, langid.Settings(per_class=20))
    rows = [r for r in langid.identify(docs, model).collect() if r.lang and r.lang_pred != "und"]
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.9


def test_temperature_corrects_overconfidence():
    r = np.random.default_rng(0)
    truth = r.integers(0, 3, 400)
    scores = np.eye(3)[np.where(r.random(400) < 0.8, truth, r.integers(0, 3, 400))] * 40
    assert langid.fit_temperature(scores, truth) > 5


def test_nothing_to_learn(docs, no_docs):
    model = langid.fit(no_docs)
    assert {(r.lang_pred, r.score) for r in langid.identify(docs, model).collect()} == {("und", 0.0)}
    assert langid.identify(no_docs, model).count() == 0
