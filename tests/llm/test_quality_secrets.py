import random

import numpy as np
from pyspark.sql import functions as F

from gridpulse.llm import quality, secrets, trees
from tests.llm.conftest import SCHEMA, prose


def test_parse_and_paths():
    text = "Tree\n  If (feature 3 <= 0.5)\n   Predict: 0.25\n  Else (feature 3 > 0.5)\n   If (feature 1 <= -2.0E-3)\n    Predict: 1.0\n   Else (feature 1 > -2.0E-3)\n    Predict: 0.0\n"
    t = trees.parse(text)
    assert t == (3, 0.5, 0.25, (1, -0.002, 1.0, 0.0))
    assert [trees.value(t, x) for x in ([0, 0, 0, 0.5], [0, -1, 0, 1], [0, 0, 0, 1])] == [0.25, 1.0, 0.0]
    assert trees.paths(t) == [((3, False, 0.5),), ((3, True, 0.5),), ((3, True, 0.5), (1, False, -0.002)), ((3, True, 0.5), (1, True, -0.002))]
    assert trees.simplify(((1, True, 2.0), (0, False, 9.0), (1, True, 5.0), (0, False, 3.0))) == ((0, False, 3.0), (1, True, 5.0))


def junk(r, n):
    return "".join(f"{w}{r.choice('$%&#')}{r.choice('!*|')} " for w in prose(r, n).split())


def test_quality_on_held_out_rows(spark, no_docs):
    r = random.Random(5)
    rows = [(i, prose(r, 80) if i % 3 else junk(r, 80), "", "", 0, 0, "", 0, 0) for i in range(400)]
    rows += [(900, None, "", "", 0, 0, "", 0, 0), (901, "", "", "", 0, 0, "", 0, 0), (902, prose(r, 20000), "", "", 0, 0, "", 0, 0), (None, rows[0][1], "", "", 0, 0, "", 0, 0)]
    docs = spark.createDataFrame(rows + rows[:2], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 300)] + [(5, None, 0), (7, 9, 0), (None, 1, 0), (901, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality.rate(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= x.score <= 1 for x in out)
    judged = [((x.doc_id % 3 > 0), x.score) for x in out if x.doc_id is not None and 300 <= x.doc_id < 400]
    assert min(s for y, s in judged if y) > 0.7 > max(s for y, s in judged if not y)
    assert {round(x.score, 6) for x in quality.rate(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.rate(no_docs, labels).count() == 0


def test_rules_are_sparse_column_expressions(spark):
    r = random.Random(6)
    docs = spark.createDataFrame([(i, prose(r, 50) if i % 2 else junk(r, 50)) for i in range(200)], "doc_id long, text string")
    table = quality.with_statistics(docs).withColumn("label", (F.col("doc_id") % 2).cast("double"))
    rules = quality.fit(table)
    assert 0 < len(rules.weights) < 60
    by_hand = {}
    for x in table.collect():
        z = rules.intercept + sum(
            w for rule, w in rules.weights if all((x[quality.STATISTICS[f]] > t) == g for f, g, t in rule))
        by_hand[x.doc_id] = 1 / (1 + np.exp(-z))
    for x in table.select("doc_id", rules.score().alias("s")).collect():
        assert abs(x.s - by_hand[x.doc_id]) < 1e-9


def test_forest_on_unseen_findings(spark):
    forest = secrets.default_forest(spark)
    right = total = 0
    for before, s, after, y in secrets.labelled_findings(600, seed=99):
        x = secrets.features(before[-secrets.CONTEXT:], s, after[: secrets.CONTEXT])
        right += (sum(trees.value(t, x) for t in forest) / len(forest) >= 0.5) == bool(y)
        total += 1
    assert right / total > 0.95


def test_scan_and_redact(spark, edge_docs, no_docs):
    forest = secrets.default_forest(spark)
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    text = f'prose before token = "{key}" and after. mail 12@mail3.example.com 4024007112345678 {prose(random.Random(1), 30)}'
    rows = [(1, text, 0, 5), (1, text, 0, 5), (2, None, 0, 5), (3, "", 0, 5), (4, "TOKEN = \"" + key.upper() + "\"!!", 0, 5), (5, text * 300, 0, 5), (None, "clean words", 0, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int, n_chars long")
    found = secrets.scan(docs, forest).where("secret").groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in found} == {1: 2, 4: 1, 5: 300}
    hit = secrets.scan(docs, forest).where("secret and doc_id = 1").first()
    assert text[hit.start : hit.end] == key and hit.length == 40
    out = secrets.redact(docs, forest)
    assert out.columns == docs.columns and out.count() == len(rows)
    kept = {r.doc_id: r for r in out.collect()}
    assert kept[1].text == text.replace(key, "[SECRET]") and kept[1].n_chars == len(kept[1].text)
    assert kept[None].text == "clean words" and kept[2].text is None and kept[2].n_chars == 5
    assert key not in kept[5].text
    assert secrets.scan(no_docs, forest).count() == 0 and secrets.redact(edge_docs, forest).count() == edge_docs.count()


def test_generated_secrets_are_candidates():
    for before, s, after, y in secrets.labelled_findings(4000, seed=5):
        if y:
            found = [(before + s + after)[a:b] for a, b in secrets.candidates(before + s + after)]
            assert s in found, (before, s, after, found)


def test_values_with_other_signs_are_replaced_whole(spark):
    values = ["abcd12!Xy9kQ", "S3cure#Pass$99", "Tr0ub4dor!x9", "p4$!w", "a1%B2^c3&D4*e5"]
    for v in values:
        for text in (f'the password = "{v}" is old', f"password: '{v}'", f"see password={v}", f"password = {v}, and so on", f"?user=me&password={v}&page=2"):
            assert v in [text[a:b] for a, b in secrets.candidates(text)], text
    docs = spark.createDataFrame([(i, f'we set password = "{v}" here') for i, v in enumerate(values[:3])], "doc_id long, text string")
    out = secrets.redact(docs, secrets.default_forest(spark)).collect()
    assert {x.text for x in out} == {'we set password = "[SECRET]" here'}


def test_quoted_sentences_are_looked_into():
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    text = f'note: "use {key} or password = abc1!x now" end {key}'
    assert [text[a:b] for a, b in secrets.candidates(text)] == [f"use {key} or password = abc1!x now", key, "abc1!x", key]
