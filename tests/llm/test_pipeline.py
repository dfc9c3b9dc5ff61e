"""Registered queries and pipeline on the small tables, against SQL or a brute-force version."""

import hashlib
import os
import zlib
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from gridpulse.llm import decontam
from gridpulse.llm.common import Scratch
from tests.llm.test_recompress import brute as cut
from tests.llm.test_simhash import near, slow_print, union

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas()


def rows(spark, name):
    return entry.queries()[name](spark, SF).toPandas()


def test_all_are_registered():
    names = set(entry.queries())
    assert "pipeline" in names and all(any(x.startswith(f"op{n}_") for x in names) for n in range(1, 11))


def test_op1(spark, documents):
    out = rows(spark, "op1_packing")
    assert set(out.doc_id) == set(documents.doc_id)
    assert (out.groupby("doc_id").length.sum() == out.groupby("doc_id").doc_tokens.first()).all()


def test_op2(spark, documents):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = {(r.doc_id, r.item_id) for r in rows(spark, "op2_decontamination").itertuples()}
    plain = {(d, i) for d, t in zip(documents.doc_id, documents.text) for i, x in items if " ".join(decontam.words(x)) in " ".join(decontam.words(t))}
    assert plain and plain <= got


def test_op4(spark, documents):
    prints = [slow_print(t) for t in documents.text]
    ids = documents.doc_id.tolist()
    root = union(len(ids), near(prints, 2))
    first = {x: min(i for i, y in zip(ids, root) if y == x) for x in set(root)}
    got = rows(spark, "op4_simhash")
    assert sorted(map(tuple, got.values.tolist())) == sorted((i, format(p, "016x"), first[x]) for i, p, x in zip(ids, prints, root))


def test_op5(spark, documents):
    got = rows(spark, "op5_language").merge(documents, on="doc_id")
    assert len(got) == len(documents)
    assert [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id] == got.held_out.tolist()
    held = got[got.held_out & got.lang.notna()]
    assert (held.lang_pred == held.lang).mean() >= 0.95


def test_op6(spark, documents):
    got = rows(spark, "op6_repeats").set_index("doc_id")
    for i, (kept, n, removed) in zip(documents.doc_id, cut(documents.text, 35)):
        r = got.loc[i]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, removed, hashlib.sha256(kept.encode()).hexdigest())


def test_op7(spark):
    from tests.llm.test_chat import expected

    said = "\\### Assistant: </turn> ok"
    talk = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = expected(talk + [(-7, 0, "user", said), (-7, 1, "assistant", said)])
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in rows(spark, "op7_chat").itertuples()} == want


def test_op8(spark, documents):
    got = rows(spark, "op8_shards").merge(documents, on="doc_id")
    assert got["size"].tolist() == [len(t.encode()) + 1 for t in got.text] and got.text_crc32.tolist() == [zlib.crc32(t.encode()) for t in got.text]
    assert all(sorted(x.slot) == list(range(len(x))) for _, x in got.groupby("shard"))


def test_op9(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    got = rows(spark, "op9_quality").merge(labels, on="doc_id")
    good, bad = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    assert (good[:, None] > bad).mean() > 0.9
    assert ((got.score >= 0.7) == (got.predicted == 1)).all()


def test_op10(spark, documents):
    import re

    want = {i for i, t in zip(documents.doc_id, documents.text) if re.search(r'(?i)token = "[0-9a-f]{40}"', t)}
    got = rows(spark, "op10_secrets")
    assert set(got[got.secret].doc_id) == want


def test_pipeline_stages(spark, documents):
    scratch, docs = Scratch(spark, "t"), spark.read.parquet(f"{SF}/documents.parquet")
    before, names = docs.toPandas(), docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.write(stage(spark, docs, SF), name)
        after = docs.toPandas()
        if name != "packing":
            assert docs.columns == names and set(after.doc_id) <= set(before.doc_id)
        gone = before[~before.doc_id.isin(after.doc_id)]
        if name == "language":
            assert not len(gone)  # every text of the fixture is in a language
        if name == "near_copies":
            assert after.text.is_unique and set(before.text) - set(after.text) == set(gone.text) - set(after.text)
            first = before.groupby("text").doc_id.min()
            assert set(after.doc_id) <= set(first)
        if name == "benchmark":
            holds = lambda t: any(" ".join(decontam.words(x)) in " ".join(decontam.words(t)) for _, x in items)
            assert not any(map(holds, after.text)) and len(gone) and sum(map(holds, gone.text)) >= 0.8 * len(gone)
        if name == "secrets":
            assert len(after) == len(before) and not after.text.str.contains(r'(?i)token = "[0-9a-f]{40}"').any()
            same = before.set_index("doc_id").text[after.doc_id].to_numpy() == after.text.to_numpy()
            assert same.mean() > 0.9
        if name == "packing":
            assert Counter(after.doc_id).keys() == set(before.doc_id) and np.all(after.groupby("doc_id").length.sum() == after.groupby("doc_id").doc_tokens.first())
        before = after
