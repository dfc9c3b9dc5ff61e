import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gridpulse.llm import importance, terms
from gridpulse.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest):
    w = WORD.findall((text or "").translate(LOWER))
    return w, [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, buckets, longest, least, percent, seed):
    """(doc_id, n_words, n_features, weight, score) of every row and those drawn, in order."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in features(x, longest)[1]) for texts in ([x for _, x in docs], target))
    s_all, t_all = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * float(s_all) / ((s[b] + 1) * float(t_all)))) for b in s}
    rows = []
    for doc_id, text in docs:
        w, f = features(text, longest)
        weight = sum(gain[bucket(x)] for x in f)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    return rows, able[: percent * len(able) // 100]


def test_running_crcs_and_shifts():
    r = np.random.default_rng(1)
    data = r.integers(0, 256, 50_000).astype(np.uint8)
    crcs = terms.running(data)
    a = r.integers(0, 50_000, 300)
    b = np.minimum(50_000, a + np.append(r.integers(0, 70, 200), r.integers(0, 50_000, 100)))
    got = crcs[b] ^ terms.shifted(crcs[a], b - a)
    assert got.tolist() == [zlib.crc32(data[i:j].tobytes()) for i, j in zip(a, b)]
    assert terms.running(data[:0]).tolist() == [0]


@pytest.mark.parametrize("longest", [1, 3])
@pytest.mark.parametrize("piece", [7, 40, 10_000])
def test_parts_of_a_long_text_give_each_run_once(longest, piece):
    text = "Ab, cD é-f\n" * 30 + "x" * 50 + " 1 2 3"
    batch = pa.record_batch({"text": [text]})
    got = Counter()
    for _, parts in terms.words_of([batch], longest - 1, piece):
        for found in parts:
            crcs = terms.running(found.data)
            for n in range(1, longest + 1):
                got.update(terms.run_crcs(found, crcs, n)[1].tolist())
    assert got == Counter(zlib.crc32(f.encode()) for f in features(text, longest)[1])


@pytest.mark.parametrize("longest,buckets", [(1, 10_000), (2, 97), (4, 1)])
def test_resample_equals_brute_force(spark, edge_docs, edge_rows, longest, buckets):
    r = random.Random(3)
    target = [prose(r, 30, 50), None, "", "One, TWO; one two é"]
    docs = [(x[0], x[1]) for x in edge_rows]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    rows, drawn = brute(docs, target, buckets, longest, 20, 30, 7)
    got = importance.resample(edge_docs, bench, buckets, longest, 20, 30, 7).collect()
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted((tuple(x)[:5] for x in got), key=key) == sorted(rows, key=key)
    ranked = sorted((x for x in got if x.rank is not None), key=lambda x: x.rank)
    assert [x.rank for x in ranked] == list(range(1, len(drawn) + 1)) and [tuple(x)[:5] for x in ranked] == drawn


def test_ties_go_to_the_smaller_id_and_copies_have_ranks_of_their_own(spark):
    text = " ".join(["same"] * 25)
    docs = spark.createDataFrame([(5, text)] * 40 + [(i, "few words") for i in range(40)], "doc_id long, text string").repartition(7)
    bench = spark.createDataFrame([(1, "same")], "item_id long, text string")
    got = importance.resample(docs, bench, percent=50).where("rank is not null").collect()
    assert sorted(x.rank for x in got) == list(range(1, 21)) and {x.doc_id for x in got} == {5}


def test_empty_tables(spark, no_docs, edge_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(no_docs, none).count() == 0
    got = importance.resample(edge_docs, none)
    assert got.count() == edge_docs.count() and got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]


def test_query_equals_sql_with_edges(spark, edge_docs, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    edge_docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, prose(random.Random(1), 40)), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got, want = QUERIES["op13_importance"](spark, str(tmp_path)).collect(), con.execute(ORACLES["op13_importance"]).fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
