import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from gridpulse.llm import ranked
from gridpulse.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    """(item_id, rank, doc_id, score), every document scored for every item."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, c.total()) for i, c in held if c]
    n_docs, n_words = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = defaultdict(Counter)
    for i, t in set(items):
        if i is not None:
            asked[i].update(terms(t))
    out = []
    for item, query in asked.items():
        rows = []
        for doc_id, c, n in held:
            m = 100 - 25 + 25 * n * n_docs // n_words
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
                        for t, times in query.items() if t in c)
            if score > 0:
                rows.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=lambda x: x[:2])


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda x: x[:2])


@pytest.fixture(scope="module")
def items():
    r = random.Random(8)
    return [(i, prose(r, r.randint(1, 30), 400)) for i in range(12)] + [
        (3, "second text of three, É é"), (3, "second text of three, É é"), (20, ""), (21, None), (None, "no id"), (22, "no-such-term-anywhere")]


@pytest.fixture(scope="module")
def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("k", [1, 3, 20])
def test_ranked_equals_brute_force(spark, edge_docs, edge_rows, items, bench, k):
    assert rows_of(ranked.ranked(edge_docs, bench, k)) == brute([(x[0], x[1]) for x in edge_rows], items, k)


@pytest.mark.parametrize("setting", [{"SHARD_DOCS": 7}, {"SHARD_POSTINGS": 50}, {"BLOCK_BYTES": 300}, {"SALTS": 2}])
def test_small_shards_and_blocks_find_the_same(spark, edge_docs, edge_rows, items, bench, monkeypatch, setting):
    for name, value in setting.items():
        monkeypatch.setattr(ranked, name, value)
    assert rows_of(ranked.ranked(edge_docs, bench, 5)) == brute([(x[0], x[1]) for x in edge_rows], items, 5)


@pytest.mark.parametrize("seed", range(12))
def test_search_of_a_shard_equals_full_scores(seed):
    """Short and long lists, many steps of the walk, floors that come from outside."""
    r = np.random.default_rng(seed)
    size, width, k = int(r.integers(1, 400)), 30, int(r.integers(1, 12))
    held = r.random((size, width)) < r.choice([0.002, 0.02, 0.3, 0.9], width)
    counts = np.where(held, r.integers(1, 9, (size, width)), 0)
    doc, term = np.nonzero(held)
    shard = ranked.Shard.build(r.integers(1, 200, size), held.sum(1), term, counts[doc, term], width, size, 40 * size)
    query = [(t, int(w)) for t, w in enumerate(r.integers(0, 50, width))]
    full = np.zeros(size, dtype=np.int64)
    for t, w in query:
        lo, hi = shard.at[t], shard.at[t + 1]
        full[shard.docs[lo:hi]] += w * shard.share[lo:hi]
    top = np.sort(full)[::-1]
    for floor in (0, int(top[min(k, size) - 1]) if size >= k else 0):
        docs, scores = ranked.search(shard, query, k, floor, walk=16, short=int(r.integers(1, 40)))
        assert (full[docs] == scores).all() and len(set(docs.tolist())) == len(docs)
        least = top[k - 1] if size >= k else 1
        assert set(np.flatnonzero(full >= max(least, 1)).tolist()) <= set(docs.tolist())


def test_walk_skips_what_cannot_win():
    """With a high floor the blocks without the winner are never summed up."""
    size = 64 * 100
    docs = np.arange(size)
    share = np.ones(size, dtype=np.int64)
    share[4000] = 1000
    shard = ranked.Shard(size, np.array([0, size]), docs, share)
    found, scores = ranked.search(shard, [(0, 1)], 1, 500, walk=64)
    assert found.tolist() == [4000] and scores.tolist() == [1000]


def test_ties_and_copies(spark):
    docs = spark.createDataFrame([(i, "alpha beta") for i in (9, 4, 4, 7, None)] + [(1, "gamma")], "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(1, "Alpha alpha delta")], "item_id long, text string")
    got = ranked.ranked(docs, bench, 10).orderBy("rank").collect()
    assert [x.doc_id for x in got] == [4, 4, 7, 9, None] and [x.rank for x in got] == [1, 2, 3, 4, 5]
    assert len({x.score for x in got}) == 1


def test_empty_tables(spark, no_docs, edge_docs, bench):
    none = spark.createDataFrame([], "item_id long, text string")
    for docs, items in ((no_docs, bench), (edge_docs, none), (no_docs, none)):
        got = ranked.ranked(docs, items)
        assert got.count() == 0 and got.columns == ["item_id", "rank", "doc_id", "score"]


def test_query_equals_sql_with_edges(spark, edge_docs, bench, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    edge_docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(ORACLES["op12_ranked"]).fetchall()
    assert rows_of(QUERIES["op12_ranked"](spark, str(tmp_path))) == sorted(want, key=lambda x: x[:2])
