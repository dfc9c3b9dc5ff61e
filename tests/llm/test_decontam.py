import random

import numpy as np
import pytest

from gridpulse.llm import decontam
from tests.llm.conftest import SCHEMA, prose


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(texts, items, slack=0.2):
    out = set()
    for d, text in texts:
        w = decontam.words(text)
        for i, item in items:
            v = decontam.words(item)
            if v and any(distance(v, w[p : p + len(v)]) <= decontam.limit(len(v), slack) for p in range(len(w) - len(v) + 1)):
                out.add((d, i))
    return out


def test_edit_distances_by_rows():
    r = np.random.default_rng(1)
    a, b = r.integers(0, 4, (50, 9)), r.integers(0, 4, (50, 9))
    assert decontam.edit_distances(a, b).tolist() == [distance(x, y) for x, y in zip(a.tolist(), b.tolist())]


def test_embedding_of_near_texts_is_near():
    r = np.random.default_rng(2)
    a = r.integers(1, 1 << 60, (40, 40), dtype=np.uint64)
    b = a.copy()
    b[:, 20] = 7
    same = np.mean(decontam.embed(a, 0, 70) == decontam.embed(b, 0, 70))
    assert same > 0.7 > 0.1 > np.mean(decontam.embed(a, 0, 70) == decontam.embed(a[::-1], 0, 70))


def test_matches_equal_brute_force(spark):
    r = random.Random(9)
    items = [(i, prose(r, r.randint(5, 30))) for i in range(12)] + [(50, ""), (51, None), (None, "no id here at all")]
    known = [x for x in items if x[1] and x[0] is not None]
    texts = []
    for d in range(60):
        w = prose(r, r.randint(0, 60)).split()
        if d % 2:
            v = r.choice(known)[1].upper().split()
            for _ in range(r.randint(0, len(v) // 4)):
                k = r.randrange(len(v))
                r.choice((lambda: v.__setitem__(k, "zz"), lambda: v.insert(k, "yy"), lambda: v.__delitem__(k)))()
            w[len(w) // 2 : len(w) // 2] = v
        texts.append((d, " ".join(w)))
    texts += [(100, None), (101, ""), (102, known[0][1] + ".  " + known[1][1]), (102, known[0][1] + ".  " + known[1][1])]
    docs = spark.createDataFrame([(d, t, "en", "s", 0, 0, "", 0, 0) for d, t in texts], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.contaminated(docs, bench).collect()
    got, want = {(x.doc_id, x.item_id) for x in found}, brute(texts, known)
    assert got <= want and len(got) >= 0.97 * len(want) and len(found) == len(got)
    assert {(102, known[0][0]), (102, known[1][0])} <= got
    clean = decontam.clean(docs, bench)
    assert clean.columns == docs.columns
    assert {x.doc_id for x in clean.collect()} == {d for d, _ in texts} - {d for d, _ in got}


def test_more_blocks_find_the_same(spark, monkeypatch):
    r = random.Random(3)
    items = [(i, prose(r, 12)) for i in range(10)]
    docs = spark.createDataFrame([(d, t) for d, t in items] + [(50, prose(r, 40))], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = decontam.contaminated(docs, bench).toPandas().sort_values(["doc_id", "item_id"], ignore_index=True)
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 40)
    many = decontam.contaminated(docs, bench).toPandas().sort_values(["doc_id", "item_id"], ignore_index=True)
    assert one.equals(many) and len(one) >= 10


def test_empty_tables(spark, no_docs):
    empty = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert decontam.contaminated(no_docs, empty).count() == 0
    assert decontam.contaminated(some, empty).count() == 0
    assert decontam.clean(some, empty).count() == 1


def passage(a, b):
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def blocks_find(v, w, d):
    """Exact filter to hold the sampled search against: d edits leave one of d + 1 blocks of the item whole."""
    cuts = [len(v) * i // (d + 1) for i in range(d + 2)]
    return any(w[p : p + hi - lo] == v[lo:hi] for lo, hi in zip(cuts, cuts[1:]) for p in range(len(w) - (hi - lo) + 1))


@pytest.mark.parametrize("seed", [12, 13])
def test_passages_against_brute_force(spark, seed):
    """Words left out, added and changed up to the limit, at both ends of texts, in texts shorter than the item, and in items of
    200 and 400 words: no false positive, at least 0.97 of all pairs found."""
    r = random.Random(seed)
    items = [(i, prose(r, n)) for i, n in enumerate([1, 3, 4, 5, 9, 10, 16, 19, 20, 25, 37, 59, 200, 400])]
    texts = []
    for d in range(300):
        v = items[r.randrange(len(items))][1].split()
        kinds = r.choice(([0], [1], [2], [0, 1, 2]))
        for _ in range(r.choice((0, len(v) // 10, len(v) // 5, len(v) // 5, len(v) // 4))):
            k = r.randrange(len(v))
            (lambda: v.__setitem__(k, "zz"), lambda: v.insert(k, "yy"), lambda: v.__delitem__(k))[r.choice(kinds)]()
        around = prose(r, r.choice((0, 0, 5, 40))).split(), prose(r, r.choice((0, 0, 5, 40))).split()
        texts.append((d, " ".join([*around[0], *v, *around[1]])))
    split = [(d, decontam.words(t)) for d, t in texts]
    want = {}
    for i, x in items:
        v = decontam.words(x)
        for d, w in split:
            if blocks_find(v, w, decontam.limit(len(v), 0.2)) and (k := passage(v, w)) <= decontam.limit(len(v), 0.2):
                want[d, i] = k
    docs = spark.createDataFrame(texts + [(900, None), (901, "")], "doc_id long, text string").repartition(8)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.contaminated(docs, bench, passages=True).collect()
    got = {(x.doc_id, x.item_id): x.distance for x in found}
    assert len(got) == len(found) and set(got) <= set(want) and all(got[k] >= want[k] for k in got)
    assert len(got) >= 0.97 * len(want) and sum(got[k] == want[k] for k in got) >= 0.97 * len(got)
    long = {k for k in want if len(items[k[1]][1].split()) >= 200}
    assert len(long & set(got)) >= 0.9 * len(long) > 10
    gone = {d for d, _ in texts} - {x.doc_id for x in decontam.clean(docs, bench, passages=True).collect()}
    assert gone == {d for d, _ in got}


def test_queries_go_through_the_sampled_tables(spark, tmp_path, monkeypatch):
    """Without the sampler's tables, neither the query nor the pipeline's stage finds anything."""
    import corpus_pipeline
    from gridpulse.llm.queries import QUERIES

    r = random.Random(1)
    items = [(i, prose(r, 30)) for i in range(5)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in items], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["op2_decontamination"](spark, str(tmp_path)).count() == 5
    assert corpus_pipeline.benchmark(spark, docs, str(tmp_path)).count() == 0
    sampler = decontam.Benchmark._sampler
    monkeypatch.setattr(decontam.Benchmark, "_sampler", lambda self, n, x: decontam.Sampler(1, [p[:0] for p in sampler(self, n, x).picks]))
    assert QUERIES["op2_decontamination"](spark, str(tmp_path)).count() == 0
    assert corpus_pipeline.benchmark(spark, docs, str(tmp_path)).count() == 5


def test_several_blocks_and_empty_tables_of_passages(spark, no_docs, monkeypatch):
    r = random.Random(3)
    items = [(i, prose(r, 12)) for i in range(10)]
    docs = spark.createDataFrame([(d, t) for d, t in items] + [(50, prose(r, 40))], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 40)
    assert {(x.doc_id, x.item_id) for x in decontam.contaminated(docs, bench, passages=True).collect()} >= {(i, i) for i in range(10)}
    assert [x.doc_id for x in decontam.clean(docs, bench, passages=True).collect()] == [50]
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(no_docs, none, passages=True).count() == 0 == decontam.contaminated(docs, none, passages=True).count()
    assert decontam.clean(docs, none, passages=True).count() == 11 and decontam.clean(no_docs, bench, passages=True).columns == no_docs.columns


def test_sampled_tables_reach_the_recall_or_say_so(monkeypatch):
    r = random.Random(2)
    items = [(1, prose(r, 400))]
    monkeypatch.setattr(decontam, "MOST_TABLES", 128)
    with pytest.raises(ValueError, match="400 words"):
        decontam.Benchmark(0.2, 0.97, 3, 4).add(items)
