from collections import defaultdict

import numpy as np
import pytest
import xxhash

from gridpulse.llm import simhash
from gridpulse.llm.common import Scratch
from gridpulse.llm.components import components


def slow_print(text, k=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def union(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def near(prints, radius):
    return [(i, j) for i in range(len(prints)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= radius]


def test_fingerprint(edge_rows):
    for text in [r[1] for r in edge_rows][:70]:
        assert simhash.fingerprint(text, 3) == [slow_print(text)]


def clustered(n, seed=0):
    r = np.random.default_rng(seed)
    x = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    out = set(x.tolist())
    while len(out) < n:
        y = int(r.choice(list(out)[:200]))
        for _ in range(r.integers(1, 4)):
            y ^= 1 << int(r.integers(64))
        out.add(y)
    return sorted(out)


@pytest.mark.parametrize("radius", [0, 1, 2, 5])
def test_index_finds_all_links(radius):
    prints = np.array(clustered(700), dtype=np.uint64)
    index = simhash.GrayIndex(prints[:, None])
    got = {tuple(sorted((int(index.prints[a, 0]), int(index.prints[b, 0])))) for i, j in index.links(radius) for a, b in zip(i, j)}
    p = prints.tolist()
    assert got == {tuple(sorted((p[a], p[b]))) for a, b in near(p, radius)}


@pytest.mark.parametrize("group", [16, 4096])
def test_deals_lose_no_link(spark, group):
    """With groups of 16, crowded block values are cut again and again."""
    prints = clustered(900, 1)
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in prints], "f0 long")
    scratch = Scratch(spark, "t")
    edges = simhash.group_edges(simhash.deal_exact(df, 2, scratch, group), 1, 2).collect()
    place = {int(np.uint64(x).astype(np.int64)): i for i, x in enumerate(prints)}
    assert union(len(prints), [(place[e.f0], place[e.r_f0]) for e in edges]) == union(len(prints), near(prints, 2))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 200), (5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long"), Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}


def test_groups_equal_brute_force(edge_docs, edge_rows, no_docs):
    rows = simhash.near_groups(edge_docs).collect()
    assert len(rows) == len(edge_rows)
    prints = [slow_print(r[1]) for r in edge_rows]
    root = union(len(prints), near(prints, 2))
    least = defaultdict(list)
    for r, x in zip(edge_rows, root):
        if r[0] is not None:
            least[x].append(r[0])
    want = sorted((str(r[0]), p, min(least[x])) for r, p, x in zip(edge_rows, prints, root))
    assert want == sorted((str(r.doc_id), int(np.int64(r.f0).astype(np.uint64)), r.component_id) for r in rows)
    assert simhash.near_groups(no_docs).count() == 0


def test_one_of_each_near_copy(spark):
    from tests.llm.conftest import prose
    import random

    r = random.Random(8)
    rows, group = [], {}
    for g in range(30):
        w = prose(r, 200, 5000).split()
        for c in range(4):
            v = list(w)
            for _ in range(0 if c < 2 else 2):
                v[r.randrange(len(v))] = f"new{r.randrange(10**6)}"
            group[len(rows)] = g
            rows.append((len(rows), " ".join(v), 1.5))
    rows += [(0, rows[0][1], 1.5), (None, rows[0][1], 2.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id double")
    out = simhash.one_of_each(docs)
    assert out.columns == docs.columns
    ids = [x.doc_id for x in out.collect()]
    assert sorted(i for i in ids if i is not None) == list(range(0, 120, 4)) and ids.count(None) == 1


def test_crowded_tables(spark):
    """Nearly all rows in one crowd: bins are cut, and the crowd stays one group."""
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 63, 4, dtype=np.int64)
    rows = []
    for i in range(600):
        x = base.copy()
        for b in r.integers(0, 256, 6):
            x[b // 64] ^= np.int64(1) << np.int64(b % 64 % 63)
        rows.append(tuple(int(v) for v in x))
    df = spark.createDataFrame(sorted(set(rows)), "f0 long, f1 long, f2 long, f3 long")
    dealt = simhash.deal_sampled(df, 4, 49, Scratch(spark, "t"), 0.97, group=8)
    edges = simhash.group_edges(dealt, 4, 49).collect()
    names = sorted(set(rows))
    place = {x: i for i, x in enumerate(names)}
    root = union(len(names), [(place[tuple(e[:4])], place[tuple(e[4:])]) for e in edges])
    assert len(set(root)) == 1


def jaccard(a, b, k=5):
    a, b = ({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def test_texts_below_the_similarity_stay(spark):
    """A long shared passage: neighbours are similar to 0.7 or so and within 49 bits, but no near copies."""
    import random

    from tests.llm.conftest import prose

    r = random.Random(31)
    shared = prose(r, 200, 5000)
    texts = [shared + " " + prose(r, 40, 5000) for _ in range(40)]
    texts += [texts[0] + " end", " ".join([prose(r, 60, 5000)] * 1), texts[1]]
    assert max(jaccard(a, b) for i, a in enumerate(texts[:40]) for b in texts[:i]) < 0.8
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(x.doc_id for x in simhash.one_of_each(docs).collect()) == [*range(40), 41]


def test_repeated_lines_count_once(spark):
    import random

    from tests.llm.conftest import prose

    r = random.Random(5)
    body, line = prose(r, 200, 5000), prose(r, 6, 5000)
    docs = spark.createDataFrame([(1, f"{body} {line}"), (2, f"{body} " + f"{line} " * 200)], "doc_id long, text string")
    assert [x.doc_id for x in simhash.one_of_each(docs).collect()] == [1]


@pytest.mark.parametrize("most", [8, 4096])
def test_blocks_of_a_crowd_lose_no_link(spark, most):
    """One key holds a large group, chains that leave it, small groups and single rows."""
    r = np.random.default_rng(6)
    flip = lambda x, k: [w ^ sum(1 << int(b) % 64 for b in bits if b // 64 == i) for bits in [r.choice(256, k, replace=False)] for i, w in enumerate(x)]
    new = lambda: [int(x) for x in r.integers(0, 1 << 63, 4, dtype=np.uint64)]
    base = new()
    prints = [flip(base, 10) for _ in range(120)] + [new() for _ in range(15)]
    for _ in range(8):
        prints.append(flip(prints[-1], 45))
    other = new()
    prints += [flip(other, 45) for _ in range(20)] + [flip(base, 47)]
    flat = [sum(w << 64 * i for i, w in enumerate(x)) for x in prints]
    rows = [(1, n, 1, *(int(np.uint64(w).astype(np.int64)) for w in x)) for n, x in enumerate(prints)]
    df = spark.createDataFrame(rows, "key long, node long, weight int, f0 long, f1 long, f2 long, f3 long")
    edges = simhash.links_by_key(df, simhash.near_prints(4, 49), Scratch(spark, "t"), most, 4096).collect()
    assert union(len(flat), [(e.u, e.v) for e in edges]) == union(len(flat), near(flat, 49))


def test_recall_in_crowds(spark):
    """Pairs at 49 bits amid a crowd of copies meet in a bin as often as elsewhere."""
    r = np.random.default_rng(7)
    rows, pairs = [], []
    crowd = r.integers(0, 1 << 63, 4, dtype=np.int64)
    for g in range(300):
        a = crowd.copy()
        for b in r.choice(256, 20, replace=False):
            a[b // 64] ^= np.int64(1) << np.int64(b % 64) if b % 64 < 63 else np.int64(-(1 << 63))
        c = a.copy()
        for b in r.choice(256, 49, replace=False):
            c[b // 64] ^= np.int64(1) << np.int64(b % 64) if b % 64 < 63 else np.int64(-(1 << 63))
        rows += [tuple(map(int, a)), tuple(map(int, c))]
        pairs.append(rows[-2:])
    df = spark.createDataFrame(rows, "f0 long, f1 long, f2 long, f3 long")
    bins = defaultdict(set)
    for x in simhash.deal_sampled(df, 4, 49, Scratch(spark, "t"), 0.97, group=2).collect():
        bins[tuple(x[1:])].add(x.bin)
    recall = np.mean([bool(bins[a] & bins[c]) for a, c in pairs])
    print("recall in the crowd", recall)
    assert recall >= 0.94


def test_repeated_ids_are_judged_by_their_text(spark):
    import random

    from tests.llm.conftest import prose

    r = random.Random(14)
    a, b, c = (prose(r, 80, 5000) for _ in range(3))
    docs = spark.createDataFrame([(1, a), (2, b), (2, c), (3, a), (1, b), (4, c), (2, c)], "doc_id long, text string")
    assert sorted((x.doc_id, x.text) for x in simhash.one_of_each(docs).collect()) == sorted([(1, a), (1, b), (2, c)])


def test_recall_of_documents_just_above_the_similarity(spark):
    """Pairs of texts with an exact Jaccard similarity of 0.80 to 0.85, by words changed, left out and added."""
    import random

    from tests.llm.conftest import prose

    r = random.Random(77)
    rows, pairs = [], []
    while len(pairs) < 120:
        a = prose(r, r.randint(60, 400), 5000).split()
        b = list(a)
        while (j := jaccard(" ".join(a), " ".join(b))) > 0.85:
            k = r.randrange(len(b))
            r.choice((lambda: b.__setitem__(k, "zz"), lambda: b.insert(k, "yy"), lambda: b.__delitem__(k)))()
        if j >= 0.8:
            n = len(rows)
            pairs.append((n, n + 1))
            rows += [(n, " ".join(a)), (n + 1, " ".join(b))]
    kept = {x.doc_id for x in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert all(a in kept for a, _ in pairs)
    assert sum(b not in kept for _, b in pairs) >= 0.9 * len(pairs)


def test_columns_that_clash_and_many_copies_of_a_text(spark):
    docs = spark.createDataFrame([(i, "one text that is copied often", 5) for i in range(300)] + [(i, f"another text number {i} " * 9, 6) for i in range(300, 320)],
                                 "doc_id long, text string, text_hash long").repartition(9)
    out = simhash.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted((x.doc_id, x.text_hash) for x in out.collect()) == [(0, 5), *((i, 6) for i in range(300, 320))]
