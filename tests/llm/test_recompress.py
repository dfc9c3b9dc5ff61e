import random
from collections import Counter

import numpy as np
import pytest

from gridpulse.llm import recompress
from tests.llm.conftest import SCHEMA, prose


def brute(texts, width):
    docs = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[p : p + width]) for w in docs for p in range(len(w) - width + 1))
    out = []
    for w in docs:
        cut = [False] * len(w)
        for p in range(len(w) - width + 1):
            if seen[tuple(w[p : p + width])] > 1:
                cut[p : p + width] = [True] * width
        out.append((b" ".join(x for x, c in zip(w, cut) if not c).decode(), len(w), sum(cut)))
    return out


def fixture(seed):
    r = random.Random(seed)
    passages = [prose(r, r.randint(5, 90)) for _ in range(6)]
    texts = []
    for _ in range(50):
        parts = [prose(r, r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages).split()
            a = r.randint(0, len(p))
            parts += [" ".join(p[a : r.randint(a, len(p))] if r.random() < 0.5 else p), prose(r, r.randint(0, 20))]
        texts.append(r.choice((" ", "\n", "\t ")).join(parts))
    # periods, runs of one word, repeats in one document, copies
    texts += ["a " * 80, "a " * 50 + "b " + "a " * 40, "x y " * 60, "x y " * 33 + "z", "p q r " * 30, "a b " * 20 + "a a " * 30, "a " * 11, "a " * 12]
    texts += [passages[0] + " mid " + passages[0], texts[3], texts[3], None, "", "  \n"]
    return texts


@pytest.mark.parametrize("seed", [0, 1])
@pytest.mark.parametrize("width,rounds", [(35, 3), (12, 3), (5, 2), (1, 3), (8, 0)])
def test_equals_brute_force(spark, seed, width, rounds):
    texts = fixture(seed)
    rows = [(i, t, "en", "s", 0, 0, "", 0, 0) for i, t in enumerate(texts)]
    out = {r.doc_id: r for r in recompress.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(4), width, rounds).collect()}
    got = [(out[i].text, out[i].n_words, out[i].n_removed) for i in range(len(texts))]
    assert got == brute(texts, width)
    for i in range(len(texts)):
        assert sum(b - a for a, b in out[i].spans) == out[i].n_removed


def test_repeated_rows_and_missing_ids(spark, edge_docs, edge_rows, no_docs):
    want = Counter((r[0], *x) for r, x in zip(edge_rows, brute([r[1] for r in edge_rows], 35)))
    assert want == Counter((r.doc_id, r.text, r.n_words, r.n_removed) for r in recompress.remove_repeats(edge_docs).collect())
    assert recompress.remove_repeats(no_docs).count() == 0


def test_equal_windows_have_equal_anchors():
    r = random.Random(6)
    words = [w.encode() for w in prose(r, 300).split()]
    a = recompress.anchors([words], 35)
    b = recompress.anchors([[b"u", b"v", *words[100:200], b"w"]], 35)
    at = lambda x, p: next(n for f, k, n in zip(x["first"], x["windows"], x["name"]) if f <= p < f + k)
    assert all(at(a, 100 + p) == at(b, 2 + p) for p in range(66))


def test_a_block_stands_for_several_windows():
    r = random.Random(7)
    words = [w.encode() for w in prose(r, 20000, 5000).split()]
    found = recompress.anchors([words], 35)
    assert found["windows"].sum() == 20000 - 34 and len(found["name"]) < 20000 / 8
    assert np.all(found["windows"] >= 1)
