import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridpulse.llm import config_packing as cp
from gridpulse.llm.queries import QUERIES
from gridpulse.llm.word_tokens import WordEncoder, word_encoder

ODD = ["a <|endoftext|> b<|startoftext|>x", "<|ENDOFTEXT|>", "É é x≠ a,b 'S don't we'LL", "\x1c \x85  x　y z", "İstanbul ΣΑΣ Σ",
       "à,b!́ é", "x" * 3000, "12,345.67% (A-B) [c]", "\r\n\t", "日本語 テスト", "a\x00b", "'s't 'd"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_library(library, edge_rows):
    texts = [r[1] for r in edge_rows] + ODD
    for encoder in (word_encoder(), WordEncoder(public_tokenizers.path("word_bpe_49k.json"), remembered=50)):
        for some in (texts, texts[:3], *([t] for t in ODD)):
            ids, many = encoder.ids(some, chars=40)
            want = [library(t) for t in some]
            assert many.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("aB,.'s ’é́<|>\n9 ") | st.characters(), max_size=40))
def test_ids_of_any_text_equal_the_library(library, text):
    text = text.encode("utf-8", "ignore").decode()
    assert word_encoder().ids([text, text + " " + text])[0].tolist() == library(text) + library(text + " " + text)


def test_long_texts_are_read_in_parts(library, monkeypatch):
    from gridpulse.llm import word_tokens

    monkeypatch.setattr(word_tokens, "PIECE_BYTES", 100)
    text = "The quick, brown fox's é jumps\n" * 50
    assert word_encoder().ids([text])[0].tolist() == library(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZéÉßÿŸ×÷ÃãÞþªİ1' \u0301"), max_size=30), min_size=1, max_size=5))
def test_ids_of_latin_letters_equal_the_library(library, texts):
    ids, many = WordEncoder(public_tokenizers.path("word_bpe_49k.json"), remembered=20).ids(texts) if len(texts) > 3 else word_encoder().ids(texts)
    want = [library(t) for t in texts]
    assert many.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_a_new_word_costs_no_call_of_its_own(library):
    import sys

    words = sorted({"".join(w) for w in itertools.product(["an", "th", "é", "ing", "ß", "Ou"], repeat=5)})
    encoder, calls = WordEncoder(public_tokenizers.path("word_bpe_49k.json")), [0]

    def count(frame, event, arg):
        calls[0] += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        ids, many = encoder.ids([" ".join(words)])
    finally:
        sys.setprofile(None)
    assert ids.tolist() == library(" ".join(words)) and many.tolist() == [len(ids)]
    assert calls[0] < len(words) / 5


def test_words_met_again_are_remembered(library):
    encoder, sent = WordEncoder(public_tokenizers.path("word_bpe_49k.json"), remembered=100), []
    encode = encoder._encode
    encoder._encode = lambda chunks: sent.extend(chunks) or encode(list(chunks))
    for k in range(30):
        text = f"often and again {' '.join(f'w{chr(97 + k % 26)}{chr(97 + i)}{k}' for i in range(20))}"
        assert encoder.ids([text])[0].tolist() == library(text)
        assert len(encoder._slot) <= 100
    assert sent.count(b"often") == sent.count(b"again") == 1


@pytest.mark.parametrize("seed", range(6))
def test_knapsack_equals_enumeration(seed):
    r = np.random.default_rng(seed)
    lengths = np.array(sorted(r.choice(np.arange(2, 12), 4, replace=False)))
    prices = r.random(4)
    best, _ = cp.knapsack(lengths, prices, 20)
    for room in range(21):
        every = [c for c in itertools.product(range(11), repeat=4) if np.dot(c, lengths) <= room]
        assert best[room] == pytest.approx(max(float(np.dot(c, prices)) for c in every))


def fewest(pieces, capacity):
    """Fewest sequences by exhaustive search."""
    best = [len(pieces)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(pieces):
            best[0] = len(rooms)
            return
        for k in sorted(set(range(len(rooms)))):
            if rooms[k] >= pieces[i] and rooms[k] not in rooms[:k]:
                go(i + 1, rooms[:k] + [rooms[k] - pieces[i]] + rooms[k + 1 :])
        go(i + 1, rooms + [capacity - pieces[i]])

    go(0, [])
    return best[0]


def sequences_of(made):
    held = defaultdict(list)
    for length, low, high, per, sequence, offset in made.rows:
        for k in range(high - low):
            held[sequence + k // per].append((offset + k % per * length, length))
    return held


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_plan_of_few_pieces_is_within_one_of_the_fewest(pieces):
    made = cp.plan(Counter(pieces), 20)
    held = sequences_of(made)
    assert Counter(n for x in held.values() for _, n in x) == Counter(pieces) and len(held) == made.sequences
    for parts in held.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 20
    if pieces:
        assert made.bound - 1e-6 <= fewest(sorted(pieces, reverse=True), 20) >= made.sequences - 1


@pytest.mark.parametrize("low,high,count,capacity,over", [(30, 50, 20_000, 100, 1.03), (20, 60, 20_000, 100, 1.02), (1100, 2047, 3_000, 4096, 1.06), (1, 400, 3_000, 4096, 1.0), (1, 99, 20_000, 100, 1.01)])
def test_plan_comes_near_the_lower_bound_and_beats_best_fit(low, high, count, capacity, over):
    counts = Counter(np.random.default_rng(1).integers(low, high + 1, count).tolist())
    made, plain = cp.plan(counts, capacity), cp.Plan(capacity)
    cp.best_fit(plain, dict(counts), {})
    held = sequences_of(made)
    assert Counter(n for x in held.values() for _, n in x) == counts
    assert made.bound <= made.sequences <= min(plain.sequences + plain.sequences // 2000, over * made.bound + 1)


def test_rows_of_the_plan_do_not_grow_with_the_counts():
    r = np.random.default_rng(2)
    counts = Counter(r.integers(1, 100, 2000).tolist())
    few = cp.plan(counts, 100)
    many = cp.plan({n: 1_000_000 * c for n, c in counts.items()}, 100)
    assert len(many.rows) < 10 * len(few.rows) + 1000
    assert many.sequences <= 1.01 * sum(n * c for n, c in counts.items()) * 10_000


@pytest.mark.parametrize("capacity", [16, 4096])
def test_pieces_hold_documents_whole(edge_docs, edge_rows, library, capacity):
    rows = cp.pack_whole(edge_docs, capacity).collect()
    by_sequence, got = defaultdict(list), Counter()
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        got[r.doc_id, r.piece, r.start, r.ids, r.doc_tokens] += 1
        assert len(r.ids) == 4 * r.length
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    want = Counter()
    for doc_id, text in ((r[0], r[1]) for r in edge_rows):
        ids = library(text) + [1]
        for k in range(0, len(ids), capacity):
            want[doc_id, k // capacity, k, np.array(ids[k : k + capacity], "<u4").tobytes(), len(ids)] += 1
    assert got == want
    total = sum(len(k[3]) // 4 * n for k, n in want.items())
    assert len(by_sequence) <= 1.05 * total / capacity + 1


def test_one_hot_length_and_empty_table(spark, no_docs):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("alpha beta gamma delta").alias("text")).repartition(6)
    rows = cp.pack_whole(docs, 16).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("c")).collect()
    assert max(r.n for r in rows) <= 16 and len(rows) == -(-3000 // max(r.c for r in rows))
    assert cp.pack_whole(no_docs).count() == 0


def test_query_equals_brute_force(spark, edge_docs, edge_rows, library, tmp_path):
    odd = spark.createDataFrame([(900 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    edge_docs.select("doc_id", "text").unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op11_config_packing"](spark, str(tmp_path)).collect()
    want = Counter()
    for doc_id, text in [(r[0], r[1]) for r in edge_rows] + [(900 + i, t) for i, t in enumerate(ODD)]:
        ids = library(text) + [1]
        for k in range(0, len(ids), 4096):
            part = np.array(ids[k : k + 4096], "<u4")
            want[doc_id, k // 4096, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    filled = defaultdict(int)
    for r in rows:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 4096 and len(filled) <= -(-sum(filled.values()) // 4096) + 1
