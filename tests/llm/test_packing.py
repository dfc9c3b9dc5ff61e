import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridpulse.llm import packing
from gridpulse.llm.queries import QUERIES
from gridpulse.llm.tokens import encoder


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_ids_equal_those_of_the_json_file(reference, edge_rows):
    for text in [r[1] for r in edge_rows if r[1] is not None] + ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x  <|endoftext| >", "<|ENDOFTEXT|>", "it's  two\n\nlines\t", "x  \n y" * 50]:
        assert encoder().ids(text).tolist() == reference(text)
        assert encoder().ids(text, chars=37).tolist() == reference(text)


def best_fill(counts, room):
    reach = {0}
    for n, c in counts.items():
        for _ in range(min(c, room // n)):
            reach |= {x + n for x in reach if x + n <= room}
    return max(reach)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 6), max_size=6), st.integers(0, 60))
def test_least_slack_is_the_best_fill(counts, room):
    chosen = packing.least_slack(counts, room)
    assert all(chosen[n] <= counts[n] for n in chosen)
    assert sum(n * m for n, m in chosen.items()) == best_fill(counts, room)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(1, 500), max_size=20))
def test_plan_uses_every_piece_once(counts):
    filled, aside = packing.plan(counts, 64)
    used = Counter(aside)
    for times, chosen in filled:
        assert sum(n * m for n, m in chosen.items()) == 64
        for n, m in chosen.items():
            used[n] += m * times
    assert used == Counter(counts)


@pytest.mark.parametrize("capacity", [32, 1024])
def test_pieces_cover_documents_and_sequences_have_no_gaps(edge_docs, edge_rows, reference, capacity):
    rows = packing.pack(edge_docs, capacity).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length and 0 < r.length <= capacity
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    copies = Counter(r[0] for r in edge_rows)
    assert set(by_doc) == set(copies)
    for doc_id, text in {(r[0], r[1]) for r in edge_rows}:
        want = reference(text or "") + [0]
        got = Counter((r.start, r.ids, r.doc_tokens) for r in by_doc[doc_id])
        assert sum(len(i) // 4 * n for (_, i, _), n in got.items()) == len(want) * copies[doc_id]
        for (start, ids, total), n in got.items():
            assert np.frombuffer(ids, "<u4").tolist() == want[start : start + len(ids) // 4] and total == len(want)
    total = sum(r.length for r in rows)
    assert len(by_sequence) == -(-total // capacity)  # only the last one is short


def test_query_equals_brute_force(spark, edge_docs, edge_rows, reference, tmp_path):
    """Every id of every document lies in exactly one piece; a text may hold the string of an added token."""
    odd = [(900, "a <|endoftext|> b"), (901, "<|endoftext|>"), (902, "x<|endoftext|>" * 700), (903, "é <|endoftext|>\n\n <|endoftext")]
    more = spark.createDataFrame(odd, "doc_id long, text string")
    edge_docs.select("doc_id", "text").unionByName(more).write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op1_packing"](spark, str(tmp_path)).collect()
    texts = [(r[0], r[1]) for r in edge_rows] + odd
    copies, by_doc, filled = Counter(d for d, _ in texts), defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        filled[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(copies)
    for doc_id, text in set(texts):
        want = np.array(reference(text or "") + [0], "<u4")
        assert sum(r.length for r in by_doc[doc_id]) == len(want) * copies[doc_id]
        starts = Counter()
        for r in by_doc[doc_id]:
            assert r.doc_tokens == len(want) and r.ids_crc32 == zlib.crc32(want[r.start : r.start + r.length].tobytes())
            starts.update(range(r.start, r.start + r.length))
        assert set(starts.values()) == {copies[doc_id]} and len(starts) == len(want)
    for parts in filled.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(filled) == -(-sum(r.length for r in rows) // 1024)


def test_padded_sequences(edge_docs):
    pieces = packing.pack(edge_docs, 64)
    for r in packing.padded(pieces, 64).collect():
        n = len(r.ids) // 4
        assert n == 64 or n & (n - 1) == 0
        assert n >= r.filled


def test_hot_length(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("alpha beta gamma delta").alias("text"))
    rows = packing.pack(docs, 16)
    total = rows.agg(F.sum("length"), F.countDistinct("sequence_id")).first()
    assert total[1] == -(-total[0] // 16)


def test_empty_table(no_docs):
    assert packing.pack(no_docs).count() == 0
