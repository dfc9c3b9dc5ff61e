"""Ranked lexical search: hybrid of term-at-a-time accumulators and document-at-a-time skipping.

The documents are read once; of each, the counts of the query terms it holds are written (one narrow row a document),
from which the collection's statistics and the postings come. Each task turns its rows into shards of bounded size, with
a posting list for each query term, and answers all queries of a block:

1. Term at a time: the short lists of a query are summed into accumulators, which form one more list in document order
   whose largest value is a tight bound. Contributions are never negative, so the k-th accumulator is a floor.
2. Document at a time: the accumulators and the long lists are walked together in blocks of documents. A block whose
   lists' largest values do not add up to the floor is skipped. Elsewhere the lists with the smallest bounds that stay
   below the floor together are not traversed but probed, for documents that can still reach the floor.
3. The k best of a task raise the floor of its next shards; only they leave the task and are merged by rank.

All scores are 64-bit integers. Documents are dropped only if their bound is below the floor, so ties stay exact.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from gridpulse.llm.common import Scratch
from gridpulse.llm.terms import Words, split, words_of

BLOCK_BYTES = 16_000_000  # text of the queries that are answered at a time
SHARD_DOCS = 16_384
SHARD_POSTINGS = 4_000_000
WALK_DOCS = 4096  # documents of one step of the walk
SHORT = 32  # lists that hold less than one document in so many are short
SALTS = 64


def _keys(found: Words) -> pa.BinaryArray:
    """The words, each with the space behind it, as slices of the normalised text."""
    offsets = np.append(found.start, len(found.data)).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(found.start), [None, pa.py_buffer(offsets), pa.py_buffer(found.data)])


def item_terms(text: str | None) -> Counter:
    """How often a query holds each of its terms (bytes, with a space behind)."""
    raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
    return Counter(_keys(split(raw, np.array([0, len(raw)]))).to_pylist())


def counted(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n (terms with repeats), terms, counts: the query terms of each document by their place in the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value, pa.binary())
        width = len(known) + 1
        for some, parts in words_of(batches):
            n = np.zeros(len(some), dtype=np.int64)
            met, many = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
            for found in parts:
                n += np.bincount(found.text, minlength=len(some))
                term = pc.index_in(_keys(found), value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
                held = term >= 0
                place, times = np.unique(found.text[held] * width + term[held], return_counts=True)
                met, at = np.unique(np.concatenate([met, place]), return_inverse=True)
                both = np.zeros(len(met), dtype=np.int64)
                np.add.at(both, at, np.concatenate([many, times]))
                many = both
            offsets = np.searchsorted(met, np.arange(len(some) + 1) * width).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), x) for x in (pa.array((met % width).astype(np.int32)), pa.array(many))]
            yield pa.RecordBatch.from_arrays([some.column("doc_id").cast(pa.int64()), pa.array(n), *lists], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<long>")


def document_counts(rows: DataFrame, terms: int) -> np.ndarray:
    """How many documents hold each term; each task sends one row per term."""
    schema = pa.schema([("term", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(terms, dtype=np.int64)
        for batch in batches:
            n += np.bincount(batch.column("terms").flatten().to_numpy(zero_copy_only=False), minlength=terms)
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(n[met])], schema=schema)

    out = np.zeros(terms, dtype=np.int64)
    for r in rows.select("terms").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out


@dataclass
class Shard:
    """Posting lists of some documents: those of term t are docs[at[t] : at[t + 1]], ascending, with their shares."""

    size: int
    at: np.ndarray
    docs: np.ndarray
    share: np.ndarray

    @staticmethod
    def build(n: np.ndarray, lengths: np.ndarray, terms: np.ndarray, counts: np.ndarray, width: int, docs_all: int, words_all: int) -> "Shard":
        doc = np.repeat(np.arange(len(n)), lengths)
        m = 100 - 25 + 25 * n * docs_all // max(1, words_all)
        share = 1_000_000_000 * counts // (1000 * counts + 12 * m[doc])
        order = np.argsort(terms, kind="stable")
        at = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=width))])
        return Shard(len(n), at, doc[order], share[order])


def _summed(docs: list[np.ndarray], scores: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Lists added up into one list in document order."""
    if not docs:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    d, s = np.concatenate(docs), np.concatenate(scores)
    order = np.argsort(d, kind="stable")
    d, s = d[order], s[order]
    first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
    return d[first], np.add.reduceat(s, first)


def search(shard: Shard, query: list[tuple[int, int]], k: int, floor: int, walk: int = WALK_DOCS, short: int = SHORT):
    """(docs, scores) of a shard that may be among the k best; query has (term, weight), floor a score that k rows reach."""
    lists, brief = [], ([], [])
    for term, weight in query:
        lo, hi = shard.at[term], shard.at[term + 1]
        if hi > lo and weight > 0:
            docs, scores = shard.docs[lo:hi], shard.share[lo:hi] * weight
            if (hi - lo) * short < shard.size:
                brief[0].append(docs)
                brief[1].append(scores)
            else:
                lists.append((docs, scores))
    sums = _summed(*brief)
    if len(sums[0]):
        if len(sums[1]) >= k:
            floor = max(floor, int(np.partition(sums[1], len(sums[1]) - k)[len(sums[1]) - k]))
        lists.append(sums)
    if not lists:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    bounds = [int(s.max()) for _, s in lists]
    order = np.argsort(bounds, kind="stable")
    lists, bounds = [lists[i] for i in order], np.array([bounds[i] for i in order])
    reach = np.cumsum(bounds)
    steps = np.arange(0, shard.size + walk, walk)
    edges = [np.searchsorted(d, steps) for d, _ in lists]
    best_docs, best = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    for b, low in enumerate(steps[:-1]):
        cuts = [(e[b], e[b + 1]) for e in edges]
        tops = np.array([s[i:j].max() if j > i else 0 for (_, s), (i, j) in zip(lists, cuts)])
        if tops.sum() < max(floor, 1):
            continue
        cut = int(np.searchsorted(reach, floor, side="left"))  # lists before it stay below the floor together
        partial = np.zeros(walk, dtype=np.int64)
        for (docs, scores), (i, j) in zip(lists[cut:], cuts[cut:]):
            partial[docs[i:j] - low] += scores[i:j]
        rest = np.concatenate([[0], np.cumsum(tops[:cut])])
        alive = np.flatnonzero((partial > 0) & (partial + rest[cut] >= floor))
        partial = partial[alive]
        for i in range(cut - 1, -1, -1):
            if not len(alive):
                break
            docs, scores = (x[cuts[i][0] : cuts[i][1]] for x in lists[i])
            if len(docs):
                at = np.minimum(np.searchsorted(docs, alive + low), len(docs) - 1)
                partial = partial + np.where(docs[at] == alive + low, scores[at], 0)
            near = partial + rest[i] >= floor
            alive, partial = alive[near], partial[near]
        best_docs, best = np.concatenate([best_docs, alive + low]), np.concatenate([best, partial])
        if len(best) > k:
            kth = int(np.partition(best, len(best) - k)[len(best) - k])
            floor = max(floor, kth)
            keep = best >= floor
            best_docs, best = best_docs[keep], best[keep]
    return best_docs, best


def _answers(rows: DataFrame, queries: list[tuple[int, list[tuple[int, int]]]], width: int, docs_all: int, words_all: int, k: int) -> DataFrame:
    """item_id, doc_id, score, part: the k best documents of each task for each query."""
    shared = rows.sparkSession.sparkContext.broadcast(queries)
    schema = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64()), ("part", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

        def look(held: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(held)
            doc_id = table.column("doc_id")
            bare = pc.is_null(doc_id).to_numpy()
            ids = pc.fill_null(doc_id, 0).to_numpy()
            terms = table.column("terms").combine_chunks()
            lengths = pc.list_value_length(terms).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = [c.flatten().to_numpy(zero_copy_only=False) for c in (terms, table.column("counts").combine_chunks())]
            shard = Shard.build(table.column("n").to_numpy(), lengths, *flat, width, docs_all, words_all)
            for q, (_, query) in enumerate(shared.value):
                old = best.get(q)
                floor = int(old[2].min()) if old is not None and len(old[2]) >= k else 0
                docs, scores = search(shard, query, k, floor)
                if not len(docs):
                    continue
                new = bare[docs], ids[docs], scores
                if old is not None:
                    new = tuple(np.concatenate(x) for x in zip(old, new))
                order = np.lexsort((new[1], new[0], -new[2]))[:k]
                best[q] = tuple(x[order] for x in new)

        held, docs, postings = [], 0, 0
        for batch in batches:
            size = np.cumsum(pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False).astype(np.int64))
            start, done = 0, 0
            while start < len(batch):
                room = min(len(batch), start + SHARD_DOCS - docs)
                end = max(start + 1, min(room, int(np.searchsorted(size, done + SHARD_POSTINGS - postings, side="right"))))
                held.append(batch.slice(start, end - start))
                docs, postings = docs + end - start, postings + int(size[end - 1]) - done
                start, done = end, int(size[end - 1])
                if docs >= SHARD_DOCS or postings >= SHARD_POSTINGS or start < len(batch):
                    look(held)
                    held, docs, postings = [], 0, 0
        if held:
            look(held)
        part = TaskContext.get().partitionId()
        for q, (bare, ids, scores) in best.items():
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, shared.value[q][0])), pa.array(ids, mask=bare), pa.array(scores), pa.array(np.full(n, part, dtype=np.int32))],
                schema=schema)

    return rows.where(F.size("terms") > 0).mapInArrow(run, "item_id long, doc_id long, score long, part int")


def _best(found: DataFrame, keys: list, k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents with a score above 0 for each item.

    Equal scores are ranked by ascending doc_id, a NULL one last. NULL and empty texts hold no term: such documents do
    not count, such items find nothing. Rows of one item_id are one item, whose equal rows count once; items without id are
    left out. Repeated document rows count and are ranked one by one. Very long texts are read in parts. Extra columns
    are not carried. Empty tables give no rows. Items are answered in blocks of bounded text.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ranked")
    items = items.select("item_id", "text").where("item_id is not null and text is not null").distinct()
    count = max(1, math.ceil((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / BLOCK_BYTES))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for b in range(count):
        asked: dict[int, Counter] = {}
        for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(count)) == b).collect():  # one block, bounded
            asked.setdefault(r["item_id"], Counter()).update(item_terms(r["text"]))
        vocabulary = sorted(set().union(*asked.values()))
        place = {t: i for i, t in enumerate(vocabulary)}
        rows = scratch.write(counted(docs, vocabulary), f"counts{b}")
        total = rows.where("n > 0").agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
        weight = [math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * n + 1))) for n in document_counts(rows, len(vocabulary)).tolist()]
        queries = [(i, [(place[t], weight[place[t]] * n) for t, n in sorted(c.items())]) for i, c in sorted(asked.items())]
        found = scratch.write(_answers(rows, queries, len(vocabulary), total["docs"], total["words"], k), f"found{b}")
        scratch.drop(f"counts{b}")
        some = _best(found, ["item_id", F.pmod("part", F.lit(SALTS))], k).drop("rank")
        out = out.unionByName(_best(some, ["item_id"], k).select("item_id", "rank", "doc_id", "score"))
    return out
