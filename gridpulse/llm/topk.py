"""Exact top-k inner products by MaxScore over sharded integer vectors.

A term is a dimension. For one query, its score bound is the largest contribution that any vector of the shard makes to
it. The terms with the smallest bounds whose sum stays below the k-th best score known so far are non-essential: a
vector that has a positive contribution in none of the others cannot enter the result. The essential postings are
traversed, and the rest is probed for those vectors only that can still reach the k-th score. Shard results are merged
by rank.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

SHARD_ROWS = 8192
BLOCK_QUERIES = 2048
SEED_ROWS = 512


def quantise(column: str, factor: int = 256) -> Column:
    return F.transform(column, lambda x: F.floor(F.lit(factor) * x.cast("double")))


def usable(column: str) -> Column:
    """Vectors that are not null and hold neither nulls nor non-finite components."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(column).isNotNull() & ~bad


def _matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    """One row per vector; shorter vectors are filled up with zeros."""
    flat = lists.combine_chunks()
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    lengths = flat.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    col = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, col] = flat.flatten().to_numpy(zero_copy_only=False)
    return out


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    if len(score) > k:
        kth = np.partition(score, len(score) - k)[len(score) - k]
        keep = np.flatnonzero(score >= kth)
    else:
        keep = np.arange(len(score))
    return keep[np.lexsort((ids[keep], -score[keep]))][:k]


def max_score(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int):
    """(query_id, vec_id, score) of the k best vectors of one shard for each query, itself excluded."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    columns = np.ascontiguousarray(vectors.T)
    top, bottom = columns.max(1), columns.min(1)
    picks = np.unique(np.linspace(0, len(ids) - 1, min(SEED_ROWS, len(ids))).astype(int))
    seeds = queries @ vectors[picks].T
    out = []
    for q, (query_id, weights) in enumerate(zip(query_ids, queries)):
        first = seeds[q][ids[picks] != query_id]
        floor = np.partition(first, len(first) - k)[len(first) - k] if len(first) >= k else None
        terms = np.flatnonzero(weights)
        bound = np.maximum(np.maximum(weights[terms] * top[terms], weights[terms] * bottom[terms]), 0)
        terms = terms[np.argsort(bound, kind="stable")]
        bound = np.maximum(np.maximum(weights[terms] * top[terms], weights[terms] * bottom[terms]), 0)
        reach = np.cumsum(bound)
        cut = 0 if floor is None else int(np.searchsorted(reach, floor, side="left"))
        partial = np.zeros(len(ids), dtype=np.int64)
        touched = np.zeros(len(ids), dtype=bool) if cut else np.ones(len(ids), dtype=bool)
        for t in terms[cut:]:
            add = weights[t] * columns[t]
            partial += add
            if cut:
                touched |= add > 0
        touched &= ids != query_id
        rest = reach[cut - 1] if cut else 0
        alive = np.flatnonzero(touched & (partial + rest >= floor)) if floor is not None else np.flatnonzero(touched)
        partial = partial[alive]
        for i in range(cut - 1, -1, -1):
            partial = partial + weights[terms[i]] * columns[terms[i]][alive]
            rest = reach[i - 1] if i else 0
            if len(partial) > k:
                floor = max(floor, np.partition(partial, len(partial) - k)[len(partial) - k] - _loss(weights, terms[:i], top, bottom))
            near = partial + rest >= floor
            if not near.all():
                alive, partial = alive[near], partial[near]
        best = _best(partial, ids[alive], k)
        out.append((np.full(len(best), query_id), ids[alive][best], partial[best]))
    return [np.concatenate(x) if out else np.zeros(0, dtype=np.int64) for x in zip(*out)] if out else [np.zeros(0, dtype=np.int64)] * 3


def _loss(weights, terms, top, bottom) -> int:
    """How much the terms still to be probed can take from a score at most."""
    return int(-np.minimum(np.minimum(weights[terms] * top[terms], weights[terms] * bottom[terms]), 0).sum())


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for each query (vec_id, v) against all vectors (vec_id, v), v integers.

    A query finds every row but those that bear its own vec_id; ties go to the smaller vec_id. Rows with a NULL vec_id
    or vector take no part; a shorter vector counts as filled up with zeros; repeated rows are ranked one by one. Empty
    tables give no rows. Products must stay within 63 bits. Both sides are cut into blocks of bounded size, and each
    pair of blocks is one group.
    """
    vectors = vectors.select("vec_id", "v").where("vec_id is not null and v is not null")
    queries = queries.select("vec_id", "v").where("vec_id is not null and v is not null")
    shards = max(1, math.ceil(vectors.count() / SHARD_ROWS))
    blocks = max(1, math.ceil(queries.count() / BLOCK_QUERIES))
    left = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        if a.num_rows and b.num_rows:
            width = max(pc.max(pc.list_value_length(t.column("v"))).as_py() for t in (a, b))
            found = max_score(a.column("vec_id").to_numpy(), _matrix(a.column("v"), width), b.column("vec_id").to_numpy(),
                              _matrix(b.column("v"), width), k)
        else:
            found = [np.zeros(0, dtype=np.int64)] * 3
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("query_id", "vec_id", "score"), found)})

    near = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(
        cell, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
