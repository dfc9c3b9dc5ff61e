"""Sharding by histogram sort: equal bytes per shard, DataFrame functions only.

Rows are ordered by (hash of the text, hash of the id). Splitters between shards are found by counting: a pass sums the
exact bytes of every candidate interval inside the ranges that still hold a splitter, and the range that holds the
target is refined by the next binary digits of the key until its edge is within the tolerance. Rows then move once.

Equal texts have equal first keys and therefore stay in one shard. Only a text whose copies weigh more than
`group_share` of a shard is cut, by the second key. Rows equal in text and doc_id cannot be told apart and stay together.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridpulse.llm.common import Scratch, bits_for

KEY_BITS = 63
DIGIT = 9


def _keys(docs: DataFrame) -> DataFrame:
    """Keys are non-negative longs, so that digits are plain shifts."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id",
        "text",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.shiftrightunsigned(F.xxhash64(text), 1).alias("k1"),
        F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("id")), 1).alias("k2"),
    )


@dataclass
class Range:
    """Keys in [low, low + 2**width) of one key column; `below` bytes lie before it. For k2, `k1` is the fixed first key."""

    below: int
    low: int = 0
    width: int = KEY_BITS
    k1: int | None = None


def _count(keyed: DataFrame, ranges: list[Range]) -> dict[tuple, list]:
    """Bytes, least and greatest key of every next-digit interval in the given ranges (at most len(ranges) * 2**DIGIT rows)."""
    mark, digit, key = F.lit(None).cast("int"), F.lit(None).cast("long"), F.lit(None).cast("long")
    for i, r in enumerate(ranges):
        col = F.col("k2") if r.k1 is not None else F.col("k1")
        inside = (col >= r.low) & (col <= r.low + (1 << r.width) - 1)
        if r.k1 is not None:
            inside = inside & (F.col("k1") == r.k1)
        step = max(0, r.width - DIGIT)
        mark = F.when(inside, F.lit(i)).otherwise(mark)
        digit = F.when(inside, F.shiftrightunsigned(col - r.low, step)).otherwise(digit)
        key = F.when(inside, col).otherwise(key)
    rows = (
        keyed.select(mark.alias("i"), digit.alias("d"), key.alias("key"), "size")
        .where("i is not null")
        .groupBy("i", "d")
        .agg(F.sum("size").alias("bytes"), F.min("key").alias("low"), F.max("key").alias("high"))
        .collect()
    )
    found: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r.i, r.d)):
        found.setdefault(r.i, []).append(r)
    return found


def splitters(keyed: DataFrame, shards: int, tolerance: float, group_share: float) -> list[tuple[int, int]]:
    """Keys (k1, k2) at which shards 1, 2, ... begin."""
    total = keyed.agg(F.sum("size")).first()[0] or 0
    share = total / shards
    state: dict[int, Range] = {j: Range(below=0) for j in range(1, shards)} if total else {}
    done: dict[int, tuple[int, int]] = {}
    while state:
        distinct = {(r.low, r.width, r.k1): r for r in state.values()}
        ranges = list(distinct.values())
        place = {key: i for i, key in enumerate(distinct)}
        counted = _count(keyed, ranges)
        for j, r in list(state.items()):
            target, below = j * share, r.below
            step = max(0, r.width - DIGIT)
            rows = counted[place[r.low, r.width, r.k1]]
            for row in rows:
                if below + row.bytes >= target:
                    break
                below += row.bytes
            start, after = (row.low, row.high + 1) if step == 0 or row.low == row.high else (
                r.low + (row.d << step), r.low + ((row.d + 1) << step))
            nearer_end = below + row.bytes - target < target - below
            edge, off = (after, below + row.bytes - target) if nearer_end else (start, target - below)
            if off <= tolerance * share:
                done[j] = (edge, 0) if r.k1 is None else (r.k1, edge)
            elif row.low != row.high:
                state[j] = Range(below, r.low + (row.d << step), step, r.k1)
                continue
            elif r.k1 is None and row.bytes > group_share * share:
                state[j] = Range(below, k1=row.low)
                continue
            else:
                done[j] = (edge, 0) if r.k1 is None else (r.k1, edge)
            del state[j]
    return [done[j] for j in sorted(done)]


def _shard(edges: list[tuple[int, int]]) -> Column:
    out = F.lit(0)
    for k1, k2 in edges:
        out = out + ((F.col("k1") > k1) | ((F.col("k1") == k1) & (F.col("k2") >= k2))).cast("int")
    return out


def shard_by_bytes(docs: DataFrame, shards: int = 8, tolerance: float = 0.01, group_share: float = 0.05, rows_per_bin: int = 2000) -> DataFrame:
    """doc_id, text, size (UTF-8 bytes and one), shard, slot (gapless from 0 in each shard).

    A NULL text weighs one byte and sorts as an empty one; a NULL doc_id is a value like any other. Repeated rows get a
    slot each. Extra columns are not carried. An empty table gives no rows. Numbering works on bins of a shard that
    hold about `rows_per_bin` rows, so no task sees a whole shard.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    keyed = scratch.write(_keys(docs).select("k1", "k2", "size"), "keys")
    edges = splitters(keyed, shards, tolerance, group_share)
    bins = 1 << bits_for(keyed.count(), rows_per_bin * shards)
    placed = lambda d: d.withColumn("shard", _shard(edges)).withColumn(
        "bin", F.pmod(F.xxhash64("k1", "k2"), F.lit(bins)).cast("int"))
    counts = placed(keyed).groupBy("shard", "bin").count()
    before = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bin", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "bin").orderBy("k1", "k2")
    return (
        placed(_keys(docs))
        .withColumn("at", F.row_number().over(inside))
        .join(starts, ["shard", "bin"])
        .select("doc_id", "text", "size", "shard", (F.col("first") + F.col("at") - 1).cast("long").alias("slot"))
    )
