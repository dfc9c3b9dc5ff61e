"""Packing token sequences by minimum bin slack.

Documents become token ids and an end id. Full windows of a document fill a sequence alone; what remains of it is
shorter than a window. The counts of the remaining lengths, at most `capacity - 1` numbers at any input size, are all
that packing needs: for the longest length left, a subset-sum programme over bitsets (bounded counts by binary
splitting) finds the multiset of lengths that leaves the least slack beside it; the counts are backtracked and the
multiset is repeated as often as the counts allow. The plan, a list of such multisets, is then joined to the pieces by
their length and their number among the pieces of that length. Lengths that no multiset completes (a frequent length
may have no partners left) are laid end to end and cut at the windows' borders, so only the very last sequence is short.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gridpulse.llm.common import Scratch, slices
from gridpulse.llm.tokens import DEFAULT_RANKS, encoder

END_ID = 0


def least_slack(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, within their counts, whose sum is the largest that is at most `room`."""
    full = (1 << (room + 1)) - 1
    layers: list[tuple[int, int, int]] = []
    reach = 1
    for length in sorted(counts, reverse=True):
        left = min(counts[length], room // length)
        step = 1
        while left > 0 and not reach >> room & 1:
            take = min(step, left)
            layers.append((length, take, reach))
            reach |= reach << (length * take) & full
            left -= take
            step *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(layers):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return used


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, dict[int, int]]], dict[int, int]]:
    """(times, multiset) pairs that fill windows exactly, and the counts of the lengths that are to be cut.

    Each multiset holds the longest length that was left. Where the least slack is not zero it never will be, as counts
    only fall, so all pieces of that length are set aside.
    """
    counts = {n: c for n, c in counts.items() if c}
    out, aside = [], {}
    while counts:
        first = max(counts)
        counts[first] -= 1
        chosen = least_slack({n: c for n, c in counts.items() if c and n <= capacity - first}, capacity - first)
        counts[first] += 1
        chosen[first] = chosen.get(first, 0) + 1
        if sum(n * m for n, m in chosen.items()) < capacity:
            aside[first] = counts.pop(first)
            continue
        times = min(counts[n] // m for n, m in chosen.items())
        for n, m in chosen.items():
            counts[n] -= m * times
            if not counts[n]:
                del counts[n]
        out.append((times, chosen))
    return out, aside


_PIECES = "doc_id long, start long, length int, ids binary, doc_tokens long, part int, number long"


def tokenise(docs: DataFrame, capacity: int, ranks: str = DEFAULT_RANKS) -> DataFrame:
    """Pieces of at most `capacity` ids (little-endian uint32), numbered in their task: full ones together, others by length."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("ids", pa.binary()),
                        ("doc_tokens", pa.int64()), ("part", pa.int32()), ("number", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen, bpe = TaskContext.get().partitionId(), {}, encoder(ranks)
        for some in slices(batches):
            rows = []
            for doc_id, text in zip(some.column("doc_id").to_pylist(), some.column("text").to_pylist()):
                ids = np.append(bpe.ids(text or ""), np.uint32(END_ID)).astype("<u4")
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    number = seen.get(len(piece), 0)
                    seen[len(piece)] = number + 1
                    rows.append((doc_id, start, len(piece), piece.tobytes(), len(ids), part, number))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, _PIECES)


def pack(docs: DataFrame, capacity: int = 1024, ranks: str = DEFAULT_RANKS) -> DataFrame:
    """doc_id, start, length, ids (binary, little-endian uint32), doc_tokens, sequence_id, offset of every piece.

    A NULL or empty text is the end id alone; a NULL doc_id is carried along; repeated rows are packed one by one; very
    long texts become many full windows. Extra columns are not carried. An empty table gives no pieces. Sequence ids
    are unique, not gapless; offsets are gapless within a sequence. A sequence short of `capacity` is to be padded
    (`padded`), unless its length is a power of two.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.write(tokenise(docs, capacity, ranks), "pieces")
    rest = F.col("length") < capacity
    by_part = scratch.write(pieces.where(rest).groupBy("length", "part").count(), "counts")
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("count").alias("n")).collect()}

    rows, sequence = [], 0
    taken = dict.fromkeys(counts, 0)
    filled, aside = plan(counts, capacity)
    for times, chosen in filled:
        offset = 0
        for n, m in sorted(chosen.items(), reverse=True):
            rows.append((n, taken[n], taken[n] + m * times, m, sequence, offset))
            taken[n] += m * times
            offset += n * m
        sequence += times
    at = 0
    for n, c in sorted(aside.items()):
        rows.append((n, taken[n], taken[n] + c, None, sequence, at))
        at += n * c
    sequence += -(-at // capacity)
    placed = spark.createDataFrame(rows, "length int, low long, high long, times long, first_sequence long, first_offset long")

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_part.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    nth = F.col("base") + F.col("number") - F.col("low")
    where = F.col("first_offset") + nth * F.col("length")
    window = F.lit(capacity).cast("long")
    head = F.least(F.col("length").cast("long"), window - F.pmod(where, window))
    part = lambda skip, size, sequence_, offset_: F.struct(
        skip.cast("long").alias("skip"), size.cast("long").alias("size"), sequence_.cast("long").alias("sequence_id"),
        offset_.cast("long").alias("offset"))
    whole = part(F.lit(0), F.col("length"), F.col("first_sequence") + F.floor(nth / F.col("times")),
                 F.col("first_offset") + F.col("length") * (nth % F.col("times")))
    row = F.col("first_sequence") + F.floor(where / window)
    cut = F.filter(
        F.array(part(F.lit(0), head, row, F.pmod(where, window)), part(head, F.col("length") - head, row + 1, F.lit(0))),
        lambda x: x["size"] > 0)
    short = (
        pieces.where(rest).join(starts, ["length", "part"])
        .join(F.broadcast(placed), "length").where((nth >= 0) & (F.col("base") + F.col("number") < F.col("high")))
        .withColumn("p", F.explode(F.when(F.col("times").isNull(), cut).otherwise(F.array(whole))))
        .select(
            "doc_id", (F.col("start") + F.col("p.skip")).alias("start"), F.col("p.size").cast("int").alias("length"),
            F.expr("substring(ids, cast(4 * p.skip + 1 as int), cast(4 * p.size as int))").alias("ids"),
            "doc_tokens", "p.sequence_id", "p.offset",
        )
    )
    # a full piece needs no plan: its number in its task makes a sequence id beyond those of the plan
    full = pieces.where(~rest).select(
        "doc_id", "start", "length", "ids", "doc_tokens",
        (F.lit(sequence) + F.shiftleft(F.col("part").cast("long"), 36) + F.col("number")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    return short.unionByName(full)


def padded(pieces: DataFrame, capacity: int = 1024, pad_id: int = END_ID) -> DataFrame:
    """sequence_id, ids (binary), filled: the sequences themselves. A group is one sequence, so at most `capacity` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    whole = pieces.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("filled"))

    @F.pandas_udf("binary")
    def pad(ids):
        fill = np.uint32(pad_id).astype("<u4").tobytes()
        return ids.map(lambda x: x if (n := len(x) // 4) & (n - 1) == 0 else x + fill * (capacity - n))

    return whole.withColumn("ids", pad("ids"))

