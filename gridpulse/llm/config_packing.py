"""Packing whole documents into few sequences by a configuration linear program.

Documents become token ids and an end id; only those longer than a sequence are cut. The counts of the pieces' lengths,
at most `capacity - 1` numbers at any input size, are all that the plan needs:

1. Configuration LP: a configuration is a multiset of lengths that fits a sequence; the programme asks for the least
   total of configurations that covers every length's count. It is solved by multiplicative weights: a length's price
   falls exponentially with its coverage, and a knapsack dynamic programme over the prices finds, for every length that
   lags behind, the most valuable configuration that holds it. The prices, divided by the best configuration's value,
   are a feasible dual, so every round also gives a lower bound on the number of sequences.
2. Rounding: fractions are carried from one configuration to the next, whole numbers are taken as long as the counts
   last, and the programme is solved again for what is left.
3. The last part, and what the rounding leaves, goes by best fit, longest first, over runs of equal sequences.

The plan is a list of runs of equal sequences, whose number depends on the number of lengths and rounds, not on the
input. Tasks find a piece's place by binary search of its number among the pieces of its length.
"""

from __future__ import annotations

import bisect
from collections import Counter
from dataclasses import dataclass, field
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gridpulse.llm.common import Scratch, slices
from gridpulse.llm.word_tokens import DEFAULT_VOCABULARY, word_encoder

END_ID = 1
ROUNDS = 60  # price changes of one solve
RATE = 2.0  # how fast a price falls with coverage
ENOUGH = 0.02  # a share this small need not be covered before rounding
MOST = 50_000  # a configuration with a smaller part of the sequences is left out, so that a solve has no more than so many
STALLED = 0.1  # a round that covers a smaller part of what is left lowers the demands
GROUPS = 48  # groups of lengths that the prices are found on
UNITS = 512  # and rooms
STEPS = 300  # configurations priced for them
EASE = 0.05  # how fast a group's price falls with coverage
TILT = 0.01  # how much more a token of the longest piece is worth
LOWER = 2.0  # by how much the demands are lowered
SHORTFALL = 0.003  # a configuration worth this much less than the best is not taken at first
LONG_FIRST = 50  # in the second order of rounds: how many until the shortest pieces choose partners, too
SOLVES = 3  # times that the programme is solved for what is left
LAST = 64  # sequences that are left to best fit


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value of a multiset of lengths (ascending) within each room up to capacity, and the last length taken (-1: none)."""
    best = np.zeros(capacity + 1)
    taken = np.full(capacity + 1, -1, dtype=np.int64)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(int(lengths[0]), capacity + 1):
        k = fits[room]
        value = best[room - lengths[:k]] + prices[:k]
        i = int(value.argmax())
        if value[i] > best[room - 1]:
            best[room], taken[room] = value[i], i
        else:
            best[room], taken[room] = best[room - 1], -2  # as one token less
    return best, taken


def _configurations(first: np.ndarray, lengths: np.ndarray, taken: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, length number) of all members of the best configurations that hold each of `first`."""
    row, room = np.arange(len(first)), capacity - lengths[first]
    rows, members = [row], [first]
    while len(row):
        step = taken[room]
        row, room, step = (x[step != -1] for x in (row, room, step))
        less = step == -2
        rows.append(row[~less])
        members.append(step[~less])
        room = np.where(less, room - 1, room - lengths[np.maximum(step, 0)])
    return np.concatenate(rows), np.concatenate(members)


def dual_prices(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> np.ndarray:
    """Prices of the lengths near the programme's dual optimum, by multiplicative weights on grouped lengths.

    Groups of neighbouring lengths of about equal mass are rounded up to their longest one. Each step takes the most
    valuable configuration as often as its scarcest group allows and lowers the prices of what it covers. The prices of
    the step with the best bound are interpolated between the groups.
    """
    unit = max(1, capacity // UNITS)
    mass = np.cumsum(counts * lengths)
    group = np.minimum(GROUPS - 1, (mass - counts * lengths) * GROUPS // mass[-1])
    ends = np.flatnonzero(np.append(group[1:] != group[:-1], True))
    sizes = -(-lengths[ends] // unit)
    n = np.diff(np.append(0, np.cumsum(counts)[ends])).astype(float)
    sizes, kind = np.unique(sizes, return_inverse=True)  # groups that share a size after rounding are one
    n = np.bincount(kind, weights=n)
    log, shown, most = np.log(sizes / sizes[-1]), None, 0.0
    covered = np.zeros(len(n))
    for _ in range(STEPS):
        prices = np.exp(log - log.max())
        best, taken = knapsack(sizes, prices, capacity // unit)
        if (value := float(n @ prices / best[-1])) > most * (1 + 1e-6):
            shown, most = prices / best[-1], value
        start = np.array([int((prices + best[capacity // unit - sizes]).argmax())])
        member = _configurations(start, sizes, taken, capacity // unit)[1]
        many = np.bincount(member, minlength=len(n))
        step = many * (n[many > 0] / many[many > 0]).min() / n
        covered += step
        log -= EASE * step
    tops = np.maximum.reduceat(lengths[ends], np.searchsorted(kind, np.arange(len(n))) if len(n) < len(ends) else np.arange(len(n)))
    return np.interp(lengths, np.append(0, tops), np.append(0.0, shown))


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int, long_first: int = 1) -> tuple[list[tuple[float, Counter]], float]:
    """Fractional (times, configuration of length numbers) that cover no count more than once, and a lower bound on any cover.

    Early rounds take configurations whose value is close to the best one's only; what the rounds leave uncovered is
    for the next solve.
    """
    n = counts.astype(float)
    covered = np.zeros(len(n))  # as shares of the counts
    base = dual_prices(lengths, counts, capacity) * (1 + TILT * lengths / capacity)  # of equal values, the one of longer pieces
    found: dict[tuple, float] = {}
    bound = float((n * lengths).sum() / capacity)
    least = max(1e-3, bound / MOST)
    short = SHORTFALL
    # in the first rounds of so many, only the longest pieces choose their partners
    mass = np.cumsum((n * lengths)[::-1])
    least_length = lengths[::-1][np.minimum(np.searchsorted(mass, mass[-1] * np.arange(1, long_first + 1) / long_first), len(n) - 1)]
    for turn in range(ROUNDS):
        prices = base * np.exp(-RATE * covered)
        able = np.flatnonzero(covered < 1)
        if not len(able):
            break
        best, taken = knapsack(lengths[able], prices[able], capacity)
        if not turn:
            bound = max(bound, float((n * prices).sum() / best[capacity]))
            top = best[capacity]
        # what the best configuration that holds a length is worth at the prices that nothing is covered at
        near = np.flatnonzero((covered < 1 - ENOUGH) & (lengths >= least_length[min(turn, len(least_length) - 1)]))
        if not len(near):
            continue
        row, member = _configurations(np.searchsorted(able, near), lengths[able], taken, capacity)
        member = able[member]
        worth = np.bincount(row, weights=base[member], minlength=len(near)) / top
        short = max(short, 1 - float(worth.max()))
        good = worth >= 1 - short
        first = near[good]
        row, member = (np.cumsum(good) - 1)[row[good[row]]], member[good[row]]
        times = (1 - covered[first]) * n[first]
        wanted = np.bincount(member, weights=times[row], minlength=len(n))
        share = np.minimum(1.0, (1 - covered) * n / np.maximum(wanted, 1e-12))
        scale = np.ones(len(first))
        np.minimum.at(scale, row, share[member])
        times = times * scale
        gained = np.bincount(member, weights=times[row], minlength=len(n))
        covered = np.minimum(1.0, covered + gained / n)
        covered[covered > 1 - 1e-9] = 1.0
        order = np.argsort(row, kind="stable")
        cuts = np.cumsum(np.bincount(row, minlength=len(first)))
        for q, members in zip(times.tolist(), np.split(member[order], cuts[:-1])):
            if q > least:
                key = tuple(sorted(members.tolist(), reverse=True))
                found[key] = found.get(key, 0.0) + q
        if (gained * lengths).sum() < STALLED * ((1 - covered) * n * lengths).sum():
            if short >= 1:
                break
            short = min(1.0, LOWER * short)
    return [(q, Counter(key)) for key, q in sorted(found.items(), reverse=True)], bound


@dataclass
class Plan:
    """Runs of sequences. A row (length, low, high, per, sequence, offset) places the pieces number low to high - 1 of
    that length, `per` to a sequence, the first at `offset` of `sequence`."""

    capacity: int
    rows: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0
    taken: Counter = field(default_factory=Counter)
    bound: float = 0.0

    def put(self, length: int, per: int, times: int, sequence: int, offset: int) -> None:
        low = self.taken[length]
        self.rows.append((length, low, low + per * times, per, sequence, offset))
        self.taken[length] = low + per * times


def best_fit(plan: Plan, counts: dict[int, int], rooms: dict[int, list[tuple[int, int]]]) -> None:
    """Place all pieces, longest first, each where it leaves least room; rooms has runs (first sequence, count) by room."""
    held = {r: list(x) for r, x in rooms.items() if x}
    order = sorted(held)

    def keep(room: int, run: tuple[int, int]) -> None:
        if room not in held:
            held[room] = []
            bisect.insort(order, room)
        held[room].append(run)

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(order, length)
            if at == len(order):
                per = plan.capacity // length
                times, per = (left // per, per) if left >= per else (1, left)
                first = plan.sequences
                plan.sequences += times
                room = plan.capacity
            else:
                room = order[at]
                first, many = held[room].pop()
                if not held[room]:
                    del held[room]
                    del order[at]
                per = min(room // length, left)
                times = min(many, left // per)
                if times < many:
                    keep(room, (first + times, many - times))
            plan.put(length, per, times, first, plan.capacity - room)
            left -= per * times
            keep(room - per * length, (first, times))


def _rounded(counts: dict[int, int], capacity: int, long_first: int) -> Plan:
    out = Plan(capacity)
    left = {n: c for n, c in counts.items() if c}
    rooms: dict[int, list[tuple[int, int]]] = {}
    for turn in range(SOLVES):
        if not left or turn and sum(n * c for n, c in left.items()) <= LAST * capacity:
            break
        lengths = np.array(sorted(left))
        found, bound = solve(lengths, np.array([left[n] for n in lengths.tolist()]), capacity, long_first)
        out.bound = out.bound or bound
        carry, before = 0.0, out.sequences
        for q, members in found:
            carry += q
            whole = int(carry + 1e-9)
            times = min(whole, *(left.get(int(lengths[i]), 0) // m for i, m in members.items()))
            carry -= whole
            if not times:
                continue
            offset = 0
            for i, m in members.items():
                n = int(lengths[i])
                out.put(n, m, times, out.sequences, offset)
                offset += n * m
                left[n] -= m * times
                if not left[n]:
                    del left[n]
            rooms.setdefault(capacity - offset, []).append((out.sequences, times))
            out.sequences += times
        if out.sequences == before:
            break
    best_fit(out, left, rooms)
    return out


def plan(counts: dict[int, int], capacity: int) -> Plan:
    """Runs of sequences that hold every piece of the given counts of lengths once.

    Of two orders of rounds (all lengths at once, long ones first) the one with fewer sequences; the second is only tried
    where the first stays above the lower bound.
    """
    first = _rounded(counts, capacity, 1)
    if first.sequences <= np.ceil(first.bound - 1e-6) + first.sequences // 5000:
        return first
    return min(first, _rounded(counts, capacity, LONG_FIRST), key=lambda p: p.sequences)


_PIECES = "doc_id long, piece int, start long, length int, ids binary, doc_tokens long, part int, number long"


def tokenise(docs: DataFrame, capacity: int, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """Pieces of at most `capacity` ids (little-endian uint32), numbered in their task by length."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids", pa.binary()),
                        ("doc_tokens", pa.int64()), ("part", pa.int32()), ("number", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen, encoder = TaskContext.get().partitionId(), {}, word_encoder(vocabulary)
        for some in slices(batches, rows=2048):
            ids, many = encoder.ids(some.column("text").to_pylist())
            stop = np.cumsum(many)
            ids = np.insert(ids, stop, END_ID).astype("<u4").tobytes()
            rows, at = [], 0
            for doc_id, n in zip(some.column("doc_id").to_pylist(), (many + 1).tolist()):
                for k, start in enumerate(range(0, n, capacity)):
                    size = min(capacity, n - start)
                    number = seen.get(size, 0)
                    seen[size] = number + 1
                    rows.append((doc_id, k, start, size, ids[4 * (at + start) : 4 * (at + start + size)], n, part, number))
                at += n
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, _PIECES)


def _placed(pieces: DataFrame, made: Plan) -> DataFrame:
    """sequence_id and offset for the columns length and nth (number among all pieces of that length)."""
    rows = np.array(sorted(made.rows), dtype=np.int64).reshape(-1, 6)
    shared = pieces.sparkSession.sparkContext.broadcast((np.searchsorted(rows[:, 0], np.arange(made.capacity + 1)), rows))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, nth):
        import pandas as pd

        first, rows = shared.value
        # rows of one length are ascending and gapless from 0: (length, low) in one key
        n, k = length.to_numpy().astype(np.int64), nth.to_numpy().astype(np.int64)
        at = np.empty(len(n), dtype=np.int64)
        for size in np.unique(n).tolist():
            mine = n == size
            lo, hi = first[size], first[size + 1] if size + 1 < len(first) else len(rows)
            at[mine] = lo + np.searchsorted(rows[lo:hi, 1], k[mine], side="right") - 1
        _, low, _, per, sequence, offset = rows[at].T
        return pd.DataFrame({"sequence_id": sequence + (k - low) // per, "offset": offset + (k - low) % per * n})

    return pieces.withColumn("p", place("length", "nth"))


def pack_whole(docs: DataFrame, capacity: int = 4096, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """doc_id, piece (from 0), start, length, ids (binary, little-endian uint32), doc_tokens, sequence_id, offset of every piece.

    A document longer than `capacity` is cut into full pieces and a last one; others stay whole. A NULL or empty text is
    the end id alone; a NULL doc_id is carried along; repeated rows are packed one by one. Very long texts are read in
    parts. Extra columns are not carried. An empty table gives no pieces. Sequence ids are unique, not gapless; offsets
    are gapless within a sequence.
    """
    scratch = Scratch(docs.sparkSession, "config-packing")
    pieces = scratch.write(tokenise(docs, capacity, vocabulary), "pieces")
    rest = F.col("length") < capacity
    by_part = scratch.write(pieces.where(rest).groupBy("length", "part").count(), "counts")
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most capacity - 1 rows
    made = plan(counts, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_part.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    columns = ["doc_id", "piece", "start", "length", "ids", "doc_tokens"]
    short = _placed(pieces.where(rest).join(starts, ["length", "part"]).select(*columns, (F.col("base") + F.col("number")).alias("nth")), made)
    # a full piece needs no plan: its number in its task makes a sequence id beyond those of the plan
    full = pieces.where(~rest).select(
        *columns, (F.lit(made.sequences) + F.shiftleft(F.col("part").cast("long"), 36) + F.col("number")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"))
    return short.select(*columns, "p.sequence_id", "p.offset").unionByName(full)
