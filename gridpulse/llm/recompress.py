"""Exact removal of repeated word windows, found by recompression.

Words get 64-bit names. A round of recompression names maximal runs of one symbol, then pairs of neighbours that a
coin tossed per symbol puts into the left and the right class. Names are hashes of what they stand for, so all tasks
give the same run or pair the same name, in every round, without an exchange. Each symbol knows the interval of words
that determines it: its own words and the neighbours that the rounds have looked at. A symbol whose interval lies in a
window of text appears wherever that window does; this is what makes interior symbols consistent.

* Every window of `width` words takes as its anchor the symbol of the highest round whose interval it contains, the one
  with the least name. The choice depends on the window's words only, so equal windows have equal anchors. Windows that
  share one occurrence of an anchor are neighbours and make one row: a block, with a hash of its words.
* Anchors that occur once cannot belong to a repeated window. Where all blocks of an anchor are equal, the repeat is
  verified for all their windows at once. Only for anchors with different blocks (the borders of repeats) are the single
  windows hashed, one representative for each different block.

Blocks and windows are compared by a 64-bit hash within one anchor, whose name is another 64-bit hash of the content.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridpulse.llm.common import Scratch, mix, slices

ROUNDS = 4
BASE = np.uint64(0x9E3779B97F4A7C15)
RUN, PAIR = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
EDGE = np.uint64(0x8EBC6AF09C88C6E3)


def word_hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word: one for names, one for block contents."""
    import xxhash

    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), dtype=np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


class Level:
    """Symbols in text order with the first and last word that determine each."""

    def __init__(self, names, low, high):
        self.names, self.low, self.high = names, low, high


def compress(level: Level, number: int) -> Level:
    """One round: runs, then pairs. Neighbours that were looked at widen the interval."""
    s, low, high = level.names, level.low, level.high
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    last = np.append(first[1:] - 1, len(s) - 1)
    length = (last - first + 1).astype(np.uint64)
    names = np.where(length > 1, mix(s[first] * RUN + length), s[first])
    low, high = low[np.maximum(first - 1, 0)], high[np.minimum(last + 1, len(s) - 1)]
    coin = mix(names ^ np.uint64((number + 1) * int(EDGE) % (1 << 64))) & np.uint64(1) == 1
    joined = coin[:-1] & ~coin[1:]
    left = np.append(joined, False)
    right = np.append(False, joined)
    out_low, out_high = low.copy(), high.copy()
    lone = ~left & ~right
    # an unpaired symbol of the left class has looked at its right neighbour, one of the right class at its left one
    ahead, behind = np.flatnonzero(lone & coin), np.flatnonzero(lone & ~coin)
    out_high[ahead] = high[np.minimum(ahead + 1, len(names) - 1)]
    out_low[behind] = low[np.maximum(behind - 1, 0)]
    at = np.flatnonzero(left)
    names, merged = names.copy(), mix(names[at] * PAIR + mix(names[at + 1] + np.uint64(number)))
    names[at] = merged
    out_high[at] = high[at + 1]
    keep = ~right
    return Level(names[keep], out_low[keep], out_high[keep])


def _least(level: Level, start: np.ndarray, width: int) -> np.ndarray:
    """For windows at these (ascending) starts, the index of the contained symbol with the least name; -1 where none is contained."""
    n = len(level.names)
    fit = level.high - level.low < width
    index = np.flatnonzero(fit)
    if not len(index):
        return np.full(len(start), -1)
    names, low, high = level.names[index], level.low[index], level.high[index]
    # intervals ascend in both ends, so those inside a window are neighbours
    a = np.searchsorted(low, start)
    b = np.searchsorted(high, start + width - 1, side="right") - 1
    some = b >= a
    a, b = np.minimum(a, len(index) - 1), np.clip(b, 0, len(index) - 1)
    span = np.where(some, b - a, 0)
    tables = [np.arange(len(index))]
    while 2 << (len(tables) - 1) <= span.max() + 1:
        t, step = tables[-1], 1 << (len(tables) - 1)
        x, y = t[:-step], t[step:]
        tables.append(np.concatenate([np.where(names[x] <= names[y], x, y), t[-step:]]))
    k = np.frexp(span + 1)[1] - 1
    best = np.empty(len(start), dtype=np.int64)
    for j, t in enumerate(tables):
        here = k == j
        x, y = t[a[here]], t[b[here] - (1 << j) + 1]
        best[here] = np.where(names[x] <= names[y], x, y)
    return np.where(some, index[best], -1)


def anchors(texts: list[list[bytes]], width: int, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Blocks of neighbouring windows with one anchor: document number, first word, windows, anchor name, hash of the block."""
    sizes = np.array([len(t) for t in texts])
    flat = [w for t in texts for w in t]
    if not len(flat) or sizes.max() < width:
        return {k: np.zeros(0, dtype=np.int64) for k in ("doc", "first", "windows", "name", "block")}
    a, b = word_hashes(flat)
    # one separator before, between and after documents; no window holds one
    begin = np.cumsum(sizes + 1) - sizes
    place = np.arange(len(flat)) + np.repeat(np.arange(1, len(sizes) + 1), sizes)
    total = len(flat) + len(sizes) + 1
    names = mix(np.arange(total, dtype=np.uint64) * EDGE)
    names[place] = a
    where = np.arange(total)
    levels = [Level(names, where, where)]
    for r in range(rounds):
        levels.append(compress(levels[-1], r))
    counts = np.maximum(sizes - width + 1, 0)
    doc = np.repeat(np.arange(len(sizes)), counts)
    start = np.repeat(begin, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    name, symbol = np.zeros(len(start), dtype=np.uint64), np.full(len(start), -1)
    for number in range(rounds, -1, -1):
        left = np.flatnonzero(symbol < 0)
        if not len(left):
            break
        found = _least(levels[number], start[left], width)
        hit = found >= 0
        name[left[hit]] = mix(levels[number].names[found[hit]] + np.uint64(number))
        symbol[left[hit]] = found[hit] * (rounds + 1) + number
    lead = np.flatnonzero(np.concatenate([[True], (symbol[1:] != symbol[:-1]) | (doc[1:] != doc[:-1])]))
    windows = np.diff(np.append(lead, len(start)))
    first = start[lead] - begin[doc[lead]]
    at = np.cumsum(sizes) - sizes
    block = spans(b, at[doc[lead]] + first, windows + width - 1)
    return {"doc": doc[lead], "first": first, "windows": windows, "name": name[lead], "block": mix(block + windows.astype(np.uint64))}


def spans(hashes: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hash of each run of words: a polynomial modulo 2**64, from prefix sums."""
    power = np.multiply.accumulate(np.full(len(hashes), BASE, dtype=np.uint64))
    prefix = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(hashes * power)])
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    back = np.multiply.accumulate(np.concatenate([np.ones(1, dtype=np.uint64), np.full(len(hashes), inverse, dtype=np.uint64)]))
    return mix((prefix[first + length] - prefix[first]) * back[first] + length.astype(np.uint64))


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


_KEYS = [("id", pa.int64()), ("th", pa.int64())]


def _numbered(docs: DataFrame) -> DataFrame:
    """Rows are told apart by id and text; rows equal in both are equal in all results."""
    return docs.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), F.xxhash64("text").alias("th"), "doc_id", "text")


def _blocks(docs: DataFrame, width: int, rounds: int) -> DataFrame:
    schema = pa.schema([*_KEYS, ("first", pa.int32()), ("windows", pa.int16()), ("name", pa.int64()), ("block", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, chars=2_000_000):
            found = anchors([split(t) for t in part.column("text").to_pylist()], width, rounds)
            if len(found["doc"]):
                yield pa.RecordBatch.from_arrays([
                    part.column("id").take(pa.array(found["doc"])), part.column("th").take(pa.array(found["doc"])),
                    pa.array(found["first"].astype(np.int32)), pa.array(found["windows"].astype(np.int16)),
                    pa.array(found["name"].view(np.int64)), pa.array(found["block"].view(np.int64)),
                ], schema=schema)

    return docs.mapInArrow(run, "id long, th long, first int, windows short, name long, block long")


def _single_windows(docs: DataFrame, chosen: DataFrame, width: int) -> DataFrame:
    """(speaker, step, alone, hash): every window of the chosen blocks; the hash is of the anchor's name and the window's words."""
    lists = chosen.groupBy("id", "th").agg(F.collect_list(F.struct("speaker", "name", "alone", "first", "windows")).alias("blocks"))
    schema = pa.schema([("speaker", pa.int64()), ("step", pa.int16()), ("alone", pa.bool_()), ("hash", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, chars=2_000_000):
            texts = [split(t) for t in part.column("text").to_pylist()]
            sizes = np.array([len(t) for t in texts])
            flat = part.column("blocks").flatten()
            count = part.column("blocks").value_lengths().to_numpy(zero_copy_only=False)
            speaker, name, alone, first, windows = (
                flat.field(f).to_numpy(zero_copy_only=False) for f in ("speaker", "name", "alone", "first", "windows"))
            windows = windows.astype(np.int64)
            lead = np.repeat(np.cumsum(sizes) - sizes, count) + first
            step = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
            hashes = spans(word_hashes([w for t in texts for w in t])[1], np.repeat(lead, windows) + step, np.full(len(step), width))
            both = mix(hashes ^ np.repeat(name.view(np.uint64), windows)).view(np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(speaker, windows)), pa.array(step.astype(np.int16)), pa.array(np.repeat(alone, windows).astype(bool)),
                pa.array(both)], schema=schema)

    once = docs.join(lists, ["id", "th"]).select("text", "blocks")
    return once.mapInArrow(run, "speaker long, step short, alone boolean, hash long")


def repeated_windows(docs: DataFrame, width: int, rounds: int, scratch: Scratch) -> DataFrame:
    """(id, th, first, windows): runs of windows whose words start anywhere else too."""
    blocks = scratch.write(_blocks(docs, width, rounds), "blocks")
    shared = scratch.write(
        blocks.groupBy("name").agg(F.count("*").alias("n"), F.min("block").alias("least"), F.max("block").alias("most"))
        .where("n > 1").select("name", (F.col("least") != F.col("most")).alias("mixed")), "shared")
    kept = scratch.write(blocks.join(shared, "name"), "kept")
    scratch.drop("blocks", "shared")
    same = kept.where(~F.col("mixed")).select("id", "th", "first", "windows")
    # of equal blocks, one speaks for all; where it is not alone, its windows are repeated anyhow
    speakers = scratch.write(
        kept.where("mixed").groupBy("name", "block").agg(
            F.count("*").alias("n"), F.min(F.struct("id", "th", "first", "windows")).alias("x"))
        .select(F.monotonically_increasing_id().alias("speaker"), "name", "block", (F.col("n") == 1).alias("alone"), "x.*"), "speakers")
    members = kept.where("mixed").join(speakers.where(~F.col("alone")).select("name", "block"), ["name", "block"], "left_semi").select(
        "id", "th", "first", "windows")
    single = scratch.write(_single_windows(docs, speakers, width), "single")
    twice = scratch.write(single.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "twice")
    border = single.where("alone").join(twice, "hash", "left_semi").join(speakers.select("speaker", "id", "th", "first"), "speaker").select(
        "id", "th", (F.col("first") + F.col("step")).cast("int").alias("first"), F.lit(1).cast("short").alias("windows"))
    border = scratch.write(border, "border")
    scratch.drop("single", "twice")
    return same.unionByName(members).unionByName(border)


def remove_repeats(docs: DataFrame, width: int = 35, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, text (kept words joined by one space), n_words, n_removed, spans (cut ranges of words) of every row.

    Words are runs of anything but ASCII white space; a NULL text has none, and neither it nor texts shorter than a
    window lose words. A NULL doc_id is carried along; rows that repeat id and text are judged as separate texts, so
    each makes the other's windows repeated. Extra columns are not carried. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "recompress")
    docs = _numbered(docs)
    found = repeated_windows(docs, width, rounds, scratch)
    cuts = scratch.write(
        found.groupBy("id", "th").agg(F.array_sort(F.collect_set(F.struct("first", "windows"))).alias("cuts")), "cuts")

    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                        ("spans", pa.list_(pa.list_(pa.int32())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for doc_id, text, cut in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "cuts"))):
                words, kept, spans_, at = split(text), [], [], 0
                for x in cut or ():
                    low, high = max(at, x["first"]), x["first"] + x["windows"] + width - 1
                    kept += words[at:low]
                    if spans_ and spans_[-1][1] >= x["first"]:
                        spans_[-1][1] = max(spans_[-1][1], high)
                    else:
                        spans_.append([x["first"], high])
                    at = max(at, high)
                kept += words[at:]
                rows.append((doc_id, b" ".join(kept).decode("utf-8", "surrogatepass"), len(words), len(words) - len(kept), spans_))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.join(cuts, ["id", "th"], "left").select("doc_id", "text", "cuts").mapInArrow(
        run, "doc_id long, text string, n_words long, n_removed long, spans array<array<int>>")
