"""Benchmark decontamination under edit distance by CGK embedding and bit-sampling LSH.

Texts are sequences of lower-cased words. For an item of n words, every window of n words of a document is looked at; it
is contaminated if its word edit distance to the item is at most `slack` * n (0.2: a similarity of 0.8).

1. Counting lemma: such a window has n - d words and n - 1 - 2d neighbouring pairs of the item's, so windows with fewer
   words or pairs known from the benchmark are left out without loss.
2. CGK embedding: a walk over the window, driven by shared coins for (step, word), copies a word at each step and
   moves on by the coin. Two sequences at a small edit distance walk in step most of the time, so their embeddings are
   at a small Hamming distance. Steps after the last word carry nothing and are not taken.
3. Bit sampling: a table hashes a few sampled positions of an embedding. How many tables (over several walks) reach the
   target recall at the distance limit is measured on the items themselves, with edits drawn from a seed.
4. Windows that meet an item in a table are verified by exact edit distance.

With `passages`, as the queries use it, windows only propose. Words may be left out or added, so a passage need not be as
long as its item: the distance is that to the best passage of any length around a proposing window (semi-global). The
window that starts with such a passage still holds n - d words and n - 1 - 2d pairs of the item; a window that runs past
the end of its text is filled up with END, so passages at the end and texts shorter than the item have windows as well. The
tables are as many as substitutions, insertions, deletions and their mixture need.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from itertools import chain, repeat
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridpulse.llm.common import Scratch, mix, slices

_WORD = re.compile(r"\w+")
SAMPLED = 7  # quarters of n: steps of a walk that are taken
END = np.uint64(0xFF51AFD7ED558CCD)
BLOCK_WORDS = 2_000_000
MOST_TABLES = 4096
ENOUGH_TABLES = 256  # of one walk; beyond, more walks are taken
MOST_WALKS = 64
SLICE_ROWS = 2048  # texts looked at together, within a bound of characters


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def limit(n: int, slack: float) -> int:
    return int(math.floor(slack * n + 1e-9))


def embed(windows: np.ndarray, walk: int, steps: int) -> np.ndarray:
    """First `steps` symbols of the CGK embeddings of windows, an array (count, n) of word names."""
    count, n = windows.shape
    padded = np.concatenate([windows, np.full((count, 1), END)], axis=1)
    row, at = np.arange(count), np.zeros(count, dtype=np.int64)
    out = np.empty((count, steps), dtype=np.uint64)
    for t in range(steps):
        if t % 64 == 0:  # a word's next 64 coins
            coins = mix(padded + np.uint64(((walk << 20) + t + 1) * 0xC2B2AE3D27D4EB4F % (1 << 64)))
        out[:, t] = padded[row, at]
        at = np.minimum(at + (coins[row, at] >> np.uint64(t % 64) & np.uint64(1)).astype(np.int64), n)
    return out


def edit_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Word edit distances of the rows of two arrays (count, n), all rows at a time."""
    step = np.arange(b.shape[1] + 1)
    row = np.repeat(step[None, :], len(a), axis=0)
    for i in range(a.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, :-1] + (b != a[:, i : i + 1]), row[:, 1:] + 1)
        row = np.minimum.accumulate(new - step, axis=1) + step
    return row[:, -1]


def passage_distances(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the rows of two arrays (count, n) and (count, m): least edit distance of a to a run of words of b, and its first start."""
    unit = b.shape[1] + 1
    step = np.arange(unit) * unit
    row = np.repeat(np.arange(unit)[None, :], len(a), axis=0)  # distance * unit + start
    for i in range(a.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = (i + 1) * unit
        new[:, 1:] = np.minimum(row[:, :-1] + (b != a[:, i : i + 1]) * unit, row[:, 1:] + unit)
        row = np.minimum.accumulate(new - step, axis=1) + step
    best = row.min(1)
    return best // unit, best % unit


@dataclass
class Sampler:
    """Tables of sampled positions for embeddings of windows of n words."""

    steps: int
    picks: list[np.ndarray]  # for each walk, positions (tables, bits)

    def keys(self, windows: np.ndarray) -> np.ndarray:
        """(count, tables) hashes."""
        out, first = [], 0
        for walk, positions in enumerate(self.picks):
            shown = embed(windows, walk, self.steps)
            h = np.arange(first, first + len(positions), dtype=np.uint64)[None, :]
            for column in positions.T:
                h = mix(h + shown[:, column])
            out.append(h)
            first += len(positions)
        return np.concatenate(out, axis=1)


@dataclass
class Benchmark:
    """Items of one block, by number of words, with their tables."""

    slack: float
    recall: float
    bits: int
    walks: int
    vocabulary: dict[str, int] = field(default_factory=dict)
    items: dict[int, list[tuple[int, np.ndarray]]] = field(default_factory=dict)
    samplers: dict[int, Sampler] = field(default_factory=dict)
    tables: dict[int, dict[int, list[int]]] = field(default_factory=dict)
    table_keys: dict[int, np.ndarray] = field(default_factory=dict)
    pairs: np.ndarray | None = None
    pairs_of: dict[int, np.ndarray] = field(default_factory=dict)
    passages: bool = False

    def add(self, rows: list[tuple[int, str]]) -> "Benchmark":
        pairs: dict[int, set] = {}
        for item_id, text in rows:
            parts = words(text)
            if not parts:
                continue
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in parts]
            pairs.setdefault(len(ids), set()).update(a << 32 | b for a, b in zip(ids, ids[1:]))
            self.items.setdefault(len(ids), []).append((item_id, np.array(ids, dtype=np.int64)))
        self.pairs = np.array(sorted(set().union(*pairs.values())), dtype=np.int64)
        self.pairs_of = {n: np.array(sorted(x), dtype=np.int64) for n, x in pairs.items()}
        for n, items in self.items.items():
            self.samplers[n] = self._sampler(n, np.stack([x for _, x in items]))
            keys = self.samplers[n].keys(mix(np.stack([x for _, x in items]).astype(np.uint64)))
            table: dict[int, list[int]] = {}
            for i, row in enumerate(keys.tolist()):
                for k in row:
                    table.setdefault(k, []).append(i)
            self.tables[n] = table
            self.table_keys[n] = np.array(sorted(table), dtype=np.uint64)
        return self

    def _passages(self, ids: np.ndarray, text: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """Matches around the windows that meet an item in a table."""
        out: dict[tuple[int, int, int], tuple[int, int]] = {}
        stop = (begin + sizes - 1)[text]  # end of the text, for each place
        two = np.append(ids[:-1] << 32 | ids[1:], 0) if len(ids) else ids
        met = np.zeros(len(two), dtype=bool)
        both = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        met[both] = _within(two[both], self.pairs)
        pair = np.concatenate([[0], np.cumsum(met, dtype=np.int32)])
        longest = max(self.items, default=1)
        pair = np.concatenate([pair, np.full(longest, pair[-1], dtype=np.int32)])  # windows may run past the end
        lengths: dict[int, list[int]] = {}
        for n in self.items:
            lengths.setdefault(limit(n, self.slack), []).append(n)
        for d, group in lengths.items():
            # the first `least` words of a window of any of these lengths hold that many known pairs
            least = min(group)
            some = pair[least - 1 : least - 1 + len(ids)] - pair[: len(ids)] >= least - 1 - 2 * d
            dense = np.flatnonzero(some & (ids > 0) if d == 0 else some)
            for n in group:
                for start in np.array_split(dense, math.ceil(len(dense) / 4096)) if len(dense) else []:
                    self._propose(n, d, start[start + n - d <= stop[start]], ids, two, text, begin, stop, out)
        return [(t, self.items[n][i][0], first, n, far) for (t, n, i), (far, first) in out.items()]

    def _propose(self, n, d, start, ids, two, text, begin, stop, out) -> None:
        place = start[:, None] + np.arange(n)
        inside = place < stop[start][:, None]
        place = np.minimum(place, len(ids) - 1)
        windows = np.where(inside, ids[place], -1)
        known = (_within(np.where(inside[:, 1:], two[place[:, :-1]], 0), self.pairs_of[n])).sum(1) if n > 1 else np.zeros(len(start))
        good = ((windows > 0).sum(1) >= n - d) & (known >= n - 1 - 2 * d)
        start, windows = start[good], windows[good]
        if not len(start):
            return
        keys = self.samplers[n].keys(np.where(windows >= 0, mix(windows.view(np.uint64)), END))
        row, column = np.nonzero(_within(keys, self.table_keys[n]))
        table, item_of = self.tables[n], self.items[n]
        met = {(w, i) for w, k in zip(row.tolist(), keys[row, column].tolist()) for i in table[k]}
        if not met:
            return
        w, i = np.array(sorted(met)).T
        # windows of one text that start within d words of the first and propose the same item are verified together
        at, of = start[w], text[start[w]]
        order = np.lexsort((at, i, of))
        at, of, i = at[order], of[order], i[order]
        heads, last = [], None
        for k, key in enumerate(zip(of.tolist(), i.tolist(), at.tolist())):
            if last is None or key[:2] != last[:2] or key[2] - last[2] > d:
                heads.append(k)
                last = key
        for part in np.array_split(np.array(heads), math.ceil(len(heads) / 1024)):
            place = at[part][:, None] - d + np.arange(n + 3 * d)
            inside = (place >= begin[of[part]][:, None]) & (place < stop[at[part]][:, None])
            around = np.where(inside, ids[np.clip(place, 0, len(ids) - 1)], 0)
            distance, shift = passage_distances(np.stack([item_of[x][1] for x in i[part].tolist()]), around)
            for k in np.flatnonzero(distance <= d).tolist():
                t = int(of[part[k]])
                first = max(0, int(at[part[k]]) - d + int(shift[k]) - int(begin[t]))
                key, found = (t, n, int(i[part[k]])), (int(distance[k]), first)
                out[key] = min(out.get(key, found), found)

    def _sampler(self, n: int, items: np.ndarray) -> Sampler:
        """As many tables as edits of items at the distance limit need to meet their item with the target recall."""
        draw = np.random.default_rng(n)
        d, tries = limit(n, self.slack), 64
        source = items[draw.integers(0, len(items), tries)]
        edited = np.array([self._edited(row, d, i % 4, draw) for i, row in enumerate(source)])
        # a walk is past the last word after 2n steps on average; samples are taken before that. Words left out or added
        # shift what comes late, so passages sample the early steps and fewer bits.
        steps, bits = (n, min(self.bits, 2)) if self.passages else (max(1, SAMPLED * n // 4), self.bits)
        source, edited = mix(source.view(np.uint64)), mix(edited.view(np.uint64))
        agree, walks = [], self.walks
        while True:
            agree += [(embed(source, w, steps) == embed(edited, w, steps)).mean(1) for w in range(len(agree), walks)]
            same = np.stack(agree) if self.passages else np.broadcast_to(np.mean(agree, 0), (walks, tries))
            missed, each = np.log1p(-np.minimum(same**bits, 1 - 1e-12)).sum(0), 2
            while np.mean(1 - np.exp(missed * each)) < self.recall and each <= MOST_TABLES:
                each += 2
            # an edit in the first words can lead some walks astray for good; more tables do not help then, other walks do
            if each > ENOUGH_TABLES and self.passages and walks < MOST_WALKS:
                walks *= 2
                continue
            if each > MOST_TABLES:
                raise ValueError(f"items of {n} words need more than {MOST_TABLES} tables a walk for a recall of {self.recall}")
            return Sampler(steps, [draw.integers(0, steps, (each, bits)) for _ in range(walks)])

    def _edited(self, row: np.ndarray, d: int, kind: int, draw) -> np.ndarray:
        """A window with d edits of a kind. Without passages, insertions and deletions come in twos and keep the length."""
        new = lambda: -1 - int(draw.integers(1 << 30))
        v, n = row.tolist(), len(row)
        if not self.passages:
            for _ in range(d // 2):
                del v[int(draw.integers(n))]
                v.insert(int(draw.integers(n)), new())
            if d % 2:
                v[int(draw.integers(n))] = new()
            return np.array(v)
        for _ in range(d):
            what, k = kind if kind < 3 else int(draw.integers(3)), int(draw.integers(len(v)))
            if what == 0:
                v[k] = new()
            elif what == 1:
                v.insert(k, new())
            else:
                del v[k]
        return np.array((v + [new() for _ in range(d)])[:n])

    def matches(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(number of the text, item_id, first word, words, distance) of every contaminated window of some texts."""
        known = self.vocabulary.get
        parts = [words(t) for t in texts]
        sizes = np.array([len(p) + 1 for p in parts], dtype=np.int64)
        begin = np.cumsum(sizes) - sizes
        # one separator after each text; it is no known word, and windows that hold one are left out
        named = chain.from_iterable(chain(map(known, p, repeat(0)), (0,)) for p in parts)
        ids = np.fromiter(named, dtype=np.int64, count=int(sizes.sum()))
        text = np.repeat(np.arange(len(parts)), sizes)
        if self.passages:
            return self._passages(ids, text, begin, sizes)
        hit = np.concatenate([[0], np.cumsum(ids > 0)])
        two = ids[:-1] << 32 | ids[1:]
        pair = np.concatenate([[0], np.cumsum(_within(two, self.pairs))])
        out = []
        for n, items in self.items.items():
            if len(ids) < n:
                continue
            d = limit(n, self.slack)
            enough = n - 1 - 2 * d
            start = np.flatnonzero((hit[n:] - hit[:-n] >= n - d) & (pair[n - 1 :] - pair[: len(pair) - n + 1] >= enough))
            start = start[start + n <= (begin + sizes - 1)[text[start]]]
            if not len(start):
                continue
            # the same count with the pairs of items of this length only
            own = _within(two[start[:, None] + np.arange(n - 1)], self.pairs_of[n]).sum(1) >= enough
            start = start[own]
            for part in np.array_split(start, math.ceil(len(start) / 2048)) if len(start) else []:
                windows = ids[part[:, None] + np.arange(n)]
                keys = self.samplers[n].keys(mix(windows.astype(np.uint64)))
                row, column = np.nonzero(_within(keys, self.table_keys[n]))
                table = self.tables[n]
                met = {(w, i) for w, k in zip(row.tolist(), keys[row, column].tolist()) for i in table[k]}
                if not met:
                    continue
                w, i = np.array(sorted(met)).T
                distance = edit_distances(np.stack([x for _, x in items])[i], windows[w])
                near = np.flatnonzero(distance <= d)
                for at, item, far in zip(part[w[near]].tolist(), i[near].tolist(), distance[near].tolist()):
                    out.append((int(text[at]), items[item][0], at - int(begin[text[at]]), n, far))
        return out


def _within(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    if not len(ascending):
        return np.zeros(values.shape, dtype=bool)
    return ascending[np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)] == values


def _blocks(benchmark: DataFrame, slack: float, recall: float, bits: int, walks: int, passages: bool) -> tuple[int, Iterator[Benchmark]]:
    """Number of blocks of a bounded number of words and the blocks, made one at a time: neither driver nor task holds more."""
    rows = benchmark.select("item_id", "text").where("text is not null and item_id is not null")
    size = rows.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    count = max(1, math.ceil(size / BLOCK_WORDS))

    def made():
        for b in range(count):
            part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == b).distinct().orderBy("item_id", "text").collect()
            yield Benchmark(slack, recall, bits, walks, passages=passages).add([(r["item_id"], r["text"]) for r in part])

    return count, made()


def contaminated(docs: DataFrame, benchmark: DataFrame, slack: float = 0.2, recall: float = 0.97, bits: int = 3, walks: int = 4, passages: bool = False) -> DataFrame:
    """The best match of each document and item: doc_id, item_id, first_word, n_words, distance, similarity.

    NULL texts and texts without words, on either side, match nothing; an item without id is left out; without `passages`
    a text shorter than an item has no window for it. n_words are the item's. Repeated rows give one row for each doc_id
    and item; ties go to the earliest place. A NULL doc_id is a value like others. Extra columns are not carried. Empty
    tables give no rows. Of several blocks, each one's matches are written before the next block is made.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontam")
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int32()), ("n_words", pa.int32()), ("distance", pa.int32())])
    found = None
    count, blocks = _blocks(benchmark, slack, recall, bits, walks, passages)
    for number, block in enumerate(blocks):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, rows=SLICE_ROWS):
                best: dict[tuple, tuple] = {}
                ids = part.column("doc_id").to_pylist()
                for at, item, first, n, distance in shared.value.matches(part.column("text").to_pylist()):
                    x = (distance, first, n)
                    best[ids[at], item] = min(best.get((ids[at], item), x), x)
                if best:
                    rows = [(d, i, first, n, distance) for (d, i), (distance, first, n) in best.items()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        one = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, first_word int, n_words int, distance int")
        if count > 1:
            one = scratch.write(one, f"found{number}")
            shared.destroy()
        found = one if found is None else found.unionByName(one)
    best = found.groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "first_word", "n_words")).alias("m"))
    return best.select("doc_id", "item_id", "m.first_word", "m.n_words", "m.distance", (1 - F.col("m.distance") / F.col("m.n_words")).alias("similarity"))


def clean(docs: DataFrame, benchmark: DataFrame, slack: float = 0.2, recall: float = 0.97, bits: int = 3, walks: int = 4, passages: bool = False) -> DataFrame:
    """docs without the rows whose text holds an item; all columns stay. Each row is judged by its own text.

    A row with a NULL or empty text holds nothing and stays, as do all rows if the benchmark is empty. Repeated rows all go or
    all stay. Of several blocks, the rows that one leaves are written before the next block is made.
    """
    out, scratch = docs, Scratch(docs.sparkSession, "decontam")
    count, blocks = _blocks(benchmark, slack, recall, bits, walks, passages)
    for number, block in enumerate(blocks):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        @F.pandas_udf("boolean")
        def holds(texts, shared=shared):
            held, size = np.zeros(len(texts), dtype=bool), np.cumsum(texts.str.len().fillna(0).to_numpy())
            at = 0
            while at < len(texts):  # a bounded number of rows and characters at a time
                end = min(at + SLICE_ROWS, max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + 4_000_000, side="right"))))
                for found in shared.value.matches(texts.iloc[at:end].tolist()):
                    held[at + found[0]] = True
                at = end
            return pd.Series(held)

        out = out.where(~holds("text"))
        if count > 1:
            out = scratch.write(out, f"left{number}")
            shared.destroy()
    return out
