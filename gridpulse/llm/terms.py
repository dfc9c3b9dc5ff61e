"""Words of whole texts as byte ranges, and CRCs of any run of words from running CRCs.

A word is a maximal run of ASCII digits, ASCII letters (A-Z lower-cased) and characters above U+007F. A text is
normalised to its words with one space after each, so a run of words is a byte range of the normalised text.
"""

from __future__ import annotations

import functools
import zlib
from dataclasses import dataclass
from typing import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gridpulse.llm.common import slices

SPACE = 32
PIECE_BYTES = 4_000_000
LANES = 4096
_SHORT = 64  # shifts by fewer bytes than this have a table of their own


@functools.cache
def folding() -> np.ndarray:
    """What becomes of each byte: A-Z lower case, other ASCII outside a word a space."""
    out = np.full(256, SPACE, dtype=np.uint8)
    for low, high in ((ord("0"), ord("9")), (ord("a"), ord("z")), (128, 255)):
        out[low : high + 1] = np.arange(low, high + 1)
    out[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
    return out


@dataclass
class Words:
    """Words of some texts: `data` is the normalised text, `start` and `end` the words' ranges there, `text` their text.

    Words before `new` repeat the end of a part of the same text that came before.
    """

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    new: int = 0


def split(raw: np.ndarray, offsets: np.ndarray, new: int = 0) -> Words:
    """Words of texts that lie one after another in `raw` (bytes); text i is raw[offsets[i] : offsets[i + 1]]."""
    low = folding()[raw]
    letter = low != SPACE
    edge = np.zeros(len(low) + 1, dtype=bool)
    edge[offsets] = True
    first = letter.copy()
    first[1:] &= ~letter[:-1] | edge[1:-1]
    start = np.flatnonzero(first)
    last = letter.copy()
    last[:-1] &= ~letter[1:] | edge[1:-1]
    size = np.flatnonzero(last) + 1 - start
    text = np.searchsorted(offsets[1:], start, side="right")
    begin = np.cumsum(size + 1) - (size + 1)
    data = np.full(int(size.sum()) + len(size), SPACE, dtype=np.uint8)
    data[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = low[letter]
    return Words(data, begin, begin + size, text, new)


def words_of(batches: Iterable[pa.RecordBatch], overlap: int = 0, piece: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, Iterator[Words]]]:
    """Slices of the batches and the words of their column `text`; NULL has none.

    A text longer than `piece` bytes comes in several parts, cut between words; each but the first repeats the last
    `overlap` words of the part before.
    """
    for some in slices(batches):
        column = pc.fill_null(some.column("text"), "").cast(pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        held = column.buffers()[2]
        raw = np.frombuffer(held, dtype=np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, dtype=np.uint8)
        offsets = offsets - offsets[0]
        yield some, iter([split(raw, offsets)]) if len(some) > 1 or len(raw) <= piece else _parts(raw, overlap, piece)


def _parts(raw: np.ndarray, overlap: int, piece: int) -> Iterator[Words]:
    at, halo, held = 0, np.zeros(0, dtype=np.uint8), 0
    while at < len(raw):
        end = min(at + piece, len(raw))
        while end < len(raw):  # on to the next byte outside a word
            gap = np.flatnonzero(folding()[raw[end : end + piece]] == SPACE)
            if len(gap):
                end += int(gap[0])
                break
            end = min(end + piece, len(raw))
        found = split(np.concatenate([halo, raw[at:end]]), np.array([0, len(halo) + end - at]), held)
        yield found
        held = min(overlap, len(found.start))
        halo = found.data[found.start[-held] :] if held else np.zeros(0, dtype=np.uint8)
        at = end


@functools.cache
def _byte_step() -> np.ndarray:
    """CRC register after one zero byte, for each value of its low byte (reflected polynomial of CRC-32)."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, x >> np.uint32(1) ^ np.uint32(0xEDB88320), x >> np.uint32(1)).astype(np.uint32)
    return x


def _pass(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A GF(2)-linear map of 32-bit values given by its values on each of the four bytes."""
    return table[0][x & 255] ^ table[1][x >> 8 & 255] ^ table[2][x >> 16 & 255] ^ table[3][x >> 24]


@functools.cache
def _shifts() -> tuple[np.ndarray, list[np.ndarray]]:
    """Maps that append n zero bytes: one for each n below _SHORT, and those for _SHORT * 2**k."""
    step = _byte_step()
    one = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    short = [one]
    for _ in range(_SHORT):
        short.append(step[short[-1] & 255] ^ short[-1] >> 8)
    doubled = [short.pop()]
    for _ in range(30):
        doubled.append(_pass(doubled[-1], doubled[-1]))
    return np.stack(short), doubled


def shifted(crc: np.ndarray, count: np.ndarray) -> np.ndarray:
    """What the CRCs of some prefixes contribute to a CRC `count` bytes further on."""
    short, doubled = _shifts()
    n = count & (_SHORT - 1)
    out = short[n, 0, crc & 255] ^ short[n, 1, crc >> 8 & 255] ^ short[n, 2, crc >> 16 & 255] ^ short[n, 3, crc >> 24]
    high = count // _SHORT
    k = 0
    while high.any():
        odd = np.flatnonzero(high & 1)
        out[odd] = _pass(doubled[k], out[odd])
        high, k = high >> 1, k + 1
    return out


def running(data: np.ndarray) -> np.ndarray:
    """CRC-32 of every prefix of the bytes, the empty one first. Lanes of equal length are scanned side by side."""
    lane = max(64, -(-len(data) // LANES))
    count = -(-len(data) // lane)
    starts = np.zeros(count, dtype=np.uint32)
    view, crc = memoryview(np.ascontiguousarray(data)), 0
    for k in range(count):
        starts[k] = crc
        crc = zlib.crc32(view[k * lane : (k + 1) * lane], crc)
    grid = np.zeros(count * lane, dtype=np.uint8)
    grid[: len(data)] = data
    grid = np.ascontiguousarray(grid.reshape(count, lane).T)
    out = np.empty((lane, count), dtype=np.uint32)
    step, register = _byte_step(), ~starts
    for i in range(lane):
        register = step[(register ^ grid[i]) & 255] ^ register >> 8
        out[i] = register
    return np.concatenate([np.zeros(1, dtype=np.uint32), ~out.T.reshape(-1)[: len(data)]])


def run_crcs(found: Words, crcs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, CRC-32) of every run of `length` words of one text whose last word is new; crcs are the running ones."""
    if len(found.start) < length:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint32)
    a, b = found.start[: len(found.start) - length + 1], found.end[length - 1 :]
    keep = found.text[: len(a)] == found.text[length - 1 :]
    keep[: max(0, found.new - length + 1)] = False
    a, b, text = a[keep], b[keep], found.text[: len(keep)][keep]
    return text, crcs[b] ^ shifted(crcs[a], b - a)
