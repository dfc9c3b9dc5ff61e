"""Ids of the word-end BPE vocabulary, by its own library, at the price of the distinct words only.

In this vocabulary white space is dropped and a piece ends where an ASCII letter is followed by ASCII punctuation, so the
ids of a text are those of such chunks one after another. The chunks of a slice of texts are counted out by Arrow; only
those not met before are given to the library, and the texts' ids are gathered from the chunks' ids. Chunks of ASCII and
Latin-1 letters are one word each, so they need its BPE model only, many in one call: the last id of a word, and no other,
has the vocabulary's end mark. All others go through its normaliser and splitter, too. Texts that may hold an added token
are encoded whole. What is remembered is bounded; when it is full, chunks met again stay.
"""

from __future__ import annotations

import functools
import itertools
import os
import re

import numpy as np
import public_tokenizers
import pyarrow as pa

DEFAULT_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
REMEMBERED = 400_000  # chunks
TOGETHER = 500  # words to a call of the model
PIECE_BYTES = 4_000_000
_WHITE = frozenset(b"\t\n\v\f\r ")
_ADDED = b"<|"  # every added token starts with it


def _letters(raw: np.ndarray) -> np.ndarray:
    return ((raw | 32) - 97) < 26


class WordEncoder:
    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self._library = Tokenizer.from_file(path)
        self._words = Tokenizer(self._library.model)
        self._words.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        mark, vocabulary = self._library.model.end_of_word_suffix, self._library.get_vocab(with_added_tokens=False)
        self._last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # ids that end a word
        self._last[[i for token, i in vocabulary.items() if mark and token.endswith(mark)]] = True
        self._remembered = remembered
        self._slot: dict[bytes, int] = {}
        self._ids = np.zeros(1 << 16, dtype=np.uint32)
        self._end = np.zeros(1, dtype=np.int64)  # ids of slot i end at _end[i + 1]
        self._met = np.zeros(0, dtype=np.int64)  # slices that had it

    def _forget(self) -> None:
        """Keep the chunks met again, half of what may be remembered at most."""
        least = 2
        while np.count_nonzero(self._met >= least) > self._remembered // 2:
            least *= 2
        keep = np.flatnonzero(self._met >= least)
        many = self._end[keep + 1] - self._end[keep]
        ids = self._gather(keep, many)
        self._ids = np.zeros(max(1 << 16, len(ids)), dtype=np.uint32)
        self._ids[: len(ids)] = ids
        self._end = np.append(0, np.cumsum(many))
        chunks = list(self._slot)  # in the order of the slots
        self._slot = {chunks[i]: k for k, i in enumerate(keep.tolist())}
        self._met = self._met[keep] // 2

    def _gather(self, slot: np.ndarray, many: np.ndarray) -> np.ndarray:
        """Ids of the slots, one after another."""
        at = np.repeat(self._end[slot] - (np.cumsum(many) - many), many)
        at += np.arange(len(at))
        return self._ids[at]

    def _of_words(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words of these sizes, one after another, and how many lie between end marks."""
        stop = np.cumsum(size)
        text = np.insert(raw, stop, 32).tobytes()
        cuts = [0, *(stop + np.arange(1, len(stop) + 1))[TOGETHER - 1 :: TOGETHER].tolist(), len(text)]
        found = [x.ids for i, j in itertools.pairwise(cuts) if i < j
                 for x in self._words.encode_batch_fast([text[i:j].decode()], add_special_tokens=False)]
        ids = np.fromiter(itertools.chain.from_iterable(found), dtype=np.uint32)
        return ids, np.diff(np.flatnonzero(self._last[ids]), prepend=-1)

    def _encode(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order of the chunks; in that order their ids, one after another, and how many each has."""
        size = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        raw = np.frombuffer(b"".join(chunks), dtype=np.uint8).copy()
        lead = raw[:-1] == 0xC3
        lead &= (raw[1:] != 0x97) & (raw[1:] != 0xB7)  # the signs among the letters
        raw[1:][lead & (raw[1:] < 0x9F)] += 32  # to lower case
        other = ~_letters(raw)
        other[:-1] &= ~lead
        other[1:] &= ~lead
        plain = ~np.logical_or.reduceat(other, np.cumsum(size) - size)
        ids, many = self._of_words(raw[np.repeat(plain, size)], size[plain])
        if len(many) != np.count_nonzero(plain):  # a word without an end mark, not in the default vocabulary
            ids, many, plain = ids[:0], many[:0], np.zeros_like(plain)
        rest = np.flatnonzero(~plain)
        found = [x.ids for x in self._library.encode_batch_fast([chunks[i].decode() for i in rest.tolist()], add_special_tokens=False)]
        return (np.append(np.flatnonzero(plain), rest),
                np.concatenate([ids, np.fromiter(itertools.chain.from_iterable(found), dtype=np.uint32)]),
                np.concatenate([many, np.array([len(x) for x in found], dtype=np.int64)]))

    def _slots(self, chunks: list[bytes]) -> np.ndarray:
        def known() -> np.ndarray:
            return np.fromiter(map(self._slot.get, chunks, itertools.repeat(-1)), dtype=np.int64, count=len(chunks))

        slot = known()
        if len(self._slot) and len(self._slot) + np.count_nonzero(slot < 0) > self._remembered:
            self._forget()
            slot = known()
        missing = np.flatnonzero(slot < 0)
        if len(missing):
            order, ids, many = self._encode([chunks[i] for i in missing.tolist()])
            missing, start, base = missing[order], int(self._end[-1]), len(self._slot)
            if start + len(ids) > len(self._ids):
                self._ids = np.concatenate([self._ids, np.zeros(max(len(self._ids), start + len(ids)), dtype=np.uint32)])
            self._ids[start : start + len(ids)] = ids
            self._end = np.concatenate([self._end, start + np.cumsum(many)])
            self._met = np.concatenate([self._met, np.zeros(len(missing), dtype=np.int64)])
            slot[missing] = np.arange(base, base + len(missing))
            self._slot.update(zip([chunks[i] for i in missing.tolist()], range(base, base + len(missing))))
        self._met[slot] += 1
        return slot

    def _pieces(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts raw[offsets[i] : offsets[i + 1]], one after another, and how many each has."""
        white, letter = ((raw - 9) < 5) | (raw == 32), _letters(raw)
        sign = ((raw - 33) < 94) & ~letter & ((raw - 48) >= 10)
        first = ~white
        first[1:] &= white[:-1] | letter[:-1] & sign[1:]
        edge = offsets[offsets < len(raw)]
        first[edge] = ~white[edge]
        start = np.flatnonzero(first)
        if not len(start):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(offsets) - 1, dtype=np.int64)
        last = ~white
        last[:-1] &= white[1:] | first[1:]
        where = np.append(0, np.cumsum(np.flatnonzero(last) + 1 - start)).astype(np.int32)
        bare = (raw + (((raw - 65) < 26).view(np.uint8) << 5))[~white]
        chunks = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(where), pa.py_buffer(bare)]).dictionary_encode()
        slot = self._slots(chunks.dictionary.to_numpy(zero_copy_only=False).tolist())[chunks.indices.to_numpy(zero_copy_only=False)]
        many = self._end[slot + 1] - self._end[slot]
        before = np.append(0, np.cumsum(many))
        return self._gather(slot, many), np.diff(before[np.searchsorted(start, offsets)])

    def _whole(self, text: str, chars: int) -> np.ndarray:
        """One text by the library, cut at white space if it is very long."""
        out, start = [], 0
        while len(text) - start > chars and (gap := re.compile(r"[ \t\n\r]").search(text, start + chars)):
            out.append(text[start : gap.start()])
            start = gap.start()
        found = self._library.encode_batch_fast([*out, text[start:]], add_special_tokens=False)
        return np.concatenate([np.array(x.ids, dtype=np.uint32) for x in found])

    def ids(self, texts: list[str | None], chars: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after another, and how many each has; NULL has none."""
        raw = [(t or "").encode() for t in texts]
        added = [i for i, x in enumerate(raw) if _ADDED in x]
        plain = [b"" if i in set(added) else x for i, x in enumerate(raw)] if added else raw
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in plain])]).astype(np.int64)
        flat = np.frombuffer(b"".join(plain), dtype=np.uint8)
        if len(plain) == 1 and len(flat) > PIECE_BYTES:
            ids, many = self._long(flat)
        else:
            ids, many = self._pieces(flat, offsets)
        for i in added:
            more = self._whole(texts[i], chars)
            ids = np.insert(ids, int(many[:i].sum()), more)
            many[i] = len(more)
        return ids, many

    def _long(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out, at = [], 0
        while at < len(raw):
            end = min(at + PIECE_BYTES, len(raw))
            while end < len(raw) and int(raw[end]) not in _WHITE:
                end += 1
            out.append(self._pieces(raw[at:end], np.array([0, end - at]))[0])
            at = end
        ids = np.concatenate(out)
        return ids, np.array([len(ids)])


@functools.cache
def word_encoder(path: str = DEFAULT_VOCABULARY) -> WordEncoder:
    """One encoder per worker process; executors read the installed vocabulary file."""
    return WordEncoder(path)
