"""Byte-level BPE ids from a public rank file.

The rank file holds the vocabulary of byte_bpe_50k.json; the ids equal those of that file (tests compare them). Texts are
first split at the added tokens that the JSON file lists, each of which has one id. Long texts are cut before white space
that follows another character, where the split pattern always starts a new piece, so memory stays bounded and ids do
not change.
"""

from __future__ import annotations

import base64
import functools
import json
import re
from typing import Iterator

import numpy as np
import public_tokenizers

DEFAULT_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
DEFAULT_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
CUT_CHARS = 200_000
_EDGE = re.compile(r"(?<=\S)(?=\s)")


class Encoder:
    def __init__(self, path: str, vocabulary: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        with open(vocabulary, encoding="utf-8") as f:
            self._added = {t["content"]: int(t["id"]) for t in json.load(f)["added_tokens"]}
        longest_first = sorted(map(re.escape, self._added), key=len, reverse=True)
        self._split = re.compile(f"({'|'.join(longest_first)})") if longest_first else None

    def pieces(self, text: str, chars: int = CUT_CHARS) -> Iterator[list[int]]:
        for i, part in enumerate(self._split.split(text) if self._split else [text]):
            if i % 2:
                yield [self._added[part]]
            else:
                yield from self._ordinary(part, chars)

    def _ordinary(self, text: str, chars: int) -> Iterator[list[int]]:
        start = 0
        while len(text) - start > chars:
            edge = _EDGE.search(text, start + chars)
            if not edge:
                break
            yield self._bpe.encode_ordinary(text[start : edge.start()])
            start = edge.start()
        yield self._bpe.encode_ordinary(text[start:] if start else text)

    def ids(self, text: str, chars: int = CUT_CHARS) -> np.ndarray:
        parts = [np.array(p, dtype=np.uint32) for p in self.pieces(text, chars)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def count(self, text: str) -> int:
        return sum(map(len, self.pieces(text)))


@functools.cache
def encoder(path: str = DEFAULT_RANKS, vocabulary: str = DEFAULT_VOCABULARY) -> Encoder:
    """One encoder per worker process; executors read the installed vocabulary files."""
    return Encoder(path, vocabulary)
