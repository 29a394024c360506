"""Byte-level BPE by merge replay over the distinct words of a slice of the corpus."""

from __future__ import annotations

import base64
import heapq
import re
import unicodedata
from functools import lru_cache

import numpy as np

# The white space of the Unicode property White_Space, as ranges.
_SPACE = "\t-\r \x85\xa0" + "".join(map(chr, [0x1680, 0x2000, 0x2D, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
# The contractions that are words of their own.
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"


@lru_cache
def _class_of(kind: str) -> str:
    """The ranges of all characters whose general category begins with ``kind``."""
    out, start = [], None
    for c in range(0x110001):
        inside = c < 0x110000 and unicodedata.category(chr(c))[0] == kind
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}" if c - 1 > start else f"\\U{start:08x}")
            start = None
    return "".join(out)


def _pattern(letter: str, digit: str, space: str) -> re.Pattern:
    return re.compile(f"{_SHORT}| ?[{letter}]+| ?[{digit}]+| ?[^{space}{letter}{digit}]+|[{space}]+(?![^{space}])|[{space}]+")


_ASCII = _pattern("A-Za-z", "0-9", "\t-\r ")


@lru_cache
def _full() -> re.Pattern:
    return _pattern(_class_of("L"), _class_of("N"), _SPACE)


def words_of(text: str) -> list[str]:
    """The words within which merges take place."""
    return (_ASCII if text.isascii() else _full()).findall(text)


class MergeReplay:
    """All words seen so far with their ids.

    New words are encoded together. An inverted index leads from each merge (its rank) to the places of its pair in
    all of the words; merges are applied in rank order, each to all its places from left to right, and only the two
    neighbours of a place enter the index anew.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.rank_of_pair: dict[tuple[int, int], int] = {}
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = _Places()
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.int32)

    def _rank(self, a: int, b: int) -> int:
        r = self.rank_of_pair.get((a, b))
        if r is None:
            r = self.rank_of_pair[a, b] = self.ranks.get(self.bytes_of[a] + self.bytes_of[b], -1)
        return r

    def replay(self, words: list[str]) -> list[list[int]]:
        token: list[int] = []
        after: list[int] = []
        first = []
        single = self.single
        for w in words:
            first.append(len(token))
            token.extend(single[b] for b in w.encode())
            after.extend(range(len(after) + 1, len(token) + 1))
            after[-1] = -1
        before = [-1] * len(token)
        for i, j in enumerate(after):
            if j >= 0:
                before[j] = i
        index: dict[int, list[int]] = {}
        for i, j in enumerate(after):
            if j >= 0 and (r := self._rank(token[i], token[j])) >= 0:
                index.setdefault(r, []).append(i)
        heap = list(index)
        heapq.heapify(heap)
        rank = self._rank
        while heap:
            r = heapq.heappop(heap)
            for i in sorted(index.pop(r)):
                j = after[i]
                # The place may be gone or changed since it entered the index.
                if token[i] < 0 or j < 0 or rank(token[i], token[j]) != r:
                    continue
                k = after[j]
                token[i], token[j], after[i] = r, -1, k
                if k >= 0:
                    before[k] = i
                    if (n := rank(r, token[k])) >= 0:
                        if n not in index:
                            index[n] = []
                            heapq.heappush(heap, n)
                        index[n].append(i)
                h = before[i]
                if h >= 0 and (n := rank(token[h], r)) >= 0:
                    if n not in index:
                        index[n] = []
                        heapq.heappush(heap, n)
                    index[n].append(h)
        out = []
        for i in first:
            ids = []
            while i >= 0:
                ids.append(token[i])
                i = after[i]
            out.append(ids)
        return out

    def _learn(self) -> None:
        new = self.place.new
        if new:
            found = self.replay(new)
            lengths = np.fromiter(map(len, found), np.int32, len(found))
            starts = len(self.ids) + np.cumsum(lengths, dtype=np.int64) - lengths
            self.ids = np.concatenate([self.ids, np.fromiter((x for f in found for x in f), np.int32, int(lengths.sum()))])
            self.starts, self.lengths = np.concatenate([self.starts, starts]), np.concatenate([self.lengths, lengths])
            new.clear()

    def _places(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Of all texts the places of their words, and how many words each text has."""
        get, found = self.place.__getitem__, []
        for t in texts:
            words = words_of(t) if t else ()
            found.append(np.fromiter(map(get, words), np.int32, len(words)))
        self._learn()
        return (np.concatenate(found) if found else np.zeros(0, np.int32)), np.fromiter(map(len, found), np.int64, len(found))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets (one more than texts) and ids."""
        places, counts = self._places(texts)
        lengths = self.lengths[places].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        at = np.arange(ends[-1]) + np.repeat(self.starts[places] - ends[:-1], lengths)
        return ends[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32), self.ids[at]

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Number of ids of each text."""
        places, counts = self._places(texts)
        ends = np.concatenate([[0], np.cumsum(self.lengths[places], dtype=np.int64)])
        edges = np.concatenate([[0], np.cumsum(counts)])
        return ends[edges[1:]] - ends[edges[:-1]]


class _Places(dict):
    """From a word to its number; unknown words get the next and are noted in ``new``."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """A vocabulary file: one token in base64 and its rank a line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}


#: Words that a worker remembers; beyond, it starts anew. This bounds memory and changes no result.
REMEMBERED = 500_000
_known: dict[int, MergeReplay] = {}


def replayer(raw: bytes) -> MergeReplay:
    """This worker's replayer for a vocabulary; its words stay known from batch to batch and task to task."""
    m = _known.get(key := hash(raw))
    if m is None:
        m = _known[key] = MergeReplay(read_ranks(raw))
    elif len(m.place) > REMEMBERED:
        m.clear()
    return m
