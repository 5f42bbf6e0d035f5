"""Hashes of words and word shingles, vectorised over the bytes of a text."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import numpy as np

_B = np.uint64(0x9E3779B97F4A7C15)
_BI = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_pow = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        m = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            for k, b in enumerate((_B, _BI)):
                p = np.full(m, b, np.uint64)
                p[0] = 1
                _pow[k] = np.multiply.accumulate(p)
    return _pow[0][:n], _pow[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def word_hashes(text: str) -> np.ndarray:
    """One 64-bit hash for each white-space separated word, A-Z taken as a-z."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    gap = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    up, down = _powers(len(raw) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)))
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's n-word shingles; a shorter text is one shingle; none without words."""
    words = word_hashes(text) if text else np.empty(0, np.uint64)
    if not len(words):
        return words
    k = min(n, len(words))
    out = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(3) + words[i : len(words) - k + 1 + i] + np.uint64(i + 1))
    return np.unique(out + np.uint64(k))


#: 64-bit words of the marks of a set.
MARKS = 8


def marks(s: np.ndarray) -> np.ndarray:
    """MARKS longs: for each value of the low bits of a set's hashes whether an odd number of them has it.

    The marks of two sets differ in no more places than the sets do, as those of the symmetric
    difference are the exclusive or of both.
    """
    odd = np.bincount((s.view(np.uint64) & np.uint64(MARKS * 64 - 1)).astype(np.int64), minlength=MARKS * 64) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


class Sets(Protocol):
    """How the set of a text is made, and two of them compared."""

    def of(self, text: str): ...

    def common(self, x, y) -> int: ...

    def difference(self, x, y) -> tuple[np.ndarray, np.ndarray]:
        """64-bit tokens of what y has and x lacks, and of what x has and y lacks."""
        ...


class _Hashed:
    """Sets as sorted arrays of 64-bit hashes: of n shingles two different ones collide with odds of about n * n / 2**65."""

    def common(self, x: np.ndarray, y: np.ndarray) -> int:
        both = np.concatenate((x, y))
        both.sort()
        return int(np.count_nonzero(both[1:] == both[:-1]))

    def difference(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.setdiff1d(y, x, assume_unique=True).view(np.int64), np.setdiff1d(x, y, assume_unique=True).view(np.int64)


@dataclass(frozen=True)
class WordShingles(_Hashed):
    """Word shingles: see shingle_hashes."""

    n: int

    def of(self, text: str | None) -> np.ndarray:
        return shingle_hashes(text, self.n)


@dataclass(frozen=True)
class CharShingles(_Hashed):
    """Distinct substrings of k characters; a shorter text is one shingle."""

    k: int

    def of(self, text: str) -> np.ndarray:
        h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        k = min(self.k, len(h))
        out, skip, width, bit = None, 0, 1, 1
        while bit <= k:  # the hash of k characters from hashes of 1, 2, 4 ... characters
            if k & bit:
                n = len(h) - skip if out is None else min(len(out), len(h) - skip)
                out = h[skip : skip + n] if out is None else out[:n] * np.uint64(pow(int(_B), width, 1 << 64)) + h[skip : skip + n]
                skip += bit
            if bit * 2 <= k:
                h = h[: len(h) - width] * np.uint64(pow(int(_B), width, 1 << 64)) + h[width:]
            width, bit = width * 2, bit * 2
        return np.unique(mix(out + np.uint64(k))) if k else np.zeros(1, np.uint64)

    def sizes(self, texts: list[str]) -> np.ndarray:
        """The number of shingles of each of up to 2**24 texts, by 40 bits of their hashes.

        Two shingles of one text can be taken for one, with odds of about n * n / 2**41: a size may be short by one.
        """
        k, lengths = self.k, np.fromiter(map(len, texts), np.int64, len(texts))
        if not len(texts):
            return lengths
        h = np.frombuffer("".join(t + "\0" * (k - 1) for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        out = h[: len(h) - k + 1].copy() if len(h) >= k else np.zeros(0, np.uint64)
        for i in range(1, k):
            out *= _B
            out += h[i : len(h) - k + 1 + i]
        counts = np.maximum(1, lengths - k + 1)
        starts = np.cumsum(lengths + k - 1) - (lengths + k - 1)
        owner = np.repeat(np.arange(len(texts)), counts)
        at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        key = mix(out[np.minimum(at, len(out) - 1)]) >> np.uint64(24) | owner.astype(np.uint64) << np.uint64(40) if len(out) else owner.astype(np.uint64) << np.uint64(40)
        key.sort()
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        return np.bincount((key[fresh] >> np.uint64(40)).astype(np.int64), minlength=len(texts))
