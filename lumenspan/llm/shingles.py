"""Distinct word shingles of texts as 64-bit hashes, computed on whole batches with NumPy.

Letters A-Z are lower-cased, words are maximal runs without white space, and a shingle
is five words in a row; a text of one to four words has one shingle, all its words.
Equal shingles have equal hashes; two different ones of a pair of texts agree with a
chance near 2**-64.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
CHUNK = 1 << 20

_random = np.random.default_rng(20240101)
_BYTES = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _random.integers(1, 1 << 63, WORDS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_random.integers(1, 1 << 62)) * 2 + 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES = _BYTES[_LOWER]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, CHUNK + 2), _powers(_INVERSE, CHUNK + 2)


def _chunk_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word."""
    up, down = (_UP, _DOWN) if len(raw) < CHUNK + 2 else (_powers(_BASE, len(raw) + 1), _powers(_INVERSE, len(raw) + 1))
    space = np.ones(len(raw) + 2, dtype=bool)
    space[1:-1] = _SPACE[raw]
    starts = np.flatnonzero(space[:-1] & ~space[1:])[: len(raw)]
    ends = np.flatnonzero(~space[:-1] & space[1:])
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[raw] * up[: len(raw)], out=sums[1:])
    return starts, mix((sums[ends] - sums[starts]) * down[starts])


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for text of any length, in chunks that end at white space."""
    starts, hashes, at = [], [], 0
    while at < len(raw):
        end = min(at + CHUNK, len(raw))
        if end < len(raw):
            cuts = np.flatnonzero(_SPACE[raw[at:end]])
            if len(cuts):
                end = at + int(cuts[-1]) + 1
            else:  # one word fills the chunk: take it whole
                more = np.flatnonzero(_SPACE[raw[end:]])
                end = end + int(more[0]) + 1 if len(more) else len(raw)
        s, h = _chunk_words(raw[at:end])
        starts.append(s + at)
        hashes.append(h)
        at = end
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """For every text its sorted distinct shingle hashes; empty without words."""
    coded = [(t or "").encode("utf-8") for t in texts]
    ends = np.cumsum([len(c) + 1 for c in coded])
    starts, words = word_hashes(np.frombuffer(b" ".join(coded), dtype=np.uint8))
    bounds = np.concatenate(([0], np.searchsorted(starts, ends)))
    long = np.zeros(0, dtype=np.uint64)
    if len(words) >= WORDS:
        n = len(words) - WORDS + 1
        long = words[:n] * _PLACES[0]
        for k in range(1, WORDS):
            long += words[k : k + n] * _PLACES[k]
        long = mix(long)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= WORDS:
            s = np.sort(long[a : b - WORDS + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            whole = (words[a:b] * _PLACES[: b - a]).sum(dtype=np.uint64, keepdims=True)
            out.append(mix(whole + _PLACES[WORDS:] * np.array([b - a], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
