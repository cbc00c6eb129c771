"""Words and word n-grams of whole batches as 64-bit hashes, in numpy.

A word is a run of characters other than ASCII punctuation, white space and control characters; A-Z count
as a-z. All other characters are bytes above 0x7F in UTF-8, so words are found in the bytes themselves.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gramloom.llm.tables import PIECE_BYTES

_BASE = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit value over all others (a fixed bijection)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(n, base, dtype=np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def _cut(data: np.ndarray, lo: int) -> int:
    """End of the next piece of `data`: not inside a word."""
    hi = lo + PIECE_BYTES
    while hi < len(data):
        ahead = np.flatnonzero(~_IS_WORD[_LOWER[data[hi:hi + 65536]]])
        if len(ahead):
            return hi + int(ahead[0])
        hi += 65536
    return len(data)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, index of every text's first word and the number of words); null has no words."""
    ended = pc.binary_join_element_wise(pc.fill_null(column, ""), "", "\n")
    begins = np.frombuffer(ended.buffers()[1], dtype=np.int32, count=len(ended) + 1).astype(np.int64)
    data = np.frombuffer(ended.buffers()[2], dtype=np.uint8, count=int(begins[-1]))
    hashes, starts, lo = [], [], 0
    while lo < len(data):
        hi = _cut(data, lo)
        low = _LOWER[data[lo:hi]]
        edges = np.flatnonzero(np.diff(_IS_WORD[low].view(np.int8), prepend=0, append=0))
        first, end = edges[0::2], edges[1::2]
        size = max(PIECE_BYTES, 1 << (hi - lo - 1).bit_length())
        up, down = _powers(size)
        sums = np.zeros(len(low) + 1, dtype=np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:len(low)], out=sums[1:])
        hashes.append(mix((sums[end] - sums[first]) * down[first]))
        starts.append(first + lo)
        lo = hi
    starts_ = np.concatenate(starts) if starts else np.zeros(0, dtype=np.int64)
    words = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
    return words, np.searchsorted(starts_, begins)


def ngrams(words: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of the k words from each position on, text borders ignored; seeds and lengths give unlike hashes."""
    n = max(len(words) - k + 1, 0)
    factors = mix(np.arange(1, k + 1, dtype=np.uint64) + np.uint64((seed * 1000 + k) << 20)) | np.uint64(1)
    out = np.full(n, np.uint64(k))
    for j in range(k):
        out += words[j:j + n] * factors[j]
    return mix(out)


def whole(offsets: np.ndarray, k: int) -> np.ndarray:
    """Positions at which k words of one text begin."""
    n = max(int(offsets[-1]) - k + 1, 0)
    ok = np.ones(n, dtype=bool)
    for j in range(1, k):  # no start in the last k - 1 words of a text
        at = offsets[1:-1] - j
        ok[at[(at >= 0) & (at < n)]] = False
    return np.flatnonzero(ok)
