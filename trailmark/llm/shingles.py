"""Word shingles of whole texts as sorted arrays of 64-bit hashes.

Words are maximal runs of bytes outside U+0020 and U+0009..U+000D, with A-Z
lower-cased. A set is all distinct runs of ``k`` words; a text of fewer words
has its whole sequence as one shingle; without words the set is empty. Two
shingles stand for the same words unless 64-bit hashes collide.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np

U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes hashed at once; blocks end at a space, so a longer word makes a longer block.
BLOCK = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of a 64-bit number over all bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=1)
def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    powers = np.cumprod(np.concatenate([[U(1)], np.full(n, base, dtype=U)]))
    back = np.cumprod(np.concatenate([[U(1)], np.full(n, inverse, dtype=U)]))
    return powers, back, mix(np.arange(1, 257, dtype=U) * U(0xD1B54A32D192ED03))


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words in a block of bytes."""
    space = np.concatenate([[True], _SPACE[raw], [True]])
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[::2], edge[1::2]
    n = 1 << max(int(raw.size).bit_length(), 18)
    powers, back, values = _tables(n)
    sums = np.concatenate([[U(0)], np.cumsum(values[raw] * powers[: raw.size])])
    return start, mix((sums[end] - sums[start]) * back[start] + (end - start).astype(U))


def word_hashes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and where each text's words begin."""
    raws = [t.encode().lower() for t in texts]
    raw = np.frombuffer(b" ".join([*raws, b""]), dtype=np.uint8)
    text_starts = np.cumsum([0, *(len(r) + 1 for r in raws)])
    starts, hashes, at = [], [], 0
    while at < raw.size:
        end = min(raw.size, at + BLOCK)
        if end < raw.size:
            gaps = np.flatnonzero(_SPACE[raw[end : end + (1 << 12)]])
            while not len(gaps):
                end = min(raw.size, end + (1 << 12))
                gaps = np.flatnonzero(_SPACE[raw[end : end + (1 << 12)]]) if end < raw.size else np.array([0])
            end = min(raw.size, end + int(gaps[0]))
        s, h = _words(raw[at:end])
        starts.append(s + at)
        hashes.append(h)
        at = end
    start = np.concatenate(starts) if starts else np.array([], dtype=np.int64)
    return np.concatenate(hashes) if hashes else np.array([], dtype=U), np.searchsorted(start, text_starts)


def shingle_sets(texts: Sequence[str], k: int) -> list[np.ndarray]:
    """For each text its sorted distinct shingle hashes."""
    words, bounds = word_hashes(texts)
    rolled = words
    with np.errstate(over="ignore"):
        for j in range(1, k):
            rolled = mix(rolled[: max(0, len(words) - j)] * U(0x9FB21C651E98DF25) + words[j:])
        out = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= k:
                found = np.sort(rolled[a : b - k + 1])
                out.append(found[np.concatenate([[True], found[1:] != found[:-1]])])
            elif b > a:
                h = U(b - a)
                for w in words[a:b]:
                    h = mix(np.array([h * U(0x9FB21C651E98DF25) + w + U(1)], dtype=U))[0]
                out.append(np.array([h], dtype=U))
            else:
                out.append(np.array([], dtype=U))
    return out


def fingerprint(shingles: np.ndarray) -> int:
    """A signed 64-bit number for a set: equal sets, equal numbers."""
    with np.errstate(over="ignore"):
        total = mix(shingles + U(0x632BE59BD9B4E019)).sum(dtype=U) + U(len(shingles))
        return int(mix(np.array([total], dtype=U)).view(np.int64)[0])
