"""Words of a text as 64-bit hashes, and hashes of runs of words, in numpy.

A word is a maximal run of bytes outside \\x20 and \\x09-\\x0D of the UTF-8 text. A word's hash depends only on its bytes. Short
words are hashed by a polynomial of random numbers for bytes; over hundreds of bytes words can be built that collide, so longer
words have a cryptographic hash. There are two such hashes, which share nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np

#: A text is hashed in pieces of about so many bytes, whatever its length.
PIECE = 1 << 20
#: Longer words (in bytes) are hashed one by one.
LONG_WORD = 64

_BASE, _RUN = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95  # odd, so they have inverses modulo 2^64
_BASES = (_BASE, 0xC2B2AE3D27D4EB4F)
_BYTES = [np.random.Generator(np.random.PCG64(seed)).integers(1, 2**64 - 1, 256, dtype=np.uint64) for seed in (20, 21)]
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    both = []
    for b in (base, pow(base, -1, 1 << 64)):
        x = np.full(n, b, dtype=np.uint64)
        x[0] = 1
        both.append(np.multiply.accumulate(x))
    return both[0], both[1]


_CACHE: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of base, and of its inverse, modulo 2^64."""
    if base not in _CACHE or len(_CACHE[base][0]) < n:
        _CACHE[base] = _powers(base, max(n, 1 << 15))
    return _CACHE[base]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of x over the result (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where words start and end."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = _IS_WORD[np.frombuffer(data, dtype=np.uint8)]
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """The first (which = 0) or the second hash of each word."""
    out = np.empty(len(starts), dtype=np.uint64)
    long_words = np.flatnonzero(ends - starts > LONG_WORD)
    for i in long_words:
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i]:ends[i]], digest_size=8, salt=bytes([which])).digest(), "little")
    edges = [-1, *long_words.tolist(), len(starts)]
    for i, j in ((a + 1, b) for a, b in zip(edges, edges[1:])):
        while i < j:
            k = max(i + 1, min(j, int(np.searchsorted(ends, starts[i] + PIECE, side="right"))))
            first, last = int(starts[i]), int(ends[k - 1])
            up, down = powers(_BASES[which], last - first + 1)
            total = np.zeros(last - first + 1, dtype=np.uint64)
            np.cumsum(_BYTES[which][np.frombuffer(data, dtype=np.uint8, count=last - first, offset=first)] * up[:last - first], out=total[1:])
            at, to = starts[i:k] - first, ends[i:k] - first
            out[i:k] = mix((total[to] - total[at]) * down[at] + (to - at).astype(np.uint64))
            i = k
    return out


def run_hashes(words: np.ndarray, width: int, base: int = _RUN) -> np.ndarray:
    """The hash of every run of `width` consecutive words, by its start; empty where there are fewer words."""
    n = len(words)
    if n < width:
        return np.empty(0, dtype=np.uint64)
    up, down = powers(base, n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(words * up[:n], out=total[1:])
    return mix((total[width:] - total[:n - width + 1]) * down[:n - width + 1] + np.uint64(width))


def text_words(text: str | None, lower: bool = False) -> np.ndarray:
    """The hashes of a text's words; none for null."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if lower:
        data = data.translate(LOWER)
    return word_hashes(data, *word_spans(data))
