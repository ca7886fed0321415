"""Sets of word shingles as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

WIDTH = 5
#: Odd multipliers, one for each place in a shingle.
_PLACES = np.array([xxhash.xxh3_64_intdigest(b"place %d" % i) | 1 for i in range(WIDTH)], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values evenly (the finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles of ``WIDTH`` words of a text; with fewer words the whole sequence is the only one.

    Words are what stands between ASCII white space, with A-Z lower-cased: ``bytes.lower`` and ``bytes.split``.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < WIDTH:
        return np.array([xxhash.xxh3_64_intdigest(b"%d " % len(words) + b" ".join(words))], dtype=np.uint64)
    h = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), dtype=np.uint64)
    n = len(h) - WIDTH + 1
    total = h[:n] * _PLACES[0]
    for i in range(1, WIDTH):
        total += h[i : i + n] * _PLACES[i]
    return np.unique(mixed(total))
