"""Words of a text as 64-bit hashes, for Python tasks."""

from __future__ import annotations

import numpy as np
import xxhash

P1, P2, P3 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def word_list(text: str | None) -> list[bytes]:
    """The words, A-Z lower-cased. bytes.lower and bytes.split know exactly
    the letters A-Z and the white space \\x20, \\x09-\\x0D."""
    return text.encode().lower().split() if text else []


def word_hashes(text: str | None) -> np.ndarray:
    found = word_list(text)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * P1
    x = x ^ (x >> np.uint64(29))
    x = x * P2
    return x ^ (x >> np.uint64(32))


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``n`` words; with fewer words,
    of the whole run."""
    if not len(h):
        return h
    n = min(n, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = mix(out * P3 + h[k:len(h) - n + 1 + k])
    return np.unique(mix(out + np.uint64(n)))
