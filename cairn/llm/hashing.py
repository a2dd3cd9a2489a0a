"""Vectorised 64-bit hashes of byte ranges and of word shingles, inside tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: A random number for each byte.
VALUE = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=8).digest(), "little") for b in range(256)], np.uint64)
_POWERS: dict[bool, np.ndarray] = {}
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """Powers 0..n-1 of the multiplier, or of its inverse, modulo 2**64."""
    have = _POWERS.get(inverse)
    if have is None or len(have) < n:
        base = np.full(max(n, 1 << 16), INVERSE if inverse else MULTIPLIER, np.uint64)
        base[0] = 1
        have = _POWERS[inverse] = np.cumprod(base)
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def prefixes(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums; differences of two, scaled, hash what lies between."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(VALUE[data] * powers(len(data)), out=out[1:])
    return out


def window_hashes(sums: np.ndarray, width: int, starts: np.ndarray | None = None) -> np.ndarray:
    """Hash of the ``width`` bytes at each start (at every one, if none are named)."""
    n = len(sums) - width
    if n <= 0:
        return np.zeros(0, np.uint64)
    if starts is None:
        return mixed((sums[width:] - sums[:n]) * powers(n, inverse=True))
    return mixed((sums[starts + width] - sums[starts]) * powers(len(sums), inverse=True)[starts])


def shingle_sets(texts: list[str], k: int, at_once: int = 1 << 21) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct hashes of its k-word shingles, A-Z lower-cased.

    Words are runs of anything but the blank and bytes 9 to 13. A text of 1 to k-1
    words has its whole sequence as one; a text without words has none. About
    ``at_once`` bytes are hashed together.
    """
    group: list[bytes] = []
    size = 0
    for text in texts:
        group.append((text or "").encode("utf-8", "surrogatepass").lower())
        size += len(group[-1])
        if size >= at_once:
            yield from _sets(group, k)
            group, size = [], 0
    if group:
        yield from _sets(group, k)


def _sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    blank = np.concatenate(([True], _BLANK[data], [True]))
    start = np.flatnonzero(blank[:-1] & ~blank[1:])
    end = np.flatnonzero(~blank[:-1] & blank[1:])
    sums = prefixes(data)
    word = mixed((sums[end] - sums[start]) * powers(len(sums), inverse=True)[start] + (end - start).astype(np.uint64))
    bounds = np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    n = max(len(word) - k + 1, 0)
    joint = np.zeros(n, np.uint64)
    for j in range(k):
        joint = mixed(joint * MULTIPLIER + word[j : j + n])
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(joint[a : b - k + 1])
        else:
            few = np.full(int(b > a), b - a, np.uint64)
            for w in word[a:b]:
                few = mixed(few * MULTIPLIER + w)
            yield few
