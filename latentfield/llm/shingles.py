"""Word shingles as 64-bit numbers, computed for whole batches of texts in numpy, and min-hash bands of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import by_size

BASE = 0x9E3779B97F4A7C15 | 1
M64 = (1 << 64) - 1
BLOCK = 1 << 20
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i up to n."""
    if not _POWERS or len(_POWERS[0]) <= n:
        size = max(n + 1, 2 * BLOCK)
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, b, np.uint64)])) for b in (BASE, pow(BASE, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of data: a polynomial over its bytes, from running sums, then mixed."""
    raw = np.frombuffer(data, np.uint8)
    inside = np.concatenate([[False], ~IS_SPACE[raw], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    p, inverse = powers(len(raw))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * p[: len(raw)], dtype=np.uint64)])
    return start, mixed((sums[end] - sums[start]) * inverse[start])


def pieces(data: bytes) -> Iterator[bytes]:
    """data cut after white space into parts of about BLOCK bytes, so that a huge text needs no huge arrays."""
    at = 0
    while len(data) - at > 2 * BLOCK:
        cut = next((i for i in range(at + BLOCK, len(data)) if IS_SPACE[data[i]]), len(data) - 1) + 1
        yield data[at:cut]
        at = cut
    yield data[at:]


def text_words(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """Index of each text and the hashes of its words, in order."""
    for part in by_size(range(len(texts)), lambda i: len(texts[i]) + 1, BLOCK):
        if len(part) == 1 and len(texts[part[0]]) > 2 * BLOCK:
            yield part[0], np.concatenate([word_hashes(x)[1] for x in pieces(texts[part[0]])])
            continue
        start, h = word_hashes(b"\n".join(texts[i] for i in part))
        begins = np.cumsum([0] + [len(texts[i]) + 1 for i in part[:-1]])
        cuts = np.searchsorted(start, begins).tolist() + [len(start)]
        for k, i in enumerate(part):
            yield i, h[cuts[k] : cuts[k + 1]]


def shingle_set(words: np.ndarray, width: int = 5) -> np.ndarray:
    """The distinct shingles of a word sequence, sorted; one for a sequence shorter than width, none for an empty one."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    k = np.uint64(0xD6E8FEB86659FD93)
    if n < width:
        h = np.uint64(n)
        with np.errstate(over="ignore"):
            for w in words:
                h = h * k + w
        return mixed(np.array([h], np.uint64))
    h = np.full(n - width + 1, np.uint64(width))
    for i in range(width):
        h = h * k + words[i : n - width + 1 + i]
    h = mixed(h)
    h.sort()
    return h[np.append(True, h[1:] != h[:-1])]


class Bands:
    """Keys of `bands` groups of `rows` min-hashes each: two sets share a key with probability J**rows."""

    def __init__(self, bands: int, rows: int, seed: int = 9):
        n = bands * rows
        self.bands, self.rows = bands, rows
        self.a = mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)
        self.b = mixed(self.a)

    def keys(self, s: np.ndarray) -> np.ndarray:
        least = np.full(len(self.a), np.uint64(M64))
        for i in range(0, len(s), 1024):
            x = s[i : i + 1024, None] ^ self.b[None, :]
            x *= self.a[None, :]
            np.minimum(least, x.min(axis=0), out=least)
        k = np.arange(self.bands, dtype=np.uint64)
        for r in least.reshape(self.bands, self.rows).T:
            k = mixed(k * np.uint64(0xD6E8FEB86659FD93) + mixed(r))
        return k.view(np.int64)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def linked(n_a: int, n_b: int, common: int, percent: int = 80) -> bool:
    """100 * intersection >= percent * union."""
    return n_a > 0 and n_b > 0 and 100 * common >= percent * (n_a + n_b - common)
