"""Words and word shingles of whole Arrow batches as hashes, computed with numpy on the code points.

A word is a longest run of letters and digits. Its hash is a polynomial in its code points (each first spread over 64
bits), taken for all words of a batch at once from one running sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

#: Characters handled at once; it only bounds memory.
CHARS_AT_ONCE = 1_000_000

_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads sums of products over all bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * _A
        h = (h ^ (h >> np.uint64(27))) * _B
        return h ^ (h >> np.uint64(31))


@cache
def _alnum() -> np.ndarray:
    return np.fromiter((chr(o).isalnum() for o in range(0x110000)), bool, 0x110000)


@cache
def _spread() -> np.ndarray:
    return mixed(np.arange(1, 0x110001, dtype=np.uint64))


_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, n.bit_length())
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps, dtype=np.uint64))
        _powers[:] = made
    return _powers[0][:n], _powers[1][:n]


def chunks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about ``CHARS_AT_ONCE`` characters each."""
    lo = total = 0
    for i, s in enumerate(sizes):
        if total and total + s > CHARS_AT_ONCE:
            yield lo, i
            lo, total = i, 0
        total += s
    if lo < len(sizes):
        yield lo, len(sizes)


def spans(texts: list[str], fold: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points, where each word starts, where it has ended, its hash, where each text has ended).

    The texts lie in one array with a zero after each. ``fold``: a table that maps each code point to the one it is
    compared as.
    """
    cp = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    if fold is not None:
        cp = fold[cp]
    inside = _alnum()[cp]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate([[0], edge])
    first, past = edge[0::2], edge[1::2]  # the last character is a separator, so every word has an end
    power, inverse = _power(len(cp))
    with np.errstate(over="ignore"):
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_spread()[cp] * power, dtype=np.uint64)])
        h = mixed((running[past] - running[first]) * inverse[first])
    return cp, first, past, h, ends


def words(texts: list[str], fold: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and where each text starts (n + 1)."""
    if not texts:
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    _, first, _, h, ends = spans(texts, fold)
    return h, np.concatenate([[0], np.searchsorted(first, ends)])


def grams(h: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's sequences of k words in order, and where each text starts (n + 1)."""
    sizes = np.maximum(np.diff(starts) - k + 1, 0)
    out = np.concatenate([[0], np.cumsum(sizes)])
    if len(h) < k:
        return np.empty(0, np.uint64), out
    with np.errstate(over="ignore"):
        g = h[: len(h) - k + 1].copy()
        for j in range(1, k):
            g = g * np.uint64(_BASE) + h[j : len(h) - k + 1 + j]
            g ^= g >> np.uint64(29)
    at = np.arange(out[-1]) + np.repeat(starts[:-1] - out[:-1], sizes)
    return mixed(g[at]), out


def by_text(key: np.ndarray, text: np.ndarray, texts: int, tie: np.ndarray | None = None) -> np.ndarray:
    """The order by text and, within one, by key and then by ``tie``; without ``tie`` equal keys come in any order."""
    order = np.argsort(key)
    order = order[np.argsort(text[order].astype(np.uint16 if texts <= 1 << 16 else np.uint32), kind="stable")]
    if tie is not None and len(key) and ((key[order[1:]] == key[order[:-1]]) & (text[order[1:]] == text[order[:-1]])).any():
        return np.lexsort((tie, key, text))
    return order


def shingle_sets(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles of k words as ascending 64-bit hashes, and where each text starts (n + 1)."""
    h, starts = words(texts)
    g, at = grams(h, starts, k)
    text = np.repeat(np.arange(len(texts)), np.diff(at))
    order = by_text(g, text, len(texts))
    g, text = g[order], text[order]
    if len(g):
        keep = np.concatenate([[True], (g[1:] != g[:-1]) | (text[1:] != text[:-1])])
        g, text = g[keep], text[keep]
    return g, np.searchsorted(text, np.arange(len(texts) + 1))
