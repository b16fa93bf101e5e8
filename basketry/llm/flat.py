"""Word and shingle hashes of many texts at once, on one flat byte array.

Words are maximal runs of bytes other than space and 0x09-0x0D, letters A-Z
lower-cased.  A word's hash is a polynomial over its bytes modulo 2**64, read
off prefix sums (the base is odd, so its powers have inverses), then mixed.
"""

from __future__ import annotations

import functools

import numpy as np

_U = np.uint64
#: Odd base of the polynomial and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser: spreads every input bit over the 64 output bits."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


@functools.cache
def _letters() -> np.ndarray:
    table = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))
    table[ord("A") : ord("Z") + 1] = table[ord("a") : ord("z") + 1]
    return table


_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse (kept for the next call)."""
    if len(_powers[0]) < n:
        for i, b in enumerate((_BASE, _INVERSE)):
            p = np.full(n, b & (2**64 - 1), _U)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def prefix_sums(data: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """P with (P[e] - P[s]) * inverse**s = polynomial hash of bytes s..e-1."""
    p = np.zeros(len(data) + 1, _U)
    np.cumsum(letters[data] * powers(max(len(data), 1))[0][: len(data)], out=p[1:])
    return p


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word, in order."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~_SEP[data]
    first = np.zeros(n + 1, bool)
    first[off] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    before &= ~first[:n]
    starts = np.flatnonzero(word & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    after &= ~first[1:]
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and text number of every word."""
    starts, ends, doc = word_bounds(data, off)
    p = prefix_sums(data, _letters())
    inv = powers(max(len(data), 1))[1]
    return mix((p[ends] - p[starts]) * inv[starts] if len(starts) else np.zeros(0, _U)), doc


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its k-word shingles.

    A text of fewer than k words (but one) has its whole word sequence as its
    only shingle; a text without words has none.
    """
    h, doc = word_hashes(data, off)
    n_docs = len(off) - 1
    # the i-th word of a shingle is weighted, so order counts
    weights = mix(np.arange(11, 11 + k, dtype=_U))  | _U(1)
    m = max(len(h) - k + 1, 0)
    sh = np.zeros(m, _U)
    for i in range(k):
        sh += h[i : i + m] * weights[i]
    sh = mix(sh)
    same = doc[:m] == doc[k - 1 : k - 1 + m] if m else np.zeros(0, bool)
    sh, owner = sh[same], doc[:m][same]
    bounds = np.searchsorted(owner, np.arange(n_docs + 1))
    words = np.searchsorted(doc, np.arange(n_docs + 1))
    out = []
    for d in range(n_docs):
        a, b = bounds[d], bounds[d + 1]
        if a < b:
            x = np.sort(sh[a:b])
            keep = np.empty(len(x), bool)
            keep[0] = True
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            out.append(x[keep])
        else:
            u, v = words[d], words[d + 1]
            whole = np.zeros(1 if u < v else 0, _U)
            for i in range(u, v):
                whole += h[i : i + 1] * weights[i - u]
            out.append(mix(whole + _U(int(v - u))))
    return out
