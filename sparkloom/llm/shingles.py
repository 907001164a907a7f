"""Word shingles of whole batches of texts, as 64-bit hashes, without a Python loop over words.

A word is a maximal run of bytes that are ASCII letters or digits or belong to a non-ASCII
character; texts are lower-cased before. The hash of a word is a polynomial in its bytes,
read off running sums; a shingle's hash mixes those of its words in order.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits depend on all input bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, b in enumerate((_BASE, _INV)):
            p = np.full(max(n, 1 << 16), b, np.uint64)
            p[0] = 1
            _POWERS[i] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each text. A null text has none."""
    raw = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    buf = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    ends = np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))
    inside = _WORD[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    start, stop = edge[::2], edge[1::2]
    up, down = _powers(len(buf) + 1)
    run = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=run[1:])
    h = mix((run[stop] - run[start]) * down[start] + (stop - start).astype(np.uint64))
    return h, np.diff(np.searchsorted(start, np.concatenate(([0], ends))))


def weighted_shingles(texts: list[str], k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, weight, text number) of each distinct shingle of each text, by text then hash.

    The weight is how often the text has the shingle. A text of fewer than ``k`` words has one
    shingle, all its words; a text without words has none.
    """
    h, n = word_hashes(texts)
    first = np.cumsum(n) - n
    m = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    doc = np.repeat(np.arange(len(n)), m)
    at = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m) + first[doc]
    length = np.minimum(n, k)[doc]
    out = np.full(len(at), np.uint64(0x51ED270B), np.uint64) + length.astype(np.uint64)
    padded = np.concatenate((h, np.zeros(k, np.uint64)))
    for i in range(k):
        nxt = mix(out * np.uint64(0x9E3779B97F4A7C15) + padded[at + i])
        out = np.where(i < length, nxt, out)
    order = np.lexsort((out, doc))
    out, doc = out[order], doc[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    where = np.flatnonzero(new)
    return out[where], np.diff(np.append(where, len(out))), doc[where]
