"""Words, word hashes and windows of many texts at once, vectorised over their UTF-8 bytes.

A word is a longest run without U+0020 and U+0009 to U+000D. All hashes are 64 bits wide and the
same on every machine; equal hashes are taken as equal words or windows. A range of bytes or words is
hashed by a tree of mixed pairs, never by a polynomial, which has known strings of equal hashes.
A text costs some 20 bytes of memory for each of its bytes while it is taken; nothing is kept.
"""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed bijection that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: What each byte counts as: itself, with A-Z lower-cased, and so with digits alike.
EXACT = np.arange(256, dtype=np.uint8)
LOWER = EXACT.copy()
LOWER[65:91] = EXACT[97:123]
FOLDED = LOWER.copy()
FOLDED[48:58] = EXACT[48]


def powers(n: int) -> np.ndarray:
    """BASE**i for i up to n, modulo 2**64."""
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, BASE))])


def _spread(starts: np.ndarray, sizes: np.ndarray, step: int = 1) -> np.ndarray:
    """starts[g] + step * j for every j below sizes[g], group after group."""
    ends = np.cumsum(sizes)
    out = np.arange(int(ends[-1]) if len(ends) else 0)
    if step > 1:
        out *= step
    return out + np.repeat(starts - step * (ends - sizes), sizes)


def folded(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One hash for each group of consecutive hashes: neighbours are mixed in pairs until one is left, then with the group's size."""
    at = np.cumsum(sizes) - sizes
    out = np.zeros(len(sizes), np.uint64)
    one = sizes == 1
    out[one] = h[at[one]]
    live = np.flatnonzero(sizes > 1)
    h, n = h[_spread(at[live], sizes[live])], sizes[live]
    while len(live):
        at, half = np.cumsum(n) - n, (n + 1) // 2
        left = _spread(at, half, 2)
        pair = left + 1 < np.repeat(at + n, half)
        up = h[left]
        up[pair] = mixed(up[pair] * BASE + mixed(h[left[pair] + 1] + BASE))
        done = half == 1
        first = np.cumsum(half) - half
        out[live[done]] = up[first[done]]
        more = ~done
        h, live, n = up[_spread(first[more], half[more])] if done.any() else up, live[more], half[more]
    return mixed(out ^ (sizes.astype(np.uint64) * BASE))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash for each range of bytes, by its content alone."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))  # the eight bytes from each place on
    sizes = ends - starts
    chunks = np.maximum((sizes + 7) // 8, 1)
    value = eight[_spread(starts, chunks, 8)]
    last = np.cumsum(chunks) - 1  # bytes behind the end don't count
    value[last] &= _LOW[sizes - 8 * (chunks - 1)]
    return mixed(folded(mixed(value + BASE), chunks) ^ sizes.astype(np.uint64))


_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and text number of every word; no word crosses texts."""
    n = len(buf)
    word = np.zeros(n + 2, bool)
    np.logical_not(SPACE[buf], out=word[1:-1])
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    inside = word[1:]  # inside[i]: byte i belongs to a word
    before = word[:-1]
    starts = np.flatnonzero(inside[:n] & (~before[:n] | cut[:n]))
    ends = np.flatnonzero(before[1:] & (~inside[1:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def windows(hashes: np.ndarray, text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every k-word window inside one text, and the number of its first word."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up = powers(k)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += hashes[j : j + n] * up[j]
    first = np.flatnonzero(text[:n] == text[k - 1 :])
    return mixed(total[first]), first


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each text's bytes."""
    out = np.zeros(len(offsets) - 1, np.int64)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        out[some] = np.add.reduceat(flags, offsets[some], dtype=np.int64)
    return out
