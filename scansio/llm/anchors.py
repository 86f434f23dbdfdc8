"""Anchors: places of a text that depend on the bytes around them alone.

Every window of ``width`` bytes has one anchor, the ``gram`` bytes inside it
whose hash is smallest (the leftmost of equals).  Equal windows have the same
anchor at the same place, so equal strings of ``width`` bytes can be looked for
among equal anchors only; about one byte in ``(width - gram) / 2`` is an anchor.
"""

from __future__ import annotations

import numpy as np

P = np.uint64(0x9E3779B97F4A7C15)
Q = np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers so that every bit depends on every other."""
    x = (x ^ (x >> np.uint64(32))) * Q
    x = (x ^ (x >> np.uint64(29))) * P
    return x ^ (x >> np.uint64(32))


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A polynomial hash of the ``gram`` bytes at each place, by doubling."""
    hashed = raw.astype(np.uint64) + np.uint64(1)
    out, done, power = None, 0, P
    size = 1
    while True:
        if gram & size:
            if out is None:
                out, done = hashed, size
            else:
                # the bytes so far, then ``size`` more
                tail = hashed[done:]
                out = out[:len(tail)] * power + tail
                done += size
        if done == gram:
            return out[:len(raw) - gram + 1]
        hashed = hashed[:-size] * power + hashed[size:]
        power = np.uint64(int(power) ** 2 & (1 << 64) - 1)
        size *= 2


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring values."""
    size, low = 1, values
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    return np.minimum(low[:len(values) - width + 1], low[width - size:])


def prefix_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every prefix and the powers to take the hash of any part from them."""
    powers = np.empty(len(raw) + 1, np.uint64)
    powers[0] = 1
    powers[1:] = Q
    powers = np.multiply.accumulate(powers)
    # letters are spread first: the polynomial then runs over random 64-bit numbers
    letters = mixed(np.arange(1, 257, dtype=np.uint64))[raw]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(letters * powers[:-1], dtype=np.uint64)))
    return sums, powers


def inverse_powers(n: int) -> np.ndarray:
    inverse = pow(int(Q), -1, 1 << 64)
    powers = np.empty(n + 1, np.uint64)
    powers[0] = 1
    powers[1:] = np.uint64(inverse)
    return np.multiply.accumulate(powers)


def anchors(raw: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """For each run of windows with one anchor: the anchor's place and hash, first and last window, content hash.

    The content hash covers the bytes from the first window's start to the last
    window's end, and where in them the anchor lies.
    """
    windows = len(raw) - width + 1
    if windows < 1:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    hashes = mixed(gram_hashes(raw, gram))
    # the place below the hash: the least value names its place, the leftmost of equals
    order = np.arange(len(hashes), dtype=np.uint64)
    low = sliding_min((hashes & np.uint64(0xFFFFFFFF00000000)) | order, width - gram + 1)
    place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    last = np.append(first[1:], windows) - 1
    place = place[first]
    sums, _ = prefix_hashes(raw)
    content = (sums[last + width] - sums[first]) * inverse_powers(len(raw))[first]
    content = mixed(content + mixed(((last - first) * 256 + place - first).astype(np.uint64)))
    return place, hashes[place].astype(np.int64), first, last, content.astype(np.int64)
