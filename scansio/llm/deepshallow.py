"""Deep-shallow sorting of short byte strings inside groups.

Shallow: multikey quicksort, all groups at once, eight bytes a character, so
that a round splits every group by its next eight bytes; strings that stand
alone take no further part.  Deep: what still shares a prefix of the shallow
depth is ordered by a blind trie, which holds only the depths and bytes at which
strings part, and compares whole strings once for each string put in.
"""

from __future__ import annotations

import numpy as np


def blind_trie_order(strings: list[bytes]) -> list[int]:
    """Positions of equally long strings in their order; equal ones in the given order."""
    same: dict[bytes, list[int]] = {}
    for k, s in enumerate(strings):
        same.setdefault(s, []).append(k)
    bits = 8 * len(strings[0])
    # a leaf is its string, an inner node [depth, {byte: child}]
    root: bytes | list | None = None
    for s in same:
        if root is None:
            root = s
            continue
        node = root
        while node.__class__ is list:
            children = node[1]
            node = children.get(s[node[0]]) or next(iter(children.values()))
        different = int.from_bytes(s) ^ int.from_bytes(node)
        shared = (bits - different.bit_length()) // 8
        parent, below = None, root
        while below.__class__ is list and below[0] < shared:
            parent, below = below, below[1][s[below[0]]]
        if below.__class__ is list and below[0] == shared:
            below[1][s[shared]] = s
            continue
        inner = [shared, {node[shared]: below, s[shared]: s}]
        if parent is None:
            root = inner
        else:
            parent[1][s[parent[0]]] = inner
    order: list[int] = []
    todo = [root]
    while todo:
        node = todo.pop()
        if node.__class__ is list:
            todo += [node[1][b] for b in sorted(node[1], reverse=True)]
        else:
            order += same[node]
    return order


def sort_strings(group: np.ndarray, rows: np.ndarray, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of ``rows`` (bytes, a multiple of eight wide) inside ascending ``group``, and shared prefixes.

    The second array holds how many bytes a row of the order shares with the one
    before it, and -1 for the first of a group.
    """
    n = len(rows)
    letters = rows.view(">u8").astype(np.uint64)
    order, part = np.arange(n), np.asarray(group)
    for k in range(min(shallow // 8, letters.shape[1])):
        edge = np.concatenate(([True], part[1:] != part[:-1], [True]))
        live = np.flatnonzero(~(edge[:-1] & edge[1:]))
        if not len(live):
            break
        rows_ = order[live]
        order[live] = rows_[np.lexsort((letters[rows_, k], part[live]))]
        letter = letters[order, k]
        new = np.concatenate(([True], (part[1:] != part[:-1]) | (letter[1:] != letter[:-1])))
        part = np.cumsum(new)
    edges = np.append(np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))), n)
    width = rows.shape[1]
    for e in np.flatnonzero(np.diff(edges) > 1):
        low, high = edges[e], edges[e + 1]
        members = order[low:high]
        raw = rows[members].tobytes()
        found = blind_trie_order([raw[i:i + width] for i in range(0, len(raw), width)])
        order[low:high] = members[found]
    return order, shared_prefixes(np.asarray(group)[order], letters[order])


def shared_prefixes(group: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the one before; -1 where a group begins."""
    n, words = letters.shape
    shared = np.full(n, -1, np.int64)
    if n < 2:
        return shared
    different = letters[1:] ^ letters[:-1]
    unequal = different != 0
    word = np.where(unequal.any(1), unequal.argmax(1), words)
    value = different[np.arange(n - 1), np.minimum(word, words - 1)]
    byte = np.zeros(n - 1, np.int64)
    for k in range(1, 8):
        byte += (value >> np.uint64(64 - 8 * k)) == 0
    total = 8 * word + np.where(word < words, byte, 0)
    shared[1:] = np.where(group[1:] == group[:-1], total, -1)
    return shared
