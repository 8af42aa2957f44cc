"""Deep-shallow sorting of fixed-length strings in groups, with longest common prefixes.

Shallow: multikey quicksort steps on eight bytes at a time, over all groups at
once, down to ``SHALLOW`` words. Deep: what is still tied after that has a long
common prefix; each such group is ordered by a blind trie, which looks at one
byte for each branch and compares whole strings once for each insertion.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 4


def words(strings: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of big-endian 64-bit words, zeros at the end."""
    n, length = strings.shape
    padded = np.zeros((n, -(-length // 8) * 8), np.uint8)
    padded[:, :length] = strings
    return padded.view(">u8").astype(np.uint64)


def _common_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal leading bytes of two different words."""
    x = a ^ b
    out = np.zeros(len(x), np.int64)
    for shift in (56, 48, 40, 32, 24, 16, 8):
        out += (x >> np.uint64(shift)) == 0
    return out


class BlindTrie:
    """Strings of one length in a trie of branching depths; equal strings share a leaf."""

    def __init__(self, first: bytes, number: int):
        self.root: list = [None, first, [number]]  # leaf: None, string, numbers; node: depth, children

    def insert(self, s: bytes, number: int) -> None:
        node = self.root
        while node[0] is not None:  # blind: follow the branching bytes, or any child where there is none
            children = node[1]
            node = children.get(s[node[0]]) or next(iter(children.values()))
        other = node[1]
        if other == s:
            node[2].append(number)
            return
        low, high = 0, len(s)  # the common prefix by halving
        while low < high:
            middle = (low + high + 1) // 2
            if s[low:middle] == other[low:middle]:
                low = middle
            else:
                high = middle - 1
        node = self.root
        while node[0] is not None and node[0] < low:
            node = node[1][s[node[0]]]
        leaf = [None, s, [number]]
        if node[0] == low:
            node[1][s[low]] = leaf
        else:
            node[:] = [low, {other[low]: list(node), s[low]: leaf}]

    def ordered(self, length: int) -> list[tuple[int, int]]:
        """(number, common prefix with the one before) in order; the first has -1."""
        out, stack = [], [(self.root, -1)]
        while stack:
            node, before = stack.pop()
            if node[0] is None:
                out += [(k, length if i else before) for i, k in enumerate(node[2])]
            else:
                children = sorted(node[1].items())
                stack += [(c, before if i == 0 else node[0]) for i, (_, c) in reversed(list(enumerate(children)))]
        return out


def sort_groups(strings: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by group, then bytes, and the common prefix of each with the row before; -1 at a group's first row."""
    n, length = strings.shape
    w = words(strings)
    order = np.argsort(group, kind="stable")
    first = np.ones(n, bool)
    first[1:] = group[order][1:] != group[order][:-1]
    common = np.where(first, -1, length).astype(np.int64)
    for depth in range(min(SHALLOW, w.shape[1])):
        tied = ~first | np.append(~first[1:], False)
        at = np.nonzero(tied)[0]
        if not len(at):
            break
        run = np.cumsum(first)[at]
        row = order[at]
        by = np.lexsort((w[row, depth], run))
        row = row[by]
        order[at] = row
        key = w[row, depth]
        split = np.zeros(len(at), bool)
        split[1:] = (key[1:] != key[:-1]) & (run[1:] == run[:-1])
        common[at[split]] = 8 * depth + _common_bytes(key[split], key[np.nonzero(split)[0] - 1])
        first[at[split]] = True
    tied = ~first
    starts = np.nonzero(first & np.append(tied[1:], False))[0]
    ends = np.append(np.nonzero(first)[0], n)
    ends = ends[np.searchsorted(ends, starts, side="right")]
    skip = min(8 * SHALLOW, length)
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        rows = order[a:b]
        trie = BlindTrie(strings[rows[0], skip:].tobytes(), int(rows[0]))
        for r in rows[1:].tolist():
            trie.insert(strings[r, skip:].tobytes(), r)
        for i, (r, shared) in enumerate(trie.ordered(length - skip)):
            order[a + i] = r
            if i:
                common[a + i] = skip + shared
    return order, common
