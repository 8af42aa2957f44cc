"""Packing plan over a histogram of lengths: linear grouping, configurations, substitution, best fit.

The plan works on (length, count) pairs, so its cost depends on the number of
distinct lengths, which the capacity bounds, and not on the number of items.
Bins with the same contents are kept as one run.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass, field
from itertools import combinations_with_replacement

import numpy as np


@dataclass
class Run:
    """``bins`` bins that each hold, in order, ``copies`` items of ``length`` for each pair of ``fill``."""

    bins: int
    free: int
    fill: list[tuple[int, int]] = field(default_factory=list)


def group_linearly(counts: dict[int, int], groups: int) -> list[tuple[int, list[list[int]]]]:
    """Deal lengths, largest first, into groups of equal cardinality: (rounded length, [[length, count]])."""
    total = sum(counts.values())
    out: list[tuple[int, list[list[int]]]] = []
    size = max(1, -(-total // groups))
    room = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                out.append((length, []))
                room = size
            n = min(left, room)
            out[-1][1].append([length, n])
            left -= n
            room -= n
    return out


def configurations(sizes: list[int], capacity: int) -> np.ndarray:
    """All ways to fill a bin with the rounded sizes, as columns of counts."""
    most = capacity // min(sizes)
    found = []
    for k in range(1, most + 1):
        for c in combinations_with_replacement(range(len(sizes)), k):
            if sum(sizes[i] for i in c) <= capacity:
                found.append(np.bincount(c, minlength=len(sizes)))
    return np.array(found, dtype=float).T


def fewest_bins(matrix: np.ndarray, need: np.ndarray) -> dict[int, int]:
    """The linear programme min sum(x), matrix x = need, by the revised simplex method, rounded down.

    The first basis holds as many copies of a single size as fit; a configuration
    enters while its dual value exceeds one.
    """
    n = len(need)
    single = {int(np.nonzero(col)[0][0]): j for j, col in enumerate(matrix.T) if np.count_nonzero(col) == 1}
    basis = [single[i] for i in range(n)]  # the last single column of a size has the most copies
    for _ in range(50 * n):
        b = matrix[:, basis]
        duals = np.linalg.solve(b.T, np.ones(n))
        gain = duals @ matrix
        enter = int(np.argmax(gain))
        if gain[enter] <= 1 + 1e-9:
            break
        x, d = np.linalg.solve(b, need), np.linalg.solve(b, matrix[:, enter])
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        basis[int(np.argmin(ratio))] = enter
    x = np.linalg.solve(matrix[:, basis], need)
    return {j: int(v + 1e-9) for j, v in zip(basis, x, strict=True) if v >= 1 - 1e-9}


def substitute(groups: list[tuple[int, list[list[int]]]], matrix: np.ndarray, chosen: dict[int, int], capacity: int) -> list[Run]:
    """Put the real lengths of each group into the slots of the chosen configurations."""
    queues = [list(reversed(items)) for _, items in groups]
    runs = []
    for j, bins in chosen.items():
        slots = [(g, int(k)) for g, k in enumerate(matrix[:, j]) if k]
        while bins:
            n = bins
            for g, k in slots:
                n = min(n, max(1, queues[g][-1][1] // k)) if queues[g] else 0
            if not n:
                break
            fill: list[tuple[int, int]] = []
            for g, k in slots:
                while k and queues[g]:
                    length, there = queues[g][-1]
                    take = min(k, max(there // n, 0)) if n > 1 else min(k, there)
                    fill.append((length, take))
                    queues[g][-1][1] -= take * n
                    if not queues[g][-1][1]:
                        queues[g].pop()
                    k -= take
            runs.append(Run(n, capacity - sum(a * b for a, b in fill), fill))
            bins -= n
    for (_, items), queue in zip(groups, queues, strict=True):
        items[:] = queue
    return runs


def best_fit(runs: list[Run], counts: dict[int, int], capacity: int) -> list[Run]:
    """Place the counted lengths, largest first, each into the fullest bin with room.

    Items of one length that meet the same bin follow one another into it, so
    they are placed together.
    """
    by_free: dict[int, list[Run]] = {}
    for r in runs:
        by_free.setdefault(r.free, []).append(r)
    frees = sorted(by_free)
    done: list[Run] = []

    def put(r: Run) -> None:
        if not r.free:
            done.append(r)
            return
        if r.free not in by_free:
            insort(frees, r.free)
            by_free[r.free] = []
        by_free[r.free].append(r)

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(frees, length)
            if at == len(frees):
                k = min(capacity // length, left)
                n = left // k
                put(Run(n, capacity - k * length, [(length, k)]))
                left -= n * k
                continue
            free = frees[at]
            r = by_free[free].pop()
            if not by_free[free]:
                del by_free[free], frees[at]
            k = min(free // length, left)
            n = min(r.bins, left // k)
            if n < r.bins:
                put(Run(r.bins - n, r.free, list(r.fill)))
            put(Run(n, free - k * length, [*r.fill, (length, k)]))
            left -= n * k
    return done + [r for rs in by_free.values() for r in rs]


def repack(runs: list[Run], capacity: int, share: float) -> list[Run]:
    """Take the emptiest bins apart, up to this share of all, and best-fit their items into the rest."""
    left, kept, loose = int(share * sum(r.bins for r in runs)), [], {}
    for r in sorted(runs, key=lambda r: -r.free):
        n = min(left, r.bins)
        left -= n
        for length, copies in r.fill if n else ():
            loose[length] = loose.get(length, 0) + n * copies
        if n < r.bins:
            kept.append(Run(r.bins - n, r.free, list(r.fill)))
    return best_fit(kept, loose, capacity)


#: (large from this part of the capacity, groups): the finer the grouping, the smaller the slots' waste and the larger the programme.
SETTINGS = ((1 / 3, 48), (1 / 3, 12), (1 / 4, 10), (1 / 2, 48))


def plan(counts: dict[int, int], capacity: int, settings: tuple[tuple[float, int], ...] = SETTINGS) -> list[Run]:
    """The plan with the fewest bins over the settings; the first that meets the volume bound ends the search."""
    best: list[Run] | None = None
    floor = -(-sum(k * v for k, v in counts.items()) // capacity)
    size = lambda runs: sum(r.bins for r in runs)
    for part, groups in settings:
        large = {k: v for k, v in counts.items() if part * capacity < k < capacity}
        rest = {k: v for k, v in counts.items() if k not in large}
        runs: list[Run] = []
        if large:
            # Groups of the same rounded size would give equal rows: they become one.
            merged: dict[int, list[list[int]]] = {}
            for rounded, items in group_linearly(large, groups):
                merged.setdefault(rounded, []).extend(items)
            grouped = list(merged.items())
            matrix = configurations([s for s, _ in grouped], capacity)
            need = np.array([sum(n for _, n in items) for _, items in grouped], dtype=float)
            runs = substitute(grouped, matrix, fewest_bins(matrix, need), capacity)
            for _, items in grouped:
                for length, n in items:
                    rest[length] = rest.get(length, 0) + n
        runs = best_fit(runs, rest, capacity)
        for share in (0, 0.01, 0.03, 0.1, 0.3):
            tried = repack(runs, capacity, share) if share else runs
            if best is None or size(tried) < size(best):
                best = tried
            if size(best) == floor:
                return best
    return best or []


def places(runs: list[Run]) -> np.ndarray:
    """Rows (length, first rank, first bin, copies in a bin, offset), sorted: where the r-th item of a length goes."""
    rows, used, base = [], {}, 0
    for r in runs:
        offset = 0
        for length, copies in r.fill:
            rows.append((length, used.get(length, 0), base, copies, offset))
            used[length] = used.get(length, 0) + copies * r.bins
            offset += length * copies
        base += r.bins
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
