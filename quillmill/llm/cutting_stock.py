"""Cutting-stock by column generation over a length histogram.

Everything here is bounded by the capacity (at most `capacity` distinct lengths), never by the number of documents.
"""

from __future__ import annotations

import numpy as np


def best_patterns(sizes: np.ndarray, worth: np.ndarray, capacity: int, starts: int) -> tuple[float, list[np.ndarray]]:
    """Unbounded knapsack by dynamic programming over capacities: the best value, and the best patterns with and
    without each of the `starts` most valuable first pieces."""
    useful = np.flatnonzero(worth > 1e-12)
    if not useful.size:
        return 0.0, []
    w, v = sizes[useful], worth[useful]
    order = np.argsort(w, kind="stable")
    useful, w, v = useful[order], w[order], v[order]
    fits = np.searchsorted(w, np.arange(capacity + 1), side="right")
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        k = fits[c]
        best[c], choice[c] = best[c - 1], -1
        if k:
            values = best[c - w[:k]] + v[:k]
            j = int(values.argmax())
            if values[j] > best[c]:
                best[c], choice[c] = values[j], j

    def traced(first: int) -> np.ndarray:
        pattern = np.zeros(len(sizes))
        c = capacity
        if first >= 0:
            pattern[useful[first]] += 1
            c -= w[first]
        while c > 0:
            j = choice[c]
            if j < 0:
                c -= 1
                continue
            pattern[useful[j]] += 1
            c -= w[j]
        return pattern

    with_first = v + best[capacity - w]
    firsts = [int(i) for i in np.argsort(-with_first, kind="stable")[:starts] if with_first[i] > 1 + 1e-9]
    return float(best[capacity]), [traced(-1), *(traced(i) for i in firsts)]


def relax(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 2e-3, max_pivots: int = 1500) -> tuple[np.ndarray, np.ndarray, float]:
    """Linear program min sum(x), patterns @ x = demand, by the revised simplex method with priced columns.

    The first basis is triangular: each pattern of `fill` uses up a length that no later one holds.
    Returns the basic patterns (a column each), their amounts and the lower bound. Stops when the amounts are within
    `gap` of the bound, or after `max_pivots` (both only bound the driver's work; any basis is feasible).
    """
    n = len(sizes)
    copies = (capacity // sizes).astype(float)
    patterns, inverse = np.diag(copies), np.diag(1 / copies)
    amounts = demand / copies

    def enter(column: np.ndarray, change: np.ndarray, leave: int) -> None:
        """Swap a column of the basis; element-wise work only, as threaded matrix routines can stall beside a JVM."""
        nonlocal amounts
        step = amounts[leave] / change[leave]
        amounts = (amounts - step * change).clip(0)
        amounts[leave] = step
        patterns[:, leave] = column
        row = inverse[leave] / change[leave]
        for i in np.flatnonzero(change):
            inverse[i] -= change[i] * row
        inverse[leave] = row

    for column, times, row in fill(sizes, demand, capacity, whole=False):
        enter(column, np.einsum("ij,j->i", inverse, column.astype(float)), row)
        amounts[row] = times
    amounts = np.einsum("ij,j->i", inverse, demand.astype(float)).clip(0)
    bound = float(sizes @ demand) / capacity
    pivots = 0
    while pivots < max_pivots and amounts.sum() > bound * (1 + gap):
        prices = inverse.sum(axis=0)
        value, columns = best_patterns(sizes, prices, capacity, starts=24)
        if value <= 1 + 1e-9:
            break
        if (prices >= 0).all():
            bound = max(bound, float(prices @ demand) / value)
        before = pivots
        for column in columns:
            if inverse.sum(axis=0) @ column <= 1 + 1e-9:
                continue
            change = np.einsum("ij,j->i", inverse, column)
            up = change > 1e-9
            if up.any():
                ratios = np.full(n, np.inf)
                ratios[up] = amounts[up] / change[up]
                enter(column, change, int(ratios.argmin()))
                pivots += 1
        if pivots == before:  # only rounding errors are left to gain
            break
    return patterns, amounts, bound


def fill(sizes: np.ndarray, demand: np.ndarray, capacity: int, whole: bool) -> list[tuple[np.ndarray, float, int]]:
    """Greedy patterns, their repeats and a length that bounds these: the longest piece left, the subset sum that
    fills best, as often as the pieces last. Unless `whole`, repeats are fractions and that length is used up."""
    left, found = demand.astype(np.int64 if whole else float), []
    mask = (1 << (capacity + 1)) - 1
    order = np.argsort(-sizes, kind="stable").tolist()
    while left.any():
        first = next(i for i in order if left[i])
        pattern = np.zeros(len(sizes), dtype=np.int64)
        pattern[first] = 1
        room = capacity - int(sizes[first])
        steps, reach = [], 1  # bit c: a sum of c can be reached
        for i in order if room else ():
            size, take = int(sizes[i]), 1
            spare = min(int(left[i]) - int(i == first), room // size) if whole else room // size if left[i] else 0
            while spare > 0:
                take = min(take, spare)
                steps.append((i, take, reach))
                reach |= (reach << (size * take)) & mask
                spare -= take
                take *= 2
            if reach >> room & 1:
                break
        at = (reach & ((1 << (room + 1)) - 1)).bit_length() - 1
        for i, take, before in reversed(steps):
            if not before >> at & 1:
                pattern[i] += take
                at -= int(sizes[i]) * take
        used = pattern > 0
        last = np.where(used, left // pattern.clip(1) if whole else left / pattern.clip(1), np.inf)
        bounding = int(last.argmin())
        times = int(last[bounding]) if whole else float(last[bounding])
        left -= times * pattern
        if not whole:
            left[bounding] = 0
            left[np.abs(left) < 1e-9] = 0
        found.append((pattern, times, bounding))
    return found


def plan(lengths: dict[int, int], capacity: int, gap: float = 2e-3, max_pivots: int = 1500) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Whole patterns for a histogram length -> count: (lengths, copies of each, how many sequences)."""
    sizes = np.array(sorted(lengths, reverse=True), dtype=np.int64)
    demand = np.array([lengths[int(s)] for s in sizes], dtype=np.int64)
    if not sizes.size:
        return []
    patterns, amounts, _ = relax(sizes, demand, capacity, gap, max_pivots)
    out, left = [], demand.copy()
    for k in np.argsort(-amounts, kind="stable"):
        column = np.rint(patterns[:, k]).astype(np.int64)
        used = column > 0
        whole = int(min(np.floor(amounts[k] + 1e-6), (left[used] // column[used]).min() if used.any() else 0))
        if whole > 0:
            left -= whole * column
            out.append((sizes[used], column[used], whole))
    for column, times, _ in fill(sizes, left, capacity, whole=True):
        used = column > 0
        out.append((sizes[used], column[used], times))
    return out
