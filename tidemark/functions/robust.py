"""The robust line and the detector's verdict over arrays, for state that tasks hold series by series."""

from __future__ import annotations

import numpy as np

#: Pairs up to which all slopes are held at once; points of the intervals that narrow the middle down.
AT_ONCE, ROUNDS = 1 << 21, 60


def inverted(rank: np.ndarray, pairs: bool = False):
    """How many pairs i < j have rank[i] > rank[j] (all ranks differ); with pairs, their places i and j. By merging sorted halves:
    of each left half, what exceeds an element of the right one is its end."""
    n = len(rank)
    total, left, right = 0, [], []
    place = np.arange(n)
    size = 1
    while size < n:
        block = place // (2 * size)
        order = np.lexsort((rank, block))  # each pair of halves sorted
        from_left = (order // size) % 2 == 0
        seen = np.cumsum(from_left)
        first = block[order] * 2 * size  # where the block begins, in places and in the order alike
        before = seen - np.where(first > 0, seen[np.maximum(first - 1, 0)], 0)
        lefts = np.minimum(size, n - first)
        over = np.where(from_left, 0, lefts - before)
        total += int(over.sum())
        if pairs:
            at = np.flatnonzero(over)
            # The larger ones of the left half are the last of its elements in the order.
            only = order[from_left]
            end = (np.cumsum(from_left) - 1)[np.minimum(first[at] + 2 * size, n) - 1]
            counts = over[at]
            back = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            left.append(only[np.repeat(end, counts) - back])
            right.append(np.repeat(order[at], counts))
        size *= 2
    return (np.concatenate(left) if left else np.zeros(0, np.int64), np.concatenate(right) if right else np.zeros(0, np.int64)) if pairs else total


def median_slope(x: np.ndarray, y: np.ndarray, at_once: int = AT_ONCE, seed: int = 0) -> float:
    """Median of the slopes of all pairs with different x, 0 without any; x ascending. Over `at_once` pairs it is selected: two points
    change their order along y - t x exactly where t passes their slope, so inversions count the slopes below t. Sampled slopes
    bracket the middle, counts narrow the bracket until few pairs lie inside, and these are compared one by one. O(n log n) for
    each count, and memory for `at_once` slopes.

    Exact but where over `at_once` slopes agree to 12 digits: their middle value as sampled is returned then."""
    n = len(x)
    x, y = np.asarray(x, float), np.asarray(y, float)
    by = np.lexsort((y, x))
    x, y = x[by], y[by]
    same = np.unique(x, return_counts=True)[1]
    valid = n * (n - 1) // 2 - int((same * (same - 1) // 2).sum())
    if not valid:
        return 0.0
    middle = [(valid + 1) // 2, valid // 2 + 1]  # ranks from 1
    if n * (n - 1) // 2 <= at_once:
        i, j = np.triu_indices(n, 1)
        ok = x[i] != x[j]
        s = np.sort((y[j] - y[i])[ok] / (x[j] - x[i])[ok])
        return float((s[middle[0] - 1] + s[middle[1] - 1]) / 2)
    rng = np.random.default_rng(seed)

    def order(t: float) -> np.ndarray:
        """Places by y - t x; what ties keeps its order, so points of one x never change theirs."""
        return np.lexsort((np.arange(n), y - t * x))

    def count(t: float) -> int:
        rank = np.empty(n, np.int64)
        rank[order(t)] = np.arange(n)
        return inverted(rank)

    i, j = rng.integers(0, n, at_once // 8), rng.integers(0, n, at_once // 8)
    ok = x[i] != x[j]
    sample = np.sort((y[j] - y[i])[ok] / (x[j] - x[i])[ok])
    size = max(float(np.abs(sample).max()), 1e-300)
    slack = 1e-13 * size
    where = np.searchsorted(np.arange(len(sample)) / len(sample), [0.5 - 4 / len(sample) ** 0.5, 0.5 + 4 / len(sample) ** 0.5])
    low, high = sample[max(where[0] - 1, 0)] - slack, sample[min(where[1], len(sample) - 1)] + slack
    below, upto = count(low), count(high)
    wide = max(high - low, 1e-9 * size)
    while below >= middle[0]:
        low, wide = low - wide, 2 * wide
        below = count(low)
    while upto < middle[1]:
        high, wide = high + wide, 2 * wide
        upto = count(high)
    for r in range(ROUNDS):
        if upto - below <= at_once or high - low <= 8 * slack:
            break
        # Towards the middle by where it lies between the counts, with a margin; every third time by halves.
        share = ((middle[0] - below) / (upto - below)) if r % 3 < 2 else 0.5
        margin = 0.05 if r % 3 < 2 else 0.0
        for t in (low + (high - low) * max(0.0, share - margin), low + (high - low) * min(1.0, share + margin)):
            if low < t < high:
                c = count(t)
                if c < middle[0]:
                    low, below = t, c
                elif c >= middle[1]:
                    high, upto = t, c
    if upto - below > at_once:
        near = sample[(sample >= low) & (sample <= high)]
        return float(near[len(near) // 2]) if len(near) else float((low + high) / 2)
    # Pairs whose order differs between the bracket's ends: in the order at its lower end, inverted by that at the upper one.
    first = order(low)
    rank = np.empty(n, np.int64)
    rank[order(high)] = np.arange(n)
    a, b = inverted(rank[first], pairs=True)
    i, j = np.minimum(first[a], first[b]), np.maximum(first[a], first[b])
    s = np.sort((y[j] - y[i]) / (x[j] - x[i]))
    return float((s[middle[0] - below - 1] + s[middle[1] - below - 1]) / 2)


def median_slopes(x: np.ndarray, y: np.ndarray, size: np.ndarray, at_once: int = AT_ONCE) -> np.ndarray:
    """median_slope of many series, one after another in x and y, each of `size` points. Those of one length are taken together, as many
    as have `at_once` slopes."""
    first = np.cumsum(size) - size
    out = np.zeros(len(size))
    for n in np.unique(size[size > 1]).tolist():
        rows, pairs = np.flatnonzero(size == n), n * (n - 1) // 2
        if pairs > at_once:
            for r in rows.tolist():
                out[r] = median_slope(x[first[r] : first[r] + n], y[first[r] : first[r] + n], at_once)
            continue
        i, j = np.triu_indices(n, 1)
        for k in range(0, len(rows), max(1, at_once // pairs)):
            some = rows[k : k + max(1, at_once // pairs)]
            at = first[some][:, None] + np.arange(n)
            xs, ys = x[at], y[at]
            dx, dy = xs[:, j] - xs[:, i], ys[:, j] - ys[:, i]
            with np.errstate(divide="ignore", invalid="ignore"):
                s = np.where(dx != 0, dy / dx, np.inf)
            m = (dx != 0).sum(1)
            s.sort(axis=1)  # pairs of one x come last
            own, some_left = np.arange(len(some)), m > 0
            low, high = np.maximum((m + 1) // 2 - 1, 0), np.minimum(m // 2, pairs - 1)
            out[some] = np.where(some_left, (s[own, low] + s[own, high]) / 2, 0.0)
    return out


def _median(v: np.ndarray) -> float:
    s = np.sort(v)
    return float((s[(len(s) + 1) // 2 - 1] + s[len(s) // 2]) / 2)


def _longest(marks: np.ndarray) -> int:
    best = now = 0
    for m in marks:
        now = now + 1 if m else 0
        best = max(best, now)
    return best


def verdict(x: np.ndarray, y: np.ndarray, k: float = 3.0, least: int = 8, share: float = 0.30, cap: float = 1e6) -> dict | None:
    """What the batch detector says of one series, ordered by x; None under `least` points or 4 early ones."""
    n = len(x)
    holdout = max(2, round(share * n))
    split = n - holdout
    if n < least or split < 4:
        return None
    slope = median_slope(x[:split], y[:split])
    intercept = _median(y[:split] - slope * x[:split])
    resid = y[:split] - (slope * x[:split] + intercept)
    sigma = 1.4826 * _median(np.abs(resid - _median(resid)))
    if not sigma > 0:
        sigma = max(float(np.std(resid)), 0.05 * max(float(y[:split].max() - y[:split].min()), abs(_median(y[:split]))), 1e-9)
    s = (y[split:] - (slope * x[split:] + intercept)) / sigma
    need = max(2, -(-holdout // 2))
    surprise, down = min(float(s.max()), cap), min(max(0.0, -float(s.min())), cap)
    return {"n": n, "surprise": surprise, "fired": surprise >= k, "sustained": _longest(s > 0) >= need, "dissolving": down >= k and _longest(s < 0) >= need}
