"""Driver-side mathematics on a handful of numbers."""

from __future__ import annotations

import math


def beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    tiny, c = 1e-300, 1.0
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * beta_fraction(a, b, x) / a
    return 1 - front * beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def natural_breaks(values, k: int, weights=None) -> list[float]:
    """Fisher-Jenks class limits, least first, of values that occur weights times each.

    Each class's last value is a limit. The best start of a class's last value
    grows with that value, so that the programme halves its way: values midway
    between those done search only between their neighbours' starts, a level at
    a time, in n log n steps a class.
    """
    import numpy as np

    x, at = np.unique(np.asarray(values, np.float64), return_inverse=True)
    n = len(x)
    k = min(k, n)
    if k < 1:
        return []
    w = np.bincount(at, None if weights is None else np.asarray(weights, np.float64), n).astype(np.float64)
    if weights is None:
        w = np.ones(n)
    d = x - np.average(x, weights=w)
    sums = [np.concatenate([[0.0], np.cumsum(c)]) for c in (w, w * d, w * d * d)]

    def spread(i, j):  # of x[i:j]
        m, s, q = (c[j] - c[i] for c in sums)
        return q - s * s / m

    cost = np.concatenate([[0.0], spread(np.zeros(n, int), np.arange(1, n + 1))])
    back = []
    for c in range(2, k + 1):
        new, start = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        # ends c..n; the best start of each lies between those of its neighbours done
        lows, highs = np.array([c]), np.array([n])
        first, last = np.array([c - 1]), np.array([n - 1])
        while len(lows):
            mid = (lows + highs) // 2
            top = np.minimum(last, mid - 1)
            size = top - first + 1
            begin = np.cumsum(size) - size
            number = np.repeat(np.arange(len(mid)), size)
            i = np.arange(size.sum()) - begin[number] + first[number]
            got = cost[i] + spread(i, mid[number])
            least = np.minimum.reduceat(got, begin)
            hits = np.flatnonzero(got == least[number])
            _, one = np.unique(number[hits], return_index=True)
            best = i[hits[one]]
            new[mid], start[mid] = least, best
            left, right = lows < mid, mid < highs
            lows, highs, first, last = np.concatenate([lows[left], mid[right] + 1]), np.concatenate([mid[left] - 1, highs[right]]), np.concatenate([first[left], best[right]]), np.concatenate([best[left], last[right]])
        back.append(start)
        cost = new
    limits, j = [float(x[-1])], n
    for start in reversed(back):
        j = int(start[j])
        limits.append(float(x[j - 1]))
    return sorted({float(x[0]), *limits})
