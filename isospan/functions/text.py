"""String distances and name helpers."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaro(a: str, b: str) -> float:
    """Jaro similarity of two strings, for a few on the driver."""
    if a == b:
        return 1.0
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    reach = max(n, m) // 2 - 1
    taken = [False] * m
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(m, i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, t in zip(b, taken) if t]
    k, moved = len(left), sum(x != y for x, y in zip(left, right)) // 2
    return (k / n + k / m + (k - moved) / k) / 3


def jaro_similarity(a: Column, b: Column) -> Column:
    """Jaro similarity as an expression; null if either is null.

    Folding over a's letters, each takes the first letter of b within reach that
    is the same and not taken; the places taken are all that is needed: in a's
    order and sorted, they spell the two sequences whose differences count.
    """
    bound = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))
    letters = lambda x: F.when(F.length(x) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.substring(x, i, 1)))

    def taken(s):
        n, m = F.size(s["a"]), F.size(s["b"])
        reach = F.floor(F.greatest(n, m) / 2).cast("int") - 1

        def step(used, i):
            low, high = F.greatest(F.lit(0), i - reach), F.least(m - 1, i + reach)
            near = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
            return F.concat(used, F.slice(F.filter(near, lambda j: (F.get(s["b"], j) == F.get(s["a"], i)) & ~F.array_contains(used, j)), 1, 1))

        places = F.when((n > 0) & (m > 0), F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        return F.struct(F.aggregate(places, F.array().cast("array<int>"), step).alias("used"), s["b"].alias("b"), n.alias("n"), m.alias("m"))

    def scored(t):
        k = F.size(t["used"]).cast("double")
        moved = F.size(F.filter(F.zip_with(t["used"], F.sort_array(t["used"]), lambda x, y: F.get(t["b"], x) != F.get(t["b"], y)), lambda z: z))
        moved = F.floor(moved / 2)  # whole transpositions
        return F.when(k == 0, F.lit(0.0)).otherwise((k / t["n"] + k / t["m"] + (k - moved) / k) / 3)

    value = bound(bound(F.struct(letters(a).alias("a"), letters(b).alias("b")), taken), scored)
    return F.when(a.isNotNull() & b.isNotNull(), F.when(a == b, F.lit(1.0)).otherwise(value))


def jaro_distance(a: Column, b: Column) -> Column:
    """1 - Jaro similarity; null if either is null."""
    return 1 - jaro_similarity(a, b)


def jaro_bound(a: Column, b: Column) -> Column:
    """No more than the Jaro distance: by how many letters of each the other has."""
    both = F.least(F.length(a) - F.length(F.call_function("translate", a, b, F.lit(""))), F.length(b) - F.length(F.call_function("translate", b, a, F.lit(""))))
    return F.when(both == 0, F.lit(1.0)).otherwise(1 - (both / F.length(a) + both / F.length(b) + 1) / 3)


def trimmed(x: Column) -> Column:
    """Without leading and trailing blanks, tabs, CR and LF."""
    return F.regexp_replace(x, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def valid_name(code: str) -> str:
    """A column name for an unnamed indicator code."""
    return re.sub(r"[^A-Za-z0-9._]", ".", code)


def si_label(x):
    """1500 -> 1.5K, 4e6 -> 4M, 2e9 -> 2B; small numbers as they are."""
    if x is None:
        return None
    for limit, unit in ((1e12, "T"), (1e9, "B"), (1e6, "M"), (1e3, "K")):
        if abs(x) >= limit:
            return f"{x / limit:.3g}{unit}"
    return f"{x:.3g}"
