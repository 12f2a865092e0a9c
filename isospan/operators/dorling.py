"""Dorling cartograms: circles of area by weight, pushed apart in rounds.

In a round all circles that overlap push each other apart along the line between
their middles, each by half, and every circle moves by the sum of its pushes.
Pairs meet by grid cells: circles are in levels by their radius, half as large
from one to the next, and a level has a grid of its own with cells as wide as its
largest circle. A circle looks at the nine cells around it in its own level's
grid, in which the circles of its level and all finer ones are entered.

Several rounds are made at once in tiles of the plane: a task has the circles of a
tile and those so near that they can matter to them within these rounds, and moves
all of them; each circle's place is taken from its own tile. How near that is
follows from the largest step of any circle, which is checked afterwards. Where a
tile would hold too much, a round is an equi-join by cells. No task, nor the
driver, holds all circles.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SpineError, need_columns
from ..shared import cut
from .prefix import number
from .spatial import TASKS

LEVELS = 16  # circles below 2 ** -LEVELS of the largest radius share the finest grid
TOGETHER = 2000  # at most so many circles are laid out in one task, by the same rule
CROWD = 64  # circles of one level in a cell beyond which they are spread out first
RELAX, MARGIN, GROWTH, MOST_MARGIN = 0.7, 0.01, 1.05, 0.5
TOLERANCE = 1e-6  # of the largest radius
AT_ONCE = 8  # rounds in tiles before the first shuffle; twice as many from then on
STEP = 0.5  # of the largest radius: what a circle moves in a round at most, as first supposed
TILE = 6  # width of a tile, in widths of its border
TILE_CIRCLES = 200_000  # circles of a tile and its border, beyond which rounds are joins
_SCHEMA = "key string, x double, y double, r double, t double, level int"


def _margin(i: int) -> float:
    """How far beyond touching pairs are pushed in round i; it grows, so that heaps open up."""
    return min(MOST_MARGIN, MARGIN * GROWTH**i)


def _circles(df: DataFrame, key: str, x: str, y: str, weight: str, k: float) -> DataFrame:
    """One row per key with finite place and weight above 0: the heaviest, then the least x and y."""
    rows = df.select(F.col(key).cast("string").alias("key"), number(x).alias("x"), number(y).alias("y"), number(weight).alias("w"))
    fine = rows.where("key is not null and w > 0 and w < double('Infinity') and abs(x) < double('Infinity') and abs(y) < double('Infinity')")
    best = fine.groupBy("key").agg(F.min(F.struct((-F.col("w")).alias("w"), "x", "y")).alias("b"))
    best = cut(best.select("key", "b.x", "b.y", (-F.col("b.w")).alias("w")))
    top = best.agg(F.max("w")).first()[0]
    if top is None:
        raise SpineError("no positive weights")
    r = F.lit(float(k)) * F.sqrt(F.col("w") / F.lit(top))
    turn = F.pmod(F.xxhash64("key"), F.lit(1 << 20)) * (2 * math.pi / (1 << 20))
    level = F.least(F.lit(LEVELS), F.greatest(F.lit(0), F.floor(F.log2(F.lit(float(k)) / F.col("r"))))).cast("int")
    return best.select("key", "x", "y", r.alias("r"), turn.alias("t")).withColumn("level", level)


def _cell(c: str, size) -> F.Column:
    return F.floor(F.col(c) / size).cast("long")


def _size(level, top: float):
    return F.lit(2 * top) * F.pow(F.lit(2.0), -F.col(level))


def touching_circles(circles: DataFrame, top: float, levels: list[int]) -> DataFrame:
    """(a, b, r and places of both, d): every pair that overlaps by over TOLERANCE, once.

    circles: (key, x, y, r, t, level, m), r at most top.
    """
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    sizes = circles.withColumn("_s", _size("level", top))
    large = sizes.select(F.col("level").alias("grid"), *[F.col(c).alias(f"{c}_a") for c in ("key", "x", "y", "r", "t", "m")], _cell("x", F.col("_s")).alias("_x"), _cell("y", F.col("_s")).alias("_y"), around.alias("n"))
    large = large.withColumns({"_x": F.col("_x") + F.col("n.i"), "_y": F.col("_y") + F.col("n.j")}).drop("n")
    grids = F.explode(F.filter(F.array(*map(F.lit, levels)), lambda g: g <= F.col("level")))
    entered = circles.withColumn("grid", grids).withColumn("_s", _size("grid", top))
    small = entered.select("grid", F.col("level").alias("level_b"), *[F.col(c).alias(f"{c}_b") for c in ("key", "x", "y", "r", "t")], _cell("x", F.col("_s")).alias("_x"), _cell("y", F.col("_s")).alias("_y"))
    dx, dy = F.col("x_b") - F.col("x_a"), F.col("y_b") - F.col("y_a")
    met = small.join(large, ["grid", "_x", "_y"]).where((F.col("level_b") > F.col("grid")) | (F.col("key_b") > F.col("key_a")))
    return met.withColumn("d", F.sqrt(dx * dx + dy * dy)).where(F.col("r_a") + F.col("r_b") - F.col("d") > TOLERANCE * top).drop("grid", "_x", "_y", "level_b")


def _round(circles: DataFrame, top: float, levels: list[int]) -> DataFrame:
    """Circles after a round; hits: how many others each met.

    The margin is a column, so that every round runs the same compiled code.
    """
    pairs = touching_circles(circles, top, levels)
    push = ((F.col("r_a") + F.col("r_b")) * (1 + F.col("m_a")) - F.col("d")) / 2 * RELAX
    ahead = F.when(F.col("key_b") > F.col("key_a"), 1.0).otherwise(-1.0)
    turn = F.col("t_a") + F.col("t_b")  # of circles in one place
    way = lambda c, f: F.when(F.col("d") > 0, (F.col(f"{c}_b") - F.col(f"{c}_a")) / F.col("d")).otherwise(f(turn) * ahead) * push
    pairs = pairs.select("key_a", "key_b", way("x", F.cos).alias("mx"), way("y", F.sin).alias("my"))
    ends = F.array(F.struct(F.col("key_a").alias("key"), (-F.col("mx")).alias("mx"), (-F.col("my")).alias("my")), F.struct(F.col("key_b").alias("key"), "mx", "my"))
    moves = pairs.select(F.explode(ends).alias("e")).select("e.*").groupBy("key").agg(F.sum("mx").alias("mx"), F.sum("my").alias("my"), F.count(F.lit(1)).alias("hits"))
    add = lambda c: (F.col(c) + F.coalesce(F.col(f"m{c}"), F.lit(0.0))).alias(c)
    return circles.join(moves, "key", "left").select("key", add("x"), add("y"), "r", "t", "level", F.least(F.lit(MOST_MARGIN), F.col("m") * GROWTH).alias("m"), F.coalesce("hits", F.lit(0)).alias("hits"))


def _spread(circles: DataFrame, top: float) -> DataFrame:
    """Circles of a level that crowd a cell, dealt over a disc by their keys' hashes.

    Else all in one place would meet in pairs. Cells double in width until none
    holds more than CROWD of them for each cell of the level's own.
    """
    part = lambda i: F.pmod(F.xxhash64("key", F.lit(i)), F.lit(1 << 30)) / float(1 << 30)
    for j in range(60):
        size = _size("level", top)
        placed = circles.withColumns({"_x": _cell("x", size * 2.0**j), "_y": _cell("y", size * 2.0**j)})
        crowds = cut(placed.groupBy("level", "_x", "_y").agg(F.count(F.lit(1)).alias("_n"), F.avg("x").alias("_mx"), F.avg("y").alias("_my")).where(F.col("_n") > CROWD * 4.0**j))
        if crowds.isEmpty():
            return circles
        far = F.sqrt(F.col("_n") / (4 * math.pi) * part(2 * j)) * size
        at = lambda c, f: F.when(F.col("_n").isNull(), F.col(c)).otherwise(F.col(f"_m{c}") + far * f(part(2 * j + 1) * 2 * math.pi)).alias(c)
        circles = cut(placed.join(crowds, ["level", "_x", "_y"], "left").select("key", at("x", F.cos), at("y", F.sin), "r", "t", "level"))
    return circles


def _settled(top: float, rounds: int):
    """All rounds over the few circles of one task."""

    def settle(pdf):
        import numpy as np

        pdf = pdf.sort_values("key").reset_index(drop=True)
        x, y, r, t = (pdf[c].to_numpy(float).copy() for c in ("x", "y", "r", "t"))
        need, turn, order = r[:, None] + r, t[:, None] + t, np.arange(len(r))
        ahead = np.sign(order[:, None] - order)
        for i in range(rounds):
            dx, dy = x[:, None] - x, y[:, None] - y
            d = np.sqrt(dx * dx + dy * dy)
            hit = (need - d > TOLERANCE * top) & (ahead != 0)
            if not hit.any():
                break
            push = np.where(hit, (need * (1 + _margin(i)) - d) / 2 * RELAX, 0.0)
            apart = np.where(d > 0, d, 1.0)
            x = x + (np.where(d > 0, dx / apart, np.cos(turn) * ahead) * push).sum(axis=1)
            y = y + (np.where(d > 0, dy / apart, np.sin(turn) * ahead) * push).sum(axis=1)
        return pdf.assign(x=x, y=y)

    return settle


def _near_pairs(x, y, r, level, top: float):
    """(a, b) of all circles that overlap by over TOLERANCE, once; rows are in order of their keys."""
    import numpy as np

    found_a, found_b = [], []
    for g in np.unique(level):
        size = 2 * top * 2.0 ** -int(g)
        large, small = np.flatnonzero(level == g), np.flatnonzero(level >= g)
        i, j = np.floor(x / size).astype(np.int64), np.floor(y / size).astype(np.int64)
        i, j = i - i.min() + 1, j - j.min() + 1
        rows = int(j.max()) + 2
        cell = i * rows + j
        small = small[np.argsort(cell[small], kind="stable")]
        held = cell[small]
        for off in (-rows - 1, -rows, -rows + 1, -1, 0, 1, rows - 1, rows, rows + 1):
            first, last = (np.searchsorted(held, cell[large] + off, side) for side in ("left", "right"))
            n = last - first
            a = np.repeat(large, n)
            b = small[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)]
            d = np.sqrt((x[b] - x[a]) ** 2 + (y[b] - y[a]) ** 2)
            k = ((level[b] > g) | (b > a)) & (r[a] + r[b] - d > TOLERANCE * top)
            found_a.append(a[k])
            found_b.append(b[k])
    return np.concatenate(found_a), np.concatenate(found_b)


def _around(x, y, hit, size: float):
    """Circles in the cells of those hit and beside them, in order: no others can overlap anew."""
    import numpy as np

    i, j = np.floor(x / size).astype(np.int64), np.floor(y / size).astype(np.int64)
    i, j = i - i.min() + 1, j - j.min() + 1
    rows = int(j.max()) + 2
    cell = i * rows + j
    offsets = np.array([a * rows + b for a in (-1, 0, 1) for b in (-1, 0, 1)])
    near = np.unique(np.unique(cell[hit])[:, None] + offsets)
    at = np.searchsorted(near, cell)
    return np.flatnonzero(near[np.minimum(at, len(near) - 1)] == cell)


def _tile_rounds(top: float, rounds: int):
    """Rounds over the circles of a tile and its border; those of the tile itself come out."""

    def settle(pdf):
        import numpy as np

        pdf = pdf.sort_values("key").reset_index(drop=True)
        x, y, r, t = (pdf[c].to_numpy(float).copy() for c in ("x", "y", "r", "t"))
        level, own, m, n = pdf["level"].to_numpy(), pdf["own"].to_numpy(bool), float(pdf["m"].iloc[0]), len(pdf)
        hits, step = np.zeros(n, np.int64), np.zeros(n)
        for _ in range(rounds):
            k = _around(x, y, hits > 0, 2 * top) if hits.any() else np.arange(n)
            a, b = (k[v] for v in _near_pairs(x[k], y[k], r[k], level[k], top))
            hits = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
            if not len(a):
                break
            dx, dy = x[b] - x[a], y[b] - y[a]
            d = np.sqrt(dx * dx + dy * dy)
            push = ((r[a] + r[b]) * (1 + m) - d) / 2 * RELAX
            ahead, turn, apart = np.where(b > a, 1.0, -1.0), t[a] + t[b], np.where(d > 0, d, 1.0)
            mx, my = (np.where(d > 0, v / apart, f(turn) * ahead) * push for v, f in ((dx, np.cos), (dy, np.sin)))
            mx, my = (np.bincount(b, v, n) - np.bincount(a, v, n) for v in (mx, my))
            x, y, step = x + mx, y + my, np.maximum(step, np.sqrt(mx * mx + my * my))
            m = min(MOST_MARGIN, m * GROWTH)
        return pdf.assign(x=x, y=y, hits=hits, step=step)[own][["key", "x", "y", "r", "t", "level", "hits", "step"]]

    return settle


def _in_tiles(circles: DataFrame, top: float, rounds: int, step: float) -> tuple[DataFrame | None, float]:
    """(circles after so many rounds, their largest step); None where tiles hold too many.

    A round carries a push on by 2 * top at most, beside the steps of both sides; so
    with steps up to `step`, what lies further than the border doesn't matter.
    """
    border = rounds * 2 * (top + step)
    width = F.lit(TILE * border)
    axis = lambda c: F.sequence(F.floor((F.col(c) - border) / width), F.floor((F.col(c) + border) / width))
    dealt = circles.withColumn("i", F.explode(axis("x"))).withColumn("j", F.explode(axis("y")))
    most, tiles = dealt.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.count(F.lit(1))).first()
    if most > TILE_CIRCLES:
        return None, 0.0
    dealt = dealt.withColumn("own", (F.floor(F.col("x") / width) == F.col("i")) & (F.floor(F.col("y") / width) == F.col("j")))
    dealt = dealt.repartition(min(TASKS, tiles), "i", "j")  # few bytes are much work
    after = cut(dealt.groupBy("i", "j").applyInPandas(_tile_rounds(top, rounds), f"{_SCHEMA}, hits long, step double"))
    return after, after.agg(F.max("step")).first()[0]


def _moved(circles: DataFrame, top: float, levels: list[int], margin: float, rounds: int, step: float) -> tuple[DataFrame, int, float]:
    """(circles with hits, rounds made, step to suppose next): several rounds in tiles, or one by joins."""
    while rounds:
        after, made = _in_tiles(circles, top, rounds, step)
        if after is None:
            rounds //= 2
        elif made <= step:
            return after.drop("step"), rounds, max(1.25 * made, STEP * top)
        else:  # the border was too narrow for such steps
            rounds, step = max(1, min(rounds, int(rounds * (top + step) / (top + 1.25 * made)))), 1.25 * made
    return cut(_round(circles.withColumn("m", F.lit(margin)), top, levels)).drop("m"), 1, STEP * top


def dorling_layout(df: DataFrame, weight: str, key: str = "iso3c", x: str = "lon", y: str = "lat", k: float = 5.0, rounds: int = 1000, together: int = TOGETHER) -> DataFrame:
    """(key, x, y, r): a circle per key, of area by weight, the largest of radius k, none overlapping.

    Pairs are pushed apart by halves, so the mean of all places stays. Rows with
    a null key, a missing place or a weight not above 0 drop out; of a key's rows
    the heaviest counts, then that of least x and y. Circles may overlap only if
    `rounds` are used up. Where over CROWD circles of like radius share a cell
    they are first spread over a disc. Up to `together` circles are one task's
    work, of the same rounds. Nothing with a weight above 0 is an error.
    """
    need_columns(df, key, x, y, weight)
    circles = cut(_circles(df, key, x, y, weight, k))
    top = float(k)
    out = lambda c: c.select(F.col("key").alias(key), *[F.col(a).alias(b) for a, b in (("x", x), ("y", y))], "r")
    if circles.count() <= together:
        return out(circles.groupBy().applyInPandas(_settled(top, rounds), _SCHEMA))
    levels = sorted(row[0] for row in circles.select("level").distinct().collect())
    circles, done, step = _spread(circles, top), 0, STEP * top
    while done < rounds:
        margin = _margin(done)
        after, made, step = _moved(circles.withColumn("m", F.lit(margin)), top, levels, margin, min(AT_ONCE * (2 if done else 1), rounds - done), step)
        circles, done = after.drop("hits"), done + made
        if after.where("hits > 0").isEmpty():
            break
    return out(circles)
