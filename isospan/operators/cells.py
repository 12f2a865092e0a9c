"""The outline of a union, within one strip of the plane: cells first, edges last.

A strip is halved, by turns in height and width, into cells. A cell that one
country covers whole has no outline in it and is dropped at once, with all edges
in it, and so is one that none touches; only cells along the outline are halved on,
until a few edges are left. For each country that has edges in a cell it is known
whether the cell's lower left corner is inside, which is worked out from the
parent's corner by the edges that the way to the new corner crosses. All cells of
a level are halved together, as arrays.

Cell borders lie off the grid that vertices are rounded to, and off the coarser
grids that vertices and crossings of made shapes often have, at another offset in
height than in width, so that edges at 45 degrees don't run through corners.
"""

from __future__ import annotations

import numpy as np

EPS = 2e-9  # points nearer than this are one
FEW = 6  # edges of a cell that is not halved any more
STALE = 4  # halvings that leave over 4/5 of the edges, after which a cell isn't halved any more
NEAR = 1e-9
X_OFF, Y_OFF = 3.7185e-6, 3.14125e-6


def border(v, off):
    """A place for a border near v."""
    return np.floor(np.asarray(v) * 1e5) / 1e5 + off


def heights(x, x0, y0, x1, y1):
    """Heights of edges at x, exact at their ends; of upright ones the lower end."""
    with np.errstate(divide="ignore", invalid="ignore"):
        h = y0 + (x - x0) / (x1 - x0) * (y1 - y0)
    return np.where(x <= x0, y0, np.where(x >= x1, y1, h))


def _count(index, chosen, n):
    return np.bincount(index[chosen], minlength=n)


def outline_cells(x0, y0, x1, y1, owner, mask, root, boxes, keep):
    """[(cell, rows, pairs)] along the outlines, several arrays at a time.

    Rows: edge, result and pair (country in cell) of each; x0 <= x1, of upright
    edges y0 < y1. root: which result a row is of; boxes: (left, bottom, right,
    top) of each result, below and beside which nothing is inside.
    """
    xl, yb, xr, yt = (np.asarray(b, float) for b in boxes)
    res = np.arange(len(xl))
    node, e = root, np.arange(len(x0))
    a, b = heights(np.maximum(x0, xl[node]), x0, y0, x1, y1), heights(np.minimum(x1, xr[node]), x0, y0, x1, y1)
    upright = x0 == x1
    b[upright] = y1[upright]
    kinds, pair = np.unique(np.stack([node, np.where(mask, -1, owner)]), axis=1, return_inverse=True)
    pnode, powner, ppar = kinds[0], kinds[1], np.zeros(kinds.shape[1], bool)
    full, inmask, stale = np.zeros(len(xl), bool), np.zeros(len(xl), bool), np.zeros(len(xl), int)
    while len(node):
        # what has no outline goes; what is covered whole needs only the mask's edges
        n = len(xl)
        own_pairs = _count(pnode, powner >= 0, n) > 0
        mask_pairs = _count(pnode, powner < 0, n) > 0
        if keep is None:
            gone = full | ~own_pairs
        else:
            shut = ~mask_pairs & (inmask != keep)
            gone = (~full & ~own_pairs) | shut | (full & ~mask_pairs)
        stay = ~gone[pnode] & ~(full[pnode] & (powner >= 0))
        rows = stay[pair]
        new_pair, new_node = np.cumsum(stay) - 1, np.cumsum(~gone) - 1
        node, e, a, b, pair = new_node[node[rows]], e[rows], a[rows], b[rows], new_pair[pair[rows]]
        pnode, powner, ppar = new_node[pnode[stay]], powner[stay], ppar[stay]
        xl, yb, xr, yt, res, full, inmask, stale = (v[~gone] for v in (xl, yb, xr, yt, res, full, inmask, stale))
        n = len(xl)
        if not n:
            return
        held = np.bincount(node, minlength=n)
        leaf = (held <= FEW) | (stale >= STALE) | (np.maximum(xr - xl, yt - yb) < 1e-6)
        if leaf.any():
            lr, lp = leaf[node], leaf[pnode]
            yield (xl, yb, xr, yt, res, full, inmask, leaf), (node[lr], e[lr], a[lr], b[lr]), (pnode[lp], powner[lp], ppar[lp])
            if leaf.all():
                return
        # halve the others
        tall = (yt - yb) >= (xr - xl)
        mid = np.where(tall, yb + 0.4837 * (yt - yb), xl + 0.4837 * (xr - xl))
        small = np.maximum(yt - yb, xr - xl) < 1e-3
        mid = np.where(small, np.round(mid, 9) + np.where(tall, 0.25e-9, 0.5e-9), border(mid, np.where(tall, Y_OFF, X_OFF)))
        go = ~leaf[node]
        node, e, a, b, pair = node[go], e[go], a[go], b[go], pair[go]
        m, t, left, low, top = mid[node], tall[node], xl[node], yb[node], yt[node]
        ex0, ex1 = x0[e], x1[e]
        up = ex0 == ex1
        at = heights(m, ex0, y0[e], ex1, y1[e])
        b_low = np.where(t | (ex1 <= m), b, at)  # at the right end of the low half
        a_high = np.where(t | (ex0 >= m), a, at)  # at the left end of the high half
        in_low = np.where(t, np.minimum(a, b) < m, (ex0 < m) & (np.maximum(a, b_low) > low) & (np.minimum(a, b_low) < top))
        in_high = np.where(t, np.maximum(a, b) > m, (ex1 > m) & (np.maximum(a_high, b) > low) & (np.minimum(a_high, b) < top))
        crossed = np.where(t, ~up & (ex0 < left) & (a > low) & (a < m), (ex0 < m) & ((a < low) != (b_low < low)))
        p = len(pnode)
        flip = _count(pair, crossed, p) % 2 == 1
        has = [_count(pair, in_low, p) > 0, _count(pair, in_high, p) > 0]
        pars = [ppar, ppar ^ flip]
        split_pair = ~leaf[pnode]
        full2, inmask2 = np.repeat(full, 2), np.repeat(inmask, 2)
        parts, number = [], []
        at_least = 0
        for side in (0, 1):
            without = split_pair & ~has[side]
            full2[2 * pnode[without & (powner >= 0) & pars[side]] + side] = True
            none = without & (powner < 0)
            inmask2[2 * pnode[none] + side] = pars[side][none]
            with_rows = split_pair & has[side]
            number.append(np.cumsum(with_rows) - 1 + at_least)
            at_least += int(with_rows.sum())
            parts.append((2 * pnode[with_rows] + side, powner[with_rows], pars[side][with_rows]))
        pnode, powner, ppar = (np.concatenate([u, v]) for u, v in zip(*parts))
        halves = ((in_low, 0, a, b_low), (in_high, 1, a_high, b))
        rows = [(2 * node[k] + side, e[k], ha[k], hb[k], number[side][pair[k]]) for k, side, ha, hb in halves]
        node, e, a, b, pair = (np.concatenate([u, v]) for u, v in zip(*rows))
        xl, yb, xr, yt = (np.repeat(v, 2) for v in (xl, yb, xr, yt))
        tall2, mid2, second = np.repeat(tall, 2), np.repeat(mid, 2), np.arange(2 * n) % 2 == 1
        yt = np.where(tall2 & ~second, mid2, yt)
        yb = np.where(tall2 & second, mid2, yb)
        xr = np.where(~tall2 & ~second, mid2, xr)
        xl = np.where(~tall2 & second, mid2, xl)
        before = np.repeat(held, 2)
        stale = np.where(np.bincount(node, minlength=2 * n) > 0.8 * before, np.repeat(stale, 2) + 1, 0)
        res, full, inmask = np.repeat(res, 2), full2, inmask2
        was_leaf = np.repeat(leaf, 2)  # they have no rows left; without own edges they go above
        full[was_leaf], inmask[was_leaf] = False, False


def _merged(spots):
    """{x: the least within NEAR of it} of crossings of one border."""
    out, first = {}, None
    for x in sorted(spots):
        if first is None or x - first > NEAR:
            first = x
        out[x] = first
    return out


def cell_segments(cell, pieces, uprights, base, full: bool, inmask: bool, keep: bool | None) -> list[tuple]:
    """[(edge, from, to)] of the outline within a cell, inside on the left; upright sides have edge -1.

    pieces: [cx0, cy0, cx1, cy1, x0, y0, x1, y1, owner, edge, side0, side1], the
    clipped and the whole edge; sides 1 and 2: that end is on the lower, upper
    border. uprights: [(x, y0, y1, owner)]. base: {owner: corner inside}, -1 the mask.
    """
    xl, yb, xr, yt = cell
    for side in (1, 2):
        spots = [p[2 * k] for p in pieces for k in (0, 1) if p[10 + k] == side]
        if len(spots) > 1:
            one = _merged(spots)
            for p in pieces:
                for k in (0, 1):
                    if p[10 + k] == side:
                        p[2 * k] = one[p[2 * k]]
    turns = [(p[2 * k], p[8]) for p in pieces for k in (0, 1) if p[10 + k] == 1]
    turns += [(x, o) for x, y0, y1, o in uprights if y0 < yb < y1]
    turns.sort()
    pieces = [p for p in pieces if p[0] < p[2]]

    def height(p, x):
        if x == p[0]:
            return p[1]
        if x == p[2]:
            return p[3]
        return p[5] + (x - p[4]) / (p[6] - p[4]) * (p[7] - p[5])

    own = {x for p in pieces for x in (p[0], p[2])} | {u[0] for u in uprights}
    own = sorted(x for x in own if xl < x < xr)
    more = []
    for i, p in enumerate(pieces):
        for q in pieces[i + 1 :]:
            lo, hi = max(p[0], q[0]), min(p[2], q[2])
            if lo < hi:
                d, f = height(p, lo) - height(q, lo), height(p, hi) - height(q, hi)
                if d * f < 0 and max(abs(d), abs(f)) > EPS:
                    more.append(lo + d / (d - f) * (hi - lo))
    xs = [xl, *own, xr]
    if more:
        from bisect import bisect_left

        kept = []
        for x in sorted(more):
            j = bisect_left(xs, x)
            if 0 < j < len(xs) and x - xs[j - 1] > NEAR and xs[j] - x > NEAR and (not kept or x - kept[-1] > NEAR):
                kept.append(x)
        xs = sorted(xs + kept)

    parity = dict(base)
    count = int(full) + sum(v for o, v in parity.items() if o >= 0)
    masked = parity.get(-1, inmask)

    def state(n, m):
        return n > 0 if keep is None else n > 0 and m == keep

    found, before, held, turned, low_left = [], [], [], 0, False
    for k, x in enumerate(xs):
        last = k == len(xs) - 1
        now, cur = [], []
        if not last:
            nx = xs[k + 1]
            cur = sorted((((height(p, x) + height(p, nx)) / 2, i) for i, p in enumerate(pieces) if p[0] <= x and p[2] >= nx))
            cur = [i for _, i in cur]
        # heights at x of edges that end here and of those that go on, made one
        inner = xl < x < xr
        values = sorted((height(pieces[i], x), i) for i in {*held, *cur})
        at, j = {}, 0
        while j < len(values):
            g = j + 1
            while g < len(values) and values[g][0] - values[g - 1][0] <= EPS:
                g += 1
            best = values[j][0]
            if g > j + 1 and inner:
                marked = [v for v, i in values[j:g] if x == pieces[i][0] or x == pieces[i][2]]
                best = marked[0] if marked else best
            for _, i in values[j:g]:
                at[i] = best
            j = g
        lefts, rights = [], []
        for i, above, xa, ya in before:
            y = at[i]
            lefts.append(y)
            if (xa, ya) != (x, y):
                found.append((pieces[i][9], (xa, ya), (x, y)) if above else (pieces[i][9], (x, y), (xa, ya)))
        low_right = False
        if not last:
            while turned < len(turns) and turns[turned][0] <= x:
                o = turns[turned][1]
                if o < 0:
                    masked = not masked
                else:
                    parity[o] = not parity[o]
                    count += 1 if parity[o] else -1
                turned += 1
            up, n, m = None, count, masked
            low_right = was = state(n, m)
            i = 0
            while i < len(cur):
                p = pieces[cur[i]]
                j = i + 1
                ya, far = at[cur[i]], height(p, nx)
                while j < len(cur) and abs(at[cur[j]] - ya) <= EPS and abs(height(pieces[cur[j]], nx) - far) <= EPS:
                    j += 1
                for c in cur[i:j]:
                    o = pieces[c][8]
                    if o < 0:
                        m = not m
                    else:
                        if up is None:
                            up = dict(parity)
                        up[o] = not up[o]
                        n += 1 if up[o] else -1
                is_now = state(n, m)
                if is_now != was:
                    now.append((min(cur[i:j], key=lambda c: pieces[c][9]), is_now, x, ya))
                    rights.append(ya)
                    was = is_now
                i = j
        if inner and (lefts != rights or low_left != low_right):
            points = sorted({yb, yt, *lefts, *rights})
            for u, v in zip(points, points[1:]):
                in_left = low_left ^ (sum(y <= u for y in lefts) % 2 == 1)
                in_right = low_right ^ (sum(y <= u for y in rights) % 2 == 1)
                if in_left != in_right:
                    found.append((-1, (x, u), (x, v)) if in_left else (-1, (x, v), (x, u)))
        before, held, low_left = now, cur, low_right
    return found


def closed_up(segments: list[tuple], left: float, right: float) -> list[tuple]:
    """segments with short links where ends on cell borders differ by rounding."""
    from collections import Counter

    balance = Counter()
    for _, _, a, b in segments:
        balance[a] += 1
        balance[b] -= 1
    loose = [(p, n) for p, n in balance.items() if n and p[0] != left and p[0] != right]
    if not loose:
        return segments
    out = list(segments)
    starts, ends = ([p for p, n in loose for _ in range(max(0, sign * n))] for sign in (1, -1))
    for p in ends:
        near = min(starts, key=lambda q: (abs(p[0] - q[0]) + abs(p[1] - q[1]), q), default=None)
        if near is not None and abs(p[0] - near[0]) + abs(p[1] - near[1]) < 1e-6:
            starts.remove(near)
            out.append((segments[0][0], -2, p, near))
    return out


def strip_outlines(x0, y0, x1, y1, owner, mask, root, boxes, keep):
    """{result: [(result, edge, from, to)]} of all cells of a strip."""
    found: dict = {}
    number = root[1]
    for cells, (node, e, a, b), (pnode, powner, ppar) in outline_cells(x0, y0, x1, y1, owner, mask, root[0], boxes, keep):
        xl, yb, xr, yt, res, full, inmask, leaf = cells
        ex0, ey0, ex1, ey1 = x0[e], y0[e], x1[e], y1[e]
        low, top = yb[node], yt[node]
        c0, c1 = np.maximum(ex0, xl[node]), np.minimum(ex1, xr[node])

        def ends(c, h):
            side = np.where(h < low, 1, np.where(h > top, 2, 0))
            y = np.where(side == 1, low, np.where(side == 2, top, h))
            with np.errstate(divide="ignore", invalid="ignore"):
                x = ex0 + (y - ey0) * ((ex1 - ex0) / (ey1 - ey0))
            return np.where(side > 0, np.minimum(np.maximum(x, c0), c1), c), y, side

        (cx0, cy0, s0), (cx1, cy1, s1) = ends(c0, a), ends(c1, b)
        o = np.where(mask[e], -1, owner[e])
        up = (ex0 == ex1).tolist()
        rows = list(map(list, zip(*(v.tolist() for v in (cx0, cy0, cx1, cy1, ex0, ey0, ex1, ey1, o, number[e], s0, s1)))))
        of: dict = {}
        for k, i in enumerate(node.tolist()):
            of.setdefault(i, ([], [], {}))
            if up[k]:
                r = rows[k]
                of[i][1].append((r[4], r[5], r[7], r[8]))
            else:
                of[i][0].append(rows[k])
        for i, w, inside in zip(pnode.tolist(), powner.tolist(), ppar.tolist()):
            of[i][2][w] = inside
        for i, (pieces, uprights, base) in of.items():
            out = int(res[i])
            got = cell_segments((float(xl[i]), float(yb[i]), float(xr[i]), float(yt[i])), pieces, uprights, base, bool(full[i]), bool(inmask[i]), keep)
            if got:
                found.setdefault(out, []).extend((out, *s) for s in got)
    return found
