"""The choice among the points around each probe without a row for each pair.

The points near a probe are looked at where they meet, in one Python worker, so what is
shuffled are probes (once) and points (once for each cell that their surroundings touch).
Points come in order of (visit_ord, point_id) and are indexed in blocks that double, each
with a grid of about one point a cell. What a probe has found in the blocks before bounds
the circle that it must still look at, so it meets some points of each block and not all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FOLD, NEAREST, WEIGHT_FIRST, FIRST = "fold", "nearest", "weight_first", "first"

#: Points of the first block, and at most in one where the order of visits counts: there
#: all points near a probe may lie in one block.
LEAST, MOST = 64, 1 << 13
#: Pairs, or rows of grids, that are looked at at once.
PIECE = 1 << 20


class Grid:
    """Some points (by number) in cells of a regular grid, rows along the longer side."""

    def __init__(self, at: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        x, y = x[at], y[at]
        self.turned = np.ptp(y) > np.ptp(x)
        u, v = (y, x) if self.turned else (x, y)
        self.u0, self.v0, self.u1, self.v1 = u.min(), v.min(), u.max(), v.max()
        w, h = self.u1 - self.u0, self.v1 - self.v0
        side = max(np.sqrt(w * h / len(at)), w / len(at))
        self.per = 1 / side if side > 0 and np.isfinite(1 / side) else 0.0
        self.columns, self.rows = (int(s * self.per) + 1 for s in (w, h))
        place = self._at(v, self.v0, self.rows) * self.columns + self._at(u, self.u0, self.columns)
        order = np.argsort(place, kind="stable")
        self.points, self.heaviest = at[order], weight[at].max()
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=self.rows * self.columns))])

    def _at(self, c: np.ndarray, low: float, n: int) -> np.ndarray:
        return np.clip((c - low) * self.per, 0, n - 1).astype(np.int64)

    def pairs(self, who: np.ndarray, px: np.ndarray, py: np.ndarray, reach: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(probe, point) numbers of all that may lie within reach, all of a probe at once."""
        u, v = (py, px) if self.turned else (px, py)
        u, v = u[who], v[who]
        a, b, c, d = u - reach, u + reach, v - reach, v + reach
        some = np.flatnonzero((b >= self.u0) & (a <= self.u1) & (d >= self.v0) & (c <= self.v1))
        who, first, last = who[some], self._at(a[some], self.u0, self.columns), self._at(b[some], self.u0, self.columns)
        low, rows = self._at(c[some], self.v0, self.rows), self._at(d[some], self.v0, self.rows)
        rows = rows - low + 1
        for i, j in pieces(rows):
            own, row = spread(rows[i:j])
            own += i
            row = (row + low[own]) * self.columns
            start = self.starts[row + first[own]]
            n = self.starts[row + last[own] + 1] - start
            total = np.bincount(own - i, weights=n, minlength=j - i).astype(np.int64)
            edges = np.concatenate([[0], np.cumsum(rows[i:j])])
            for k, m in pieces(total):
                part = slice(edges[k], edges[m])
                which, at = spread(n[part])
                if len(which):
                    yield who[own[part][which]], self.points[start[part][which] + at]


def pieces(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of items of about PIECE in all, at least one item each."""
    ends, i = np.cumsum(sizes), 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PIECE, "right")))
        yield i, j
        i = j


def spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each k the number k as often as n[k] says, and 0, 1, 2 and so on beside it."""
    own = np.repeat(np.arange(len(n)), n)
    return own, np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)


def firsts(sorted_keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)


def blocks(order: np.ndarray, visit: np.ndarray | None, most: int) -> list[np.ndarray]:
    """The order in parts that double in length; one visit's points stay in one part."""
    out, i, size = [], 0, LEAST
    while i < len(order):
        j = min(i + size, len(order))
        if visit is not None:
            while j < len(order) and visit[order[j]] == visit[order[j - 1]]:
                j += 1
        out.append(order[i:j])
        i, size = j, min(size * 2, most)
    return out


class Nearby:
    """Points in order of their visits, and what each of many probes takes of them."""

    def __init__(self, x: np.ndarray, y: np.ndarray, visit: np.ndarray, weight: np.ndarray, radius: float, mode: str):
        self.x, self.y, self.visit, self.weight, self.radius = x, y, visit, weight, radius
        self.limit = radius * radius
        n = len(x)
        if mode == FOLD:
            parts = blocks(np.arange(n)[::-1], visit, MOST)
        elif mode == FIRST:
            parts = blocks(np.arange(n), None, MOST)
        else:
            mixed = np.random.default_rng(n).permutation(n)  # so that each block is spread over all
            parts = blocks(mixed if mode == NEAREST else mixed[np.argsort(-weight[mixed], kind="stable")], None, n)
        self.grids = [Grid(p, x, y, weight) for p in parts]

    def _within(self, grid: Grid, who, px, py, bound) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(probe, point, d2) of pairs within the bound, a squared distance for each of who."""
        reach = np.sqrt(bound) * (1 + 1e-9) + 1e-150
        for p, j in grid.pairs(who, px, py, reach):
            dx, dy = px[p] - self.x[j], py[p] - self.y[j]
            d2 = dx * dx + dy * dy
            ok = np.flatnonzero(d2 <= self.limit)
            if len(ok):
                yield p[ok], j[ok], d2[ok]

    def first(self, px: np.ndarray, py: np.ndarray, k: int) -> np.ndarray:
        """The first k points of each probe by number, -1 where there are fewer."""
        out, n = np.full((len(px), k), -1), np.zeros(len(px), np.int64)
        for grid in self.grids:
            who = np.flatnonzero(n < k)
            if not len(who):
                break
            for p, j, _ in self._within(grid, who, px, py, np.full(len(who), self.limit)):
                order = np.lexsort((j, p))
                p, j = p[order], j[order]
                starts = firsts(p)
                sizes = np.diff(np.concatenate([starts, [len(p)]]))
                place = n[p] + np.arange(len(p)) - np.repeat(starts, sizes)
                ok = place < k
                out[p[ok], place[ok]] = j[ok]
                n[p[starts]] += sizes
        return out

    def best(self, px: np.ndarray, py: np.ndarray, mode: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(point, d2, least d2, largest weight) of each probe; -1 and inf where there is
        none. The last two are of all within the radius for the fold, else of the point."""
        n = len(px)
        best, near = np.full(n, -1), np.full(n, np.inf)
        none = np.int64(self.weight.min()) - 1 if len(self.weight) else 0
        heavy = np.full(n, none, np.int64)
        own = np.full(n, np.inf)
        step = {FOLD: self._fold, NEAREST: self._nearest, WEIGHT_FIRST: self._heaviest}[mode]
        for grid in self.grids:
            who = np.arange(n)
            if mode == WEIGHT_FIRST:
                who = np.flatnonzero(heavy <= grid.heaviest)
            bound = np.minimum(near[who], self.limit)
            if mode == FOLD:
                bound[heavy[who] < grid.heaviest] = self.limit
            for p, j, d2 in self._within(grid, who, px, py, bound):
                step(p, j, d2, best, own, near, heavy)
        return best, own, near, heavy

    def _nearest(self, p, j, d2, best, own, near, heavy) -> None:
        order = np.lexsort((j, d2, p))
        order = order[firsts(p[order])]
        p, j, d2 = p[order], j[order], d2[order]
        better = (d2 < near[p]) | ((d2 == near[p]) & (j < best[p]))
        p, j, d2 = p[better], j[better], d2[better]
        best[p], own[p], near[p], heavy[p] = j, d2, d2, self.weight[j]

    def _heaviest(self, p, j, d2, best, own, near, heavy) -> None:
        order = np.lexsort((j, d2, -self.weight[j], p))
        order = order[firsts(p[order])]
        p, j, d2 = p[order], j[order], d2[order]
        w = self.weight[j]
        better = (w > heavy[p]) | ((w == heavy[p]) & ((d2 < near[p]) | ((d2 == near[p]) & (j < best[p]))))
        p, j, d2 = p[better], j[better], d2[better]
        best[p], own[p], near[p], heavy[p] = j, d2, d2, self.weight[j]

    def _fold(self, p, j, d2, best, own, near, heavy) -> None:
        """From the last visit back: what no later one is nearer or heavier than is the
        choice so far. Others count only if they are nearer or heavier than all later ones."""
        w = self.weight[j]
        some = np.flatnonzero((d2 <= near[p]) | (w > heavy[p]))
        if not len(some):
            return
        p, j, d2, w = p[some], j[some], d2[some], w[some]
        order = np.lexsort((-w, -d2, -self.visit[j], p))
        p, j, d2, w = p[order], j[order], d2[order], w[order]
        starts = firsts(p)
        m, count = len(p), len(starts)
        each = np.repeat(np.arange(count), np.diff(np.concatenate([starts, [m]])))
        # A probe's state before its pairs; ranks in place of distances, so that what was
        # summed up of one probe can be put apart from the next one's by whole numbers.
        at, before = np.arange(m) + each + 1, starts + np.arange(count)
        key, far, big = np.empty(m + count, np.int64), np.empty(m + count), np.empty(m + count, np.int64)
        key[at], key[before] = each, np.arange(count)
        far[at], far[before] = d2, near[p[starts]]
        big[at], big[before] = w, heavy[p[starts]]
        values, rank = np.unique(far, return_inverse=True)
        low = big.min()
        span = int(big.max() - low) + 1
        least = np.minimum.accumulate(rank + (count - 1 - key) * len(values)) - (count - 1 - key) * len(values)
        most = np.maximum.accumulate(big - low + key * span) - key * span
        ok = (rank[at] <= least[at - 1]) & (big[at] - low >= most[at - 1])
        best[p[ok]], own[p[ok]] = j[ok], d2[ok]  # of several the last one stays
        ends = np.concatenate([before[1:], [m + count]]) - 1
        near[p[starts]], heavy[p[starts]] = values[least[ends]], most[ends] + low
