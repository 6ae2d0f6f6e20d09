"""Geometry on columns (arithmetic and higher-order functions) and on numpy arrays."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Radius in metres of the haversine distance.
EARTH_RADIUS = 6_378_100.0
#: Radius in metres of distances along lines.
GEO_RADIUS = 6_378_137.0


# ---- columns


def squared_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Plane distance, squared, in degrees."""
    return (x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    half = lambda a, b: F.pow(F.sin((F.radians(b) - F.radians(a)) / 2), 2)
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * EARTH_RADIUS * F.asin(F.sqrt(h))


def signed_area(ring: Column) -> Column:
    """Shoelace area of an array of (x, y); positive if counter-clockwise."""
    after = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, F.lit(1), F.lit(1)))
    terms = F.transform(F.arrays_zip(ring.alias("a"), after.alias("b")), lambda p: p["a"]["x"] * p["b"]["y"] - p["b"]["x"] * p["a"]["y"])
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t) / 2


def centroid(ring: Column) -> Column:
    """Area centroid of a ring as (x, y); the vertices' mean where the area is zero; (0, 0)
    without vertices. Sums are taken from the first vertex for accuracy."""
    x0, y0 = F.get(ring, F.lit(0))["x"], F.get(ring, F.lit(0))["y"]
    after = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, F.lit(1), F.lit(1)))
    pairs = F.arrays_zip(ring.alias("a"), after.alias("b"))

    def parts(p):
        ax, ay, bx, by = p["a"]["x"] - x0, p["a"]["y"] - y0, p["b"]["x"] - x0, p["b"]["y"] - y0
        cross = ax * by - bx * ay
        return F.struct(((ax + bx) * cross).alias("x"), ((ay + by) * cross).alias("y"), cross.alias("c"))

    zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("c"))
    s = F.aggregate(F.transform(pairs, parts), zero, lambda a, p: F.struct((a["x"] + p["x"]).alias("x"), (a["y"] + p["y"]).alias("y"), (a["c"] + p["c"]).alias("c")))
    mean = lambda k: F.aggregate(ring, F.lit(0.0), lambda a, p: a + p[k]) / F.size(ring)
    empty = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    flat = F.struct(mean("x").alias("x"), mean("y").alias("y"))
    full = F.struct((x0 + s["x"] / (3 * s["c"])).alias("x"), (y0 + s["y"] / (3 * s["c"])).alias("y"))
    return F.when(F.coalesce(F.size(ring), F.lit(0)) <= 0, empty).when(s["c"] == 0, flat).otherwise(full)


def ring_contains(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd test with strict comparisons; for short rings (cost is linear in vertices)."""
    after = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, F.lit(1), F.lit(1)))

    def crosses(p):
        ay, by = p["a"]["y"], p["b"]["y"]
        return ((ay > y) != (by > y)) & (x < (p["b"]["x"] - p["a"]["x"]) * (y - ay) / F.when(by == ay, F.lit(1.0)).otherwise(by - ay) + p["a"]["x"])

    return F.size(F.filter(F.arrays_zip(ring.alias("a"), after.alias("b")), crosses)) % 2 == 1


def segment_distance_squared(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Squared distance from a point to a segment."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / F.when(length == 0, F.lit(1.0)).otherwise(length))))
    return squared_distance(px, py, ax + t * dx, ay + t * dy)


def cantor_pair(a: Column, b: Column) -> Column:
    """The pairing number of two non-negative integers."""
    return F.floor((a + b) * (a + b + 1) / 2) + b


# ---- numpy


def ring_hits(ring: np.ndarray, px: np.ndarray, py: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(inside by even-odd, on an edge) for points against one ring of (x, y) rows."""
    if len(ring) == 0:
        return np.zeros(len(px), bool), np.zeros(len(px), bool)
    a, b = ring, np.roll(ring, -1, axis=0)
    inside, edge = np.zeros(len(px), bool), np.zeros(len(px), bool)
    step = max(1, 2_000_000 // len(ring))
    for k in range(0, len(px), step):
        x, y = px[k : k + step, None], py[k : k + step, None]
        above = (a[:, 1] > y) != (b[:, 1] > y)
        with np.errstate(divide="ignore", invalid="ignore"):
            at = (b[:, 0] - a[:, 0]) * (y - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]
        inside[k : k + step] = (above & (x < at)).sum(axis=1) % 2 == 1
        cross = (b[:, 0] - a[:, 0]) * (y - a[:, 1]) - (b[:, 1] - a[:, 1]) * (x - a[:, 0])
        near = (np.minimum(a[:, 0], b[:, 0]) <= x) & (x <= np.maximum(a[:, 0], b[:, 0])) & (np.minimum(a[:, 1], b[:, 1]) <= y) & (y <= np.maximum(a[:, 1], b[:, 1]))
        edge[k : k + step] = ((cross == 0) & near).any(axis=1)
    return inside, edge


def multipolygon_contains(polygons: list[list[np.ndarray]], px: np.ndarray, py: np.ndarray) -> np.ndarray:
    """In some polygon's outer ring, or on it, and neither in nor on one of its holes.
    A polygon without an outer ring contains nothing."""
    found = np.zeros(len(px), bool)
    for rings in polygons:
        if not rings or len(rings[0]) == 0:
            continue
        todo = np.flatnonzero(~found)
        if not len(todo):
            break
        inside, edge = ring_hits(rings[0], px[todo], py[todo])
        ok = inside | edge
        for hole in rings[1:]:
            if ok.any():
                i, e = ring_hits(hole, px[todo], py[todo])
                ok &= ~(i | e)
        found[todo] = ok
    return found


def line_distances(points: np.ndarray) -> np.ndarray:
    """Lengths in metres of a line's segments; points are (lon, lat) rows."""
    r = np.radians(points)
    dlon, dlat = np.diff(r[:, 0]), np.diff(r[:, 1])
    h = np.sin(dlat / 2) ** 2 + np.cos(r[:-1, 1]) * np.cos(r[1:, 1]) * np.sin(dlon / 2) ** 2
    return 2 * GEO_RADIUS * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


def resample(points: np.ndarray, spacing: float) -> np.ndarray:
    """Evenly spaced points along a line, about ``spacing`` metres apart, ends kept."""
    if len(points) < 2 or spacing <= 0:
        return points
    along = np.concatenate([[0], np.cumsum(line_distances(points))])
    if along[-1] == 0:
        return points[:1].repeat(2, axis=0)
    n = int(along[-1] / spacing) + 1
    at = np.linspace(0, along[-1], max(n, 2))
    out = np.column_stack([np.interp(at, along, points[:, 0]), np.interp(at, along, points[:, 1])])
    out[0], out[-1] = points[0], points[-1]
    return out


def simplify_line(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker: drops vertices within the tolerance of the chord."""
    if len(points) < 3 or tolerance <= 0:
        return points
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        p, a, d = points[i + 1 : j], points[i], points[j] - points[i]
        length = float(d @ d)
        t = np.clip(((p - a) @ d) / length, 0, 1)[:, None] if length else np.zeros((len(p), 1))
        off = ((p - a - t * d) ** 2).sum(axis=1)
        k = int(off.argmax())
        if off[k] > tolerance * tolerance:
            keep[i + 1 + k] = True
            todo += [(i, i + 1 + k), (i + 1 + k, j)]
    return points[keep]


def simplify_polygons(polygons: list[list[np.ndarray]], tolerance: float) -> list[list[np.ndarray]]:
    """Simplifies every ring; rings of two vertices or fewer vanish, and a polygon with
    its outer ring."""
    out = []
    for rings in polygons:
        simple = [simplify_line(r, tolerance) for r in rings]
        if simple and len(simple[0]) > 2:
            out.append([simple[0], *(r for r in simple[1:] if len(r) > 2)])
    return out


def bounds(polygons: list[list[np.ndarray]]) -> tuple[float, float, float, float] | None:
    """(min_x, min_y, max_x, max_y) over outer rings, or None without vertices."""
    outer = [r[0] for r in polygons if r and len(r[0])]
    if not outer:
        return None
    flat = np.concatenate(outer)
    return (*flat.min(axis=0).tolist(), *flat.max(axis=0).tolist())


def ring_area(ring: np.ndarray) -> float:
    a, b = ring, np.roll(ring, -1, axis=0)
    return float((a[:, 0] * b[:, 1] - b[:, 0] * a[:, 1]).sum() / 2)


def ring_centroid(ring: np.ndarray) -> tuple[float, float]:
    """As ``centroid``, for an array of rows."""
    if len(ring) == 0:
        return 0.0, 0.0
    p = ring - ring[0]
    q = np.roll(p, -1, axis=0)
    cross = p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]
    if cross.sum() == 0:
        return tuple(ring.mean(axis=0).tolist())
    c = ((p + q) * cross[:, None]).sum(axis=0) / (3 * cross.sum()) + ring[0]
    return float(c[0]), float(c[1])


def polygon_centroid(polygons: list[list[np.ndarray]]) -> tuple[float, float]:
    """Area-weighted centroid, holes taken off."""
    total, sx, sy = 0.0, 0.0, 0.0
    for rings in polygons:
        for k, ring in enumerate(rings):
            if len(ring) < 3:
                continue
            area = abs(ring_area(ring)) * (1 if k == 0 else -1)
            x, y = ring_centroid(ring)
            total, sx, sy = total + area, sx + area * x, sy + area * y
    if total == 0:
        return ring_centroid(polygons[0][0]) if polygons and polygons[0] else (0.0, 0.0)
    return sx / total, sy / total


def scatter_in(polygons: list[list[np.ndarray]], spacing: float, seed: int, tries: int = 10) -> np.ndarray:
    """Points in the polygons, no two closer than ``spacing`` (Bridson's Poisson disc)."""
    box = bounds(polygons)
    if box is None:
        return np.zeros((0, 2))
    x0, y0, x1, y1 = box
    rng, cell = np.random.default_rng(seed), spacing / math.sqrt(2)
    grid: dict[tuple[int, int], tuple[float, float]] = {}
    at = lambda p: (int((p[0] - x0) / cell), int((p[1] - y0) / cell))
    first = (float(rng.uniform(x0, x1)), float(rng.uniform(y0, y1)))
    grid[at(first)] = first
    active, placed = [first], [first]
    while active:
        k = int(rng.integers(len(active)))
        base = active[k]
        for _ in range(tries):
            r, angle = spacing * (1 + rng.random()), 2 * math.pi * rng.random()
            p = (base[0] + r * math.cos(angle), base[1] + r * math.sin(angle))
            if not (x0 <= p[0] <= x1 and y0 <= p[1] <= y1):
                continue
            i, j = at(p)
            near = (grid.get((i + a, j + b)) for a in range(-2, 3) for b in range(-2, 3))
            if all(q is None or (q[0] - p[0]) ** 2 + (q[1] - p[1]) ** 2 >= spacing * spacing for q in near):
                grid[i, j] = p
                active.append(p)
                placed.append(p)
                break
        else:
            active[k] = active[-1]
            active.pop()
    points = np.array(placed)
    return points[multipolygon_contains(polygons, points[:, 0], points[:, 1])]


def point_to_polygon_distance(polygons: list[list[np.ndarray]], x: float, y: float) -> float:
    """Distance to the nearest edge, positive inside and negative outside."""
    best = math.inf
    p = np.array([x, y])
    for ring in (r for rings in polygons for r in rings if len(r)):
        a, d = ring, np.roll(ring, -1, axis=0) - ring
        length = (d * d).sum(axis=1)
        t = np.clip(((p - a) * d).sum(axis=1) / np.where(length == 0, 1, length), 0, 1)[:, None]
        best = min(best, float(((p - a - t * d) ** 2).sum(axis=1).min()))
    inside = bool(multipolygon_contains(polygons, np.array([x]), np.array([y]))[0])
    return math.sqrt(best) * (1 if inside else -1)


def centroid_cell(polygon: list[np.ndarray]) -> tuple[float, float, float]:
    """(x, y, distance): a polygon's centroid with its signed distance to the edge."""
    x, y = ring_centroid(polygon[0]) if polygon else (0.0, 0.0)
    return x, y, point_to_polygon_distance([polygon], x, y) if polygon else -math.inf
