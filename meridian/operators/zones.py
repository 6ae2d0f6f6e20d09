"""Zones: the first one, by id, that contains a point.

The plan depends on the zones' measured size. Few vertices are shipped to the tasks,
which then need no shuffle at all; beyond that bound points and zone boxes meet in an
equi-join on grid cells, whose size follows each zone's own, and what is in a box is dealt
out by zone, a polygon once for each lot of points. In both a box test comes first and the
polygon test runs over whole Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import multipolygon_contains, simplify_polygons
from ..schema import ZONES
from ..sources.shared import scratch

#: Zones of up to so many vertices in all (16 bytes each) may be sent to every task.
SENT_VERTICES = 1_000_000
TOLERANCE = 0.01


def arrays(polygon) -> list[list[np.ndarray]]:
    """A polygon column's value as arrays of (x, y) rows."""
    return [[np.array([(p["x"], p["y"]) for p in ring or []], float).reshape(-1, 2) for ring in rings or []] for rings in polygon or []]


def flat_arrays(polygon: pa.ListScalar) -> list[list[np.ndarray]]:
    """The same of a polygon in Arrow form, without a Python object for each vertex."""
    out = []
    for rings in polygon.values or ():
        own = []
        for ring in (rings.values if rings.is_valid else None) or ():
            points = ring.values
            own.append(np.zeros((0, 2)) if points is None else np.column_stack([points.field(i).to_numpy(zero_copy_only=False) for i in (0, 1)]).astype(float))
        out.append(own)
    return out


def nested(polygons: list[list[np.ndarray]]) -> list:
    return [[[{"x": float(a), "y": float(b)} for a, b in ring] for ring in rings] for rings in polygons]


def with_bounds(zones: DataFrame) -> DataFrame:
    """Boxes from outer rings; an empty polygon gets the box (0, 0, 0, 0)."""
    outer = F.flatten(F.transform(F.col("polygon"), lambda rings: F.coalesce(F.get(rings, F.lit(0)), F.array().cast("array<struct<x:double,y:double>>"))))
    of = lambda f, k: F.coalesce(f(F.transform(outer, lambda p: p[k])), F.lit(0.0))
    return zones.withColumns({"min_x": of(F.array_min, "x"), "min_y": of(F.array_min, "y"), "max_x": of(F.array_max, "x"), "max_y": of(F.array_max, "y")})


def load_zones(zones: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Zones as they are searched: the box of the given polygon, the polygon simplified.
    A polygon that vanishes in that never matches; tolerance 0 keeps all vertices."""
    boxed = with_bounds(zones)
    if not tolerance:
        return boxed.select([f.split()[0] for f in ZONES.split(", ")[:7]] + ["polygon"])

    def run(batches):
        for batch in batches:
            at = batch.schema.names.index("polygon")
            polygon = [nested(simplify_polygons(flat_arrays(p), tolerance)) for p in batch.column(at)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(polygon, batch.schema.field(at).type))

    rows = boxed.select("zone_id", "zone_type", "name", "min_x", "min_y", "max_x", "max_y", "polygon")
    return rows.mapInArrow(run, rows.schema)


def split_zones(zones: DataFrame, zone_type: int) -> DataFrame:
    return zones.where(F.col("zone_type") == zone_type)


def vertex_count(zones: DataFrame) -> int:
    each = F.aggregate(F.flatten(F.col("polygon")), F.lit(0).cast("long"), lambda a, ring: a + F.size(ring))
    return zones.agg(F.sum(F.coalesce(each, F.lit(0)) + 4)).first()[0] or 0


class Index:
    """Zones in order of their id, tested against batches of points."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by("zone_id")
        self.names, self.ids = rows["name"].to_pylist(), rows["zone_id"].to_pylist()
        self.boxes = np.column_stack([rows[c].to_numpy() for c in ("min_x", "min_y", "max_x", "max_y")]).astype(float).reshape(-1, 4)
        self.polygons = [flat_arrays(p) for p in rows["polygon"]]

    def first(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For each point the place of its first zone, -1 without one."""
        out = np.full(len(x), -1)
        order = np.argsort(x, kind="stable")
        low = np.searchsorted(x[order], self.boxes[:, 0], "left")
        high = np.searchsorted(x[order], self.boxes[:, 2], "right")
        for k, (a, b, box, polygon) in enumerate(zip(low, high, self.boxes, self.polygons)):
            some = order[a:b]
            some = some[(out[some] < 0) & (y[some] >= box[1]) & (y[some] <= box[3])]
            if len(some):
                out[some[multipolygon_contains(polygon, x[some], y[some])]] = k
        return out


def zone_of(points: DataFrame, zones: DataFrame, name: str, *, x: str = "lon", y: str = "lat", sent_vertices: int = SENT_VERTICES) -> DataFrame:
    """The points with the name of their first zone added, null where there is none.

    ``zones`` are loaded zones of one type. Null or NaN coordinates have no zone.
    """
    return zones_of(points, zones, {name: None}, x=x, y=y, sent_vertices=sent_vertices)


def zones_of(points: DataFrame, zones: DataFrame, types: dict[str, int | None], *, x: str = "lon", y: str = "lat", sent_vertices: int = SENT_VERTICES) -> DataFrame:
    """As ``zone_of`` for several types of zones at once (None: all), a column for each."""
    points = points.drop(*types)
    of_type = lambda t: zones if t is None else split_zones(zones, t)
    if not zones.is_cached:  # made once, however often it is looked at
        zones = scratch(zones, "zones")
    if vertex_count(zones) > sent_vertices:
        for name, t in types.items():
            points = _by_cells(points, of_type(t), name, x, y)
        return points
    rows = zones.toArrow()  # bounded by the count above
    indexes = [Index(rows if t is None else rows.filter(pc.equal(rows["zone_type"], t))) for t in types.values()]
    names = [*points.columns, *types]

    def run(batches):
        for batch in batches:
            xs, ys = (batch.column(batch.schema.names.index(c)).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in (x, y))
            ok, added = np.flatnonzero(np.isfinite(xs) & np.isfinite(ys)), []
            for index in indexes:
                found = np.full(len(xs), -1)
                found[ok] = index.first(xs[ok], ys[ok])
                words = pa.array([*index.names, None], pa.string())
                added.append(words.take(pa.array(np.where(found >= 0, found, len(index.names)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=names)

    return points.mapInArrow(run, ", ".join([_ddl(points), *(f"`{n}` string" for n in types)]))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


#: The smallest cell, in degrees; cells of a level are twice as wide as those before. Points
#: of one zone that meet its polygon in one task.
FINEST, LOT = 1e-6, 200_000


def _by_cells(points: DataFrame, zones: DataFrame, name: str, x: str, y: str) -> DataFrame:
    """The same by an equi-join on cells, without a polygon on any joined row.

    A zone enters the cells of its box at the level whose cells are as large as the box, so
    at most four (nine at the edge of rounding), whatever other zones are like; a place
    looks at one cell of each level that some zone has. Places in a box are then dealt out
    by zone in lots, and each lot gets the polygon once.
    """
    largest = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"), F.lit(FINEST))
    boxes = zones.withColumn("level", F.ceil(F.log2(largest / FINEST)).cast("int"))
    width = F.lit(FINEST) * F.pow(F.lit(2.0), F.col("level"))
    at = lambda c: F.floor(F.col(c) / width).cast("long")
    placed = boxes.withColumns({"cx": F.explode(F.sequence(at("min_x"), at("max_x")))}).withColumn("cy", F.explode(F.sequence(at("min_y"), at("max_y"))))
    placed = placed.select("level", "cx", "cy", "zone_id", "min_x", "min_y", "max_x", "max_y")
    levels = [r.level for r in boxes.select("level").distinct().collect()]  # some dozens at most
    places = points.select(F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")).where("__x is not null and __y is not null and not isnan(__x) and not isnan(__y)").distinct()
    asked = places.withColumn("level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>"))).withColumns({"cx": at("__x"), "cy": at("__y")})
    pairs = asked.join(placed, ["level", "cx", "cy"]).where(F.col("__x").between(F.col("min_x"), F.col("max_x")) & F.col("__y").between(F.col("min_y"), F.col("max_y"))).select("zone_id", "__x", "__y")
    pairs = scratch(pairs, "in-boxes")
    lots = pairs.groupBy("zone_id").agg(F.ceil(F.count(F.lit(1)) / LOT).cast("int").alias("lots"))
    dealt = pairs.join(lots, "zone_id").select("zone_id", F.pmod(F.xxhash64("__x", "__y"), F.col("lots")).cast("int").alias("lot"), F.lit(1).alias("kind"), "__x", "__y", F.lit(None).cast("string").alias("name"), F.lit(None).cast(zones.schema["polygon"].dataType).alias("polygon"))
    none = F.lit(None).cast("double")
    polygons = zones.join(lots, "zone_id").select("zone_id", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), F.lit(0).alias("kind"), none.alias("__x"), none.alias("__y"), "name", "polygon")

    def run(batches):
        key, polygon, word = None, [], None
        for batch in batches:
            zone, lot, kind, xs, ys = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            edges = np.flatnonzero(np.concatenate([[True], (zone[1:] != zone[:-1]) | (lot[1:] != lot[:-1]) | (kind[1:] != kind[:-1])]))
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(zone)]):
                if kind[a] == 0:  # a lot's polygon comes before its places
                    key, polygon, word = (zone[a], lot[a]), flat_arrays(batch.column(6)[a]), batch.column(5)[a].as_py()
                elif key == (zone[a], lot[a]):
                    hit = np.flatnonzero(multipolygon_contains(polygon, xs[a:b], ys[a:b])) + a
                    yield pa.RecordBatch.from_arrays([pa.array(xs[hit]), pa.array(ys[hit]), pa.array(zone[hit]), pa.array([word] * len(hit), pa.string())], names=["__x", "__y", "zone_id", "zone_name"])

    parts = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    stream = polygons.unionByName(dealt).repartition(parts, "zone_id", "lot").sortWithinPartitions("zone_id", "lot", "kind")
    # A place has one answer, however many points stand there.
    hits = stream.mapInArrow(run, "__x double, __y double, zone_id long, zone_name string").groupBy("__x", "__y").agg(F.min_by("zone_name", "zone_id").alias(name))
    return points.join(hits, (points[x] == hits["__x"]) & (points[y] == hits["__y"]), "left").drop("__x", "__y")


def rectangle(min_x, min_y, max_x, max_y):
    """A rectangle as a polygon column."""
    p = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    return F.array(F.array(F.array(p(min_x, min_y), p(max_x, min_y), p(max_x, max_y), p(min_x, max_y), p(min_x, min_y))))

