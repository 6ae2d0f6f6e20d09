"""Queries of the way from map objects to stored caches and back.

The objects are derived from the star-schema tables: customers are house nodes, suppliers
houses drawn as ways and as relations of two squares, one with a hole, parts are roads
along meridians, nations countries and cities, regions bands whose borders come in four ways
and have a vertex that simplification drops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import GEO_RADIUS
from ..operators.geocode import ReverseGeocoder
from ..operators.osm import Config, generate
from ..operators.spatial import NEAREST
from ..sources.cache_files import read_metadata, read_points, read_zones, sizes, write_all, write_cache
from ..sources.osm_pbf import read_osm, write_extracts
from ..sources.shared import new_folder
from .derived import RADIUS, SQL, points, probes, table, zones
from .registry import query

SHIFT, HALF, SPACING = 0.003, 0.0004, 150.0
#: First ids of derived objects: corners of houses, pairs, roads, cities, countries, regions and areas.
HOUSE, PAIR, ROAD, CITY, COUNTRY, BAND, AREA = (k * 10**9 for k in range(1, 8))


def tags(**pairs: str):
    """A map column of the entries whose expression is not null; __ stands for a colon."""
    entries = ", ".join(f"struct('{k.replace('__', ':')}' AS key, {v} AS value)" for k, v in pairs.items())
    return F.expr(f"map_from_entries(filter(array({entries}), e -> e.value IS NOT NULL))")


def corners(rows: DataFrame, base: int, places: list[tuple[str, str]], per: int = 20, at: int = 0) -> DataFrame:
    """Nodes without tags at (x, y) expressions of rows with a key k."""
    each = F.array(*[F.struct(F.lit(at + i).alias("i"), F.expr(x).alias("lon"), F.expr(y).alias("lat")) for i, (x, y) in enumerate(places)])
    return rows.select("k", F.explode(each).alias("c")).select((F.lit(base) + F.col("k") * per + F.col("c.i")).alias("id"), "c.lat", "c.lon", F.expr("CAST(map() AS MAP<STRING, STRING>)").alias("tags"))


def way(rows: DataFrame, base: int, key: int, refs: list[int], of, per: int = 20) -> DataFrame:
    """A way a row, through corners of the row."""
    return rows.select((F.lit(base) + F.col("k") * per + key).alias("id"), F.array(*[F.lit(base) + F.col("k") * per + r for r in refs]).alias("nodes"), of.alias("tags"))


def relation(rows: DataFrame, base: int, members: list[tuple[int, str]], of, per: int = 20) -> DataFrame:
    """A relation a row, of ways of the row."""
    parts = [F.struct(F.lit("way").alias("type"), (F.lit(base) + F.col("k") * per + w).alias("ref"), F.lit(r).alias("role"), F.lit(0).cast("tinyint").alias("orientation")) for w, r in members]
    return rows.select((F.lit(base) + F.col("k") * per).alias("id"), F.array(*parts).alias("members"), of.alias("tags"))


def plain():
    return F.expr("CAST(map() AS MAP<STRING, STRING>)")


def box(x0: str, y0: str, x1: str, y1: str) -> list[tuple[str, str]]:
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def around(dx: float, half: float) -> list[tuple[str, str]]:
    return box(f"x + {dx}D - {half}D", f"y - {half}D", f"x + {dx}D + {half}D", f"y + {half}D")


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def map_objects(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, ways, relations) of the derived map, without areas."""
    c = points(spark, sf_dir)
    home = tags(building="CASE WHEN point_id % 5 <> 0 THEN 'yes' END", addr__housenumber="house_number", addr__street="street", addr__city="CASE WHEN point_id % 2 = 0 THEN concat('Own', point_id % 7) END", name="name")
    nodes = [c.select(F.col("point_id").alias("id"), F.col("y").alias("lat"), F.col("x").alias("lon"), home.alias("tags"))]
    ways, relations = [], []

    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS k", "s_name", "(s_suppkey * 7919 % 2003) / 100.0D + 0.005D AS x", "(s_suppkey * 104729 % 1999) / 100.0D + 0.005D AS y")
    nodes.append(corners(s, HOUSE, around(0, HALF)))
    ways.append(way(s, HOUSE, 0, [0, 1, 2, 3, 0], tags(building="'yes'", addr__housenumber="CAST(k AS STRING)", addr__street="concat('Way', k % 13)", name="s_name")))
    pair = s.where("k % 3 = 0")
    nodes += [corners(pair, PAIR, around(0.02, HALF * 5)), corners(pair, PAIR, around(0.03, HALF * 5), at=4), corners(pair, PAIR, around(0.021, HALF * 5 / 4), at=8)]
    ways += [way(pair, PAIR, k, [4 * k, 4 * k + 1, 4 * k + 2, 4 * k + 3, 4 * k], plain()) for k in range(3)]
    relations.append(relation(pair, PAIR, [(0, "outer"), (1, "outer"), (2, "inner")], tags(type="'multipolygon'", building="'yes'", addr__housenumber="CAST(k AS STRING)", addr__street="'Pair'", name="s_name")))

    p = table(spark, sf_dir, "part").selectExpr("p_partkey AS k", "p_brand", "(p_partkey * 31 % 2000) / 100.0D + 0.0011D AS x", "(p_partkey * 17 % 1900) / 100.0D + 0.0011D AS y", "0.002D + (p_partkey % 7) * 0.003D AS h")
    nodes.append(corners(p, ROAD, [("x", "y"), ("x", "y + h / 4"), ("x", "y + h")]))
    ways.append(way(p, ROAD, 0, [0, 1, 2], tags(highway="element_at(array('primary', 'tertiary', 'primary_link'), CAST(k % 3 AS INT) + 1)", ref="CASE WHEN k % 2 = 0 THEN concat('R', k % 11) END", name="CASE WHEN k % 5 <> 0 THEN p_brand END", addr__street="CASE WHEN k % 4 = 0 THEN 'Own street' END")))

    n = table(spark, sf_dir, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS k", "n_name", f"(n_nationkey % 5) * 4.5D - {SHIFT}D AS x", f"floor(n_nationkey / 5) * 4.2D - {SHIFT}D AS y")
    towns = n.where("k % 2 = 0")
    nodes.append(corners(towns, CITY, box("x + 1", "y + 1", "x + 2.5D", "y + 3")))
    ways.append(way(towns, CITY, 0, [0, 1, 2, 3, 0], plain()))
    relations.append(relation(towns, CITY, [(0, "outer")], tags(type="'boundary'", place="'city'", name="concat('City_', k)")))
    nodes.append(corners(n, COUNTRY, box("x", "y", "x + 4.5D", "y + 4.2D")))
    ways += [way(n, COUNTRY, 0, [0, 1, 2], plain()), way(n, COUNTRY, 1, [0, 3, 2], plain())]
    relations.append(relation(n, COUNTRY, [(0, "outer"), (1, "outer")], tags(type="'boundary'", boundary="'administrative'", admin_level="'2'", name="CASE WHEN k % 7 <> 3 THEN n_name END")))
    r = table(spark, sf_dir, "region").selectExpr("CAST(r_regionkey AS BIGINT) AS k", "r_name", f"-{SHIFT}D AS x", f"r_regionkey * 4.2D - {SHIFT}D AS y")
    nodes.append(corners(r, BAND, [*box("x", "y", "x + 21", "y + 4.2D"), ("x + 10", "y - 0.004D")]))
    ways += [way(r, BAND, 0, [2, 3], plain()), way(r, BAND, 1, [0, 4, 1], plain()), way(r, BAND, 2, [0, 3], plain()), way(r, BAND, 3, [1, 2], plain())]
    relations.append(relation(r, BAND, [(0, "outer"), (1, "outer"), (2, "outer"), (3, "outer")], tags(type="'boundary'", boundary="'administrative'", admin_level="'4'", name="r_name")))
    return union(nodes), union(ways), union(relations)


_MAP = f"""
WITH bands AS (SELECT CAST(r_regionkey AS BIGINT) AS k, r_name AS name, -{SHIFT}::DOUBLE AS x0, r_regionkey * 4.2::DOUBLE - {SHIFT}::DOUBLE AS y0 FROM region),
lattice AS (SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name, (n_nationkey % 5) * 4.5::DOUBLE - {SHIFT}::DOUBLE AS x0, (n_nationkey // 5) * 4.2::DOUBLE - {SHIFT}::DOUBLE AS y0 FROM nation),
c AS (SELECT c_custkey AS id, (c_custkey * 7919 % 2003) / 100.0::DOUBLE AS x, (c_custkey * 104729 % 1999) / 100.0::DOUBLE AS y, c_name, c_mktsegment, c_custkey % 97 AS n FROM customer),
s AS (SELECT s_suppkey AS k, s_name, (s_suppkey * 7919 % 2003) / 100.0::DOUBLE + 0.005::DOUBLE AS x, (s_suppkey * 104729 % 1999) / 100.0::DOUBLE + 0.005::DOUBLE AS y FROM supplier),
p AS (SELECT p_partkey AS k, p_brand, (p_partkey * 31 % 2000) / 100.0::DOUBLE + 0.0011::DOUBLE AS x, (p_partkey * 17 % 1900) / 100.0::DOUBLE + 0.0011::DOUBLE AS y, 0.002::DOUBLE + (p_partkey % 7) * 0.003::DOUBLE AS h, CASE WHEN p_partkey % 2 = 0 THEN 'R' || p_partkey % 11 || ' ' ELSE '' END || CASE WHEN p_partkey % 5 <> 0 THEN p_brand ELSE '' END AS road FROM part WHERE p_partkey % 3 <> 2),
along AS (SELECT *, greatest(CAST(floor({GEO_RADIUS}::DOUBLE * radians(h) / {SPACING}::DOUBLE) AS BIGINT) + 1, 2) AS n FROM p),
placed AS (SELECT 'n' AS source, id, 0 AS seq, x, y, c_name AS name, c_mktsegment AS street, CAST(n AS VARCHAR) AS house_number, CASE WHEN id % 2 = 0 THEN 'Own' || id % 7 END AS own_city, 10 AS weight FROM c WHERE id % 5 <> 0
UNION ALL SELECT 'w', {HOUSE} + 20 * k, 0, x, y, s_name, 'Way' || k % 13, CAST(k AS VARCHAR), NULL, 10 FROM s
UNION ALL SELECT 'r', {PAIR} + 20 * k, 0, x + 0.03::DOUBLE, y, s_name, 'Pair', CAST(k AS VARCHAR), NULL, 10 FROM s WHERE k % 3 = 0
UNION ALL SELECT 'r', {PAIR} + 20 * k, 1, x + 0.02::DOUBLE - 0.001::DOUBLE / 15, y, s_name, 'Pair', CAST(k AS VARCHAR), NULL, 10 FROM s WHERE k % 3 = 0
UNION ALL SELECT 'w', {ROAD} + 20 * k, i, x, y + h * i / (n - 1), CASE WHEN k % 4 = 0 THEN road ELSE '' END, CASE WHEN k % 4 = 0 THEN 'Own street' ELSE road END, '', NULL, 5 FROM (SELECT *, unnest(range(n)) AS i FROM along)),
answered AS (SELECT placed.*, (SELECT any_value(name) FROM bands b WHERE placed.y BETWEEN y0 AND y0 + 4.2::DOUBLE AND placed.x BETWEEN x0 AND x0 + 21) AS region, (SELECT any_value('City_' || k) FROM lattice l WHERE k % 2 = 0 AND placed.x BETWEEN x0 + 1 AND x0 + 2.5::DOUBLE AND placed.y BETWEEN y0 + 1 AND y0 + 3) AS city FROM placed)
"""


def micro(c: str):
    return F.round(F.col(c) * 1e6).cast("long").alias(c)


@query(_MAP + "SELECT row_number() OVER (ORDER BY source, id, seq) - 1 AS point_id, CAST(round(x * 1e6::DOUBLE) AS BIGINT) AS x, CAST(round(y * 1e6::DOUBLE) AS BIGINT) AS y, name, street, house_number, coalesce(own_city, city, '') AS city, coalesce(region, '') AS region, CAST(weight AS SMALLINT) AS weight FROM answered")
def build_points(spark, sf_dir):
    """Nodes, ways and relations become numbered points with names, cities and regions."""
    made, _ = generate(*map_objects(spark, sf_dir), Config(road_spacing=SPACING))
    return made.select("point_id", micro("x"), micro("y"), "name", "street", "house_number", "city", "region", "weight")


@query(_MAP + "SELECT 2 AS zone_type, 5000000000 + 20 * k AS zone_id, name, 5 AS vertices, CAST(round(x0 * 1e6::DOUBLE) AS BIGINT) AS min_x, CAST(round(y0 * 1e6::DOUBLE) AS BIGINT) AS min_y, CAST(round((x0 + 4.5::DOUBLE) * 1e6::DOUBLE) AS BIGINT) AS max_x, CAST(round((y0 + 4.2::DOUBLE) * 1e6::DOUBLE) AS BIGINT) AS max_y, 18900000 AS area FROM lattice WHERE k % 7 <> 3 UNION ALL SELECT 1, 6000000000 + 20 * k, name, 5, CAST(round(x0 * 1e6::DOUBLE) AS BIGINT), CAST(round(y0 * 1e6::DOUBLE) AS BIGINT), CAST(round((x0 + 21) * 1e6::DOUBLE) AS BIGINT), CAST(round((y0 + 4.2::DOUBLE) * 1e6::DOUBLE) AS BIGINT), 88200000 FROM bands")
def build_zones(spark, sf_dir):
    """Borders in parts become closed, turned, simplified rings with the box of what is left."""
    from ..functions.geometry import signed_area

    _, made = generate(*map_objects(spark, sf_dir))
    ring = F.get(F.get("polygon", F.lit(0)), F.lit(0))
    return made.select(F.col("zone_type").cast("int").alias("zone_type"), "zone_id", "name", F.size(ring).alias("vertices"), micro("min_x"), micro("min_y"), micro("max_x"), micro("max_y"), F.round(signed_area(ring) * 1e6).cast("int").alias("area"))


_AREAS = f"SELECT {AREA} + 20 * n_nationkey AS k, CASE WHEN n_nationkey % 2 = 0 THEN 'industrial' ELSE 'protected' END AS kind, n_name, 0.5::DOUBLE + n_nationkey * 0.5::DOUBLE AS x, n_nationkey * 0.3::DOUBLE AS y FROM nation"


@query(f"WITH a AS ({_AREAS}) SELECT n_name AS name, CAST(CASE kind WHEN 'industrial' THEN 3 ELSE 2 END AS INTEGER) AS weight, true AS inside, true AS apart, true AS filled FROM a WHERE n_name NOT LIKE 'NATION_1%' AND n_name NOT LIKE 'A%'")
def build_areas(spark, sf_dir):
    """Areas with a name are filled with points: all inside, none nearer than the spacing
    to another, and so many that no more than a third of the room can be left."""
    n = table(spark, sf_dir, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS k", "n_name", "0.5D + n_nationkey * 0.5D AS x", "n_nationkey * 0.3D AS y")
    about = tags(type="'multipolygon'", landuse="CASE WHEN k % 2 = 0 THEN 'quarry' END", boundary="CASE WHEN k % 2 = 1 THEN 'protected_area' END", name="CASE WHEN n_name NOT LIKE 'NATION_1%' AND n_name NOT LIKE 'A%' THEN n_name END")
    objects = corners(n, AREA, box("x", "y", "x + 0.05D", "y + 0.04D")), way(n, AREA, 0, [0, 1, 2, 3, 0], plain()), relation(n, AREA, [(0, "outer")], about)
    made, _ = generate(*objects)
    found = made.select("point_id", "name", "weight", "x", "y").join(n.select(F.col("n_name").alias("name"), F.col("x").alias("x0"), F.col("y").alias("y0")), "name")
    near = found.select("name", F.col("point_id").alias("p"), F.col("x").alias("px"), F.col("y").alias("py"))
    # Pairs within one small area, which the spacing bounds to about a hundred points.
    close = found.join(near, "name").where("point_id < p").groupBy("name").agg(F.min((F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2).alias("d2"))
    inside = F.col("x").between(F.col("x0"), F.col("x0") + 0.05) & F.col("y").between(F.col("y0"), F.col("y0") + 0.04)
    each = found.groupBy("name").agg(F.max("weight").cast("int").alias("weight"), F.bool_and(inside).alias("inside"), F.count(F.lit(1)).alias("n"))
    return each.join(close, "name").select("name", "weight", "inside", (F.col("d2") >= 0.005**2 * (1 - 1e-9)).alias("apart"), (F.col("n") >= 40).alias("filled"))


_WORDS = "array_to_string(list_sort(list_filter([{entries}], lambda x: x IS NOT NULL)), ';')"


def text_of_tags():
    return F.array_join(F.array_sort(F.transform(F.map_entries("tags"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";").alias("tags")


def extracts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The derived map, written as many files and read back."""
    folder, paths = new_folder(spark, "extracts"), []
    for kind, rows in zip(("nodes", "ways", "relations"), map_objects(spark, sf_dir)):
        paths += write_extracts(rows, kind, folder)
    return read_osm(spark, paths)


@query(_MAP + "SELECT id, CAST(round(y * 1e6::DOUBLE) AS BIGINT) AS lat, CAST(round(x * 1e6::DOUBLE) AS BIGINT) AS lon, " + _WORDS.format(entries="CASE WHEN id % 5 <> 0 THEN 'building=yes' END, 'addr:housenumber=' || n, 'addr:street=' || c_mktsegment, CASE WHEN id % 2 = 0 THEN 'addr:city=Own' || id % 7 END, 'name=' || c_name") + " AS tags FROM c")
def extract_nodes(spark, sf_dir):
    """Nodes of several files, with their tags."""
    nodes, _, _ = extracts(spark, sf_dir)
    return nodes.where(F.col("id") < HOUSE).select("id", micro("lat"), micro("lon"), text_of_tags())


@query(f"""SELECT {HOUSE} + 20 * s_suppkey AS id, array_to_string([{HOUSE} + 20 * s_suppkey + i FOR i IN [0, 1, 2, 3, 0]], ',') AS nodes, 'addr:housenumber=' || s_suppkey || ';addr:street=Way' || s_suppkey % 13 || ';building=yes;name=' || s_name AS tags FROM supplier
UNION ALL SELECT {COUNTRY} + 20 * n_nationkey + w, array_to_string([{COUNTRY} + 20 * n_nationkey + i FOR i IN CASE w WHEN 0 THEN [0, 1, 2] ELSE [0, 3, 2] END], ','), '' FROM nation, (VALUES (0), (1)) v(w)""")
def extract_ways(spark, sf_dir):
    _, ways, _ = extracts(spark, sf_dir)
    some = F.col("id").between(HOUSE, PAIR - 1) | F.col("id").between(COUNTRY, BAND - 1)
    return ways.where(some).select("id", F.array_join(F.transform("nodes", lambda n: n.cast("string")), ",").alias("nodes"), text_of_tags())


@query(f"""SELECT {PAIR} + 20 * s_suppkey AS id, 'way {PAIR // 10**9}' || lpad(CAST(20 * s_suppkey AS VARCHAR), 9, '0') || ' outer,way ' || {PAIR} + 20 * s_suppkey + 1 || ' outer,way ' || {PAIR} + 20 * s_suppkey + 2 || ' inner' AS members, 'addr:housenumber=' || s_suppkey || ';addr:street=Pair;building=yes;name=' || s_name || ';type=multipolygon' AS tags FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL SELECT {CITY} + 20 * n_nationkey, 'way ' || {CITY} + 20 * n_nationkey || ' outer', 'name=City_' || n_nationkey || ';place=city;type=boundary' FROM nation WHERE n_nationkey % 2 = 0""")
def extract_relations(spark, sf_dir):
    _, _, relations = extracts(spark, sf_dir)
    member = lambda m: F.concat(m["type"], F.lit(" "), m["ref"].cast("string"), F.lit(" "), m["role"])
    some = F.col("id").between(PAIR, ROAD - 1) | F.col("id").between(CITY, COUNTRY - 1)
    return relations.where(some).select("id", F.array_join(F.transform("members", member), ",").alias("members"), text_of_tags())


@query(_MAP + "SELECT CAST(count(*) AS BIGINT) AS points, CAST(sum(weight) AS BIGINT) AS weights, count(DISTINCT region) AS regions, CAST(sum(round(x * 1e4::DOUBLE)) AS BIGINT) AS xs FROM answered")
def build_from_extracts(spark, sf_dir):
    """From files of map objects to a stored cache of level 2 and back, in one go."""
    made, areas = generate(*extracts(spark, sf_dir), Config(road_spacing=SPACING))
    path = write_cache(made, areas, f"{new_folder(spark, 'built')}/cache")
    return read_points(spark, path).agg(F.count(F.lit(1)).alias("points"), F.sum("weight").alias("weights"), F.countDistinct("region").alias("regions"), F.sum(F.round(F.col("x") * 1e4)).cast("long").alias("xs"))


# ---- stored caches


def stored(spark: SparkSession, sf_dir: str, level: int) -> str:
    return write_cache(points(spark, sf_dir), zones(spark, sf_dir), f"{new_folder(spark, 'cache')}/level{level}", level=level, version=7, locale="en")


_ROWS = SQL + "SELECT row_number() OVER (ORDER BY point_id) - 1 AS point_id, x, y, name, street, house_number, city, region, weight FROM points"


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return read_points(spark, path).select("point_id", "x", "y", "name", "street", "house_number", "city", "region", "weight")


@query(_ROWS)
def cache_points_level1(spark, sf_dir):
    return _rows(spark, stored(spark, sf_dir, 1))


@query(_ROWS)
def cache_points_level2(spark, sf_dir):
    return _rows(spark, stored(spark, sf_dir, 2))


@query(_ROWS)
def cache_points_packed(spark, sf_dir):
    """A file packed by zstd, which its suffix tells."""
    import zstandard

    from ..sources.shared import file_system

    path = stored(spark, sf_dir, 2)
    system, inner = file_system(path)
    with system.open_input_stream(inner, compression=None) as source, system.open_output_stream(inner + ".zst", compression=None) as out:
        zstandard.ZstdCompressor().copy_stream(source, out)
    return _rows(spark, path + ".zst")


# Regions come first, then countries, each kind by id; vertices and boxes have 32 bits.
_ZONES = SQL + """, numbered AS (SELECT row_number() OVER (ORDER BY zone_type, zone_id) - 1 AS n, * FROM zones)
SELECT CAST(n AS BIGINT) AS zone_id, CAST(zone_type AS TINYINT) AS zone_type, name, CAST(CAST(x0 AS FLOAT) AS DOUBLE) AS min_x, CAST(CAST(y0 AS FLOAT) AS DOUBLE) AS min_y, CAST(CAST(x1 AS FLOAT) AS DOUBLE) AS max_x, CAST(CAST(y1 AS FLOAT) AS DOUBLE) AS max_y, CAST(pos AS INTEGER) AS pos, CAST(CAST(CASE WHEN pos IN (1, 2) THEN x1 ELSE x0 END AS FLOAT) AS DOUBLE) AS x, CAST(CAST(CASE WHEN pos IN (2, 3) THEN y1 ELSE y0 END AS FLOAT) AS DOUBLE) AS y FROM numbered, (VALUES (0), (1), (2), (3), (4)) v(pos)"""


def _vertices(spark: SparkSession, path: str) -> DataFrame:
    ring = F.get(F.get("polygon", F.lit(0)), F.lit(0))
    return read_zones(spark, path).select("zone_id", "zone_type", "name", "min_x", "min_y", "max_x", "max_y", F.posexplode(ring).alias("pos", "p")).select("zone_id", "zone_type", "name", "min_x", "min_y", "max_x", "max_y", "pos", "p.x", "p.y")


@query(_ZONES)
def cache_zones_level1(spark, sf_dir):
    return _vertices(spark, stored(spark, sf_dir, 1))


@query(_ZONES)
def cache_zones_level2(spark, sf_dir):
    return _vertices(spark, stored(spark, sf_dir, 2))


@query("SELECT CAST(level AS INTEGER) AS level, CAST(7 AS BIGINT) AS version, 'en' AS locale FROM (VALUES (1), (2)) v(level)")
def cache_metadata(spark, sf_dir):
    return union([read_metadata(spark, stored(spark, sf_dir, k)).select(F.lit(k).alias("level"), "version", "locale") for k in (1, 2)])


@query(SQL + """, nearest AS (SELECT req_id, point_id FROM pairs QUALIFY row_number() OVER (PARTITION BY req_id ORDER BY d2, visit_ord) = 1)
SELECT n.req_id, p.point_id IS NOT NULL OR coalesce(nullif(p.region, ''), zone_region, '') <> '' OR coalesce(zone_country, '') <> '' AS found, coalesce(p.name, '') AS name, coalesce(p.street, '') AS street, coalesce(p.house_number, '') AS house_number, coalesce(p.city, '') AS city, coalesce(nullif(p.region, ''), zone_region, '') AS region, coalesce(zone_country, '') AS country, CAST(coalesce(p.weight, 0) AS INTEGER) AS weight FROM named n LEFT JOIN nearest f USING (req_id) LEFT JOIN points p USING (point_id)""")
def cache_geocode(spark, sf_dir):
    """A geocoder loaded from a file answers as one over the tables."""
    coder = ReverseGeocoder.from_file(spark, stored(spark, sf_dir, 1), search_radius=RADIUS, mode=NEAREST)
    return coder.find_many(probes(spark, sf_dir))


@query(SQL + "SELECT format, CAST(count(*) AS BIGINT) AS points, CAST(sum(weight) AS BIGINT) AS weights, count(DISTINCT street) AS streets FROM points, (VALUES ('parquet'), ('v1'), ('v2')) v(format) GROUP BY 1")
def cache_outputs(spark, sf_dir):
    """One table written to several outputs at once."""
    folder = new_folder(spark, "outputs")
    kinds = ["parquet", "v1", "v2"]
    paths = write_all(points(spark, sf_dir), zones(spark, sf_dir), [(k, f"{folder}/{k}") for k in kinds])
    read = lambda kind, path: spark.read.parquet(f"{path}/points") if kind == "parquet" else read_points(spark, path)
    facts = [F.count(F.lit(1)).alias("points"), F.sum("weight").alias("weights"), F.countDistinct("street").alias("streets")]
    return union([read(k, p).agg(*facts).select(F.lit(k).alias("format"), "points", "weights", "streets") for k, p in zip(kinds, paths)])


@query("SELECT section, bytes FROM (SELECT count(*) AS n FROM customer), LATERAL (VALUES ('tree_ids', 8 * n), ('tree_coords', 16 * n), ('row_offsets', 8 * (n + 1)), ('rows', 21 * n)) v(section, bytes)")
def cache_size(spark, sf_dir):
    """Sections of a written file whose size follows from its number of rows."""
    found = sizes(spark, write_cache(points(spark, sf_dir), None, f"{new_folder(spark, 'sizes')}/points"))
    return found.where(F.col("section").isin("tree_ids", "tree_coords", "row_offsets", "rows"))


@query("SELECT 'strings' AS section, CAST(sum(octet_length(encode(w)) + 2) AS BIGINT) AS bytes FROM (SELECT DISTINCT c_mktsegment AS w, 1 AS k FROM customer UNION SELECT DISTINCT CASE WHEN c_nationkey % 2 = 0 THEN 'REG_' || c_nationkey ELSE '' END, 2 FROM customer UNION SELECT unnest(['', '']), unnest([2, 3]) UNION SELECT '', 1) UNION ALL SELECT 'zones', 0")
def cache_size_level1(spark, sf_dir):
    """The dictionaries' section: a tag, a length and the text of each word of the three."""
    found = sizes(spark, write_cache(points(spark, sf_dir), None, f"{new_folder(spark, 'sizes')}/points", level=1))
    return found.where(F.col("section").isin("strings", "zones"))


# ---- points, keys and codecs


@query(SQL + "SELECT min(point_id) AS point_id, x, y, street, weight FROM (SELECT point_id // 2 AS point_id, floor(x) AS x, floor(y) AS y, street, weight FROM points) GROUP BY x, y, street, weight")
def unique_points(spark, sf_dir):
    """Points that are alike but for their id, once each."""
    from ..operators.rangeset import distinct_points

    coarse = points(spark, sf_dir).select(F.floor(F.col("point_id") / 2).alias("point_id"), F.floor("x").cast("double").alias("x"), F.floor("y").cast("double").alias("y"), "street", "weight")
    return distinct_points(coarse, ("point_id",))


@query("SELECT o_orderkey, CAST((o_orderkey + o_custkey) * (o_orderkey + o_custkey + 1) // 2 + o_custkey AS BIGINT) AS pair FROM orders")
def cantor_keys(spark, sf_dir):
    from ..functions.geometry import cantor_pair

    return table(spark, sf_dir, "orders").select("o_orderkey", cantor_pair(F.col("o_orderkey"), F.col("o_custkey")).cast("long").alias("pair"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS k, round(n_nationkey + (1 + n_nationkey % 4) / 2.0::DOUBLE, 6) AS x, round(n_nationkey * 2 + (2 + n_nationkey % 3) / 2.0::DOUBLE, 6) AS y, round(least(1 + n_nationkey % 4, 2 + n_nationkey % 3) / 2.0::DOUBLE, 6) AS distance FROM nation")
def centroid_cells(spark, sf_dir):
    """Centroids of rectangles with their distance to the edge."""
    import numpy as np
    import pyarrow as pa

    from ..functions.geometry import centroid_cell

    n = table(spark, sf_dir, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS k", "CAST(n_nationkey AS DOUBLE) AS x", "n_nationkey * 2.0D AS y", "1.0D + n_nationkey % 4 AS w", "2.0D + n_nationkey % 3 AS h")

    def run(batches):
        for batch in batches:
            rows = [centroid_cell([np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)])]) for x, y, w, h in zip(*(c.to_pylist() for c in batch.columns[1:]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([round(r[i], 6) for r in rows], pa.float64()) for i in range(3))], names=["k", "x", "y", "distance"])

    return n.mapInArrow(run, "k long, x double, y double, distance double")


@query(SQL + "SELECT req_id, coalesce(nullif(name, ''), '') AS name, street, house_number, city, region, country, weight FROM answers WHERE found")
def read_answers(spark, sf_dir):
    """Answers in JSON, read back."""
    from ..operators.geocode import read_info, reverse_geocode, single_answers

    answers = single_answers(reverse_geocode(probes(spark, sf_dir), points(spark, sf_dir), zones(spark, sf_dir), RADIUS)).where("body is not null")
    return answers.select("req_id", *read_info(F.col("body")))
