"""The engine's queries on the driver's tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, names, text
from ..operators import compare, dictionary, geocode, metrics, rangeset, spatial
from ..operators.geocode import reverse_geocode
from ..operators.osm import BUILDING, INDUSTRIAL, PROTECTED, ROAD, border_kind, relation_kind, way_kind
from ..operators.rings import way_lines
from ..operators.zones import load_zones, split_zones, zone_of, zones_of
from ..schema import COUNTRY, REGION
from . import build  # noqa: F401 - registers its queries
from .derived import HOLE, OUTER, RADIUS, SQL, points, probes, table, zones
from .registry import ALL, query

# ---- search


@query(SQL + "SELECT point_id, x, y FROM points WHERE x BETWEEN 5 AND 12 AND y BETWEEN 4 AND 12")
def bbox_range(spark, sf_dir):
    return spatial.in_box(points(spark, sf_dir), 5, 4, 12, 12).select("point_id", "x", "y")


@query(SQL + "SELECT req_id, point_id, d2 FROM pairs")
def radius_join(spark, sf_dir):
    pairs = spatial.radius_join(probes(spark, sf_dir).select("req_id", "lon", "lat"), points(spark, sf_dir).select("point_id", "x", "y"), RADIUS)
    return pairs.select("req_id", "point_id", "d2")


@query(SQL + "SELECT req_id, point_id, x, y FROM probes JOIN points ON lon - 0.003::DOUBLE = x AND lat - 0.002::DOUBLE = y")
def radius_zero(spark, sf_dir):
    exact = probes(spark, sf_dir).select("req_id", (F.col("lon") - 0.003).alias("lon"), (F.col("lat") - 0.002).alias("lat"))
    return spatial.radius_join(exact, points(spark, sf_dir).select("point_id", "x", "y"), 0).select("req_id", "point_id", "x", "y")


def _picked(spark, sf_dir, mode):
    return spatial.search(probes(spark, sf_dir), points(spark, sf_dir), RADIUS, ["req_id"], mode).select("req_id", "point_id", "d2", "weight")


@query(SQL + "SELECT req_id, best.p AS point_id, best.d AS d2, best.w AS weight FROM fold")
def pick_fold(spark, sf_dir):
    return _picked(spark, sf_dir, spatial.FOLD)


@query(SQL + "SELECT req_id, point_id, d2, weight FROM pairs QUALIFY row_number() OVER (PARTITION BY req_id ORDER BY d2, visit_ord) = 1")
def pick_nearest(spark, sf_dir):
    return _picked(spark, sf_dir, spatial.NEAREST)


@query(SQL + "SELECT req_id, point_id, d2, weight FROM pairs QUALIFY row_number() OVER (PARTITION BY req_id ORDER BY weight DESC, d2, visit_ord) = 1")
def pick_weight_first(spark, sf_dir):
    return _picked(spark, sf_dir, spatial.WEIGHT_FIRST)


@query(SQL + "SELECT req_id, string_agg(CAST(point_id AS VARCHAR), ',' ORDER BY visit_ord) AS first_points FROM (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY req_id ORDER BY visit_ord) <= 3) GROUP BY 1")
def early_stop(spark, sf_dir):
    first = spatial.search_first(probes(spark, sf_dir), points(spark, sf_dir), RADIUS, ["req_id"], 3)
    return first.select("req_id", F.array_join(F.transform("point_ids", lambda p: p.cast("string")), ",").alias("first_points"))


@query(SQL + "SELECT req_id, zone_region, zone_country FROM named")
def zone_lookup(spark, sf_dir):
    rows = probes(spark, sf_dir).select("req_id", "lon", "lat")
    return zones_of(rows, zones(spark, sf_dir), {"zone_region": REGION, "zone_country": COUNTRY}).select("req_id", "zone_region", "zone_country")


@query(SQL + "SELECT req_id, zone_country FROM named")
def zone_lookup_by_cells(spark, sf_dir):
    """The plan for zones too large to be sent to every task."""
    return zone_of(probes(spark, sf_dir).select("req_id", "lon", "lat"), split_zones(zones(spark, sf_dir), COUNTRY), "zone_country", sent_vertices=0).select("req_id", "zone_country")


_CURVED = SQL + """, curves AS (SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name, (n_nationkey % 5) * 4.0::DOUBLE + 2 AS cx, (n_nationkey // 5) * 4.0::DOUBLE + 2 AS cy, 0.2::DOUBLE + (n_nationkey % 6) * 0.9::DOUBLE AS r FROM nation),
corner AS (SELECT k, name, i, cx + r * cos(i * 0.17::DOUBLE) * (1 - (i % 2) * 0.3::DOUBLE) AS x, cy + r * sin(i * 0.17::DOUBLE) * (1 - (i % 2) * 0.3::DOUBLE) AS y FROM curves, range(36) t(i)),
edge AS (SELECT a.k, a.name, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM corner a JOIN corner b ON a.k = b.k AND b.i = (a.i + 1) % 36),
hit AS (SELECT req_id, k, any_value(name) AS name FROM probes JOIN edge ON (ay > lat) <> (by_ > lat) AND lon < (bx - ax) * (lat - ay) / (by_ - ay) + ax GROUP BY 1, 2 HAVING count(*) % 2 = 1)
SELECT req_id, (SELECT arg_min(name, k) FROM hit h WHERE h.req_id = p.req_id) AS zone FROM probes p"""


@query(_CURVED)
def zone_lookup_curved(spark, sf_dir):
    """Overlapping star-shaped zones of very different sizes, by the plan for large zones."""
    n = table(spark, sf_dir, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS zone_id", "n_name AS name", "(n_nationkey % 5) * 4.0D + 2 AS cx", "floor(n_nationkey / 5) * 4.0D + 2 AS cy", "0.2D + (n_nationkey % 6) * 0.9D AS r")
    ring = F.expr("transform(sequence(0, 35), i -> struct(cx + r * cos(i * 0.17D) * (1 - (i % 2) * 0.3D) AS x, cy + r * sin(i * 0.17D) * (1 - (i % 2) * 0.3D) AS y))")
    made = load_zones(n.select("zone_id", F.lit(REGION).cast("tinyint").alias("zone_type"), "name", F.array(F.array(ring)).alias("polygon")), 0)
    return zone_of(probes(spark, sf_dir).select("req_id", "lon", "lat"), made, "zone", sent_vertices=0).select("req_id", "zone")


def _edges(ring):
    return ", ".join(f"({a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for a, b in zip(ring, ring[1:] + ring[:1]))


_CROSSED = "SELECT req_id, count(*) FILTER ((e.ay > lat) <> (e.by_ > lat) AND lon < (e.bx - e.ax) * (lat - e.ay) / (e.by_ - e.ay) + e.ax) % 2 = 1 AS hit FROM probes, (VALUES {edges}) e(ax, ay, bx, by_) GROUP BY 1"
_CONCAVE = SQL + f", outer_hit AS ({_CROSSED.format(edges=_edges(OUTER))}), hole_hit AS ({_CROSSED.format(edges=_edges(HOLE))}) SELECT o.req_id, o.hit AND NOT h.hit AS inside FROM outer_hit o JOIN hole_hit h USING (req_id)"


def _ring(ring):
    return F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ring])


@query(_CONCAVE)
def pip_concave(spark, sf_dir):
    """A concave polygon with a hole, by the vectorised kernel."""
    zone = spark.range(1).select(F.col("id").alias("zone_id"), F.lit(REGION).cast("tinyint").alias("zone_type"), F.lit("in").alias("name"), F.array(F.array(_ring(OUTER), _ring(HOLE))).alias("polygon"))
    found = zone_of(probes(spark, sf_dir).select("req_id", "lon", "lat"), load_zones(zone, 0), "zone")
    return found.select("req_id", F.col("zone").isNotNull().alias("inside"))


@query(_CONCAVE)
def pip_expression(spark, sf_dir):
    """The same by column expressions, which suit short rings."""
    inside = geometry.ring_contains(_ring(OUTER), F.col("lon"), F.col("lat")) & ~geometry.ring_contains(_ring(HOLE), F.col("lon"), F.col("lat"))
    return probes(spark, sf_dir).select("req_id", inside.alias("inside"))


@query(SQL + "SELECT * FROM answers")
def reverse_geocode_fold(spark, sf_dir):
    return reverse_geocode(probes(spark, sf_dir), points(spark, sf_dir), zones(spark, sf_dir), RADIUS)


_INFO = "struct_pack(name := name, street := street, house_number := house_number, city := city, region := region, country := country, weight := weight)"


@query(SQL + f"SELECT o_custkey AS req_id, CAST(to_json(list({_INFO} ORDER BY req_id)) AS VARCHAR) AS answers FROM answers JOIN probes USING (req_id) GROUP BY 1")
def batch_geocode(spark, sf_dir):
    """JSON arrays of coordinates in, JSON arrays of answers out, one request a customer."""
    pairs = F.transform(F.sort_array(F.collect_list(F.struct("req_id", "lat", "lon"))), lambda p: F.array(p["lat"], p["lon"]))
    requests = probes(spark, sf_dir).groupBy(F.col("o_custkey").alias("req_id")).agg(F.to_json(pairs).alias("body"))
    answered = reverse_geocode(geocode.parse_request(requests), points(spark, sf_dir), zones(spark, sf_dir), RADIUS, keys=["req_id", "pos"])
    return geocode.batch_answers(answered)


@query(SQL + f"SELECT req_id, CASE WHEN found THEN 200 ELSE 204 END AS status, CASE WHEN found THEN CAST(to_json({_INFO}) AS VARCHAR) END AS body FROM answers")
def single_geocode(spark, sf_dir):
    return geocode.single_answers(reverse_geocode(probes(spark, sf_dir), points(spark, sf_dir), zones(spark, sf_dir), RADIUS))


@query("""SELECT o_orderkey AS req_id, CAST(0 AS INTEGER) AS pos, CASE WHEN o_orderkey % 5 = 0 THEN 0.0::DOUBLE ELSE o_orderkey / 4.0::DOUBLE END AS lat, CASE WHEN o_orderkey % 5 <= 1 THEN 0.0::DOUBLE ELSE -o_custkey / 8.0::DOUBLE END AS lon FROM orders WHERE o_orderkey % 7 <> 0""")
def parse_requests(spark, sf_dir):
    """Pairs with numbers missing or to spare, and bodies that are no arrays."""
    o = table(spark, sf_dir, "orders")
    lat, lon = F.expr("CAST(o_orderkey / 4.0D AS STRING)"), F.expr("CAST(-o_custkey / 8.0D AS STRING)")
    body = F.when(F.expr("o_orderkey % 7 = 0"), F.lit("{oops")).when(F.expr("o_orderkey % 5 = 0"), F.lit("[[]]")).when(F.expr("o_orderkey % 5 = 1"), F.concat(F.lit("[["), lat, F.lit("]]"))).otherwise(F.concat(F.lit("[["), lat, F.lit(","), lon, F.lit(",3.5]]")))
    return geocode.parse_request(o.select(F.col("o_orderkey").alias("req_id"), body.alias("body")))


@query("SELECT o_orderkey AS req_id, CASE WHEN o_orderkey % 3 = 0 THEN 400 ELSE 200 END AS status, o_custkey / 2.0::DOUBLE AS lat, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey / 4.0::DOUBLE END AS lon FROM orders")
def parse_paths(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    path = F.concat(F.lit("/v1/address/"), F.expr("CAST(o_custkey / 2.0D AS STRING)"), F.lit("/"), F.expr("CASE WHEN o_orderkey % 3 = 0 THEN 'north' ELSE CAST(o_orderkey / 4.0D AS STRING) END"))
    return geocode.parse_path(o.select(F.col("o_orderkey").alias("req_id"), path.alias("path")))


# ---- classification and names


def _tags(spark, sf_dir) -> DataFrame:
    entries = [
        ("type", "element_at(array('multipolygon', 'boundary', 'building', 'route'), CAST(k % 4 AS INT) + 1)"),
        ("landuse", "CASE k % 7 WHEN 0 THEN 'quarry' WHEN 1 THEN 'industrial' WHEN 2 THEN 'forest' END"),
        ("boundary", "CASE k % 5 WHEN 0 THEN 'protected_area' WHEN 1 THEN 'administrative' WHEN 2 THEN 'administrative' END"),
        ("admin_level", "element_at(array('2', '4', '6'), CAST(k % 3 AS INT) + 1)"),
        ("addr:housenumber", "CASE WHEN k % 2 = 0 THEN p_brand END"),
        ("addr:street", "CASE WHEN k % 3 = 0 THEN p_name END"),
        ("building", "CASE WHEN k % 8 < 4 THEN 'yes' END"),
        ("route", "CASE WHEN k % 3 = 1 THEN 'road' END"),
        ("network", "CASE WHEN k % 6 < 3 THEN 'us:national:x' ELSE 'local' END"),
        ("highway", "element_at(array('motorway', 'trunk_link', 'tertiary', 'path', 'primary'), CAST(k % 5 AS INT) + 1)"),
        ("place", "element_at(array('city', 'suburb', 'farm'), CAST(k % 3 AS INT) + 1)"),
    ]
    pairs = ", ".join(f"struct('{n}' AS key, {e} AS value)" for n, e in entries)
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS k", "p_brand", "p_name").selectExpr("k AS p_partkey", f"map_from_entries(filter(array({pairs}), e -> e.value IS NOT NULL)) AS tags")


_T = """WITH t AS (SELECT p_partkey AS k, k % 2 = 0 AND k % 3 = 0 AND k % 8 < 4 AS b, k % 4 IN (0, 1) AS area FROM part),
r AS (SELECT k, b, CASE WHEN area THEN CASE WHEN k % 7 IN (0, 1) THEN 'industrial' WHEN k % 5 = 0 THEN 'protected' WHEN b THEN 'building' WHEN k % 5 IN (1, 2) AND k % 3 = 1 THEN 'region' WHEN k % 5 IN (1, 2) AND k % 3 = 0 THEN 'country' END WHEN k % 4 = 2 AND k % 3 = 1 AND k % 6 < 3 THEN 'highway' END AS relation,
CASE WHEN b THEN 'building' WHEN k % 5 IN (0, 2, 4) THEN 'highway' END AS way,
CASE WHEN area THEN CASE WHEN k % 3 = 1 THEN 'region' WHEN k % 3 IN (0, 2) THEN 'place' END WHEN k % 4 = 3 THEN 'names' END AS border FROM t)
"""


@query(_T + "SELECT k AS p_partkey, relation, way, border, CAST(CASE relation WHEN 'industrial' THEN 3 WHEN 'protected' THEN 2 WHEN 'building' THEN 10 WHEN 'highway' THEN 5 END AS INTEGER) AS weight FROM r")
def classify_tags(spark, sf_dir):
    kind = relation_kind(F.col("tags"))
    weight = F.when(kind == "industrial", INDUSTRIAL).when(kind == "protected", PROTECTED).when(kind == "building", BUILDING).when(kind == "highway", ROAD)
    return _tags(spark, sf_dir).select("p_partkey", kind.alias("relation"), way_kind(F.col("tags")).alias("way"), border_kind(F.col("tags")).alias("border"), weight.alias("weight"))


def _named(spark, sf_dir) -> DataFrame:
    """Suppliers as objects with names, cities and the places that hold them."""
    n = table(spark, sf_dir, "nation")
    words = n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("word"), F.concat(F.lit("L_"), "n_name").alias("local"))
    entries = [("name", "CASE WHEN s_suppkey % 4 <> 0 THEN s_name ELSE n_name END"), ("name:en", "CASE WHEN s_suppkey % 3 = 0 THEN concat('EN ', s_name) END"), ("addr:city", "CASE WHEN s_suppkey % 2 = 0 THEN n_name END"), ("addr:city:en", "CASE WHEN s_suppkey % 7 = 0 THEN 'Town' END"), ("ref", "CASE WHEN s_suppkey % 5 = 0 THEN concat('A', s_suppkey) END")]
    pairs = ", ".join(f"struct('{k}' AS key, {e} AS value)" for k, e in entries)
    s = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    rows = s.selectExpr("s_suppkey", f"map_from_entries(filter(array({pairs}), e -> e.value IS NOT NULL)) AS tags", "CASE WHEN s_suppkey % 5 < 3 THEN n_name END AS place")
    out = rows
    for column, value in (("tr_name", names.tag(F.col("tags"), "name")), ("tr_city", names.tag(F.col("tags"), "addr:city")), ("tr_place", F.col("place"))):
        out = out.join(words.select(F.col("word"), F.col("local").alias(column)), value == F.col("word"), "left").drop("word")
    return out


_N = """WITH words AS (SELECT n_name AS word, 'L_' || n_name AS local FROM nation WHERE n_nationkey % 2 = 0),
o AS (SELECT s_suppkey, CASE WHEN s_suppkey % 4 <> 0 THEN s_name ELSE n_name END AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'EN ' || s_name END AS name_en, CASE WHEN s_suppkey % 2 = 0 THEN n_name END AS city, CASE WHEN s_suppkey % 7 = 0 THEN 'Town' END AS city_en, CASE WHEN s_suppkey % 5 = 0 THEN 'A' || s_suppkey ELSE '' END AS ref, CASE WHEN s_suppkey % 5 < 3 THEN n_name END AS place FROM supplier JOIN nation ON s_nationkey = n_nationkey),
t AS (SELECT o.*, a.local AS tr_name, b.local AS tr_city, c.local AS tr_place FROM o LEFT JOIN words a ON o.name = a.word LEFT JOIN words b ON o.city = b.word LEFT JOIN words c ON o.place = c.word)
"""


@query(_N + "SELECT s_suppkey, name AS plain_name, coalesce(name_en, tr_name, name) AS local_name, CASE WHEN ref <> '' THEN ref || ' ' ELSE '' END || coalesce(name_en, tr_name, name) AS road, coalesce(city, place, '') AS plain_city, coalesce(city_en, tr_city, tr_place, place, city, '') AS local_city, CASE WHEN place IS NULL THEN '' ELSE coalesce(tr_place, place) END AS region FROM t")
def localized_names(spark, sf_dir):
    rows, tags = _named(spark, sf_dir), F.col("tags")
    local = names.localized(tags, "name", "en", F.col("tr_name"))
    return rows.select("s_suppkey", names.localized(tags, "name", "", None).alias("plain_name"), local.alias("local_name"), names.highway_name(names.tag(tags, "ref"), local).alias("road"), names.city(tags, "", F.col("tr_city"), F.col("place"), F.col("tr_place")).alias("plain_city"), names.city(tags, "en", F.col("tr_city"), F.col("place"), F.col("tr_place")).alias("local_city"), names.region(F.col("place"), F.col("tr_place")).alias("region"))


@query("WITH r AS (SELECT s_suppkey, s_nationkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 3 <> 0) SELECT n_name AS name, arg_max(n_name || '_' || s_suppkey, s_suppkey) AS localized FROM r GROUP BY 1")
def localization_dictionary(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    s = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    tags = F.expr("CASE WHEN s_suppkey % 3 = 0 THEN map('name', n_name, 'name:en', n_name) ELSE map('name', n_name, 'name:en', concat(n_name, '_', s_suppkey)) END")
    return dictionary.localization(s.select(F.col("s_suppkey").alias("id"), tags.alias("tags")), "en")


# ---- lines, centres and distances


@query("""WITH nodes AS (SELECT c_custkey AS id, c_custkey * 7919 % 2003 AS x, c_custkey * 104729 % 1999 AS y FROM customer),
refs AS (SELECT l_orderkey AS id, l_linenumber AS pos, (l_partkey * 13 + l_suppkey) % (2 * (SELECT max(c_custkey) FROM customer)) AS ref FROM lineitem)
SELECT refs.id, string_agg(x || ',' || y, ';' ORDER BY pos, ref) AS path FROM refs JOIN nodes ON ref = nodes.id WHERE NOT (x = 0 AND y = 0) GROUP BY 1""")
def node_lines(spark, sf_dir):
    nodes = points(spark, sf_dir).select(F.col("point_id").alias("id"), F.col("y").alias("lat"), F.col("x").alias("lon"))
    n = nodes.agg(F.max("id")).first()[0]
    refs = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", F.expr(f"(l_partkey * 13 + l_suppkey) % {2 * n}").alias("ref")))), lambda r: r["ref"])
    ways = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(refs.alias("nodes"))
    whole = lambda v: F.round(v * 100).cast("long").cast("string")
    return way_lines(ways, nodes).select("id", F.array_join(F.transform("line", lambda p: F.concat(whole(p["x"]), F.lit(","), whole(p["y"]))), ";").alias("path"))


@query("""WITH q AS (SELECT n_nationkey AS k, n_nationkey * 1.5::DOUBLE AS x, n_regionkey * 2.25::DOUBLE AS y, 1.0::DOUBLE + n_nationkey % 4 AS w, 2.0::DOUBLE + n_nationkey % 3 AS h FROM nation)
SELECT CAST(k AS BIGINT) AS k, round(x + (w + 2 * w) / 3, 6) AS cx, round(y + h / 3, 6) AS cy, round(w * h, 6) AS area FROM q""")
def centroids(spark, sf_dir):
    """Triangles (x, y), (x + w, y), (x + 2 w, y + h)."""
    n = table(spark, sf_dir, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS k", "n_nationkey * 1.5D AS x", "n_regionkey * 2.25D AS y", "1.0D + n_nationkey % 4 AS w", "2.0D + n_nationkey % 3 AS h")
    p = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    x, y, w, h = (F.col(c) for c in "xywh")
    ring = F.array(p(x, y), p(x + w, y), p(x + 2 * w, y + h))
    out = n.withColumn("ring", ring)
    centre = geometry.centroid(F.col("ring"))
    return out.select("k", F.round(centre["x"], 6).alias("cx"), F.round(centre["y"], 6).alias("cy"), F.round(2 * geometry.signed_area(F.col("ring")), 6).alias("area"))


@query(SQL + "SELECT a.point_id AS a, b.point_id AS b, round(2 * 6378100.0 * asin(sqrt(pow(sin((radians(b.y) - radians(a.y)) / 2), 2) + cos(radians(a.y)) * cos(radians(b.y)) * pow(sin((radians(b.x) - radians(a.x)) / 2), 2))), 3) AS metres FROM points a JOIN points b ON b.point_id = a.point_id + 1")
def haversine_distance(spark, sf_dir):
    a = points(spark, sf_dir).select(F.col("point_id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = points(spark, sf_dir).select(F.col("point_id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(geometry.haversine(F.col("ay"), F.col("ax"), F.col("by"), F.col("bx")), 3).alias("metres"))


# ---- sets of ids


@query("SELECT l_orderkey AS id, min(l_linenumber) AS first_line FROM lineitem GROUP BY 1")
def dedup_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("first_line"))
    return rangeset.distinct_ids(rows, "id", "first_line").select("id", "first_line")


@query("SELECT count(*) AS rows, count(DISTINCT l_orderkey) AS \"distinct\", count(*) - count(DISTINCT l_orderkey) AS duplicates FROM lineitem")
def duplicate_counts(spark, sf_dir):
    return rangeset.duplicate_count(table(spark, sf_dir, "lineitem"), "l_orderkey")


_KEYS = "k AS (SELECT DISTINCT l_orderkey AS key, CAST(l_orderkey // 5 % 2 AS VARCHAR) AS value FROM lineitem WHERE l_orderkey % 11 <> 3)"
_RANGES = f"{_KEYS}, ranges AS (SELECT min(key) AS lo, max(key) + 1 AS hi, value FROM (SELECT key, value, key - row_number() OVER (PARTITION BY value ORDER BY key) AS g FROM k) GROUP BY value, g)"


def _ranges(spark, sf_dir):
    keys = table(spark, sf_dir, "lineitem").where("l_orderkey % 11 <> 3").selectExpr("l_orderkey AS key", "CAST(floor(l_orderkey / 5) % 2 AS STRING) AS value")
    return rangeset.coalesce_keys(keys)


@query(f"WITH {_RANGES} SELECT lo, hi, value FROM ranges")
def id_ranges(spark, sf_dir):
    return _ranges(spark, sf_dir)


#: A range that no list of its parts could hold.
WIDE = (10**12, 2**61)
_WITH_WIDE = f"{_RANGES}, every AS (SELECT lo, hi, value FROM ranges UNION ALL SELECT {WIDE[0]}, {WIDE[1]}, 'wide')"


def _with_wide(spark, sf_dir):
    return _ranges(spark, sf_dir).unionByName(spark.createDataFrame([(*WIDE, "wide")], "lo bigint, hi bigint, value string"))


@query(f"WITH {_WITH_WIDE}, q AS (SELECT o_orderkey AS key FROM orders UNION ALL SELECT o_orderkey * 400000000000 FROM orders) SELECT key, value, value IS NOT NULL AS contains FROM q LEFT JOIN every ON lo <= key AND key < hi")
def range_get(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    return rangeset.get(_with_wide(spark, sf_dir), o.unionByName(o.select((F.col("key") * 400_000_000_000).alias("key"))))


@query(f"WITH {_WITH_WIDE}, q AS (SELECT CAST(c_custkey * 3 AS BIGINT) AS lo, CAST(c_custkey * 3 + c_custkey % 9 AS BIGINT) AS hi, c_mktsegment AS value FROM customer UNION ALL SELECT 0, {WIDE[1]}, 'all' UNION ALL SELECT -5, 3, 'low') SELECT q.lo, q.hi, q.value, r.lo AS other_lo, r.hi AS other_hi, r.value AS other_value FROM q JOIN every r ON q.lo < r.hi AND r.lo < q.hi WHERE q.lo < q.hi")
def range_overlap(spark, sf_dir):
    asked = table(spark, sf_dir, "customer").selectExpr("c_custkey * 3 AS lo", "c_custkey * 3 + c_custkey % 9 AS hi", "c_mktsegment AS value")
    more = spark.createDataFrame([(0, WIDE[1], "all"), (-5, 3, "low")], "lo bigint, hi bigint, value string")
    return rangeset.overlapping(asked.unionByName(more), _with_wide(spark, sf_dir))


_LOG = """log AS (SELECT l_orderkey * 10 + l_linenumber AS op_seq, CASE (l_orderkey + l_linenumber) % 5 WHEN 0 THEN 'delete' WHEN 1 THEN 'set_if_absent' WHEN 2 THEN 'set_if_absent' ELSE 'set' END AS op, l_partkey AS key, l_returnflag AS value FROM lineitem UNION ALL SELECT 200, 'clear', NULL, NULL),
live AS (SELECT * FROM log WHERE op_seq > 200 AND op <> 'clear'),
firm AS (SELECT key, max(op_seq) AS s, arg_max(op, op_seq) AS op, arg_max(value, op_seq) AS value FROM live WHERE op IN ('set', 'delete') GROUP BY 1),
soft AS (SELECT l.key, arg_min(l.value, l.op_seq) AS value FROM live l LEFT JOIN firm f ON l.key = f.key WHERE l.op = 'set_if_absent' AND (f.key IS NULL OR (f.op = 'delete' AND l.op_seq > f.s)) GROUP BY 1),
kept AS (SELECT key, value FROM firm WHERE op = 'set' UNION ALL SELECT key, value FROM soft)"""


def _replayed(spark, sf_dir):
    log = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS op_seq", "CASE (l_orderkey + l_linenumber) % 5 WHEN 0 THEN 'delete' WHEN 1 THEN 'set_if_absent' WHEN 2 THEN 'set_if_absent' ELSE 'set' END AS op", "l_partkey AS key", "l_returnflag AS value")
    clear = spark.range(1).selectExpr("200L AS op_seq", "'clear' AS op", "CAST(NULL AS BIGINT) AS key", "CAST(NULL AS STRING) AS value")
    return rangeset.replay(log.unionByName(clear))


@query(f"WITH {_LOG} SELECT key, value FROM kept")
def range_replay(spark, sf_dir):
    return _replayed(spark, sf_dir)


@query(f"WITH {_LOG} SELECT min(key) AS lo, max(key) + 1 AS hi, value FROM (SELECT key, value, key - row_number() OVER (PARTITION BY value ORDER BY key) AS g FROM kept) GROUP BY value, g")
def range_set_delete(spark, sf_dir):
    return rangeset.coalesce_keys(_replayed(spark, sf_dir))


# ---- dictionaries, unions, comparison


_DICT = "seen AS (SELECT word, min(c_custkey * 2 + k) AS f FROM (SELECT c_custkey, 0 AS k, c_mktsegment AS word FROM customer UNION ALL SELECT c_custkey, 1, 'N' || c_nationkey FROM customer) GROUP BY 1), dict AS (SELECT 0 AS id, '' AS text UNION ALL SELECT row_number() OVER (ORDER BY f), word FROM seen)"


def _dictionary(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.concat(F.lit("N"), F.col("c_nationkey")).alias("nation"))
    return dictionary.encode(rows, ["c_mktsegment", "nation"], "c_custkey")


@query(f"WITH {_DICT} SELECT CAST(id AS BIGINT) AS id, text FROM dict")
def dict_encode(spark, sf_dir):
    return _dictionary(spark, sf_dir)


@query(f"WITH {_DICT} SELECT CAST(id AS BIGINT) AS id, text, CAST(coalesce(sum(octet_length(encode(text)) + 1) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM dict")
def string_heap(spark, sf_dir):
    return dictionary.heap(_dictionary(spark, sf_dir))


@query(f"WITH {_DICT} SELECT c_custkey, id AS street_id FROM customer JOIN (SELECT CAST(id AS BIGINT) AS id, text FROM dict) ON text = c_mktsegment")
def dict_translate(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return dictionary.translate(rows, _dictionary(spark, sf_dir), "c_mktsegment", "street_id").select("c_custkey", "street_id")


@query("SELECT 'node' AS source, c_custkey AS id FROM customer UNION ALL SELECT 'node', c_custkey FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT DISTINCT 'way', o_custkey FROM orders")
def union_points(spark, sf_dir):
    """Several extracts together: nodes as often as they come, ways once."""
    from ..operators.osm import distinct_objects

    c, o = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    nodes = distinct_objects([c, c.where("id % 2 = 0")], deduplicate=False)
    ways = distinct_objects([o, o.where("id % 2 = 0")], deduplicate=True)
    return nodes.select(F.lit("node").alias("source"), "id").unionByName(ways.select(F.lit("way").alias("source"), "id"))


def _lists(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    base = o.selectExpr("o_custkey AS req_id", "CAST(o_orderkey AS BIGINT) AS pos", "o_orderstatus AS name", "o_orderpriority AS street", "'' AS house_number", "'' AS city", "CASE WHEN o_orderkey % 4 = 0 THEN 'R' ELSE '' END AS region", "'C' AS country", "CAST(o_orderkey % 9 AS INT) AS weight")
    other = base.where("pos % 13 <> 0").withColumn("name", F.expr("CASE WHEN pos % 3 = 0 THEN concat(name, '!') ELSE name END")).withColumn("weight", F.expr("CAST(CASE WHEN pos % 6 = 0 THEN 99 ELSE weight END AS INT)"))
    return base, other


_CMP = """WITH c AS (SELECT o_custkey AS req_id, CAST(o_orderkey AS BIGINT) AS pos, concat_ws('; ', CASE WHEN o_orderkey % 3 = 0 THEN 'name: "' || o_orderstatus || '" vs "' || o_orderstatus || '!"' END, CASE WHEN o_orderkey % 6 = 0 AND o_orderkey % 9 <> 99 THEN 'weight: ' || o_orderkey % 9 || ' vs 99' END) AS detail FROM orders WHERE o_orderkey % 13 <> 0)"""


@query(_CMP + " SELECT * FROM c")
def compare_results(spark, sf_dir):
    return compare.compare(*_lists(spark, sf_dir))


@query(_CMP + ", s AS (SELECT (SELECT count(*) FROM c WHERE detail = '') AS matches, (SELECT count(*) FROM c WHERE detail <> '') + (SELECT count(*) FROM orders WHERE o_orderkey % 13 = 0) AS mismatches) SELECT matches, mismatches, 100.0::DOUBLE * matches / (matches + mismatches) AS match_rate FROM s")
def compare_summary(spark, sf_dir):
    return compare.compare_report(*_lists(spark, sf_dir))


@query(_CMP + " SELECT req_id, pos, pos / 4.0::DOUBLE AS lat, req_id / 2.0::DOUBLE AS lon, detail FROM c WHERE detail <> '' ORDER BY req_id, pos LIMIT 50")
def compare_shown(spark, sf_dir):
    a, b = _lists(spark, sf_dir)
    return compare.shown_mismatches(a, b, a.selectExpr("req_id", "pos", "pos / 4.0D AS lat", "req_id / 2.0D AS lon"))


# ---- metrics


@query("WITH s AS (SELECT event_type, list(value ORDER BY value) AS v, count(value) AS n FROM events WHERE value IS NOT NULL GROUP BY 1) SELECT event_type, v[n * 50 // 100 + 1] AS p50, v[n * 95 // 100 + 1] AS p95, v[n * 99 // 100 + 1] AS p99 FROM s")
def latency_percentiles(spark, sf_dir):
    return metrics.percentiles(table(spark, sf_dir, "events"), "value", ["event_type"])


@query("WITH m AS (SELECT CAST(floor(value * 1000) AS BIGINT) AS micros FROM events) SELECT count(micros) AS n, min(micros) AS min, max(micros) AS max, CAST(sum(micros) // count(micros) AS BIGINT) AS avg FROM m")
def latency_summary(spark, sf_dir):
    return metrics.latency_summary(table(spark, sf_dir, "events").select(F.floor(F.col("value") * 1000).cast("long").alias("micros")), "micros")


@query("WITH b AS (SELECT unnest([0.0001, 0.0005, 0.001, 0.005, 0.01, 0.05, 0.1]::DOUBLE[]) AS le UNION ALL SELECT 'infinity'::DOUBLE) SELECT le, (SELECT count(*) FROM events WHERE value / 1000.0::DOUBLE <= le) AS count FROM b")
def latency_histogram(spark, sf_dir):
    return metrics.histogram(table(spark, sf_dir, "events").select((F.col("value") / 1000.0).alias("seconds")), "seconds")


@query("SELECT CAST(count(*) FILTER (event_type <> 'error' AND event_id % 10 <> 0) AS BIGINT) AS ok, CAST(count(*) FILTER (NOT (event_type <> 'error' AND event_id % 10 <> 0)) AS BIGINT) AS failed, CAST(coalesce(sum(user_id % 100) FILTER (event_type <> 'error' AND event_id % 10 <> 0), 0) AS BIGINT) AS points, count(*) FILTER (event_type <> 'error' AND event_id % 10 <> 0) / 8.0::DOUBLE AS requests_per_second, coalesce(sum(user_id % 100) FILTER (event_type <> 'error' AND event_id % 10 <> 0), 0) / 8.0::DOUBLE AS points_per_second FROM events")
def request_counters(spark, sf_dir):
    ok = (F.col("event_type") != "error") & (F.col("event_id") % 10 != 0)
    return metrics.throughput(metrics.counters(table(spark, sf_dir, "events"), ok, F.col("user_id") % 100), 8)


def _samples(spark, sf_dir):
    g = [f"CAST(event_id * {7 + k} % {1000003 + k} AS BIGINT) AS {c}" for k, c in enumerate(metrics.PEAKS)]
    return table(spark, sf_dir, "events").selectExpr("event_id", "ts", "event_id / 2.0D AS elapsed_seconds", *g, "CAST(event_id % 400 AS DOUBLE) / 4 AS cpu_percent", "CAST(event_id % 50 AS INT) AS num_gc")


@query("SELECT count(*) AS samples, " + ", ".join(f"max(CAST(event_id * {7 + k} % {1000003 + k} AS BIGINT)) AS peak_{c}" for k, c in enumerate(metrics.PEAKS)) + ", max((event_id % 400) / 4.0::DOUBLE) AS peak_cpu, avg((event_id % 400) / 4.0::DOUBLE) AS avg_cpu, max(CAST(event_id % 50 AS INTEGER)) AS total_gc FROM events")
def stats_summary(spark, sf_dir):
    return metrics.stats_summary(_samples(spark, sf_dir))


@query("WITH r AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS place, count(*) OVER () AS n FROM events) SELECT event_id FROM r WHERE n <= 100 OR place IN (SELECT CAST(floor(i * ((SELECT max(n) FROM r) - 1) / 99.0::DOUBLE) AS BIGINT) FROM range(100) t(i))")
def sample_decimate(spark, sf_dir):
    return metrics.evenly_chosen(_samples(spark, sf_dir), "event_id").select("event_id")


@query("SELECT o_orderkey, CASE WHEN n >= 1073741824 THEN printf('%.2f GB', n / 1073741824.0::DOUBLE) WHEN n >= 1048576 THEN printf('%.2f MB', n / 1048576.0::DOUBLE) WHEN n >= 1024 THEN printf('%.2f KB', n / 1024.0::DOUBLE) ELSE n || ' B' END AS size FROM (SELECT o_orderkey, CAST(pow(2, o_orderkey % 40) AS BIGINT) AS n FROM orders)")
def human_sizes(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", text.human_bytes(F.pow(F.lit(2.0), F.col("o_orderkey") % 40).cast("long")).alias("size"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM orders")
def timestamps(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", text.rfc3339(F.col("o_orderdate")).alias("stamp"))


@query("SELECT CAST(i AS BIGINT) AS id, 51.3::DOUBLE + 0.4::DOUBLE * ((i * 7919 + 13) % 10007) / 10007.0::DOUBLE AS lat, -0.5::DOUBLE + 0.7::DOUBLE * ((i * 104729 + 29) % 10009) / 10009.0::DOUBLE AS lon FROM range(1000) t(i)")
def generated_points(spark, sf_dir):
    """Points in a box from their number alone, the same in every engine."""
    return generate_points(spark, 1000, 51.3, 0.4, -0.5, 0.7)


def generate_points(spark: SparkSession, n: int, min_lat: float, height: float, min_lon: float, width: float) -> DataFrame:
    lat, lon = (F.col("id") * 7919 + 13) % 10007, (F.col("id") * 104729 + 29) % 10009
    return spark.range(n).select("id", (F.lit(min_lat) + F.lit(height) * lat / 10007.0).alias("lat"), (F.lit(min_lon) + F.lit(width) * lon / 10009.0).alias("lon"))


def random_points(spark: SparkSession, n: int, min_lat: float, max_lat: float, min_lon: float, max_lon: float, seed: int = 0) -> DataFrame:
    """Uniform points in a box, latitude drawn first."""
    return spark.range(n).select(F.col("id").alias("req_id"), (min_lat + F.rand(seed) * (max_lat - min_lat)).alias("lat"), (min_lon + F.rand(seed + 1) * (max_lon - min_lon)).alias("lon"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql is not None}
