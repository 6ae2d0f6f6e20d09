import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meridian.functions import geometry as g
from meridian.operators import spatial
from meridian.operators.geocode import ReverseGeocoder, parse_path, parse_request, read_info, reverse_geocode
from meridian.operators.zones import load_zones, rectangle, split_zones, zone_of
from meridian.schema import POLYGON, checked_radius


def points_frame(spark, rows):
    """rows: (id, x, y, weight)"""
    return spark.createDataFrame([(i, i, float(x), float(y), f"n{i}", "s", str(i), "c", "", w) for i, x, y, w in rows], "point_id long, visit_ord long, x double, y double, name string, street string, house_number string, city string, region string, weight short")


def probe_frame(spark, rows):
    return spark.createDataFrame([(i, float(lat), float(lon)) for i, lat, lon in rows], "req_id long, lat double, lon double")


def square(spark, rows):
    """rows: (zone_id, type, name, x0, y0, x1, y1)"""
    df = spark.createDataFrame([(a, b, c, *map(float, r)) for a, b, c, *r in rows], "zone_id long, zone_type int, name string, x0 double, y0 double, x1 double, y1 double")
    return load_zones(df.select("zone_id", F.col("zone_type").cast("tinyint").alias("zone_type"), "name", rectangle(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]).alias("polygon")))


@pytest.mark.parametrize("order,expected", [((0, 1, 2), 1), ((1, 0, 2), 2)])
def test_fold_depends_on_order(spark, order, expected):
    # A weighs most and is farthest, B is nearest, C lies between.
    far = [(0.5, 10), (0.3, 0), (0.4, 0)]
    rows = spark.createDataFrame([(0, visit, far[k][0] ** 2, far[k][1], k) for visit, k in enumerate(order)], "req_id long, visit_ord long, d2 double, weight short, point_id long")
    assert spatial.pick(rows, ["req_id"], spatial.FOLD).first().point_id == expected
    assert spatial.pick(rows, ["req_id"], spatial.NEAREST).first().point_id == 1
    assert spatial.pick(rows, ["req_id"], spatial.WEIGHT_FIRST).first().point_id == 0


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        spatial.pick(spark.range(0), ["id"], "best")


def test_radius_edge_is_inside(spark):
    pts = points_frame(spark, [(1, 0.5, 0, 1), (2, 0.50001, 0, 1), (3, 0, 0, 1)])
    probe = probe_frame(spark, [(0, 0, 0)]).select("req_id", "lon", "lat")
    found = lambda r: {x.point_id for x in spatial.radius_join(probe, pts, r).collect()}
    assert found(0.5) == {1, 3}
    assert found(0) == {3}
    with pytest.raises(ValueError):
        spatial.radius_join(probe, pts, math.inf)


@pytest.mark.parametrize("salt", [1, 3])
def test_radius_join_equals_brute_force(spark, salt):
    rng = np.random.default_rng(7)
    p, q, r = rng.uniform(-3, 3, (400, 2)), rng.uniform(-3, 3, (150, 2)), 0.37
    pts = points_frame(spark, [(i, x, y, 1) for i, (x, y) in enumerate(p.tolist())])
    probes = probe_frame(spark, [(i, y, x) for i, (x, y) in enumerate(q.tolist())])
    got = {(r_.req_id, r_.point_id) for r_ in spatial.radius_join(probes, pts, r, salt=salt).select("req_id", "point_id").collect()}
    d2 = ((q[:, None] - p[None]) ** 2).sum(axis=2)
    assert got == {tuple(x) for x in np.argwhere(d2 <= r * r).tolist()}


def test_null_and_nan_coordinates_match_nothing(spark):
    pts = points_frame(spark, [(1, 0, 0, 1)]).unionByName(points_frame(spark, [(2, math.nan, 0, 1)]))
    probes = spark.createDataFrame([(0, None, 0.0), (1, math.nan, 0.0), (2, 0.0, 0.0)], "req_id long, lat double, lon double")
    assert [r.req_id for r in spatial.radius_join(probes, pts, 1).collect()] == [2]


def test_radius_default():
    assert [checked_radius(r) for r in (0, -1, 181, 180, 0.2)] == [0.01, 0.01, 0.01, 180, 0.2]


def test_zone_fallbacks(spark):
    zones = square(spark, [(1, 1, "R", 0, 0, 4, 4), (2, 2, "C", 2, 0, 8, 4)])
    pts = points_frame(spark, [(7, 1, 1, 9)])
    probes = probe_frame(spark, [(0, 1, 1), (1, 3, 1), (2, 1, 6), (3, 3, 3), (4, 9, 9)])
    got = {r.req_id: r for r in reverse_geocode(probes, pts, zones, 0.1).collect()}
    assert (got[0].found, got[0].name, got[0].region, got[0].country, got[0].weight) == (True, "n7", "R", "", 9)
    assert (got[1].found, got[1].region, got[1].country) == (True, "R", "")
    assert (got[2].found, got[2].region, got[2].country) == (True, "", "C")
    assert (got[3].region, got[3].country) == ("R", "C")
    assert not got[4].found and got[4].name == "" and got[4].weight == 0


def test_two_squares(spark):
    zones = square(spark, [(1, 1, "1", 0, 0, 1, 1), (2, 1, "2", -1, -1, 0, 0)])
    out = {r.req_id: r.zone for r in zone_of(probe_frame(spark, [(0, 0.5, 0.5), (1, -0.5, -0.5), (2, 5, 5)]), zones, "zone").collect()}
    assert out == {0: "1", 1: "2", 2: None}


def test_first_zone_wins_and_both_plans_agree(spark):
    zones = square(spark, [(5, 1, "late", 0, 0, 3, 3), (2, 1, "early", 1, 1, 4, 4), (9, 1, "far", 20, 20, 21, 21)])
    rng = np.random.default_rng(3)
    probes = probe_frame(spark, [(i, y, x) for i, (x, y) in enumerate(rng.uniform(-1, 5, (200, 2)).tolist())] + [(900, 1.0, 1.0), (901, 3.0, 3.0)])
    sent = sorted((r.req_id, r.zone or "") for r in zone_of(probes, zones, "zone").collect())
    joined = sorted((r.req_id, r.zone or "") for r in zone_of(probes, zones, "zone", sent_vertices=0).collect())
    assert sent == joined
    assert dict(sent)[900] == "early"


def test_simplified_away_zone_never_matches(spark):
    zones = square(spark, [(1, 1, "tiny", 0, 0, 0.001, 0.001)])
    assert zone_of(probe_frame(spark, [(0, 0.0005, 0.0005)]), zones, "zone").first().zone is None
    assert split_zones(zones, 2).count() == 0


SQUARE = np.array([(0, 0), (4, 0), (4, 4), (0, 4)], float)
HOLE = np.array([(1, 1), (2, 1), (2, 2), (1, 2)], float)


def test_polygon_rules():
    inside = lambda polygons, *p: g.multipolygon_contains(polygons, np.array([q[0] for q in p], float), np.array([q[1] for q in p], float)).tolist()
    assert inside([[SQUARE]], (2, 2), (4, 2), (0, 0), (4.001, 2)) == [True, True, True, False]
    assert inside([[SQUARE, HOLE]], (1.5, 1.5), (1, 1.5), (3, 3)) == [False, False, True]
    assert inside([[SQUARE], [SQUARE + 10]], (12, 12), (5, 5)) == [True, False]
    assert inside([[np.zeros((0, 2)), HOLE]], (1.5, 1.5)) == [False]
    concave = np.array([(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)], float)
    assert inside([[concave]], (2, 3), (0.5, 1)) == [False, True]


@settings(max_examples=60, deadline=None)
@given(st.floats(-5, 5), st.floats(-5, 5), st.floats(0.5, 4), st.floats(0.5, 4), st.floats(-6, 6), st.floats(-6, 6))
def test_rectangles_equal_comparison(x0, y0, w, h, px, py):
    ring = np.array([(x0, y0), (x0 + w, y0), (x0 + w, y0 + h), (x0, y0 + h)])
    x1, y1 = ring[2]
    margin = min(abs(px - x0), abs(px - x1), abs(py - y0), abs(py - y1))
    if margin > 1e-9:
        assert g.multipolygon_contains([[ring]], np.array([px]), np.array([py]))[0] == (x0 < px < x1 and y0 < py < y1)


def test_resample_spacing():
    line = np.array([(0.0, 51.0), (0.01, 51.0), (0.01, 51.02)])
    out = g.resample(line, 150)
    gaps = g.line_distances(out)
    assert (out[0] == line[0]).all() and (out[-1] == line[-1]).all()
    assert np.median(gaps) == pytest.approx(150, rel=0.05)
    assert len(g.resample(line[:1], 150)) == 1


def test_simplify_keeps_ends_and_tolerance():
    t = np.linspace(0, 1, 200)
    line = np.column_stack([t, 0.004 * np.sin(40 * t)])
    assert len(g.simplify_line(line, 0.01)) == 2
    assert len(g.simplify_line(line, 0.0001)) > 50
    assert g.simplify_polygons([[HOLE * 1e-4]], 0.01) == []


def test_scatter_is_spaced_and_seeded():
    a = g.scatter_in([[SQUARE, HOLE]], 0.3, 5)
    assert (a == g.scatter_in([[SQUARE, HOLE]], 0.3, 5)).all()
    d = np.sqrt(((a[:, None] - a[None]) ** 2).sum(axis=2)) + np.eye(len(a))
    assert d.min() >= 0.3 and len(a) > 60
    assert g.multipolygon_contains([[SQUARE, HOLE]], a[:, 0], a[:, 1]).all()


def test_distances_to_polygon():
    assert g.point_to_polygon_distance([[SQUARE]], 2, 1) == pytest.approx(1)
    assert g.point_to_polygon_distance([[SQUARE]], 6, 2) == pytest.approx(-2)
    assert g.polygon_centroid([[SQUARE, HOLE]])[0] == pytest.approx((16 * 2 - 1 * 1.5) / 15)
    assert g.ring_centroid(np.zeros((0, 2))) == (0.0, 0.0)


def test_columns_of_geometry(spark):
    row = spark.range(1).select(
        g.segment_distance_squared(*map(F.lit, (0.0, 2.0, -1.0, 0.0, 1.0, 0.0))).alias("d"),
        g.cantor_pair(F.lit(3), F.lit(4)).alias("c"),
        g.centroid(F.array().cast("array<struct<x:double,y:double>>")).alias("e"),
    ).first()
    assert row.d == 4 and row.c == 32 and (row.e.x, row.e.y) == (0, 0)


def test_requests_and_paths(spark):
    bodies = ["[]", "[[1, 2]]", "[[1,2], [3,4]]", "[[-1.4, -1],[-0, 1]]", "[[1]]", "[[1,2,3]]", "nonsense"]
    rows = parse_request(spark.createDataFrame(list(enumerate(bodies)), "req_id long, body string")).collect()
    assert sorted((r.req_id, r.pos, r.lat, r.lon) for r in rows) == [(1, 0, 1, 2), (2, 0, 1, 2), (2, 1, 3, 4), (3, 0, -1.4, -1), (3, 1, 0, 1), (4, 0, 1, 0), (5, 0, 1, 2)]
    paths = parse_path(spark.createDataFrame([(0, "/v1/address/1.5/2"), (1, "/v1/address/x/2")], "req_id long, path string")).orderBy("req_id").collect()
    assert [(p.status, p.lat, p.lon) for p in paths] == [(200, 1.5, 2.0), (400, None, 2.0)]


def test_info_json_reads_nulls_and_unknown_keys(spark):
    row = spark.createDataFrame([('{"name":null,"street":"s","extra":[1],"weight":7}',)], "t string").select(*read_info(F.col("t"))).first()
    assert (row.name, row.street, row.city, row.weight) == ("", "s", "", 7)


def test_geocoder_batches_keep_order(spark):
    n = 60
    pts = points_frame(spark, [(i, 0.01 * i, 0.01 * i, 10) for i in range(n)]).drop("visit_ord")
    coder = ReverseGeocoder(pts, search_radius=0.1, mode="nearest")
    import json
    body = json.dumps([[0.01 * i, 0.01 * i] for i in range(n)][::-1])
    rows = {r.req_id: r.answers for r in coder.find_batch(spark.createDataFrame([(1, body), (2, "[]"), (3, "[[80, 80]]")], "req_id long, body string")).collect()}
    assert [a["name"] for a in json.loads(rows[1])] == [f"n{i}" for i in range(n)][::-1]
    assert rows[2] == "[]" and json.loads(rows[3])[0]["name"] == "" and len(json.loads(rows[3])[0]) == 7
    assert coder.find(0.05, 0.05)["house_number"] == "5" and coder.find(80, 80) is None
    coder.close()


def test_plans(spark, sf_dir, tmp_path):
    """Radius search is a hash or merge join on cells, never a nested loop; boxes reach the scan."""
    from meridian.plans import queries as plans
    plan = lambda df: df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    text = plan(plans.radius_join(spark, sf_dir))
    assert "NestedLoop" not in text and "Cartesian" not in text
    pts = points_frame(spark, [(1, 1, 1, 1)])
    pts.write.mode("overwrite").parquet(str(tmp_path / "points"))
    text = plan(spatial.in_box(spark.read.parquet(str(tmp_path / "points")), 0, 0, 1, 1).select("point_id"))
    assert "GreaterThanOrEqual(x" in text and "ReadSchema: struct<point_id:bigint,x:double,y:double>" in text


def test_fold_equals_the_sequential_rule(spark):
    """300 random sequences with many ties, against going through them one by one."""
    import random
    r, rows, want = random.Random(1), [], {}
    for key in range(300):
        best = None
        for visit in range(r.randint(1, 12)):
            d2, weight = r.randint(0, 6) / 4, r.randint(0, 4)
            rows.append((key, visit, d2, weight, 1000 * key + visit))
            if best is None or d2 < best[0] or weight > best[1]:
                best = (d2, weight, 1000 * key + visit)
        want[key] = best
    df = spark.createDataFrame(rows, "req_id long, visit_ord long, d2 double, weight short, point_id long").repartition(5)
    got = {x.req_id: (x.d2, x.weight, x.point_id) for x in spatial.pick(df, ["req_id"], spatial.FOLD).collect()}
    assert got == want


def test_zone_plans_agree_on_polygons(spark):
    """Star-shaped zones with many vertices, sent to tasks or met on cells."""
    angles = np.linspace(0, 2 * math.pi, 61)[:-1]
    rows = []
    for k in range(6):
        radius = 1.5 + 0.7 * np.cos(5 * angles + k)
        ring = [{"x": float(2.2 * k + a), "y": float(b)} for a, b in zip(radius * np.cos(angles), radius * np.sin(angles))]
        rows.append((k, 1 + k % 2, f"z{k}", [[ring]]))
    zones = load_zones(spark.createDataFrame(rows, "zone_id long, zone_type tinyint, name string, polygon array<array<array<struct<x:double,y:double>>>>"), 0)
    rng = np.random.default_rng(8)
    probes = probe_frame(spark, [(i, y, x) for i, (x, y) in enumerate(rng.uniform((-3, -3), (14, 3), (2000, 2)).tolist())])
    types = {"a": 1, "b": 2, "any": None}
    from meridian.operators.zones import zones_of
    sent = sorted(tuple(r) for r in zones_of(probes, zones, types).na.fill("").collect())
    met = sorted(tuple(r) for r in zones_of(probes, zones, types, sent_vertices=0).na.fill("").collect())
    assert sent == met and len({r[-1] for r in sent}) == 7


def test_a_crowded_cell_is_dealt_out(spark, monkeypatch):
    """Cells are counted, the fullest is split, and the answers stay."""
    monkeypatch.setattr(spatial, "CROWD", 50)
    pts = points_frame(spark, [(i, 5 + i / 1e5, 5.0, i % 7) for i in range(400)] + [(900, 9.0, 9.0, 1)])
    probes = spark.createDataFrame([(0, 5.0, 5.0), (1, 9.0, 9.0), (2, 0.0, 0.0)], "req_id long, lon double, lat double")
    assert spatial.crowding(pts, 0.01) == 8 and spatial.crowding(pts.limit(0), 0.01) == 1
    one, dealt = (sorted(map(tuple, spatial.search(probes, pts, 0.01, ["req_id"], payload=["name"], salt=s).collect())) for s in (1, None))
    assert one == dealt and len(one) == 2


def test_zones_of_all_sizes_by_cells(spark):
    """One country among villages: few cells each, and the same answers as when zones are sent."""
    import random
    r = random.Random(3)
    squares = [(i, r.uniform(0, 20), r.uniform(0, 20), r.choice([1e-5, 0.01, 0.3, 4])) for i in range(60)] + [(99, 0.0, 0.0, 1000.0), (100, 5.0, 5.0, 0.0)]
    ring = lambda x, y, s: [{"x": x, "y": y}, {"x": x + s, "y": y}, {"x": x + s, "y": y + s}, {"x": x, "y": y + s}]
    zones = load_zones(spark.createDataFrame([(k, 1, f"z{k}", [[ring(x, y, s)]]) for k, x, y, s in squares], f"zone_id bigint, zone_type tinyint, name string, polygon {POLYGON}"), 0)
    rows = [(i, r.uniform(-2, 22), r.uniform(-2, 22)) for i in range(500)] + [(600 + k, x + s / 2, y + s / 2) for k, x, y, s in squares] + [(900, None, 1.0), (901, float("nan"), 1.0), (902, 5.0, 5.0)]
    pts = spark.createDataFrame(rows, "id long, lon double, lat double")
    got = [sorted(map(tuple, zone_of(pts, zones, "z", sent_vertices=n).select("id", "z").collect())) for n in (10**6, 0)]
    assert got[0] == got[1] and len({z for _, z in got[0]}) > 10
