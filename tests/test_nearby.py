"""Choices among nearby points without a row for each pair."""

import math

import numpy as np
import pytest

from meridian.operators import nearby, spatial
from meridian.operators.geocode import reverse_geocode
from meridian.operators.nearby import FIRST, FOLD, NEAREST, WEIGHT_FIRST, Nearby

from .test_search import square


def one_by_one(points, x, y, radius, mode, k=3):
    """(d2, weight, visit) of the choice, or the first ids; points are (id, visit, x, y, weight)."""
    near = sorted((v, (x - a) * (x - a) + (y - b) * (y - b), w, i) for i, v, a, b, w in points if (x - a) * (x - a) + (y - b) * (y - b) <= radius * radius)
    if mode == FIRST:
        return [i for _, _, i in sorted((v, i, i) for v, _, _, i in near)][:k]
    best = None
    for v, d, w, _ in near if mode == FOLD else sorted(near, key=lambda n: (n[0], n[3])):
        better = {FOLD: lambda: d < best[0] or w > best[1], NEAREST: lambda: (d, v) < (best[0], best[2]), WEIGHT_FIRST: lambda: (-w, d, v) < (-best[1], best[0], best[2])}[mode]
        if best is None or better():
            best = (d, w, v)
    return best


def made(rng, n, kind):
    xy = rng.uniform(0, 4, (n, 2))
    if kind == "grid":
        xy = np.round(xy * 4) / 4
    if kind == "line":
        xy[:, 0] = 1.5
    if kind == "sorted":
        xy = xy[np.argsort(xy[:, 0])]
    visit = np.arange(n) if kind != "grid" else np.sort(rng.integers(0, n // 3 + 1, n))
    return [(i, int(visit[i]), float(xy[i, 0]), float(xy[i, 1]), int(rng.integers(0, 4))) for i in range(n)]


@pytest.mark.parametrize("kind", ["even", "grid", "line", "sorted"])
@pytest.mark.parametrize("piece", [50, 1 << 20])
def test_index_equals_going_through_all(monkeypatch, kind, piece):
    monkeypatch.setattr(nearby, "PIECE", piece)
    rng = np.random.default_rng(5)
    for n in (1, 70, 900):
        points = made(rng, n, kind)
        visit, x, y, weight = (np.array([p[k] for p in points]) for k in (1, 2, 3, 4))
        px, py = np.round(rng.uniform(-1, 5, (2, 60)) * 4) / 4
        for mode in (FOLD, NEAREST, WEIGHT_FIRST, FIRST):
            index = Nearby(x, y, visit, weight, 0.75, mode)
            if mode == FIRST:
                got = [[int(i) for i in row if i >= 0] for row in index.first(px, py, 3)]
            else:
                found, d2, _, _ = index.best(px, py, mode)
                got = [None if i < 0 else (float(d), int(weight[i]), int(visit[i])) for i, d in zip(found, d2)]
            assert got == [one_by_one(points, a, b, 0.75, mode) for a, b in zip(px, py)]


def test_work_grows_with_the_points_logarithm():
    """Of a hundred times the points a probe looks at few more, not at a hundred times as many."""
    rng = np.random.default_rng(2)
    px, py = rng.uniform(0.8, 1.2, (2, 200))
    for mode in (FOLD, NEAREST, WEIGHT_FIRST, FIRST):
        seen = []
        for n in (1_000, 100_000):
            x, y = rng.uniform(0, 2, (2, n))
            index = Nearby(x, y, np.arange(n), np.arange(n) % 4, 0.5, mode)
            plain, looked = index._within, [0]

            def counted(grid, *a):
                for p, j in grid.pairs(a[0], a[1], a[2], np.sqrt(a[3])):
                    looked[0] += len(p)
                yield from plain(grid, *a)

            index._within = counted
            index.first(px, py, 3) if mode == FIRST else index.best(px, py, mode)
            seen.append(looked[0])
        assert seen[1] < 4 * seen[0]


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(11)
    points = made(rng, 500, "grid")
    probes = [(k, *(np.round(rng.uniform(-1, 5, 2) * 4) / 4).tolist()) for k in range(150)]
    odd = [(900, None, 1.0), (901, math.nan, 1.0), (902, math.inf, 1.0), (903, 50.0, 50.0)]
    return points, probes, odd, spark.createDataFrame(points, "point_id long, visit_ord long, x double, y double, weight short"), spark.createDataFrame(probes + odd, "req_id long, lon double, lat double").repartition(5)


@pytest.mark.parametrize("salt", [1, 3, None])
def test_search_equals_going_through_all(monkeypatch, frames, salt):
    monkeypatch.setattr(spatial, "LOT", 2)
    monkeypatch.setattr(spatial, "CROWD", 4)
    points, probes, odd, p, q = frames
    visit = {i: v for i, v, *_ in points}
    for mode in (FOLD, NEAREST, WEIGHT_FIRST):
        want = {k: best for k, x, y in probes if (best := one_by_one(points, x, y, 0.5, mode))}
        rows = spatial.search(q, p, 0.5, ["req_id"], mode, salt=salt).collect()
        assert {r.req_id: (r.d2, r.weight, visit[r.point_id]) for r in rows} == want and len(rows) == len(want) < len(probes)
        kept = spatial.search(q, p, 0.5, ["req_id"], mode, salt=salt, carry=["lat"], keep=True).collect()
        assert {r.req_id: (r.d2, r.weight, visit[r.point_id]) for r in kept if r.point_id is not None} == want
        assert sorted(r.req_id for r in kept) == [k for k, *_ in probes + odd] and {r.req_id: r.lat for r in kept}[903] == 50.0
    first = spatial.search_first(q, p, 0.5, ["req_id"], 3, salt=salt).collect()
    assert {r.req_id: list(r.point_ids) for r in first} == {k: ids for k, x, y in probes if (ids := one_by_one(points, x, y, 0.5, FIRST))}


def test_probes_without_a_place_are_answered(spark, frames):
    _, probes, odd, p, q = frames
    texts = p.selectExpr("*", "'n' AS name", "'s' AS street", "'1' AS house_number", "'c' AS city", "'' AS region")
    got = {r.req_id: r.found for r in reverse_geocode(q, texts, square(spark, [(1, 1, "R", 40, 40, 60, 60)]), 0.5).collect()}
    assert len(got) == len(probes) + len(odd) and [got[k] for k, *_ in odd] == [False, False, False, True]
    none = reverse_geocode(q, texts.where("false"), square(spark, [(1, 1, "R", 40, 40, 60, 60)]), 0.5).where("found").collect()
    assert [r.req_id for r in none] == [903]


@pytest.mark.parametrize("name", ["pick_fold", "pick_nearest", "pick_weight_first", "early_stop", "reverse_geocode_fold", "single_geocode", "read_answers", "batch_geocode", "cache_geocode"])
def test_no_pair_is_a_row(spark, sf_dir, name):
    """Probes and points never meet in a join, so nothing that grows with their product is shuffled."""
    from meridian.plans import queries as plans

    text = plans.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in text and "SortMergeJoin" not in text and "ShuffledHashJoin" not in text and "MapInArrow" in text
    assert all("LeftSemi" in line or "LeftOuter" in line for line in text.splitlines() if "BroadcastHashJoin" in line)


def test_a_radius_join_copies_points_and_not_probes(spark):
    """Of many probes and few points the probes are shuffled once each."""
    p = spark.range(10).selectExpr("id AS point_id", "CAST(id AS DOUBLE) AS x", "0D AS y")
    q = spark.range(5000).selectExpr("id AS req_id", "id % 100 / 10D AS lon", "0D AS lat")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = spatial.radius_join(q, p, 0.5)._jdf.queryExecution().executedPlan().toString()
        sides = plan.split("Exchange hashpartitioning")[1:]
        assert len(sides) == 2 and "explode([[" not in sides[0] and "explode([[" in sides[1]
        assert spatial.radius_join(q, p, 0.5).count() == sum(abs(k % 100 / 10 - i) <= 0.5 for k in range(5000) for i in range(10))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
