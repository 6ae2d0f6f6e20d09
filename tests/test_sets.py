import random

import pytest
from pyspark.sql import functions as F

from meridian.operators import rangeset
from meridian.operators.dictionary import encode, heap
from meridian.operators.metrics import evenly_chosen, histogram, percentiles, report_lines
from meridian.operators.ordering import numbered, running_total


def log_frame(spark, ops):
    return spark.createDataFrame([(i, *op) for i, op in enumerate(ops)], "op_seq long, op string, key long, value string")


def expected(ops):
    state = {}
    for op, key, value in ops:
        if op == "set":
            state[key] = value
        elif op == "set_if_absent":
            state.setdefault(key, value)
        elif op == "delete":
            state.pop(key, None)
        else:
            state.clear()
    out = []
    for k in sorted(state):
        if out and out[-1][1] == k and out[-1][2] == state[k]:
            out[-1][1] = k + 1
        else:
            out.append([k, k + 1, state[k]])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("seed", range(4))
def test_replay_equals_a_plain_map(spark, seed):
    r = random.Random(seed)
    ops = [(r.choice(["set", "set", "set_if_absent", "delete", "clear"] if r.random() < 0.05 else ["set", "set", "set_if_absent", "delete"]), r.randint(-12, 12), r.choice("ab")) for _ in range(120)]
    got = rangeset.coalesce_keys(rangeset.replay(log_frame(spark, ops)))
    assert sorted(map(tuple, got.select("lo", "hi", "value").collect())) == expected(ops)


def test_ranges_meet_across_buckets(spark):
    edge = rangeset.BUCKET
    keys = spark.range(edge - 3, edge + 4).select(F.col("id").alias("key"), F.lit("v").alias("value"))
    assert [tuple(r) for r in rangeset.coalesce_keys(keys).collect()] == [(edge - 3, edge + 4, "v")]


def test_get_and_overlap(spark):
    ranges = spark.createDataFrame([(-5, 3, "a"), (3, 4, "b"), (10, rangeset.BUCKET * 2 + 5, "c")], "lo long, hi long, value string")
    keys = spark.createDataFrame([(k,) for k in (-6, -5, 2, 3, 4, 9, 10, rangeset.BUCKET * 2 + 4, rangeset.BUCKET * 2 + 5)], "key long")
    got = {r.key: (r.value, r.contains) for r in rangeset.get(ranges, keys).collect()}
    assert [v for v, _ in (got[k] for k in sorted(got))] == [None, "a", "a", "b", None, None, "c", "c", None]
    other = spark.createDataFrame([(0, 11, "q"), (4, 10, "none"), (7, 7, "empty")], "lo long, hi long, value string")
    assert sorted((r.value, r.other_value) for r in rangeset.overlapping(other, ranges).collect()) == [("q", "a"), ("q", "b"), ("q", "c")]


def test_wide_ranges(spark):
    """A range of any width has few blocks, and they hold its keys and no others."""
    r, top = random.Random(6), rangeset.MAX_KEY
    ranges = [(-(2**62), -(2**61) + 7, "low"), (-9, 2**61, "wide"), (2**61, 2**61 + 1, "one"), (2**62 + 3, top, "high"), (5, 5, "empty")]
    df = spark.createDataFrame(ranges, "lo long, hi long, value string")
    assert rangeset.covered(df).count() <= 4 * 480 and rangeset.covered(df).where("value = 'empty'").count() == 0
    keys = sorted({k + d for lo, hi, _ in ranges for k in (lo, hi) for d in (-1, 0, 1) if abs(k + d) <= top} | {r.randrange(-top, top) for _ in range(200)})
    got = {x.key: x.value for x in rangeset.get(df, spark.createDataFrame([(k,) for k in keys], "key long")).collect()}
    assert got == {k: next((v for lo, hi, v in ranges if lo <= k < hi), None) for k in keys}
    others = [tuple(sorted((r.choice(keys), r.choice(keys)))) for _ in range(60)] + [(0, 2**61)]
    pairs = rangeset.overlapping(spark.createDataFrame([(a, b, str(i)) for i, (a, b) in enumerate(others)], "lo long, hi long, value string"), df)
    want = sorted((str(i), v) for i, (a, b) in enumerate(others) for lo, hi, v in ranges if a < b and lo < hi and a < hi and lo < b)
    assert sorted((x.value, x.other_value) for x in pairs.collect()) == want


def test_empty_and_limits(spark):
    assert rangeset.coalesce_keys(rangeset.replay(log_frame(spark, [("delete", 1, None)]))).count() == 0
    assert rangeset.empty(spark).columns == ["lo", "hi", "value"]
    with pytest.raises(ValueError):
        rangeset.replay(log_frame(spark, [("set", rangeset.MAX_KEY, "a")]))


def test_dictionary(spark):
    rows = spark.createDataFrame([(0, "foo", ""), (1, "bar", "foo"), (2, None, "bäz"), (3, "foo", "bar")], "o long, a string, b string")
    d = heap(encode(rows, ["a", "b"], "o")).orderBy("id").collect()
    assert [(r.id, r.text, r.offset) for r in d] == [(0, "", 0), (1, "foo", 1), (2, "bar", 5), (3, "bäz", 9)]


def test_numbers_over_ranges(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    assert all(r.k == r.at for r in numbered(rows, ["k"], "at").collect())
    assert all(r.t == r.k * (r.k - 1) // 2 for r in running_total(rows, ["k"], F.col("k"), "t").collect())
    assert numbered(rows.limit(0), ["k"], "at").count() == 0


@pytest.mark.parametrize("n", [1, 2, 100, 101])
def test_percentiles_index(spark, n):
    row = percentiles(spark.range(n).select((F.col("id") % max(1, n // 3)).alias("v")), "v").first()
    values = sorted(i % max(1, n // 3) for i in range(n))
    assert [row.p50, row.p95, row.p99] == [values[n * p // 100] for p in (50, 95, 99)]


def test_histogram_and_samples(spark):
    assert [r["count"] for r in histogram(spark.createDataFrame([(0.0001,), (0.02,), (9.0,)], "s double"), "s").collect()] == [1, 1, 1, 1, 1, 2, 2, 3]
    chosen = sorted(r.id for r in evenly_chosen(spark.range(1000), "id").collect())
    assert chosen == [int(i * (999 / 99)) for i in range(100)]


def test_report(spark):
    from meridian.plans.queries import _samples
    lines = [r.line for r in report_lines(_samples(spark, "/root/testdata/sf0.001")).orderBy("ord").collect()]
    assert lines[0].startswith("Start: ") and len(lines) == 109


def test_sampler_and_observation(spark):
    from meridian.operators.sampler import Sampler, observed, partitions_for
    sampler = Sampler(spark, 0.05).start()
    rows, seen = observed(spark.range(100), "r", total=F.sum("id"))
    rows.write.format("noop").mode("overwrite").save()
    samples = sampler.stop()
    assert samples.count() >= 2 and samples.agg(F.min("heap_alloc")).first()[0] > 0
    assert seen.get == {"rows": 100, "total": 4950}
    assert [partitions_for(n, 1000, 8) for n in (10, 5000, 10**6)] == [2, 4, 4] and partitions_for(5, 1, 1) == 1
    with pytest.raises(ValueError):
        partitions_for(1, 0, 8)


def test_distinct_points(spark):
    rows = spark.createDataFrame([(1, 0.0, "a"), (2, 0.0, "a"), (3, 0.0, "b")], "point_id long, x double, name string")
    assert sorted(map(tuple, rangeset.distinct_points(rows).collect())) == [(1, 0.0, "a"), (3, 0.0, "b")]


def test_few_wide_ranges_send_no_key_to_every_level(spark, monkeypatch):
    """Blocks of levels with few are sent; a key is shuffled for the crowded level only, with equal answers."""
    narrow = spark.range(0, 3000, 3).selectExpr("id AS lo", "id + 2 AS hi", "CAST(id AS STRING) AS value")
    ranges = narrow.unionByName(spark.createDataFrame([(10**6 + 1, 2**61 + 5, "wide"), (-(2**40), -7, "low")], "lo bigint, hi bigint, value string"))
    keys = spark.range(-20, 3100).selectExpr("id AS key").unionByName(spark.range(1, 2000).selectExpr("id * 1000000007 AS key"))
    whole = sorted(map(tuple, rangeset.get(ranges, keys).na.fill("").collect()))
    assert {r[1] for r in whole if r[0] > 10**6} == {"wide"} and {r[1] for r in whole if r[0] < -7} == {"low"} and len(whole) == 5119
    monkeypatch.setattr(rangeset, "SENT_BLOCKS", 500)
    asked, seen = keys.distinct(), []
    found = rangeset.holding(ranges, asked, "key")
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, rangeset.get(ranges, keys).na.fill("").collect())) == whole
    for line in text.splitlines():
        if "Generate explode(" in line:
            seen.append(line[line.index("[", line.index("explode(")) : line.index("]")].count(",") + 1)
    assert len(seen) == 2 and min(seen) <= 2 < 10 < max(seen) and text.count("strategy=broadcast") == 1
    monkeypatch.setattr(rangeset, "SENT_BLOCKS", 0)
    assert sorted(map(tuple, rangeset.get(ranges, keys).na.fill("").collect())) == whole
    assert rangeset.get(rangeset.empty(spark), keys).where("contains").count() == 0
