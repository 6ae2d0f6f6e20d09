"""Sets and maps over integers, kept as maximal half-open ranges (lo, hi, value).

Operations are rows of a log; the last one of a key wins, and what is left is coalesced.
Keys are 64-bit, the largest one excepted, whose range would have no end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import scratch

MAX_KEY = (1 << 63) - 1
#: Keys are first coalesced in buckets of so many, so no task sees all keys of a value.
BUCKET = 1 << 20


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "lo bigint, hi bigint, value string")


def replay(log: DataFrame) -> DataFrame:
    """(key, value) after all operations (op_seq, op, key, value).

    ``set`` overwrites, ``set_if_absent`` does so only where the key is unset, ``delete``
    removes, ``clear`` removes everything before it. One hash aggregation, whatever the log.
    """
    bad = log.where((F.col("op") != "clear") & (F.col("key") >= MAX_KEY))
    if bad.head(1):
        raise ValueError("the largest key has no range")
    cleared = F.coalesce(F.max(F.when(F.col("op") == "clear", F.col("op_seq"))), F.lit(-1)).alias("cleared")
    live = log.crossJoin(F.broadcast(log.agg(cleared))).where((F.col("op_seq") > F.col("cleared")) & (F.col("op") != "clear"))  # one row
    # The last overwrite or removal counts, then the first set_if_absent after a removal.
    firm = F.col("op").isin("set", "delete")
    last = live.where(firm).groupBy("key").agg(F.max_by(F.struct("op_seq", "op", "value"), "op_seq").alias("last"))
    soft = live.where(F.col("op") == "set_if_absent").join(last.withColumnRenamed("last", "l"), "key", "left")
    soft = soft.where(F.col("l").isNull() | ((F.col("l.op") == "delete") & (F.col("op_seq") > F.col("l.op_seq"))))
    soft = soft.groupBy("key").agg(F.min_by("value", "op_seq").alias("value"))
    kept = last.where(F.col("last.op") == "set").select("key", F.col("last.value").alias("value"))
    return kept.unionByName(soft)


def coalesce_keys(keys: DataFrame) -> DataFrame:
    """Maximal ranges of consecutive keys with equal values from distinct (key, value) rows.

    Runs are found inside buckets of keys; only those that end at a bucket's edge, two a
    bucket and value at most, meet others across buckets.
    """
    rows = keys.select(F.col("key").cast("long").alias("key"), "value").distinct()
    own = Window.partitionBy("value", "bucket").orderBy("key")
    placed = rows.withColumn("bucket", F.floor(F.col("key") / BUCKET))
    runs = placed.withColumn("g", F.col("key") - F.row_number().over(own)).groupBy("value", "bucket", "g").agg(F.min("key").alias("lo"), (F.max("key") + 1).alias("hi"))
    edge = (F.col("lo") == F.col("bucket") * BUCKET) | (F.col("hi") == (F.col("bucket") + 1) * BUCKET)
    inner = runs.where(~edge).select("lo", "hi", "value")
    return inner.unionByName(merge_ranges(runs.where(edge).select("lo", "hi", "value")))


def merge_ranges(ranges: DataFrame) -> DataFrame:
    """Joins touching or overlapping ranges of one value."""
    before = Window.partitionBy("value").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("value").orderBy("lo", "hi")
    started = ranges.withColumn("new", (F.col("lo") > F.coalesce(F.max("hi").over(before), F.col("lo") - 1)).cast("int"))
    return started.withColumn("g", F.sum("new").over(upto)).groupBy("value", "g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("lo", "hi", "value")


#: Blocks of a level hold so many bits more of a key than those of the level before.
BITS, LEVELS = 4, 16


def covered(ranges: DataFrame) -> DataFrame:
    """The ranges with (level, cell), a row for each block of keys that they are made of:
    cell c of level n holds the 16^n keys from c * 16^n on. However wide a range is, it
    has at most 30 blocks a level, 480 in all."""
    none = "CAST(array() AS ARRAY<STRUCT<level: INT, cell: BIGINT>>)"
    start = f"named_struct('a', CAST(lo AS BIGINT), 'b', CAST(hi AS BIGINT), 'cells', {none})"
    up, down = f"(shiftright(s.a, {BITS}) + IF((s.a & 15) = 0, 0L, 1L))", f"shiftright(s.b, {BITS})"
    run = lambda first, last: f"IF({first} < {last}, transform(sequence({first}, {last} - 1L), c -> named_struct('level', n, 'cell', c)), {none})"
    # What is left of the next level's first whole block, and right of its last, is of this level.
    split = f"named_struct('a', {up}, 'b', {down}, 'cells', concat(s.cells, {run('s.a', f'{up} * 16L')}, {run(f'{down} * 16L', 's.b')}))"
    ended = f"named_struct('a', 0L, 'b', 0L, 'cells', concat(s.cells, {run('s.a', 's.b')}))"
    step = f"CASE WHEN s.a >= s.b THEN s WHEN {up} >= {down} THEN {ended} ELSE {split} END"
    return ranges.where("lo < hi").withColumn("c", F.explode(F.expr(f"aggregate(sequence(0, {LEVELS - 1}), {start}, (s, n) -> {step}, s -> s.cells)"))).select(*ranges.columns, "c.level", "c.cell")


#: So many blocks of the levels that have fewest are sent to all tasks.
SENT_BLOCKS = 100_000


def holding(ranges: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The keys' rows joined with each range that holds the key: an equi-join on blocks, in
    which every match is a result. A key looks only at levels that some range has, and is
    shuffled only for those with many blocks: a few wide ranges have few blocks on many levels."""
    cells = scratch(covered(ranges), "blocks")
    few, many, total = [], [], 0
    for level, n in sorted(((r.level, r.n) for r in cells.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()), key=lambda r: r[1]):  # at most LEVELS
        total += n
        (few if total <= SENT_BLOCKS else many).append(level)

    def met(levels: list[int], sent: bool) -> DataFrame:
        own = cells.where(F.col("level").isin(levels) if levels else F.lit(False))
        asked = keys.withColumn("level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")))
        return asked.withColumn("cell", F.expr(f"shiftright(`{key}`, level * {BITS})")).join(F.broadcast(own) if sent else own, ["level", "cell"]).drop("level", "cell")

    if few and many:
        return met(few, True).unionByName(met(many, False))
    return met(few or many, not many)


def get(ranges: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """The keys with ``value`` and ``contains``, through the range that holds each (of
    several the one with the largest lo)."""
    asked = keys.select(F.col(key).cast("long").alias("asked")).where("asked is not null").distinct()
    found = holding(ranges.select("lo", "hi", "value"), asked, "asked").groupBy("asked").agg(F.max_by(F.struct("value"), "lo").alias("r"))
    out = keys.join(found, keys[key].cast("long") == found["asked"], "left")
    return out.withColumns({"value": F.col("r.value"), "contains": F.col("asked").isNotNull()}).drop("asked", "r")


def overlapping(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (lo, hi, value, other_lo, other_hi, other_value) of ranges that share a key.

    Of two such ranges one holds the first key of the other, so each pair is found by a
    lookup of first keys: in the right ranges, and of later ones in the left.
    """
    left = left.where("lo < hi").select(F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), "value")
    right = right.where("lo < hi").select(F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), "value")
    renamed = lambda df: df.select(F.col("lo").alias("other_lo"), F.col("hi").alias("other_hi"), F.col("value").alias("other_value"))
    columns = ["lo", "hi", "value", "other_lo", "other_hi", "other_value"]
    asked = left.select(F.col("lo").alias("l"), F.col("hi").alias("h"), F.col("value").alias("v"))
    inside = holding(right, asked, "l").select(F.col("l").alias("lo"), F.col("h").alias("hi"), F.col("v").alias("value"), F.col("lo").alias("other_lo"), F.col("hi").alias("other_hi"), F.col("value").alias("other_value"))
    later = holding(left, renamed(right), "other_lo").where("other_lo > lo").select(columns)
    return inside.select(columns).unionByName(later)


def distinct_ids(rows: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """The first row of each key (by ``order``, else any)."""
    if order is None:
        return rows.dropDuplicates([key])
    return rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def duplicate_count(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct"), F.sum(F.col("n") - 1).alias("duplicates"))


def distinct_points(points: DataFrame, ids: tuple[str, ...] = ("point_id", "visit_ord")) -> DataFrame:
    """Points that differ in more than their ids, each with its smallest ids."""
    rest = [c for c in points.columns if c not in ids]
    return points.groupBy(*rest).agg(*[F.min(c).alias(c) for c in ids if c in points.columns]).select(points.columns)
