"""Comparison of two result lists, request by request and place by place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import RESULT_FIELDS


def differences(a: str, b: str):
    """The text of all differing fields of two structs, "" where they agree."""
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    parts = []
    for name in RESULT_FIELDS:
        x, y = F.col(f"{a}.{name}"), F.col(f"{b}.{name}")
        shown = (x.cast("string"), y.cast("string")) if name == "weight" else (quoted(x), quoted(y))
        parts.append(F.when(x != y, F.concat(F.lit(f"{name}: "), shown[0], F.lit(" vs "), shown[1])))
    return F.concat_ws("; ", *parts)


def compare(left: DataFrame, right: DataFrame, keys: list[str] = ("req_id", "pos")) -> DataFrame:
    """(keys, detail) for places that both lists have: "" where they match."""
    keys = list(keys)
    a = left.select(*keys, F.struct(*RESULT_FIELDS).alias("a"))
    b = right.select(*keys, F.struct(*RESULT_FIELDS).alias("b"))
    return a.join(b, keys).select(*keys, differences("a", "b").alias("detail"))


def compare_report(left: DataFrame, right: DataFrame, request: str = "req_id", place: str = "pos") -> DataFrame:
    """One row: matches, mismatches and match_rate in percent.

    Lists of different lengths add the difference to the mismatches."""
    both = compare(left, right, [request, place])
    sizes = left.groupBy(request).agg(F.count(F.lit(1)).alias("m")).join(right.groupBy(request).agg(F.count(F.lit(1)).alias("n")), request, "full")
    extra = sizes.agg(F.coalesce(F.sum(F.abs(F.coalesce("m", F.lit(0)) - F.coalesce("n", F.lit(0)))), F.lit(0)).alias("extra"))
    counts = both.agg(F.coalesce(F.sum((F.col("detail") == "").cast("long")), F.lit(0)).alias("matches"), F.coalesce(F.sum((F.col("detail") != "").cast("long")), F.lit(0)).alias("differing"))
    out = counts.crossJoin(extra).withColumn("mismatches", F.col("differing") + F.col("extra"))  # one row each
    return out.select("matches", "mismatches", F.coalesce(F.try_divide(100.0 * F.col("matches"), F.col("matches") + F.col("mismatches")), F.lit(0.0)).alias("match_rate"))


def shown_mismatches(left: DataFrame, right: DataFrame, probes: DataFrame, keys: list[str] = ("req_id", "pos"), most: int = 50) -> DataFrame:
    """At most ``most`` mismatches with their coordinates, in order of the keys."""
    keys = list(keys)
    return compare(left, right, keys).where("detail <> ''").join(probes.select(*keys, "lat", "lon"), keys).orderBy(*keys).limit(most).select(*keys, "lat", "lon", "detail")
