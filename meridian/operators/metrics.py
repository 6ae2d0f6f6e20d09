"""Counts, latencies, histograms and runtime samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import human_bytes, rfc3339
from .ordering import numbered, running_total

PERCENTILES = (50, 95, 99)
# Bounds of the latency histogram, in seconds, and the gauges of a sample.
BUCKETS = (0.0001, 0.0005, 0.001, 0.005, 0.01, 0.05, 0.1)
PEAKS = ["heap_alloc", "heap_sys", "heap_inuse", "stack_inuse", "sys", "process_rss_bytes", "num_goroutine"]
SHOWN_SAMPLES = 100


def percentiles(rows: DataFrame, value: str, by: list[str] = (), ps: tuple[int, ...] = PERCENTILES) -> DataFrame:
    """sorted[n * p / 100] by whole-number division, without interpolation.

    Equal values are counted first, so a running count over distinct values finds the
    place; no group's values are gathered."""
    by = list(by)
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    # One running count over all groups, made by ranges; a group's own starts at its least.
    run = running_total(counts, [*by, "v"], F.col("n"), "before")
    whole = run.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(F.min("before").alias("start"), F.sum("n").alias("total"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], F.lit(True))
    # Without groups this is one row.
    run = run.join(F.broadcast(whole), F.lit(True)) if not by else run.join(whole, same)
    at = [F.min(F.when(F.col("before") - F.col("start") + F.col("n") > F.floor(F.col("total") * p / 100), F.col("v"))).alias(f"p{p}") for p in ps]
    return run.groupBy(*by).agg(*at)


def latency_summary(rows: DataFrame, value: str) -> DataFrame:
    """count, min, max, avg (whole-number division of the sum) of integer durations."""
    return rows.agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.expr(f"sum(`{value}`) div count(`{value}`)").alias("avg"))


def counters(rows: DataFrame, ok, size) -> DataFrame:
    """Requests that went well or failed, and the points of those that went well."""
    n = lambda c: F.coalesce(F.sum(F.when(c, F.lit(1)).otherwise(F.lit(0))), F.lit(0)).cast("long")
    return rows.agg(n(ok).alias("ok"), n(~ok).alias("failed"), F.coalesce(F.sum(F.when(ok, size)), F.lit(0)).cast("long").alias("points"))


def throughput(counts: DataFrame, seconds: float) -> DataFrame:
    return counts.select("*", (F.col("ok") / F.lit(float(seconds))).alias("requests_per_second"), (F.col("points") / F.lit(float(seconds))).alias("points_per_second"))


def histogram(rows: DataFrame, value: str, bounds: tuple[float, ...] = BUCKETS) -> DataFrame:
    """(le, count): how many values are at most each bound; the last bound is infinity."""
    counts = [F.struct(F.lit(float(b)).alias("le"), F.coalesce(F.sum((F.col(value) <= b).cast("long")), F.lit(0)).alias("count")) for b in bounds]
    counts.append(F.struct(F.lit(float("inf")).alias("le"), F.count(value).alias("count")))
    return rows.agg(F.array(*counts).alias("h")).select(F.inline("h"))


def stats_summary(samples: DataFrame) -> DataFrame:
    """Peaks of the gauges, the CPU's peak and mean, and the samples' count."""
    return samples.agg(F.count(F.lit(1)).alias("samples"), *[F.max(c).alias(f"peak_{c}") for c in PEAKS], F.max("cpu_percent").alias("peak_cpu"), F.avg("cpu_percent").alias("avg_cpu"), F.max("num_gc").alias("total_gc"))


def evenly_chosen(samples: DataFrame, order: str, most: int = SHOWN_SAMPLES) -> DataFrame:
    """All samples, or of more than ``most`` those at floor(i * (n - 1) / (most - 1))."""
    n = samples.count()
    if n <= most:
        return samples
    step = (n - 1) / (most - 1)
    wanted = [int(i * step) for i in range(most)]
    return numbered(samples, [order], "__at").where(F.col("__at").isin(wanted)).drop("__at")


def report_lines(samples: DataFrame) -> DataFrame:
    """(ord, line): the summary and the evenly chosen samples as text."""
    s = stats_summary(samples)
    times = samples.agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    both = s.crossJoin(times)  # one row each
    line = lambda label, c: F.concat(F.lit(f"{label}: "), c)
    head = both.select(F.posexplode(F.array(line("Start", rfc3339(F.col("first"))), line("End", rfc3339(F.col("last"))), line("Samples", F.col("samples").cast("string")), line("Peak heap", human_bytes(F.col("peak_heap_alloc"))), line("Peak system", human_bytes(F.col("peak_sys"))), line("Peak RSS", human_bytes(F.col("peak_process_rss_bytes"))), line("Peak CPU", F.format_string("%.2f%%", "peak_cpu")), line("Mean CPU", F.format_string("%.2f%%", "avg_cpu")), line("GC cycles", F.col("total_gc").cast("string")))).alias("ord", "line"))
    rows = evenly_chosen(samples, "elapsed_seconds")
    order = F.row_number().over(Window.orderBy("elapsed_seconds")) + 100  # at most SHOWN_SAMPLES rows
    body = rows.select(order.alias("ord"), F.format_string("%.1f %s %s %s %.1f %d", "elapsed_seconds", human_bytes(F.col("heap_alloc")), human_bytes(F.col("process_rss_bytes")), human_bytes(F.col("sys")), "cpu_percent", "num_goroutine").alias("line"))
    return head.unionByName(body)
