"""Command line: generate, analyze, geocode, compare and bench.

    python -m meridian generate --input a.osm.pbf b.osm.pbf --output v2:out/a --output parquet:out/b
    python -m meridian analyze out/a.rgc
    python -m meridian geocode out/a.rgc --lat 51.5 --lon -0.12
    python -m meridian geocode out/a.rgc --requests requests.parquet --answers answers.parquet
    python -m meridian compare out/a.rgc out/b.rgc --points 1000
    python -m meridian bench out/a.rgc --points 1000 --requests 20
"""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.text import si_bytes
from .operators import compare, metrics
from .operators.geocode import ReverseGeocoder
from .operators.osm import Config, generate
from .plans.queries import random_points
from .schema import DEFAULT_RADIUS
from .sources.cache_files import sizes, write_all
from .sources.osm_pbf import read_osm

#: The default box of random points: latitudes and longitudes.
BOX = (51.3, 51.7, -0.5, 0.2)


def session() -> SparkSession:
    return SparkSession.builder.appName("meridian").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def run_generate(spark: SparkSession, args) -> None:
    points, zones = generate(*read_osm(spark, args.input), Config(locale=args.locale, road_spacing=args.road_spacing, version=args.version))
    outputs = [tuple(o.split(":", 1)) for o in args.output]
    for path in write_all(points, zones, outputs, version=args.version, locale=Config(locale=args.locale).locale):
        print(path)


def run_analyze(spark: SparkSession, args) -> None:
    for row in sizes(spark, args.cache).select("section", si_bytes(F.col("bytes")).alias("size")).collect():
        print(f"{row.section}: {row.size}")


def run_geocode(spark: SparkSession, args) -> None:
    coder = ReverseGeocoder.from_file(spark, args.cache, search_radius=args.radius, mode=args.mode)
    if args.requests:
        coder.find_batch(spark.read.parquet(args.requests)).write.mode("overwrite").parquet(args.answers)
        return
    print(json.dumps(coder.find(args.lat, args.lon), ensure_ascii=False))


def run_compare(spark: SparkSession, args) -> None:
    probes = random_points(spark, args.points, *args.box, seed=args.seed).withColumn("pos", F.lit(0)).persist()
    a, b = (ReverseGeocoder.from_file(spark, c, search_radius=args.radius).find_many(probes, ["req_id", "pos"]).persist() for c in (args.cache, args.other))
    print(json.dumps(compare.compare_report(a, b).first().asDict()))
    for row in compare.shown_mismatches(a, b, probes).collect():  # at most 50
        print(f"({row.lat:.6f}, {row.lon:.6f}) {row.detail}")


def run_bench(spark: SparkSession, args) -> None:
    coder, rows = ReverseGeocoder.from_file(spark, args.cache, search_radius=args.radius), []
    began = time.time()
    for k in range(args.requests):
        probes = random_points(spark, args.points, *args.box, seed=args.seed + k)
        at = time.perf_counter()
        found = coder.find_many(probes).where("found").count()
        rows.append((int((time.perf_counter() - at) * 1e6), found >= 0, args.points))
    df = spark.createDataFrame(rows, "micros bigint, ok boolean, points bigint")
    report = metrics.latency_summary(df, "micros").first().asDict() | metrics.percentiles(df, "micros").first().asDict()
    report |= metrics.throughput(metrics.counters(df, F.col("ok"), F.col("points")), time.time() - began).first().asDict()
    print(json.dumps(report))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="meridian", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    verbs = top.add_subparsers(dest="verb", required=True)

    def verb(name, run, *positional):
        p = verbs.add_parser(name)
        for x in positional:
            p.add_argument(x)
        p.set_defaults(run=run)
        return p

    p = verb("generate", run_generate)
    p.add_argument("--input", nargs="+", required=True)
    p.add_argument("--output", action="append", required=True, help="format:path with format v1, v2 or parquet")
    p.add_argument("--locale", default="")
    p.add_argument("--road-spacing", type=float, default=150.0)
    p.add_argument("--version", type=int, default=1)
    verb("analyze", run_analyze, "cache")
    p = verb("geocode", run_geocode, "cache")
    for flag in ("--lat", "--lon"):
        p.add_argument(flag, type=float)
    p.add_argument("--requests")
    p.add_argument("--answers")
    p.add_argument("--mode", default="fold")
    for name, run, more in (("compare", run_compare, ["cache", "other"]), ("bench", run_bench, ["cache"])):
        q = verb(name, run, *more)
        q.add_argument("--points", type=int, default=100)
        q.add_argument("--seed", type=int, default=0)
        q.add_argument("--box", type=float, nargs=4, default=BOX)
        q.add_argument("--radius", type=float, default=DEFAULT_RADIUS)
        if name == "bench":
            q.add_argument("--requests", type=int, default=1)
    p.add_argument("--radius", type=float, default=DEFAULT_RADIUS)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    args.run(session(), args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
