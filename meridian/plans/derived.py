"""Spatial inputs derived from the star-schema tables, which have no coordinates.

Only whole-number arithmetic and + - * / are used, so that SQL engines agree to the bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.zones import load_zones, rectangle
from ..schema import COUNTRY, REGION

RADIUS = 0.5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("point_id"),
        F.col("c_custkey").alias("visit_ord"),
        F.expr("(c_custkey * 7919 % 2003) / 100.0D").alias("x"),
        F.expr("(c_custkey * 104729 % 1999) / 100.0D").alias("y"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("street"),
        F.expr("CAST(c_custkey % 97 AS STRING)").alias("house_number"),
        F.lit("").alias("city"),
        F.expr("CASE WHEN c_nationkey % 2 = 0 THEN concat('REG_', c_nationkey) ELSE '' END").alias("region"),
        F.expr("CAST(element_at(array(2, 3, 5, 10), CAST(c_custkey % 4 AS INT) + 1) AS SMALLINT)").alias("weight"),
    )


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("req_id"), F.expr("(o_orderkey * 6101 % 2503) / 100.0D + 0.003D").alias("lon"), F.expr("(o_orderkey * 3571 % 1999) / 100.0D + 0.002D").alias("lat"), "o_custkey")


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as a lattice of countries, regions as bands."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("zone_id"), F.lit(COUNTRY).cast("tinyint").alias("zone_type"), F.col("n_name").alias("name"), F.expr("(n_nationkey % 5) * 4.5D").alias("x0"), F.expr("floor(n_nationkey / 5) * 4.2D").alias("y0"), F.lit(4.5).alias("w"))
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("zone_id"), F.lit(REGION).cast("tinyint").alias("zone_type"), F.col("r_name").alias("name"), F.lit(0.0).alias("x0"), F.expr("r_regionkey * 4.2D").alias("y0"), F.lit(21.0).alias("w"))
    both = n.unionByName(r).withColumns({"x1": F.col("x0") + F.col("w"), "y1": F.col("y0") + F.lit(4.2)})
    return load_zones(both.select("zone_id", "zone_type", "name", rectangle(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("polygon")))


OUTER = [(2.005, 2.005), (18.005, 3.005), (12.005, 9.005), (19.005, 17.005), (8.005, 12.005), (3.005, 18.005)]
HOLE = [(7.005, 6.005), (9.005, 6.005), (8.005, 8.005)]


SQL = """
WITH points AS (SELECT c_custkey AS point_id, c_custkey AS visit_ord, (c_custkey * 7919 % 2003) / 100.0::DOUBLE AS x, (c_custkey * 104729 % 1999) / 100.0::DOUBLE AS y, c_name AS name, c_mktsegment AS street, CAST(c_custkey % 97 AS VARCHAR) AS house_number, '' AS city, CASE WHEN c_nationkey % 2 = 0 THEN 'REG_' || c_nationkey ELSE '' END AS region, CAST([2, 3, 5, 10][c_custkey % 4 + 1] AS SMALLINT) AS weight FROM customer),
probes AS (SELECT o_orderkey AS req_id, (o_orderkey * 6101 % 2503) / 100.0::DOUBLE + 0.003::DOUBLE AS lon, (o_orderkey * 3571 % 1999) / 100.0::DOUBLE + 0.002::DOUBLE AS lat, o_custkey FROM orders),
boxes AS (SELECT CAST(n_nationkey AS BIGINT) AS zone_id, 2 AS zone_type, n_name AS name, (n_nationkey % 5) * 4.5::DOUBLE AS x0, (n_nationkey // 5) * 4.2::DOUBLE AS y0, 4.5::DOUBLE AS w FROM nation UNION ALL SELECT r_regionkey, 1, r_name, 0.0::DOUBLE, r_regionkey * 4.2::DOUBLE, 21.0::DOUBLE FROM region),
zones AS (SELECT zone_id, zone_type, name, x0, y0, x0 + w AS x1, y0 + 4.2::DOUBLE AS y1 FROM boxes),
pairs AS (SELECT req_id, lon, lat, point_id, visit_ord, weight, (lon - x) * (lon - x) + (lat - y) * (lat - y) AS d2 FROM probes JOIN points ON abs(lon - x) <= 0.5::DOUBLE AND abs(lat - y) <= 0.5::DOUBLE AND (lon - x) * (lon - x) + (lat - y) * (lat - y) <= 0.25::DOUBLE),
fold AS (SELECT req_id, list_reduce(list(struct_pack(d := d2, w := weight, p := point_id) ORDER BY visit_ord), lambda b, c: CASE WHEN c.d < b.d OR c.w > b.w THEN c ELSE b END) AS best FROM pairs GROUP BY 1),
named AS (SELECT req_id, (SELECT arg_min(z.name, z.zone_id) FROM zones z WHERE z.zone_type = 1 AND lon BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1) AS zone_region, (SELECT arg_min(z.name, z.zone_id) FROM zones z WHERE z.zone_type = 2 AND lon BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1) AS zone_country FROM probes),
answers AS (SELECT n.req_id, p.point_id IS NOT NULL OR coalesce(nullif(p.region, ''), zone_region, '') <> '' OR coalesce(zone_country, '') <> '' AS found, coalesce(p.name, '') AS name, coalesce(p.street, '') AS street, coalesce(p.house_number, '') AS house_number, coalesce(p.city, '') AS city, coalesce(nullif(p.region, ''), zone_region, '') AS region, coalesce(zone_country, '') AS country, CAST(coalesce(p.weight, 0) AS INTEGER) AS weight FROM named n LEFT JOIN fold f USING (req_id) LEFT JOIN points p ON p.point_id = f.best.p)
"""
