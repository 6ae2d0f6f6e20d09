"""Reverse geocoding of tables, batches and single coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ADDRESS_FIELDS, COUNTRY, DEFAULT_RADIUS, REGION, RESULT, RESULT_FIELDS, checked_radius
from .spatial import FOLD, search
from .zones import SENT_VERTICES, TOLERANCE, load_zones, zones_of


def reverse_geocode(probes: DataFrame, points: DataFrame, zones: DataFrame, radius: float = DEFAULT_RADIUS, *, keys: list[str] = ("req_id",), mode: str = FOLD, sent_vertices: int = SENT_VERTICES, salt: int | None = None) -> DataFrame:
    """The probes' keys, found, the address fields, country and weight.

    A probe takes the address of the point picked within the radius, its own region where
    that has one, else the region that contains the probe; the country always comes from
    the zones. Without a point the zones alone answer; without both nothing is found and
    all fields are empty. ``keys`` must be unique; ``zones`` are loaded zones; ``salt`` is
    that of ``search`` (None: measured).
    """
    keys = list(keys)
    placed = zones_of(probes.select(*keys, "lon", "lat"), zones, {"zone_region": REGION, "zone_country": COUNTRY}, sent_vertices=sent_vertices)
    out = search(placed, points, radius, keys, mode, payload=ADDRESS_FIELDS, salt=salt, carry=["zone_region", "zone_country"], keep=True)
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    region = F.coalesce(some("region"), some("zone_region"), F.lit(""))
    country = F.coalesce(some("zone_country"), F.lit(""))
    found = F.col("point_id").isNotNull() | (region != "") | (country != "")
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ADDRESS_FIELDS if c != "region"]
    return out.select(*keys, found.alias("found"), *text, region.alias("region"), country.alias("country"), F.coalesce(F.col("weight").cast("int"), F.lit(0)).alias("weight"))


def parse_request(requests: DataFrame, body: str = "body", key: str = "req_id") -> DataFrame:
    """Rows (key, pos, lat, lon) of JSON arrays of pairs, in order.

    Further numbers of a pair are dropped and missing ones are 0; a body that is no such
    array, or holds something else than numbers, has no rows.
    """
    pairs = F.from_json(F.col(body), "array<array<double>>", {"mode": "PERMISSIVE"})
    rows = requests.select(key, F.posexplode(pairs).alias("pos", "pair"))
    at = lambda i: F.coalesce(F.get("pair", F.lit(i)), F.lit(0.0))
    return rows.select(key, "pos", at(0).alias("lat"), at(1).alias("lon"))


def parse_path(paths: DataFrame, column: str = "path", key: str = "req_id") -> DataFrame:
    """(key, status, lat, lon) of paths that end in /{lat}/{lon}; 400 where one is no number."""
    part = lambda n: F.expr(f"try_cast(element_at(split(`{column}`, '/'), {n}) AS DOUBLE)")
    out = paths.select(key, part(-2).alias("lat"), part(-1).alias("lon"))
    return out.select(key, F.when(F.col("lat").isNull() | F.col("lon").isNull(), F.lit(400)).otherwise(F.lit(200)).alias("status"), "lat", "lon")


def info_json(ignore_missing: bool = False):
    """The answer as JSON with all seven keys."""
    return F.to_json(F.struct(*RESULT_FIELDS), {"ignoreNullFields": str(ignore_missing).lower()})


def read_info(text) -> list:
    """Columns of an answer's JSON; nulls, missing and unknown keys count as nothing."""
    parsed = F.from_json(text, RESULT)
    return [F.coalesce(parsed[c], F.lit(0) if c == "weight" else F.lit("")).alias(c) for c in RESULT_FIELDS]


def batch_answers(results: DataFrame, key: str = "req_id") -> DataFrame:
    """(key, answers): a JSON array for each request, as long as it and in its order."""
    rows = F.transform(F.sort_array(F.collect_list(F.struct("pos", F.struct(*RESULT_FIELDS).alias("info")))), lambda r: r["info"])
    return results.groupBy(key).agg(F.to_json(rows).alias("answers"))


def single_answers(results: DataFrame, key: str = "req_id") -> DataFrame:
    """(key, status, body): 200 with JSON, or 204 without a body where nothing is found."""
    return results.select(key, F.when(F.col("found"), F.lit(200)).otherwise(F.lit(204)).alias("status"), F.when(F.col("found"), info_json()).alias("body"))


class ReverseGeocoder:
    """Points and zones that answer coordinates; everything stays a DataFrame.

    ``points`` need point_id, x, y, the address fields and weight; visit_ord is point_id
    where it is missing. Zones are simplified as they are loaded, tolerance 0 leaves them.
    Crowded cells are measured and dealt to several tasks (``salt`` None).
    """

    def __init__(self, points: DataFrame, zones: DataFrame | None = None, *, search_radius: float = DEFAULT_RADIUS, mode: str = FOLD, tolerance: float = TOLERANCE, salt: int | None = None):
        self.spark: SparkSession = points.sparkSession
        self.points = points if "visit_ord" in points.columns else points.withColumn("visit_ord", F.col("point_id"))
        empty = self.spark.createDataFrame([], "zone_id bigint, zone_type tinyint, name string, polygon array<array<array<struct<x:double,y:double>>>>")
        self.zones = load_zones(empty if zones is None else zones, tolerance).persist()
        self.radius, self.mode, self.salt = checked_radius(search_radius), mode, salt

    @classmethod
    def from_file(cls, spark: SparkSession, path: str, **options) -> ReverseGeocoder:
        from ..sources.cache_files import read_points, read_zones

        return cls(read_points(spark, path), read_zones(spark, path), **options)

    def find_many(self, probes: DataFrame, keys: list[str] = ("req_id",), radius: float | None = None) -> DataFrame:
        return reverse_geocode(probes, self.points, self.zones, self.radius if radius is None else radius, keys=list(keys), mode=self.mode, salt=self.salt)

    def find_batch(self, requests: DataFrame, body: str = "body", key: str = "req_id") -> DataFrame:
        """JSON arrays of (lat, lon) pairs in, JSON arrays of answers out; [] for []."""
        answers = batch_answers(self.find_many(parse_request(requests, body, key), [key, "pos"]), key)
        empty = F.when(F.size(F.from_json(F.col(body), "array<array<double>>")) == 0, F.lit("[]"))
        return requests.join(answers, key, "left").select(key, F.coalesce("answers", empty).alias("answers"))

    def find(self, lat: float, lon: float, radius: float | None = None) -> dict | None:
        """One coordinate's answer, None where nothing is found."""
        probe = self.spark.createDataFrame([(0, float(lat), float(lon))], "req_id bigint, lat double, lon double")
        row = self.find_many(probe, radius=radius).first()
        return {c: row[c] for c in RESULT_FIELDS} if row is not None and row["found"] else None

    def close(self) -> None:
        self.zones.unpersist()

