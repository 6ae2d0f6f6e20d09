"""Table schemas. x is longitude and y latitude; "" is a missing text, never null."""

POINT = "x double, y double"
ADDRESS = "name string, street string, house_number string, city string, region string, weight smallint"
POINTS = f"point_id bigint, visit_ord bigint, {POINT}, {ADDRESS}"
POLYGON = "array<array<array<struct<x: double, y: double>>>>"
ZONES = f"zone_id bigint, zone_type tinyint, name string, min_x double, min_y double, max_x double, max_y double, polygon {POLYGON}"
META = "version bigint, locale string, date_created timestamp"
NODES = "id bigint, lat double, lon double, tags map<string,string>"
WAYS = "id bigint, nodes array<bigint>, tags map<string,string>"
RELATIONS = "id bigint, members array<struct<type: string, ref: bigint, role: string, orientation: tinyint>>, tags map<string,string>"
RESULT = "name string, street string, house_number string, city string, region string, country string, weight int"

REGION, COUNTRY = 1, 2
ADDRESS_FIELDS = ["name", "street", "house_number", "city", "region"]
RESULT_FIELDS = [*ADDRESS_FIELDS, "country", "weight"]
DEFAULT_RADIUS = 0.01


def checked_radius(radius: float) -> float:
    """The radius itself, or the default where it is not in (0, 180] degrees."""
    return radius if 0 < radius <= 180 else DEFAULT_RADIUS
