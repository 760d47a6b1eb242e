"""Geometries as structs, and expressions over arrays of points.

A geometry is struct<type, rings, part_of>: rings are arrays of points struct<x, y>; part_of gives
the polygon of each ring of a multipolygon (a polygon's first ring is its shell). Lines have one ring
for each part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
GEOMETRY = f"struct<type:string,rings:array<array<{POINT}>>,part_of:array<int>>"
#: Mean radius of the earth in kilometres, and units by their share of one (fixed values).
RADIUS_KM = 6371.0088
UNITS = {"km": 1.0, "m": 0.001, "mi": 1.609344, "nmi": 1.852, "ft": 0.0003048, "in": 0.0000254}


def xy(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def valid(lon: Column, lat: Column) -> Column:
    return (F.abs(lon) <= 180) & (F.abs(lat) <= 90)


def once(value: Column, f) -> Column:
    """f(value) with the expression value standing in the plan once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def geometry(kind: Column, rings: Column, part_of: Column | None = None) -> Column:
    """Null where there are no rings."""

    def made(r: Column) -> Column:
        parts = part_of if part_of is not None else F.transform(r, lambda _, i: i)
        return F.when(r.isNotNull() & (F.size(r) > 0), F.struct(kind.alias("type"), r.alias("rings"), parts.alias("part_of")))

    return once(rings, made).cast(GEOMETRY)


def point(lon: Column, lat: Column) -> Column:
    return geometry(F.lit("Point"), F.array(F.array(xy(lon, lat))))


def pieces(points: Column) -> Column:
    """The n - 1 two-point lines along n points."""
    n = F.size(points)
    return F.when(n >= 2, F.zip_with(F.slice(points, 1, n - 1), F.slice(points, 2, n - 1), lambda a, b: F.array(a, b)))


def way_line(points: Column) -> Column:
    """A line of one piece, or else a multi-line of two-point parts."""
    return once(pieces(points), lambda parts: geometry(F.when(F.size(parts) == 1, "LineString").otherwise("MultiLineString"), parts))


def signed_area2(ring: Column) -> Column:
    """Twice the shoelace area, positive counter-clockwise; from the first point, for precision."""
    n = F.size(ring)
    o = F.get(ring, F.lit(0))
    cross = F.zip_with(F.slice(ring, 1, n - 1), F.slice(ring, 2, n - 1), lambda a, b: (a["x"] - o["x"]) * (b["y"] - o["y"]) - (b["x"] - o["x"]) * (a["y"] - o["y"]))
    return F.aggregate(cross, F.lit(0.0), lambda s, x: s + x)


def oriented(ring: Column) -> Column:
    """The ring counter-clockwise."""
    return once(ring, lambda r: F.when(signed_area2(r) < 0, F.reverse(r)).otherwise(r))


def closed(points: Column) -> Column:
    """The points with the first one again at the end, unless it is there."""
    first = F.get(points, F.lit(0))
    return F.when(F.element_at(points, -1) == first, points).otherwise(F.concat(points, F.array(first)))


def way_polygon(points: Column) -> Column:
    """From at least three points that make a ring of four or more."""
    made = once(closed(points), lambda ring: F.when(F.size(ring) >= 4, F.array(oriented(ring))))
    return F.when(F.size(points) > 2, geometry(F.lit("Polygon"), made))


def distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column, unit: str = "m") -> Column:
    """Great-circle distance by the haversine formula."""
    if unit not in UNITS:
        raise ValueError(f"unit {unit!r} is none of {', '.join(UNITS)}")
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) * 0.5), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) * 0.5), 2)
    return F.asin(F.sqrt(h)) * F.lit(2 * RADIUS_KM / UNITS[unit])


def millimetres(piece: Column) -> Column:
    """Length of a two-point line in whole millimetres."""
    a, b = F.get(piece, F.lit(0)), F.get(piece, F.lit(1))
    return F.round(distance(a["x"], a["y"], b["x"], b["y"], "m") * 1000).cast("long")


def total_millimetres(parts: Column) -> Column:
    return F.aggregate(F.transform(parts, millimetres), F.lit(0).cast("long"), lambda s, x: s + x)


def extent(geom: Column) -> dict[str, Column]:
    """west, south, east, north of a geometry."""
    points = F.flatten(geom["rings"])
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return {"west": F.array_min(xs), "south": F.array_min(ys), "east": F.array_max(xs), "north": F.array_max(ys)}


def wkt(geom: Column) -> Column:
    """Well-known text."""
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit(")"))
    rings = geom["rings"]
    listed = F.concat(F.lit("("), F.array_join(F.transform(rings, ring), ", "), F.lit(")"))
    polygon = lambda k: F.concat(F.lit("("), F.array_join(F.transform(F.filter(rings, lambda _, i: F.get(geom["part_of"], i) == k), ring), ", "), F.lit(")"))
    many = F.concat(F.lit("("), F.array_join(F.transform(F.array_sort(F.array_distinct(geom["part_of"])), polygon), ", "), F.lit(")"))
    body = F.when(geom["type"].isin("Point", "LineString"), ring(F.get(rings, F.lit(0)))).when(geom["type"] == "MultiPolygon", many).otherwise(listed)
    return F.when(geom.isNotNull(), F.concat(F.upper(geom["type"]), F.lit(" "), body))


def equal_area(west: float, south: float, east: float, north: float) -> float:
    """Area of a box in square metres on the cylindrical equal-area projection."""
    r = RADIUS_KM * 1000
    return r * r * math.radians(east - west) * (math.sin(math.radians(north)) - math.sin(math.radians(south)))
