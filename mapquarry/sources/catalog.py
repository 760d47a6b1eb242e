"""Catalogue of extracts: by name, by place in a box. Tables come from the caller; downloads happen elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import RADIUS_KM
from ..operators.selection import normal_box

COLUMNS = "id string, name string, region string, url string, west double, south double, east double, north double"


class NotFound(ValueError):
    """No extract, or more than one, answers to the name or place."""


def variants(name: str) -> list[str]:
    """How a name is looked up, in order: as it is, without spaces, with _ for spaces, with _ for dashes."""
    n = name.lower().strip()
    return list(dict.fromkeys([n, n.replace(" ", ""), n.replace(" ", "_"), n.replace("-", "_")]))


def resolve(catalog: DataFrame, name: str) -> str:
    """The address of the extract name or region/name; an error lists the choices if several have the name."""
    if not isinstance(name, str):
        raise ValueError(f"a name should be text, not {name!r}")
    region, _, rest = name.lower().strip().rpartition("/")
    for n in [rest] if region else variants(name):
        hit = catalog.where((F.lower("name") == n) & (F.lower("region") == region if region else F.lit(True)))
        urls = hit.groupBy("url").agg(F.min(F.concat_ws("/", "region", "name")).alias("full")).limit(20).collect()
        if len(urls) == 1:
            return urls[0].url
        if urls:
            raise NotFound(f"{name!r} is the name of several extracts: {', '.join(sorted(u.full for u in urls))}")
    raise NotFound(f"there is no extract {name!r}")


def with_area(catalog: DataFrame) -> DataFrame:
    """Adds the area of each box in square metres on the cylindrical equal-area projection."""
    r = RADIUS_KM * 1000
    return catalog.withColumn("area", F.lit(r * r) * F.radians(F.col("east") - F.col("west")) * (F.sin(F.radians("north")) - F.sin(F.radians("south"))))


def covering(catalog: DataFrame, box, limit: int = 1) -> DataFrame:
    """The smallest extracts whose boxes cover the box, by area and id."""
    west, south, east, north = normal_box(box)
    hit = catalog.where((F.col("west") <= west) & (F.col("south") <= south) & (F.col("east") >= east) & (F.col("north") >= north))
    return with_area(hit).orderBy("area", "id").limit(limit)


def by_box(catalog: DataFrame, box) -> str:
    found = covering(catalog, box).collect()
    if found:
        return found[0].url
    west, south, east, north = normal_box(box)
    near = catalog.where((F.col("west") <= east) & (F.col("east") >= west) & (F.col("south") <= north) & (F.col("north") >= south)).select("id").orderBy("id").limit(5).collect()
    if near:
        raise NotFound(f"no single extract covers the box, which reaches over {', '.join(r.id for r in near)}")
    raise NotFound("the box lies outside all extracts")


def crop_name(box) -> str:
    """File name of an extract cropped to a box."""
    return "bbox_" + "_".join(f"{v:.7f}".rstrip("0").rstrip(".") for v in normal_box(box)) + ".osm.pbf"
