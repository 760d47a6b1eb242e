"""Feature tables: points, ways and relations of a layer, united by name."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..model import MapData
from . import rings, selection, tag_filter
from .tags import project

# Values of these keys that are areas although the key stands for lines.
AREA_VALUES = {
    "railway": ["platform", "station", "turntable", "roundhouse", "traverser", "wash"],
    "highway": ["platform", "rest_area", "services"],
    "waterway": ["riverbank", "dock", "boatyard", "dam", "fuel"],
}


@dataclass(frozen=True)
class Layer:
    """What to read: a filter, its gate keys, the tag columns and the kinds of elements."""

    custom: object
    columns: list[str]
    gate: list[str] | None = None
    filter_type: str = "keep"
    nodes: bool = True
    ways: bool = True
    relations: bool = True
    other_tags: bool = True
    metadata: bool = True
    compact: bool = False


def way_is_area(tags: Column, columns: list[str]) -> Column:
    """Of a closed way: area=yes or no decides, else linear keys rule an area out. Only tags that are columns count."""
    area = tag_filter.value(tags, "area") if "area" in columns else F.lit(None).cast("string")
    linear = tag_filter.any_of([tag_filter.has(tags, k) for k in ("highway", "barrier", "route") if k in columns])
    return F.when(area == "yes", True).when(area == "no", False).otherwise(~linear)


def relation_is_linear(tags: Column) -> Column:
    has, value = tag_filter.has, tag_filter.value
    known = lambda k: F.coalesce(value(tags, k).isin(AREA_VALUES[k]), F.lit(False))
    pedestrian = F.coalesce(value(tags, "highway") == "pedestrian", F.lit(False))
    bare = (has(tags, "railway") & ~known("railway")) | (has(tags, "highway") & ~pedestrian & ~known("highway")) | (pedestrian & has(tags, "area") & (value(tags, "area") != "yes"))
    # the keys are looked at in the order barrier, route, railway, highway, waterway; a pedestrian area ends the search
    stopped = pedestrian & has(tags, "area") & ~(has(tags, "railway") & ~known("railway"))
    line = has(tags, "barrier") | has(tags, "route") | bare | (~stopped & has(tags, "waterway") & ~known("waterway"))
    line = line | F.coalesce(value(tags, "area") == "no", F.lit(False))
    return line & ~F.coalesce(value(tags, "type").isin("multipolygon", "boundary"), F.lit(False))


def _metadata(layer: Layer, *names: str) -> list[str]:
    return list(names) if layer.metadata else []


def node_features(data: MapData, layer: Layer, box: selection.Box | None = None) -> DataFrame:
    keep = data.nodes.where(tag_filter.element_filter(F.col("tags"), layer.custom, layer.gate, layer.filter_type))
    if box:
        keep = keep.where(selection.in_box(box))
    if not data.anywhere:
        keep = keep.where(G.valid(F.col("lon"), F.col("lat")))
    return keep.select("id", F.lit("node").alias("osm_type"), "lon", "lat", "tags", G.point(F.col("lon"), F.col("lat")).alias("geometry"), "visible", *_metadata(layer, "version", "changeset", "timestamp"))


def split_ways(data: MapData, layer: Layer) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ways of the layer by themselves, the ways of its relations, and the relations.

    Members of a kept relation are taken whatever their tags and don't stand for themselves.
    """
    own = data.ways.where(tag_filter.way_filter(F.col("tags"), layer.custom, layer.gate, layer.filter_type))
    if not layer.relations:
        none = data.relations.where(F.lit(False))
        return own, data.ways.where(F.lit(False)), none
    relations = data.relations.where(tag_filter.element_filter(F.col("tags"), layer.custom, layer.gate, layer.filter_type))
    return selection.standalone_ways(own, relations), selection.member_ways(data.ways, relations), relations


def way_features(ways: DataFrame, nodes: DataFrame, layer: Layer, anywhere: bool = False) -> DataFrame:
    placed = selection.way_points(ways, nodes, anywhere).where(F.size("points") >= 2).withColumn("plain", selection.plain_points())
    points = F.col("plain")
    closed = F.element_at("refs", 1) == F.element_at("refs", -1)
    geom = F.when(closed & way_is_area(F.col("tags"), layer.columns), G.way_polygon(points)).otherwise(G.way_line(points))
    # explode keeps the expression in one place: filters on the geometry don't copy it
    return placed.select("id", F.lit("way").alias("osm_type"), "tags", F.explode(F.array(geom)).alias("geometry"), "visible", *_metadata(layer, "version", "timestamp"))


def relation_features(relations: DataFrame, ways: DataFrame, nodes: DataFrame, layer: Layer, anywhere: bool = False) -> DataFrame:
    lines = selection.way_points(ways.select("id", "refs"), nodes, anywhere).select(F.col("id").alias("way_id"), selection.plain_points().alias("points"))
    # a way listed twice in a relation counts once
    members = selection.way_members(relations).groupBy("relation_id", "way_id").agg(F.min("seq").alias("seq"))
    linear = relations.select(F.col("id").alias("relation_id"), relation_is_linear(F.col("tags")).alias("linear"))
    shapes = rings.assemble(members.join(lines, "way_id").join(linear, "relation_id"))
    return relations.join(shapes, "id").select("id", F.lit("relation").alias("osm_type"), "tags", "members", "geometry", "visible", *_metadata(layer, "version", "changeset", "timestamp"))


def features(data: MapData, layer: Layer, box: selection.Box | None = None, complete_relations: bool = False) -> DataFrame:
    """The layer's features; with a box, those that meet it, with whole ways.

    Relations that the box cuts are built from the members inside it, unless complete_relations.
    """
    inside = data
    if box:
        ways = selection.ways_touching(data.ways, data.nodes.where(selection.in_box(box)))
        if complete_relations:
            ways = ways.unionByName(selection.missing_members(data.relations, ways, data.ways))
        inside = data.at(ways=ways)
    own, members, relations = split_ways(inside, layer)
    if box:
        relations = selection.relations_with_ways(relations, inside.ways)
    parts = []
    if layer.nodes:
        parts.append(node_features(data, layer, box))
    if layer.ways:
        parts.append(way_features(own, data.nodes, layer, data.anywhere))
    if layer.relations:
        parts.append(relation_features(relations, members, data.nodes, layer, data.anywhere))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    out = out.where(F.col("geometry").isNotNull())
    if box:
        out = out.where(selection.intersects_box(F.col("geometry"), box))
    return project(out, layer.columns, layer.other_tags, layer.compact)
