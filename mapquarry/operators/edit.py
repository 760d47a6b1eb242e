"""Edits: tag changes laid over an extract, and new geometries turned into nodes and ways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G
from ..model import NODE, WAY, MapData
from .selection import closure

# Columns of a feature table that are no tags.
NO_TAGS = "id osm_type version timestamp changeset visible length tags nodes refs members lon lat u v seq length_mm is_valid geometry".split()


def rendered(column: Column, kind: T.DataType) -> Column:
    """A tag value as the format stores it: yes or no, whole numbers without a point."""
    if isinstance(kind, T.BooleanType):
        return F.when(column, "yes").when(~column, "no")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        whole = (column == F.floor(column)) & (F.abs(column) < 1e15)
        return F.when(F.isnan(column), F.lit(None).cast("string")).when(whole, column.cast("long").cast("string")).otherwise(column.cast("string"))
    return column.cast("string")


def row_tags(frame: DataFrame) -> Column:
    """Tag map of a feature table: its columns that are not null, and what the JSON column tags adds."""
    pairs = []
    for f in frame.schema.fields:
        if f.name in NO_TAGS or f.name.endswith("_tag") and f.name[:-4] in NO_TAGS or isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            continue
        pairs += [F.lit(f.name), rendered(F.col(f"`{f.name}`"), f.dataType)]
    own = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.create_map()
    own = own.cast("map<string,string>")
    if "tags" not in frame.columns:
        return own
    kind = frame.schema["tags"].dataType
    extra = F.col("tags") if isinstance(kind, T.MapType) else F.from_json("tags", "map<string,string>")
    extra = F.map_filter(F.coalesce(extra, F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull() & ~k.isin([*NO_TAGS, ""]) & ~F.map_contains_key(own, k))
    return F.map_concat(own, extra)


def element_type(frame: DataFrame) -> Column:
    """The given type, or the one that the geometry implies."""
    implied = F.when(F.col("geometry.type") == "Point", "node").when(F.col("geometry.type").isin("LineString", "Polygon", "MultiLineString"), "way") if "geometry" in frame.columns else F.lit(None).cast("string")
    return F.coalesce(F.col("osm_type"), implied) if "osm_type" in frame.columns else implied


def overlay(base: DataFrame, edits: DataFrame, kind: str) -> DataFrame:
    """Elements of one kind, with the tags of the edits (id, osm_type, tags map, place) that name them; of several edits of one element the last place counts."""
    mine = edits.where(F.col("osm_type") == kind).groupBy("id").agg(F.max_by("tags", "place").alias("_new"))
    return base.join(mine, "id", "left").withColumn("tags", F.coalesce("_new", "tags")).select(*base.columns)


def new_elements(frame: DataFrame, first_node: int = -1, first_way: int = -1) -> tuple[DataFrame, DataFrame]:
    """Nodes and ways for new rows (key, tags map, geometry), with negative ids counting down.

    Points become nodes, lines and polygons without holes ways. Vertices that agree to 1e-7 degrees
    are one node; a point's tags go to its node. Ids are dense ranks of sorted vertices and of keys:
    numbered within range partitions, offset by the counts before, so no task holds all.
    """
    kind = F.col("geometry.type")
    good = kind.isin("Point", "LineString", "MultiLineString") | ((kind == "Polygon") & (F.size("geometry.rings") == 1))
    bad = frame.where(~F.coalesce(good, F.lit(False)))
    if not bad.isEmpty():
        raise ValueError("only points, lines and polygons without holes can be added")
    flat = F.when(kind == "MultiLineString", F.concat(F.get("geometry.rings", F.lit(0)), F.flatten(F.transform(F.slice("geometry.rings", 2, F.greatest(F.size("geometry.rings") - 1, F.lit(1))), lambda p: F.slice(p, 2, 1))))).otherwise(F.get("geometry.rings", F.lit(0)))
    vertices = frame.select("key", kind.alias("kind"), "tags", F.posexplode(flat).alias("seq", "p"))
    vertices = vertices.select("key", "kind", "tags", "seq", F.rint(F.col("p.x") * 1e7).cast("long").alias("x"), F.rint(F.col("p.y") * 1e7).cast("long").alias("y"))
    if not vertices.where("abs(x) > 1800000000 or abs(y) > 900000000").isEmpty():
        raise ValueError("a vertex lies off the globe")
    tags = F.max_by("tags", F.when(F.col("kind") == "Point", F.struct(F.size("tags"), "key")))
    places = vertices.groupBy("x", "y").agg(tags.alias("tags"))
    numbered = _numbered(places, ["x", "y"]).select("x", "y", "tags", (F.lit(first_node) - F.col("n")).alias("node_id"))
    meta = [F.lit(1).alias("version"), F.lit(0).cast("long").alias("changeset"), F.lit(0).cast("long").alias("timestamp"), F.lit(True).alias("visible")]
    nodes = numbered.select(F.col("node_id").alias("id"), (F.col("x") / 1e7).alias("lon"), (F.col("y") / 1e7).alias("lat"), F.coalesce("tags", F.create_map().cast("map<string,string>")).alias("tags"), *meta)
    lines = vertices.where("kind <> 'Point'").join(numbered.select("x", "y", "node_id"), ["x", "y"])
    refs = lines.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "node_id"))), lambda s: s["node_id"]).alias("refs"))
    keyed = _numbered(frame.where(kind != "Point").select("key", "tags"), ["key"])
    ways = keyed.join(refs, "key").select((F.lit(first_way) - F.col("n")).alias("id"), "refs", "tags", *meta)
    return nodes, ways


def _numbered(frame: DataFrame, order: list[str]) -> DataFrame:
    """Adds n, a dense number from 0 in the given order, without one task for all rows."""
    ranged = frame.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    from ..plans.storage import checkpoint

    ranged = checkpoint(ranged)  # the partitions must not change between the two uses
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("_p", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))  # a row for each partition
    return ranged.join(F.broadcast(starts), "_p").withColumn("n", F.col("_start") + F.col("_i") - F.col("_first")).drop("_p", "_i", "_first", "_start")


def apply(data: MapData, edits: DataFrame, subset_only: bool = False) -> MapData:
    """The extract with the rows of a feature table laid over it.

    Rows that name an element replace its tags; others are new. With subset_only only the named
    elements, what they refer to, and the new ones are kept. Only EPSG:4326 places are meant.
    """
    names = edits.columns
    # a row's place in the table, so that later edits of an element win
    rows = edits.withColumn("_place", F.monotonically_increasing_id()).select(F.col("_place").alias("place"), *(["id"] if "id" in names else [F.lit(None).cast("long").alias("id")]), element_type(edits).alias("osm_type"), row_tags(edits).alias("tags"), F.col("geometry").cast(G.GEOMETRY).alias("geometry") if "geometry" in names else F.lit(None).cast(G.GEOMETRY).alias("geometry"))
    known = None
    for kind, base in (("node", data.nodes), ("way", data.ways), ("relation", data.relations)):
        part = base.select("id", F.lit(kind).alias("osm_type"))
        known = part if known is None else known.union(part)
    named = rows.join(known, ["id", "osm_type"], "left_semi")
    fresh = rows.join(known, ["id", "osm_type"], "left_anti").where(F.col("geometry").isNotNull())
    out = data.at(nodes=overlay(data.nodes, named, "node"), ways=overlay(data.ways, named, "way"), relations=overlay(data.relations, named, "relation"))
    if subset_only:
        ids = {k: named.where(F.col("osm_type") == k).select("id") for k in ("relation", "way", "node")}
        out = closure(out, ids["relation"], ids["way"], ids["node"])
    if fresh.isEmpty():
        return out
    least = lambda f: min(-1, (f.agg(F.min("id")).first()[0] or 0) - 1)
    keyed = fresh.drop("place").withColumn("key", F.struct(F.coalesce("id", F.lit(0)), F.to_json("geometry"), F.to_json(F.array_sort(F.map_entries("tags")))))
    nodes, ways = new_elements(keyed, least(data.nodes), least(data.ways))
    names_of = lambda schema: [c.split()[0] for c in schema.split(", ")]
    return out.at(nodes=out.nodes.select(*names_of(NODE)).union(nodes.select(*names_of(NODE))), ways=out.ways.select(*names_of(WAY)).union(ways.select(*names_of(WAY))))
