"""Objects of graph libraries from node and edge tables, where a library is installed. They hold the whole graph on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import network

NEEDS = {"igraph": "igraph", "networkx": "networkx", "pandana": "pandana", "pandarm": "pandarm"}


def _need(kind: str):
    import importlib

    if kind not in NEEDS:
        raise ValueError(f"graph_type should be frames or one of {', '.join(NEEDS)}")
    try:
        return importlib.import_module(NEEDS[kind])
    except ImportError as e:
        raise ImportError(f"{NEEDS[kind]} is not installed, which graph_type={kind!r} needs") from e


def renamed(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables with the column names that street-network tools expect.

    Nodes: osmid, x, y, street_count and their tags' columns. Edges: u, v, key (parallel edges of one
    direction are numbered from 0 by way and place in it), osmid, length, geometry (well-known text)
    and the rest. Edges whose nodes are not there are left out.
    """
    keys = tuple(c for c in ("id", "seq") if c in edges.columns) or ("length",)
    counts = network.street_counts(edges, keys)
    n = nodes.join(counts, "id", "left").withColumn("street_count", F.coalesce("street_count", F.lit(0).cast("long"))).withColumnsRenamed({"id": "osmid", "lon": "x", "lat": "y"})
    there = lambda end: nodes.select(F.col("id").alias(end))
    e = edges.join(there("u"), "u", "left_semi").join(there("v"), "v", "left_semi")
    # nodes have few parallel edges, so the windows are small
    e = e.withColumn("key", F.row_number().over(W.partitionBy("u", "v").orderBy(*keys)) - 1)
    if "geometry" in e.columns:
        points = F.flatten("geometry.rings")
        turned = F.when(F.col("reversed"), F.reverse(points)).otherwise(points) if "reversed" in e.columns else points
        e = e.withColumn("geometry", G.wkt(F.when(F.size(points) > 1, G.geometry(F.lit("LineString"), F.array(turned)))))
    return n, e.withColumnRenamed("id", "osmid")


def export(kind: str, nodes: DataFrame, edges: DataFrame, network_type: str):
    """A graph object with the nodes' places and street counts and all the edges' columns, geometry as well-known text (as shapely lines where shapely is installed)."""
    library = _need(kind)
    n, e = renamed(nodes, edges)
    n = n.select("osmid", "x", "y", "street_count").orderBy("osmid").toPandas()
    e = e.toPandas()
    if "geometry" in e.columns:
        try:
            from shapely import from_wkt
        except ImportError:
            from_wkt = None
        if from_wkt:
            e["geometry"] = from_wkt(e["geometry"])
    if kind == "networkx":
        g = library.MultiDiGraph(crs="epsg:4326", name=network_type)
        for r in n.itertuples(index=False):
            g.add_node(r.osmid, osmid=r.osmid, x=r.x, y=r.y, street_count=r.street_count)
        for r in e.to_dict("records"):
            g.add_edge(r["u"], r["v"], key=r["key"], **{k: v for k, v in r.items() if k not in ("u", "v", "key")})
        return g
    if kind == "igraph":
        place = {i: k for k, i in enumerate(n["osmid"])}
        g = library.Graph(n=len(n), edges=[(place[u], place[v]) for u, v in zip(e["u"], e["v"], strict=True)], directed=True)
        g.vs["node_id"], g.vs["x"], g.vs["y"], g.vs["street_count"] = (n[c].tolist() for c in ("osmid", "x", "y", "street_count"))
        for c in e.columns:
            g.es[c] = e[c].tolist()
        return g
    n = n.set_index("osmid")
    return library.Network(n["x"], n["y"], e["u"], e["v"], e[["length"]])
