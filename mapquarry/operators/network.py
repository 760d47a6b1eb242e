"""Street networks: edges, nodes, directions, street counts, strongly connected part."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.presets import AGAINST, ONEWAY
from ..plans.storage import checkpoint
from . import selection, tag_filter
from .tags import project


@dataclass(frozen=True)
class Network:
    """Edges u, v, length in metres, geometry and tags; nodes of their ends; the network's type."""

    edges: DataFrame
    nodes: DataFrame | None
    type: str

    def at(self, **frames: DataFrame) -> Network:
        return replace(self, **frames)


def select_ways(ways: DataFrame, custom, gate: list[str], filter_type: str) -> DataFrame:
    return ways.where(tag_filter.way_filter(F.col("tags"), custom, gate, filter_type))


def way_edges(ways: DataFrame, nodes: DataFrame, anywhere: bool = False) -> DataFrame:
    """One row for each way with a line of its pieces and its length: rounded pieces summed, then to whole metres (half to even)."""
    placed = selection.way_points(ways, nodes, anywhere).where(F.size("points") >= 2).withColumn("parts", G.pieces(selection.plain_points()))
    kind = F.when(F.size("parts") == 1, "LineString").otherwise("MultiLineString")
    measured = placed.select("id", "tags", "version", "timestamp", "visible", G.geometry(kind, F.col("parts")).alias("geometry"), G.total_millimetres(F.col("parts")).alias("length_mm"))
    return measured.withColumn("length", F.bround(F.col("length_mm") / 1000, 0))


def segments(ways: DataFrame, nodes: DataFrame, anywhere: bool = False) -> DataFrame:
    """One row for each piece of a way: u, v, seq, length in metres to the millimetre."""
    placed = selection.way_points(ways, nodes, anywhere).where(F.size("points") >= 2)
    n = F.size("points")
    pairs = F.zip_with(F.slice("points", 1, n - 1), F.slice("points", 2, n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    each = placed.select("id", "tags", "version", "timestamp", "visible", F.posexplode(pairs).alias("seq", "p"))
    piece = F.array(G.xy(F.col("p.a.x"), F.col("p.a.y")), G.xy(F.col("p.b.x"), F.col("p.b.y")))
    mm = G.millimetres(piece)
    return each.select("id", "seq", F.col("p.a.node_id").alias("u"), F.col("p.b.node_id").alias("v"), "tags", "version", "timestamp", "visible", G.geometry(F.lit("LineString"), F.array(piece)).alias("geometry"), mm.alias("length_mm"), (mm / 1000).alias("length"))


def end_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row for each node that an edge ends at, inside a box or not."""
    ids = edges.select(F.col("u").alias("id")).union(edges.select("v")).distinct()
    return nodes.join(ids, "id", "left_semi")


def network(ways: DataFrame, nodes: DataFrame, network_type: str, columns: list[str], box: selection.Box | None = None, with_nodes: bool = False, metadata: bool = True, compact: bool = False, anywhere: bool = False) -> Network:
    """The network of ways already filtered. With a box, edges of whole ways that meet it. anywhere as in MapData."""
    if box:
        ways = selection.ways_touching(ways, nodes.where(selection.in_box(box)))
    edges = segments(ways, nodes, anywhere) if with_nodes else way_edges(ways, nodes, anywhere)
    if box:
        edges = edges.where(selection.intersects_box(F.col("geometry"), box))
    edges = edges.withColumn("osm_type", F.lit("way"))
    if not metadata:
        edges = edges.drop("version", "timestamp")
    return Network(project(edges, columns, compact=compact), end_nodes(edges, nodes) if with_nodes else None, network_type)


def effective_direction(edges: DataFrame, direction: str = "oneway", network_type: str = "driving") -> Column:
    """The direction tag of each edge: <base>:<suffix>, or for cycling <base>:bicycle, goes before the base where it is set."""
    base, _, suffix = direction.partition(":")
    suffix = suffix or ("bicycle" if network_type == "cycling" else "")
    if base not in edges.columns:
        warnings.warn(f"there is no column {base!r}: all edges are taken in both directions", UserWarning, stacklevel=3)
    value = F.col(f"`{base}`") if base in edges.columns else F.lit(None).cast("string")
    override = f"{base}:{suffix}"
    return F.coalesce(F.col(f"`{override}`"), value) if suffix and override in edges.columns else value


def directed_edges(net: Network, direction: str = "oneway", both_ways: bool = False) -> DataFrame:
    """Edges in each direction of travel. A reversed row swaps u and v and keeps its geometry; column reversed tells.

    Walking and all networks go both ways; else a one-way value or junction=roundabout allows one
    direction, and some values the one against the way.
    """
    edges = net.edges
    if both_ways or net.type in ("walking", "all"):
        ways = F.array(F.lit(False), F.lit(True))
    else:
        value = effective_direction(edges, direction, net.type)
        one = F.coalesce(value.isin(ONEWAY), F.lit(False))
        if "junction" in edges.columns:
            one = one | F.coalesce(F.col("junction") == "roundabout", F.lit(False))
        against = F.coalesce(value.isin(AGAINST), F.lit(False))
        ways = F.when(one & against, F.array(F.lit(True))).when(one, F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    flipped = edges.withColumn("reversed", F.explode(ways)).withColumn("_u", F.col("u"))
    return flipped.withColumn("u", F.when(F.col("reversed"), F.col("v")).otherwise(F.col("u"))).withColumn("v", F.when(F.col("reversed"), F.col("_u")).otherwise(F.col("v"))).drop("_u")


def street_counts(edges: DataFrame, key: tuple[str, ...] = ("id", "seq")) -> DataFrame:
    """id, street_count: physical edges at each node, both directions of one as one, a loop twice."""
    physical = edges.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), *key).distinct()
    ends = physical.select(F.col("a").alias("id")).union(physical.select("b"))
    return ends.groupBy("id").agg(F.count("*").alias("street_count"))


def endpoints(edges: DataFrame, differ: tuple[str, ...] = (), include: DataFrame | None = None) -> DataFrame:
    """id, is_endpoint for each node of directed edges: no endpoint only where a street just passes through.

    A node passes through with two different neighbours, two or four edge ends, edges in and out, and
    no loop. Nodes whose edges disagree in a column of differ (nulls count as a value), or of include
    (column id), are endpoints too.
    """
    out = edges.select(F.col("u").alias("id"), F.col("v").alias("other"), F.lit(1).alias("o"), F.lit(0).alias("i"), *differ)
    into = edges.select(F.col("v").alias("id"), F.col("u").alias("other"), F.lit(0).alias("o"), F.lit(1).alias("i"), *differ)
    aggs = [F.sum("o").alias("n_out"), F.sum("i").alias("n_in"), F.countDistinct("other").alias("n_next"), F.max((F.col("id") == F.col("other")).cast("int")).alias("loop")]
    # not of one value: a null beside a value, or two values; min and max need no second shuffle
    disagree = [(F.coalesce(F.min(c) != F.max(c), F.lit(False)) | (F.count(c).between(1, F.count("*") - 1))).alias(f"_d{k}") for k, c in enumerate(differ)]
    per = out.union(into).groupBy("id").agg(*aggs, *disagree)
    total = F.col("n_out") + F.col("n_in")
    through = (F.col("n_next") == 2) & total.isin(2, 4) & (F.col("n_out") > 0) & (F.col("n_in") > 0) & (F.col("loop") == 0)
    end = ~through
    for k in range(len(differ)):
        end = end | F.col(f"_d{k}")
    per = per.select("id", end.alias("is_endpoint"))
    if include is not None:
        marked = include.select("id", F.lit(True).alias("_in")).distinct()
        per = per.join(marked, "id", "left").select("id", (F.col("is_endpoint") | F.coalesce("_in", F.lit(False))).alias("is_endpoint"))
    return per


def _strong_components(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Component of each node 0..n-1, by Tarjan's method without recursion."""
    order = np.argsort(u, kind="stable")
    to = v[order].tolist()
    first = np.searchsorted(u[order], np.arange(n + 1)).tolist()
    index, low, comp = [0] * n, [0] * n, [-1] * n
    counter = found = 0
    stack: list[int] = []
    for root in range(n):
        if index[root]:
            continue
        counter += 1
        index[root] = low[root] = counter
        stack.append(root)
        path = [(root, first[root])]
        while path:
            x, k = path.pop()
            if k < first[x + 1]:
                path.append((x, k + 1))
                y = to[k]
                if not index[y]:
                    counter += 1
                    index[y] = low[y] = counter
                    stack.append(y)
                    path.append((y, first[y]))
                elif comp[y] < 0:
                    low[x] = min(low[x], index[y])
                continue
            if low[x] == index[x]:
                while True:
                    y = stack.pop()
                    comp[y] = found
                    if y == x:
                        break
                found += 1
            if path:
                low[path[-1][0]] = min(low[path[-1][0]], low[x])
    return np.array(comp, dtype=np.int64)


def strong_components(edges: DataFrame, driver_edges: int = 2_000_000, max_rounds: int = 10_000) -> DataFrame:
    """node, component (the smallest node of it) for each node of directed edges u, v.

    Up to driver_edges edges are solved on the driver, whose size that number bounds. Beyond it,
    rounds over the edges: what has no edge in or out is trimmed; smallest labels spread forward to
    a fixpoint; from each label's own node, what reaches it backward within the label is a component.
    """
    spark = edges.sparkSession
    arcs = checkpoint(edges.select("u", "v").distinct())
    if arcs.limit(driver_edges + 1).count() <= driver_edges:
        rows = arcs.toPandas()
        ids, codes = np.unique(np.concatenate([rows["u"].to_numpy(np.int64), rows["v"].to_numpy(np.int64)]), return_inverse=True)
        m = len(rows)
        comp = _strong_components(codes[:m], codes[m:], len(ids))
        least = np.full(comp.max() + 1 if len(comp) else 0, np.iinfo(np.int64).max)
        np.minimum.at(least, comp, ids)
        import pandas as pd

        return spark.createDataFrame(pd.DataFrame({"node": ids, "component": least[comp] if len(comp) else ids}), "node long, component long")
    alone = arcs.select(F.col("u").alias("node")).union(arcs.select("v")).distinct()
    done = None
    rest = arcs.where("u <> v")
    for _ in range(max_rounds):
        for _ in range(max_rounds):  # trim
            both = rest.select(F.col("u").alias("node")).intersect(rest.select(F.col("v").alias("node")))
            kept = checkpoint(rest.join(both.withColumnRenamed("node", "u"), "u", "left_semi").join(both.withColumnRenamed("node", "v"), "v", "left_semi").select("u", "v"))
            same = kept.count() == rest.count()
            rest = kept
            if same:
                break
        else:
            raise RuntimeError(f"edges not trimmed after {max_rounds} rounds")
        if rest.isEmpty():
            break
        label = checkpoint(rest.select(F.col("u").alias("node")).union(rest.select("v")).distinct().withColumn("label", F.col("node")))
        for _ in range(max_rounds):
            pushed = rest.join(label.withColumnRenamed("node", "u"), "u").select(F.col("v").alias("node"), "label")
            new = checkpoint(label.union(pushed).groupBy("node").agg(F.min("label").alias("label")))
            moved = new.join(label.withColumnRenamed("label", "old"), "node").where("label < old").isEmpty()
            label = new
            if moved:
                break
        else:
            raise RuntimeError(f"labels not settled after {max_rounds} rounds")
        lu, lv = label.select(F.col("node").alias("u"), F.col("label").alias("lu")), label.select(F.col("node").alias("v"), F.col("label").alias("lv"))
        within = checkpoint(rest.join(lu, "u").join(lv, "v").where("lu = lv").select("u", "v", F.col("lu").alias("label")))
        reached = label.where("node = label")
        frontier = reached
        for _ in range(max_rounds):
            back = within.join(frontier.select(F.col("node").alias("v")), "v", "left_semi").select(F.col("u").alias("node"), "label").distinct()
            frontier = checkpoint(back.join(reached.select("node"), "node", "left_anti"))
            if frontier.isEmpty():
                break
            reached = checkpoint(reached.union(frontier))
        else:
            raise RuntimeError(f"components not reached backward after {max_rounds} rounds")
        found = reached.select("node", F.col("label").alias("component"))
        done = found if done is None else done.union(found)
        rest = checkpoint(rest.join(reached.select(F.col("node").alias("u")), "u", "left_anti").join(reached.select(F.col("node").alias("v")), "v", "left_anti"))
    else:
        raise RuntimeError(f"strong components not found after {max_rounds} rounds")
    if done is None:
        return alone.select("node", F.col("node").alias("component"))
    return alone.join(done, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def largest_strong_part(edges: DataFrame, nodes: DataFrame, driver_edges: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the largest strongly connected component; among equals the one with the busiest node, that of most edges out (of such nodes the smallest)."""
    comp = strong_components(edges, driver_edges)
    sizes = checkpoint(comp.groupBy("component").agg(F.count("*").alias("n")))
    best = sizes.where(F.col("n") == F.lit(sizes.agg(F.max("n")).first()[0])).select("component")
    if best.limit(2).count() > 1:
        busy = edges.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("out"))
        best = comp.join(best, "component", "left_semi").join(busy, "node", "left").orderBy(F.desc_nulls_last("out"), "node").limit(1).select("component")
    ids = comp.join(F.broadcast(best), "component", "left_semi").select(F.col("node").alias("id"))  # one row
    kept = edges.join(ids.withColumnRenamed("id", "u"), "u", "left_semi").join(ids.withColumnRenamed("id", "v"), "v", "left_semi")
    return nodes.join(ids, "id", "left_semi"), kept.select(*edges.columns)
