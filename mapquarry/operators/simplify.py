"""Topological simplification: chains of nodes that a street only passes through become one edge.

Endpoints are found in DataFrame expressions. Edges between endpoints stay as they are. The rest are
grouped by the connected component of pass-through nodes they touch, so a chain is whole within its
group, and each group is walked in order (an exact sequential walk, as parallel edges make the result
depend on it). Components of pass-through nodes are streets between two crossings; only rings and
long roads without a crossing are larger.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .network import endpoints


def walk(edges: list[tuple[int, int, int]], is_end: dict[int, bool], remove_rings: bool = True) -> list[list[int]]:
    """Chains of edge numbers, for edges (number, u, v) in order.

    Chains start at endpoints in order of first appearance (all u, then all v), edges in row order;
    a walk goes on by the first unused edge that doesn't lead straight back. Rings without an
    endpoint follow unless they are removed.
    """
    nodes = list(dict.fromkeys([*(e[1] for e in edges), *(e[2] for e in edges)]))
    out: dict[int, list[int]] = defaultdict(list)
    for k, (_, u, _) in enumerate(edges):
        out[u].append(k)
    used = [False] * len(edges)
    chains = []

    def follow(k: int) -> list[int]:
        chain = [k]
        used[k] = True
        before, here = edges[k][1], edges[k][2]
        while not is_end[here]:
            nxt = next((j for j in out[here] if not used[j] and edges[j][2] != before), None)
            if nxt is None:
                break
            used[nxt] = True
            chain.append(nxt)
            before, here = here, edges[nxt][2]
        return chain

    for node in nodes:
        if is_end[node]:
            for k in out[node]:
                if not used[k]:
                    chains.append(follow(k))
    if not remove_rings:
        for node in nodes:
            for k in out[node]:
                if not used[k]:
                    chains.append(follow(k))
    return [[edges[k][0] for k in c] for c in chains]


def chains(edges: DataFrame, ends: DataFrame, remove_rings: bool = True) -> DataFrame:
    """row_id, chain, step: the chain of each kept edge (named by its first row_id), and its place in it. Edges: row_id, u, v."""
    marked = edges.select("row_id", "u", "v").join(ends.select(F.col("id").alias("u"), F.col("is_endpoint").alias("end_u")), "u").join(ends.select(F.col("id").alias("v"), F.col("is_endpoint").alias("end_v")), "v")
    direct = marked.where("end_u and end_v").select("row_id", F.col("row_id").alias("chain"), F.lit(0).alias("step"))
    inner = marked.where("not (end_u and end_v)")
    linked = components(inner.where("not end_u and not end_v").select(F.col("u").alias("a"), F.col("v").alias("b")))
    anchor = F.when(~F.col("end_u"), F.col("u")).otherwise(F.col("v"))
    grouped = inner.withColumn("node", anchor).join(linked, "node", "left").withColumn("part", F.coalesce("root", "node"))

    def solve(rows: list[tuple]) -> Iterator[tuple]:
        """rows: row_id, u, v, end_u, end_v of one part, in order."""
        is_end = {r[1]: r[3] for r in rows} | {r[2]: r[4] for r in rows}
        for chain in walk([r[:3] for r in rows], is_end, remove_rings):
            yield from ((row, chain[0], k) for k, row in enumerate(chain))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by part; the last part of a batch may go on in the next."""
        part, held = None, []
        for b in batches:
            out: list[tuple] = []
            columns = (b[c].tolist() for c in ("row_id", "u", "v", "end_u", "end_v"))
            for key, group in itertools.groupby(zip(b["part"].tolist(), zip(*columns, strict=True), strict=True), key=lambda x: x[0]):
                if key != part:
                    out += solve(held)
                    part, held = key, []
                held += [x[1] for x in group]
            yield pd.DataFrame(out, columns=["row_id", "chain", "step"]).astype("int64")
        yield pd.DataFrame(list(solve(held)), columns=["row_id", "chain", "step"]).astype("int64")

    sorted_parts = grouped.select("part", "row_id", "u", "v", "end_u", "end_v").repartition("part").sortWithinPartitions("part", "row_id")
    return direct.union(sorted_parts.mapInPandas(run, "row_id long, chain long, step int"))


def _field(name: str):
    return lambda x: x[name]


def simplify(edges: DataFrame, nodes: DataFrame | None = None, differ: tuple[str, ...] = (), include: DataFrame | None = None, remove_rings: bool = True, lengths: tuple[str, ...] = ("length",), track_merged: bool = False, row_id: str = "row_id") -> tuple[DataFrame, DataFrame | None]:
    """Directed edges with a stable row_id, u, v to one edge for each chain, and the nodes it ends at.

    Lengths are summed; of other columns the first value stays, and where values differ along the
    chain <column>_merged lists them in order (null else). Geometries are joined in walk order; the
    points of a row marked reversed are turned first, and without such a column those of a row whose
    line ends at its node u.
    """
    ends = endpoints(edges, differ, include)
    place = chains(edges.withColumnRenamed(row_id, "row_id") if row_id != "row_id" else edges, ends, remove_rings)
    rows = edges.join(place, "row_id")
    lengths = tuple(c for c in lengths if c in edges.columns)
    plain = [c for c in edges.columns if c not in ("u", "v", "row_id", "geometry", "reversed", "seq", *lengths)]
    ordered = F.array_sort(F.collect_list(F.struct("step", "u", "v", *[F.col(f"`{c}`") for c in plain], *(["points"] if "geometry" in edges.columns else []))))
    if "geometry" in edges.columns:
        points = F.flatten("geometry.rings")
        turned = F.when(F.col("reversed"), F.reverse(points)).otherwise(points) if "reversed" in edges.columns else points
        if "reversed" not in edges.columns and nodes is not None:
            # a line that ends where its row begins is turned
            at = nodes.select(F.col("id").alias("u"), "lon", "lat")
            rows = rows.join(at, "u", "left")
            begins = lambda p: (p["x"] == F.col("lon")) & (p["y"] == F.col("lat"))
            turned = F.when(begins(F.element_at(points, -1)) & ~begins(F.element_at(points, 1)), F.reverse(points)).otherwise(points)
        rows = rows.withColumn("points", turned)
    merged = rows.groupBy("chain").agg(ordered.alias("s"), *[F.sum(f"`{c}`").alias(c) for c in lengths])
    first, last = F.element_at("s", 1), F.element_at("s", -1)
    out = [F.col("chain").alias("row_id"), first["u"].alias("u"), last["v"].alias("v"), *lengths]
    for c in plain:
        values = F.transform("s", _field(c))
        out += [first[c].alias(c), F.when(F.size(F.array_distinct(values)) > 1, values).alias(f"{c}_merged")]
    if "geometry" in edges.columns:
        joined = F.flatten(F.transform("s", lambda x, i: F.when(i == 0, x["points"]).otherwise(F.slice(x["points"], 2, F.greatest(F.size(x["points"]) - 1, F.lit(1))))))
        out.append(F.struct(F.lit("LineString").alias("type"), F.array(joined).alias("rings"), F.array(F.lit(0)).alias("part_of")).alias("geometry"))
    if track_merged:
        out.append(F.transform("s", lambda x: F.struct(x["u"], x["v"])).alias("merged_edges"))
    simple = merged.select(*out)
    if nodes is None:
        return simple, None
    ids = simple.select(F.col("u").alias("id")).union(simple.select("v")).distinct()
    return simple, nodes.join(ids, "id", "left_semi")
