"""Sharding by a hierarchical weighted hash tree, in DataFrame expressions only.

Shards hang in racks, racks in regions; a rack weighs what its shards weigh together, a region what
its racks do. A row descends level by level: at each it draws -ln(u) / weight for every child of the
node it has reached, u hashed from the row's id, the level and the child's number, and goes to the child with the
smallest draw. As the smallest of exponential draws falls to each in proportion to its rate, every
shard gets its share of the weight. No other draw changes with one child's weight, so when a shard's
weight changes, rows move between regions only into or out of its region; of those that stay in the
region, between racks only into or out of its rack; and of those that stay in the rack, only into or
out of the shard.

Shards beyond the `base` ones hang in a rack and region of their own, until the tree is laid out
anew: one more shard then takes rows only into itself. That is the law `key`.

Defined cases: a null id is hashed as any one value; null texts have no bytes; repeated rows get the
same shard and slots of their own; very long texts count all their bytes; an empty table gives an empty
result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import n_partitions


def topology(n_shards: int, racks: int = 2, shards_per_rack: int = 5, base: int | None = None) -> list[list[list[int]]]:
    """Regions of racks of shard numbers: the first base shards filled in order, each later one in a region of its own."""
    base = min(n_shards, n_shards if base is None else base)
    rack = [list(range(i, min(i + shards_per_rack, base))) for i in range(0, base, shards_per_rack)]
    return [rack[i : i + racks] for i in range(0, len(rack), racks)] + [[[i]] for i in range(base, n_shards)]


def _descend(key: Column, level: str, children: Column, weights: list[float], most: int) -> Column:
    """The child with the smallest draw among up to `most` children (an array of their numbers); those of weight 0 take no part."""
    weight = F.array(*[F.lit(float(x)) for x in weights])
    draws = []
    for k in range(most):
        child = F.get(children, F.lit(k))
        w = F.get(weight, child)
        # 53 high bits of the hash, moved off 0, give a uniform number in (0, 1)
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(level), child), 11)
        u = (bits.cast("double") + 0.5) * F.lit(2.0**-53)
        draws.append(F.when(w > 0, F.struct((-F.log(u) / w).alias("draw"), child.alias("child"))))
    return (F.array_min(F.array(*draws)) if len(draws) > 1 else draws[0])["child"]


def assign(rows: DataFrame, key: str, name: str, n_shards: int, weights: Mapping[int, float] | None = None, racks: int = 2, shards_per_rack: int = 5, base: int | None = None) -> DataFrame:
    """rows with the shard of each in column name; <name>_region and <name>_rack tell the way down to it."""
    w = weights or {}
    tree = topology(n_shards, racks, shards_per_rack, base)
    all_racks = [rack for region in tree for rack in region]
    at_shard = [w.get(s, 1.0) for s in range(n_shards)]
    at_rack = [sum(at_shard[s] for s in rack) for rack in all_racks]
    first = [sum(len(r) for r in tree[:k]) for k in range(len(tree))]
    racks_of = [[first[k] + j for j in range(len(region))] for k, region in enumerate(tree)]
    at_region = [sum(at_rack[r] for r in ids) for ids in racks_of]
    table = lambda ids: F.array(*[F.array(*map(F.lit, x)) for x in ids])
    key = F.col(key)

    def at_rack_level(region: Column) -> Column:
        return _once(_descend(key, "rack", F.get(table(racks_of), region), at_rack, max(map(len, racks_of))), lambda rack: F.struct(region.alias("region"), rack.alias("rack"), _descend(key, "shard", F.get(table(all_racks), rack), at_shard, max(map(len, all_racks))).alias("shard")))

    way = _once(_descend(key, "region", F.array(*map(F.lit, range(len(tree)))), at_region, len(tree)), at_rack_level)
    # explode keeps the expression in one place, whatever is made of its fields
    rows = rows.select("*", F.explode(F.array(way)).alias("_way"))
    return rows.select("*", F.col("_way.region").alias(f"{name}_region"), F.col("_way.rack").alias(f"{name}_rack"), F.col("_way.shard").alias(name)).drop("_way")


def _once(value: Column, f) -> Column:
    """f(value) with the expression value standing in the plan once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def shard(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", chunks: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    Slots number a shard's rows from 0 without gaps. Rows are ordered within hashed chunks of a
    shard, and chunks are offset by the counts before them, so no task holds a whole shard; the
    table of offsets has n_shards * chunks rows at most, whatever the input.
    """
    spark = docs.sparkSession
    chunks = chunks or min(4096, max(16, n_partitions(spark)))
    key = F.col(id_col).cast("long")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        key.alias("doc_id"),
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(key, F.lit("chunk")), F.lit(chunks)).cast("int").alias("_chunk"),
    )
    rows = assign(rows, "doc_id", "shard", n_shards)
    rows = assign(rows, "doc_id", "grown_shard", n_shards + 1, base=n_shards)
    counts = rows.groupBy("shard", "_chunk").agg(F.count("*").alias("_n"))
    before = W.partitionBy("shard").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("shard", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    place = W.partitionBy("shard", "_chunk").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("_place", F.row_number().over(place))
        .join(F.broadcast(offsets), ["shard", "_chunk"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_offset") + F.col("_place") - 1).cast("long").alias("slot"), "grown_shard")
    )
