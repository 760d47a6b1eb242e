"""The three relations of a map extract, and what is known of its file."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE = "id long, lon double, lat double, tags map<string,string>, version int, changeset long, timestamp long, visible boolean"
WAY = "id long, refs array<long>, tags map<string,string>, version int, changeset long, timestamp long, visible boolean"
MEMBERS = "array<struct<member_id:long,member_type:string,member_role:string>>"
RELATION = f"id long, members {MEMBERS}, tags map<string,string>, version int, changeset long, timestamp long, visible boolean"


@dataclass(frozen=True)
class Header:
    """Bounds are (west, south, east, north) in degrees, or None."""

    bounds: tuple[float, float, float, float] | None = None
    required: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()
    program: str = ""


@dataclass(frozen=True)
class MapData:
    """anywhere tells that places off the globe are meant, as on a plane; else lines and features leave them out."""

    nodes: DataFrame
    ways: DataFrame
    relations: DataFrame
    header: Header = field(default_factory=Header)
    anywhere: bool = False

    def at(self, **changed) -> MapData:
        return replace(self, **changed)

    def persist(self) -> MapData:
        return self.at(nodes=self.nodes.persist(), ways=self.ways.persist(), relations=self.relations.persist())


def member_rows(relations: DataFrame) -> DataFrame:
    """relation_id, seq, member_id, member_type, member_role in member order."""
    return relations.select(F.col("id").alias("relation_id"), F.posexplode("members").alias("seq", "m")).select("relation_id", "seq", "m.*")


def ref_rows(ways: DataFrame, *keep: str) -> DataFrame:
    """way_id, seq, node_id in order; a repeated node stays repeated."""
    return ways.select(F.col("id").alias("way_id"), *keep, F.posexplode("refs").alias("seq", "node_id"))
