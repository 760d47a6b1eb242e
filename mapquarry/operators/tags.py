"""From the tag map to columns: requested keys, and the rest as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of the result that a tag of the same name must not overwrite.
STRUCTURAL = ("id", "osm_type", "geometry", "tags", "members", "refs", "version", "changeset", "timestamp", "visible", "lon", "lat", "u", "v", "length")


def column_name(key: str) -> str:
    return f"{key}_tag" if key in STRUCTURAL else key


def present_keys(frame: DataFrame, keys: list[str]) -> list[str]:
    """Of the keys, those that any row carries (one pass), in their order."""
    found = frame.select(F.explode(F.map_keys("tags")).alias("k")).where(F.col("k").isin(keys)).distinct()
    there = {r[0] for r in found.collect()}  # at most len(keys) rows
    return [k for k in keys if k in there]


def leftovers(tags: Column, keys: list[str], members: Column | None = None) -> Column:
    """JSON of the tags that are no columns, null if there are none; a tag called id is id_tag there.

    members (an array of structs) are a list under the key members, which no tag overwrites.
    """
    rest = F.map_filter(tags, lambda k, _: ~k.isin(keys)) if keys else tags
    rest = F.transform_keys(rest, lambda k, _: F.when(k == "id", "id_tag").otherwise(k))
    plain = F.when(F.size(rest) > 0, F.to_json(rest))
    if members is None:
        return plain
    rest = F.map_filter(rest, lambda k, _: k != "members")
    listed = F.to_json(F.transform(members, lambda m: F.struct(m["member_id"], m["member_role"], m["member_type"])))
    both = F.concat(F.when(F.size(rest) > 0, F.concat(F.rtrim(F.to_json(rest), F.lit("}")), F.lit(","))).otherwise("{"), F.lit('"members":'), listed, F.lit("}"))
    return F.coalesce(both, plain)


def project(frame: DataFrame, keys: list[str], other_tags: bool = True, compact: bool = False) -> DataFrame:
    """Replace tags by one column for each key, and with other_tags a JSON column tags, which holds the column members too.

    compact keeps only the keys that occur, at the cost of a pass. Keys differing in case only
    share Spark's case-insensitive name, so the later ones stay in the JSON.
    """
    if compact:
        keys = present_keys(frame, keys)
    unique, seen = [], {c.lower() for c in frame.columns}
    for k in dict.fromkeys(keys):
        if column_name(k).lower() not in seen:
            seen.add(column_name(k).lower())
            unique.append(k)
    out = [F.col(f"`{c}`") for c in frame.columns if c not in ("tags", "members")]
    out += [F.element_at("tags", F.lit(k)).alias(column_name(k)) for k in unique]
    if other_tags:
        out.append(leftovers(F.col("tags"), unique, F.col("members") if "members" in frame.columns else None).alias("tags"))
    return frame.select(*out)
