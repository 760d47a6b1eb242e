"""The state of a versioned extract at a moment."""

from __future__ import annotations

import datetime
import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EARLIEST = datetime.datetime(2005, 4, 9, tzinfo=datetime.timezone.utc)


def moment(value=None) -> int:
    """Unix seconds of a date, text, or number; now if left out. Dates count as midnight UTC."""
    now = datetime.datetime.now(datetime.timezone.utc)
    if value is None:
        warnings.warn("no timestamp given: the latest state is used", UserWarning, stacklevel=2)
        return int(now.timestamp())
    if isinstance(value, bool) or not isinstance(value, (int, str, datetime.date)):
        raise ValueError(f"a timestamp should be a date, text or unix seconds, not {value!r}")
    if isinstance(value, str):
        value = datetime.datetime.fromisoformat(value.strip())
    if isinstance(value, int):
        value = datetime.datetime.fromtimestamp(value, datetime.timezone.utc)
    elif not isinstance(value, datetime.datetime):
        value = datetime.datetime(value.year, value.month, value.day)
    if value.tzinfo is None:
        value = value.replace(tzinfo=datetime.timezone.utc)
    if value > now:
        raise ValueError(f"{value} is in the future")
    if value < EARLIEST:
        raise ValueError(f"{value} is before the first edits of {EARLIEST:%Y-%m-%d}")
    return int(value.timestamp())


def is_history(path: str) -> bool:
    return "osh.pbf" in path.lower()


def as_of(frame: DataFrame, seconds: int, order: list[str] | None = None, strict: bool = False, fold_tags: bool = False) -> DataFrame:
    """One row for each id, of the versions up to the moment.

    By default versions that were not visible are dropped first and each column takes its last value
    that is not null, so what was deleted shows its last visible state. fold_tags merges the tags of
    all versions, later values winning (ways); else the last map that is not empty counts (nodes,
    relations). strict takes the last version as it is, and drops the id if that is not visible.
    """
    order = order or ["version"]
    past = frame.where(F.col("timestamp") <= seconds)
    rank = F.struct(*order)
    names = [c for c in frame.columns if c != "id"]
    if strict:
        last = past.groupBy("id").agg(F.max_by(F.struct(*names), rank).alias("r"))
        return last.select("id", "r.*").where("visible").select(*frame.columns)
    seen = past.where("visible")
    aggs = []
    for c in names:
        value = F.col(c)
        if c == "tags" and fold_tags:
            ordered = F.sort_array(F.collect_list(F.struct(rank.alias("o"), F.map_entries(value).alias("t"))))
            aggs.append(F.aggregate(F.transform(ordered, lambda x: F.map_from_entries(x["t"])), F.create_map().cast("map<string,string>"), lambda a, t: F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(t, k)), t)).alias(c))
        elif c == "tags":
            aggs.append(F.coalesce(F.max_by(value, F.when(F.size(value) > 0, rank)), F.create_map().cast("map<string,string>")).alias(c))
        else:
            aggs.append(F.max_by(value, F.when(value.isNotNull(), rank)).alias(c))
    return seen.groupBy("id").agg(*aggs).select(*frame.columns)
