"""Places by name, and files fetched before. The network is the caller's: functions to look up and fetch are passed in."""

from __future__ import annotations

import os
import re
import shutil
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators.selection import Box, normal_box
from . import catalog

Lookup = Callable[[str], dict]
Fetch = Callable[[str, str], None]


def geocode(query: str, lookup: Lookup | None = None) -> Box:
    """The bounds of a place: lookup(query) gives a mapping with bounds [west, south, east, north]."""
    if not isinstance(query, str) or not query.strip():
        raise ValueError("a place should be text")
    if lookup is None:
        raise NotImplementedError("looking up places needs the network: pass lookup")
    found = lookup(query.strip())
    if not found or "bounds" not in found:
        raise catalog.NotFound(f"no place is called {query!r}")
    return normal_box(found["bounds"])


def slug(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", text.lower()).strip("_")


def download(url: str, folder: str, fetch: Fetch | None = None, update: bool = False) -> str:
    """The file of that address in folder, fetched unless it is there. It appears when whole."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, os.path.basename(url))
    if os.path.exists(path) and not update:
        return path
    if fetch is None:
        raise NotImplementedError("downloading needs the network: pass fetch")
    part = f"{path}.part"
    fetch(url, part)
    os.replace(part, path)
    return path


def downloads(folder: str) -> list[str]:
    return sorted(f for f in os.listdir(folder) if f.endswith(".pbf")) if os.path.isdir(folder) else []


def clear_downloads(folder: str, name: str | None = None) -> list[str]:
    gone = [f for f in downloads(folder) if name in (None, f, os.path.join(folder, f))]
    for f in gone:
        os.remove(os.path.join(folder, f))
    return gone


def get_data(table: DataFrame, name: str, folder: str, fetch: Fetch | None = None, update: bool = False) -> str:
    """The file of a named extract of the catalogue."""
    return download(catalog.resolve(table, name), folder, fetch, update)


def get_data_by_bbox(table: DataFrame, box, folder: str, fetch: Fetch | None = None, crop: bool = True, spark=None, update: bool = False) -> str:
    """The file of the smallest extract that covers the box, with crop cut to it."""
    whole = download(catalog.by_box(table, box), folder, fetch, update)
    if not crop:
        return whole
    out = os.path.join(folder, catalog.crop_name(box))
    if os.path.exists(out) and not update:
        return out
    from ..api import OSM

    part = os.path.join(folder, "part_" + catalog.crop_name(box))
    OSM(whole, bounding_box=box, spark=spark).to_pbf(part)
    shutil.move(part, out)
    return out


def get_data_by_geocoding(table: DataFrame, query: str, folder: str, lookup: Lookup | None = None, fetch: Fetch | None = None, crop: bool = True, spark=None) -> str:
    return get_data_by_bbox(table, geocode(query, lookup), folder, fetch, crop, spark)
