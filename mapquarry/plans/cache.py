"""Results kept as Parquet under a key of file, its state and the parameters."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _fs(folder: str):
    import os

    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if ":/" in folder else f"file://{os.path.abspath(folder)}")


def file_state(path: str) -> tuple[str, int, int]:
    """Path, modification time in nanoseconds and size."""
    system, place = _fs(path)
    info = system.get_file_info(place)
    return place, info.mtime_ns or 0, info.size or 0


def key(path: str, **parameters) -> str:
    place, changed, size = file_state(path)
    prefix = hashlib.sha1(place.encode()).hexdigest()[:12]
    rest = hashlib.sha1(json.dumps([changed, size, parameters], sort_keys=True, default=str).encode()).hexdigest()
    return f"{prefix}-{rest}"


def materialize(spark: SparkSession, folder: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The kept result of that name, or the made one, kept. Spark's _SUCCESS mark tells a whole result."""
    system, place = _fs(folder)
    where = f"{folder.rstrip('/')}/{name}"
    mark = system.get_file_info(f"{place}/{name}/_SUCCESS")
    if mark.type.name != "File":
        make().write.mode("overwrite").parquet(where)
    return spark.read.parquet(where)


def materialize_pair(spark: SparkSession, folder: str, name: str, make: Callable[[], tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    made: list = []

    def one(k: int) -> DataFrame:
        if not made:
            made.extend(make())
        return made[k]

    return materialize(spark, folder, f"{name}-edges", lambda: one(0)), materialize(spark, folder, f"{name}-nodes", lambda: one(1))


def kept(folder: str) -> list[str]:
    from pyarrow import fs

    system, place = _fs(folder)
    if system.get_file_info(place).type.name != "Directory":
        return []
    return sorted(i.base_name for i in system.get_file_info(fs.FileSelector(place)) if i.type.name == "Directory" and "-" in i.base_name)


def clear(folder: str, path: str | None = None) -> list[str]:
    """Delete the results of a file, or all."""
    system, place = _fs(folder)
    prefix = hashlib.sha1(file_state(path)[0].encode()).hexdigest()[:12] if path else ""
    gone = [k for k in kept(folder) if k.startswith(prefix)]
    for k in gone:
        system.delete_dir(f"{place}/{k}")
    return gone
