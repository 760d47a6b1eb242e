"""Feature tables as GeoParquet: geometry in WKB, metadata under the key geo of each file's footer."""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G

# Codes of the WKB format.
WKB = {"Point": 1, "LineString": 2, "Polygon": 3, "MultiLineString": 5, "MultiPolygon": 6}


def wkb(geom) -> bytes | None:
    """Little-endian WKB of a geometry (dict or row)."""
    if geom is None:
        return None
    kind, rings, part_of = geom["type"], geom["rings"], geom["part_of"]
    ring = lambda r: struct.pack("<I", len(r)) + b"".join(struct.pack("<dd", p["x"], p["y"]) for p in r)
    head = lambda k: struct.pack("<BI", 1, WKB[k])
    if kind == "Point":
        return head(kind) + struct.pack("<dd", rings[0][0]["x"], rings[0][0]["y"])
    if kind == "LineString":
        return head(kind) + ring(rings[0])
    if kind == "Polygon":
        return head(kind) + struct.pack("<I", len(rings)) + b"".join(ring(r) for r in rings)
    if kind == "MultiLineString":
        return head(kind) + struct.pack("<I", len(rings)) + b"".join(head("LineString") + ring(r) for r in rings)
    parts: dict[int, list] = {}
    for r, k in zip(rings, part_of, strict=True):
        parts.setdefault(k, []).append(r)
    return head(kind) + struct.pack("<I", len(parts)) + b"".join(head("Polygon") + struct.pack("<I", len(p)) + b"".join(ring(r) for r in p) for p in parts.values())


def with_wkb(frame: DataFrame) -> DataFrame:
    """geometry as WKB bytes."""

    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([None if t is None else wkb({"type": t, "rings": r, "part_of": p}) for t, r, p in zip(b["type"], b["rings"], b["part_of"], strict=True)])

    return frame.withColumn("geometry", encode(F.col("geometry")))


def metadata(kinds: list[str], bounds: list[float] | None = None) -> str:
    about = {"encoding": "WKB", "geometry_types": kinds, "orientation": "counterclockwise"} | ({"bbox": bounds} if bounds else {})
    return json.dumps({"version": "1.1.0", "primary_column": "geometry", "columns": {"geometry": about}})


def write(frame: DataFrame, folder: str) -> str:
    """Write the table as part files below folder, each with the key geo in its footer.

    Spark's own writer sets no footer keys, so tasks write their parts by pyarrow: under a name of
    their own, then renamed, so a repeated task leaves the same file. The mark _SUCCESS comes last.
    """
    from pyarrow import fs

    ext = G.extent(F.col("geometry"))
    about = frame.where("geometry is not null").agg(F.sort_array(F.collect_set("geometry.type")).alias("kinds"), F.min(ext["west"]).alias("w"), F.min(ext["south"]).alias("s"), F.max(ext["east"]).alias("e"), F.max(ext["north"]).alias("n")).first()
    geo = metadata(about.kinds, None if about.w is None else [about.w, about.s, about.e, about.n])
    address = folder if ":/" in folder else f"file://{os.path.abspath(folder)}"
    system, place = fs.FileSystem.from_uri(address)
    if system.get_file_info(place).type.name == "Directory":
        system.delete_dir(place)
    system.create_dir(place, recursive=True)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(address)
        path = f"{root}/part-{TaskContext.get().partitionId():05d}.parquet"
        temp, out, rows = f"{root}/.{uuid.uuid4().hex}.tmp", None, 0
        for b in batches:
            if out is None:
                schema = b.schema.with_metadata({"geo": geo})
                out = pq.ParquetWriter(temp, schema, filesystem=store, compression="zstd")
            out.write_batch(b.replace_schema_metadata({"geo": geo}))
            rows += b.num_rows
        if out is not None:
            out.close()
            store.move(temp, path)
        yield pa.RecordBatch.from_pydict({"rows": [rows]})

    with_wkb(frame).mapInArrow(run, "rows long").agg(F.sum("rows")).first()
    with system.open_output_stream(f"{place}/_SUCCESS"):
        pass
    return folder


def write_network(edges: DataFrame, nodes: DataFrame, folder: str) -> str:
    """edges.parquet and nodes.parquet below folder, node tags as JSON."""
    write(edges, f"{folder}/edges.parquet")
    points = nodes.withColumn("tags", F.when(F.size("tags") > 0, F.to_json("tags")))
    points.write.mode("overwrite").parquet(f"{folder}/nodes.parquet")
    return folder
