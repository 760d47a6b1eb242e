"""Reading map files: blob index, blocks, header, and the data source "osmpbf".

    spark.dataSource.register(PbfSource)
    spark.read.format("osmpbf").option("element", "way").load(path)

Options: element (node, way or relation), blobs (to a partition, 16), metadata (true: version,
changeset, timestamp, visible are read), tagKeys (comma-separated: other tags are dropped).
"""

from __future__ import annotations

import lzma
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..model import NODE, RELATION, WAY, Header, MapData
from . import wire

# Features a reader must know, and limits of the format.
KNOWN = ("OsmSchema-V0.6", "DenseNodes", "HistoricalInformation")
MAX_HEADER = 64 * 1024
MEMBER_TYPES = ("node", "way", "relation")


class MapFileError(ValueError):
    """The file is no map file, or is broken."""


class UnsupportedMapFile(NotImplementedError):
    """The file needs features that aren't supported."""


def open_file(path: str):
    """A seekable file for a local path or any address that pyarrow resolves."""
    import os

    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path if ":/" in path else f"file://{os.path.abspath(path)}")
    return system.open_input_file(place)


def index_blobs(f) -> list[tuple[str, int, int]]:
    """(type, offset, size) of every blob, reading headers only."""
    out, at = [], 0
    total = f.size()
    while at < total:
        f.seek(at)
        head = f.read(4)
        if len(head) < 4:
            raise MapFileError("the file ends within a blob header's length")
        size = struct.unpack(">I", head)[0]
        if size > MAX_HEADER:
            raise MapFileError(f"a blob header of {size} bytes is too large")
        data = f.read(size)
        if len(data) < size:
            raise MapFileError("the file ends within a blob header")
        kind, length = "", None
        try:
            for number, _, value in wire.fields(data):
                if number == 1:
                    kind = value.decode()
                elif number == 3:
                    length = value
        except (ValueError, IndexError, AttributeError) as e:
            raise MapFileError(f"cannot read a blob header: {e}") from e
        if length is None:
            raise MapFileError("a blob header has no size")
        at += 4 + size
        if at + length > total:
            raise MapFileError("the file ends within a blob")
        out.append((kind, at, length))
        at += length
    return out


def payload(blob: bytes) -> bytes:
    for number, _, value in wire.fields(blob):
        if number == 1:
            return value
        if number == 3:
            return zlib.decompress(value)
        if number == 4:
            return lzma.decompress(value)
    raise MapFileError("a blob is neither raw nor packed by zlib or lzma")


def header_of(data: bytes) -> Header:
    bounds, required, optional, program = None, [], [], ""
    for number, _, value in wire.fields(data):
        if number == 1:
            box = {n: wire.unzigzag(v) / 1e9 for n, _, v in wire.fields(value)}
            bounds = (box.get(1, 0.0), box.get(4, 0.0), box.get(2, 0.0), box.get(3, 0.0))
        elif number == 4:
            required.append(value.decode())
        elif number == 5:
            optional.append(value.decode())
        elif number == 16:
            program = value.decode()
    return Header(bounds, tuple(required), tuple(optional), program)


def read_header(path: str) -> Header:
    """The header of a file; errors unless it is the first block and all required features are known."""
    with open_file(path) as f:
        blobs = index_blobs(f)
        if not blobs or blobs[0][0] != "OSMHeader":
            raise MapFileError(f"{path} does not begin with a header")
        f.seek(blobs[0][1])
        found = header_of(payload(f.read(blobs[0][2])))
    if unknown := [x for x in found.required if x not in KNOWN]:
        raise UnsupportedMapFile(f"{path} needs {', '.join(unknown)}")
    return found


@dataclass
class _Block:
    strings: list[str]
    groups: list[bytes]
    granularity: int = 100
    date: int = 1000
    lat0: int = 0
    lon0: int = 0


def _block(data: bytes) -> _Block:
    b = _Block([], [])
    for number, _, value in wire.fields(data):
        if number == 1:
            b.strings = [v.decode("utf-8", "replace") for n, _, v in wire.fields(value) if n == 1]
        elif number == 2:
            b.groups.append(value)
        elif number == 17:
            b.granularity = value
        elif number == 18:
            b.date = value
        elif number == 19:
            b.lat0 = wire.signed(value)
        elif number == 20:
            b.lon0 = wire.signed(value)
    return b


class _Rows:
    """Columns of one element kind, gathered over the groups of a block."""

    def __init__(self, kind: str, keys: frozenset[str] | None, metadata: bool):
        self.kind, self.keys, self.metadata = kind, keys, metadata
        self.c: dict[str, list] = {k: [] for k in ("id", "lon", "lat", "tags", "refs", "members", "version", "changeset", "timestamp", "visible")}

    def tags(self, strings: list[str], keys: np.ndarray, values: np.ndarray) -> list[tuple[str, str]]:
        pairs = {strings[k]: strings[v] for k, v in zip(keys.tolist(), values.tolist(), strict=True)}
        return [(k, v) for k, v in pairs.items() if self.keys is None or k in self.keys]

    def info(self, data: bytes | None, date: int) -> None:
        if not self.metadata:
            return
        got = {n: v for n, w, v in wire.fields(data) if w == 0} if data is not None else {}
        self.c["version"].append(wire.signed(got[1]) if 1 in got else -1)
        self.c["timestamp"].append(wire.signed(got.get(2, 0)) * date // 1000)
        self.c["changeset"].append(wire.signed(got.get(3, 0)))
        self.c["visible"].append(bool(got.get(6, 0)))

    def one(self, b: _Block, data: bytes) -> None:
        """A Node, Way or Relation message."""
        got = {n: v for n, _, v in wire.fields(data)}
        none = np.zeros(0, np.uint64)
        keys, values = (wire.unpack(got[n]) if n in got else none for n in (2, 3))
        self.c["tags"].append(self.tags(b.strings, keys, values))
        self.info(got.get(4), b.date)
        if self.kind == "node":
            self.c["id"].append(wire.unzigzag(got[1]))
            self.c["lat"].append((wire.unzigzag(got[8]) * b.granularity + b.lat0) / 1e9)
            self.c["lon"].append((wire.unzigzag(got[9]) * b.granularity + b.lon0) / 1e9)
            return
        self.c["id"].append(wire.signed(got[1]))
        ids = np.cumsum(wire.unpack_signed(got.get(8 if self.kind == "way" else 9, b""))).tolist()
        if self.kind == "way":
            self.c["refs"].append(ids)
        else:
            roles, types = wire.unpack(got.get(8, b"")).tolist(), wire.unpack(got.get(10, b"")).tolist()
            self.c["members"].append([{"member_id": i, "member_type": MEMBER_TYPES[t], "member_role": b.strings[r]} for i, t, r in zip(ids, types, roles, strict=True)])

    def dense(self, b: _Block, data: bytes) -> None:
        got = {n: v for n, _, v in wire.fields(data)}
        ids = np.cumsum(wire.unpack_signed(got.get(1, b"")))
        n = len(ids)
        self.c["id"] += ids.tolist()
        for name, number, zero in (("lat", 8, b.lat0), ("lon", 9, b.lon0)):
            self.c[name] += ((np.cumsum(wire.unpack_signed(got.get(number, b""))) * b.granularity + zero) / 1e9).tolist()
        mixed = wire.unpack(got.get(10, b"")).astype(np.int64)
        if len(mixed):  # key, value, key, value, 0 for each node; a key is never 0
            tags: list = []
            at = 0
            flat = mixed.tolist()
            for _ in range(n):
                one = {}
                while flat[at]:
                    one[b.strings[flat[at]]] = b.strings[flat[at + 1]]
                    at += 2
                at += 1
                tags.append([(k, v) for k, v in one.items() if self.keys is None or k in self.keys])
            self.c["tags"] += tags
        else:
            self.c["tags"] += [[]] * n
        if self.metadata:
            info = {k: v for k, _, v in wire.fields(got[5])} if 5 in got else {}
            column = lambda k, f, cum: (np.cumsum(f(info[k])) if cum else f(info[k])) if k in info else np.zeros(n, np.int64)
            self.c["version"] += column(1, wire.unpack, False).tolist()
            self.c["timestamp"] += (column(2, wire.unpack_signed, True) * b.date // 1000).tolist()
            self.c["changeset"] += column(3, wire.unpack_signed, True).tolist()
            self.c["visible"] += column(6, wire.unpack, False).astype(bool).tolist()

    def batch(self):
        import pyarrow as pa

        n = len(self.c["id"])
        text_map = pa.map_(pa.string(), pa.string())
        member = pa.list_(pa.struct([("member_id", pa.int64()), ("member_type", pa.string()), ("member_role", pa.string())]))
        kinds = {"id": pa.int64()}
        kinds |= {"node": {"lon": pa.float64(), "lat": pa.float64()}, "way": {"refs": pa.list_(pa.int64())}, "relation": {"members": member}}[self.kind]
        kinds |= {"tags": text_map, "version": pa.int32(), "changeset": pa.int64(), "timestamp": pa.int64(), "visible": pa.bool_()}
        arrays = [pa.array(self.c[k], t) if k in ("id", "lon", "lat", "tags", "refs", "members") or self.metadata else pa.nulls(n, t) for k, t in kinds.items()]
        return pa.RecordBatch.from_arrays(arrays, names=list(kinds))


def _places(counts: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


class _Messages:
    """Many messages of varints and nested varints read at once: each step reads one field of every message."""

    def __init__(self, messages: list[bytes]):
        data = np.frombuffer(b"".join(messages), dtype=np.uint8)
        last = np.flatnonzero(data < 128)
        self.starts = np.append(0, last + 1)
        if not len(last) or self.starts[-1] != len(data) or np.diff(self.starts).max() > 10:
            raise ValueError("not made of varints")
        self.values = wire.unpack(data.tobytes())
        #: The token that begins at a byte, -1 where none does.
        self.token = np.full(len(data) + 1, -1)
        self.token[self.starts] = np.arange(len(self.starts))
        ends = np.cumsum([len(m) for m in messages])
        self.fields(self.at(np.append(0, ends[:-1])), self.at(ends))

    def at(self, byte: np.ndarray) -> np.ndarray:
        out = self.token[byte]
        if (out < 0).any():
            raise ValueError("a field ends within a number")
        return out

    def fields(self, first: np.ndarray, end: np.ndarray) -> None:
        """Numbers (value, there) and ranges (first and last token) by field number; the last one of a field counts."""
        n = len(first)
        self.numbers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.ranges: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        place, rows = first.copy(), np.flatnonzero(first < end)
        while len(rows):
            p, e = place[rows], end[rows]
            if (p + 1 >= e).any():
                raise ValueError("a message ends within a field")
            key, second = self.values[p], self.values[p + 1]
            after = p + 2
            long = (key & np.uint64(7)) == 2
            if (~long & ((key & np.uint64(7)) != 0)).any():
                raise ValueError("neither numbers nor messages")
            if long.any():
                size = second[long]
                byte = self.starts[after[long]] + np.minimum(size, np.uint64(len(self.token))).astype(np.int64)
                if (byte > self.starts[e[long]]).any():
                    raise ValueError("a field runs over its message")
                after[long] = self.at(byte)
            for number in np.unique(key >> np.uint64(3)).tolist():
                for kept, kind in ((self.numbers, ~long), (self.ranges, long)):
                    mine = kind & (key >> np.uint64(3) == number)
                    if mine.any():
                        a, b = kept.setdefault(number, (np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)))
                        a[rows[mine]] = second[mine].view(np.int64) if kept is self.numbers else p[mine] + 2
                        b[rows[mine]] = 1 if kept is self.numbers else after[mine]
            place[rows] = after
            rows = rows[after < e]

    def number(self, number: int, n: int, default: int = 0) -> np.ndarray:
        value, there = self.numbers.get(number, (np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)))
        return np.where(there > 0, value, default)

    def packed(self, number: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """How many values each message has in the field, and the values as uint64."""
        first, end = self.ranges.get(number, (np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)))
        return end - first, self.values[_places(end - first, first)]


def _sums(counts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Running sums of zig-zag numbers, each message from 0 on."""
    total = np.cumsum(((values >> np.uint64(1)) ^ (np.uint64(0) - (values & np.uint64(1)))).view(np.int64))
    first = (np.cumsum(counts) - counts)[counts > 0]
    return total - np.repeat(np.where(first > 0, total[first - 1], 0), counts[counts > 0])


def _batch(b: _Block, messages: list[bytes], kind: str, keys: frozenset[str] | None, metadata: bool):
    """Ways or relations of a block as an Arrow batch; ValueError for messages that only a reading one by one can tell of."""
    import pyarrow as pa

    n, m = len(messages), _Messages(messages)
    if {1, 2, 3, 4, 8, 9, 10} & (m.ranges.keys() & m.numbers.keys()) or 1 not in m.numbers or not m.numbers[1][1].all():
        raise ValueError("unusual fields")
    if not {2, 3, 4, 8, 9, 10}.isdisjoint(m.numbers) or 1 in m.ranges:
        raise ValueError("unusual fields")
    strings = pa.array(b.strings, pa.string())
    limit = len(b.strings)
    taken = lambda places: strings.take(pa.array(places.astype(np.int64)))
    lists = lambda counts: pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
    ids, (counts, k), (others, v) = m.number(1, n), m.packed(2, n), m.packed(3, n)
    if (counts != others).any() or len(k) and max(k.max(), v.max()) >= limit:
        raise ValueError("tags don't match")
    owner = np.repeat(np.arange(n), counts)
    alike = strings.dictionary_encode().indices.to_numpy()[k.astype(np.int64)] if len(k) else k  # equal strings may stand twice in the table
    if len(np.unique(owner * max(1, limit) + alike)) < len(k):
        raise ValueError("a key stands twice")
    if keys is not None:
        kept = np.array([s in keys for s in b.strings], dtype=bool)[k.astype(np.int64)] if len(k) else np.zeros(0, dtype=bool)
        k, v, counts = k[kept], v[kept], np.bincount(owner[kept], minlength=n)
    out = {"id": pa.array(ids)}
    where, refs = m.packed(8 if kind == "way" else 9, n)
    refs = _sums(where, refs)
    if kind == "way":
        out["refs"] = pa.ListArray.from_arrays(lists(where), pa.array(refs))
    else:
        (with_role, roles), (with_type, types) = m.packed(8, n), m.packed(10, n)
        if (with_role != where).any() or (with_type != where).any() or len(types) and (types.max() > 2 or roles.max() >= limit):
            raise ValueError("members don't match")
        one = pa.StructArray.from_arrays([pa.array(refs), pa.array(MEMBER_TYPES).take(pa.array(types.astype(np.int64))), taken(roles)], names=["member_id", "member_type", "member_role"])
        out["members"] = pa.ListArray.from_arrays(lists(where), one)
    out["tags"] = pa.MapArray.from_arrays(lists(counts), taken(k), taken(v))
    if not metadata:
        out |= {c: pa.nulls(n, t) for c, t in (("version", pa.int32()), ("changeset", pa.int64()), ("timestamp", pa.int64()), ("visible", pa.bool_()))}
        return pa.RecordBatch.from_arrays(list(out.values()), names=list(out))
    first, end = m.ranges.get(4, (np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)))
    m.fields(first, end)
    stamp = m.number(2, n)
    if np.abs(stamp).max() > (1 << 62) // max(1, b.date):
        raise ValueError("a moment is too large")
    out |= {"version": pa.array(m.number(1, n, -1)).cast(pa.int32()), "changeset": pa.array(m.number(3, n)), "timestamp": pa.array(stamp * b.date // 1000), "visible": pa.array(m.number(6, n) != 0)}
    return pa.RecordBatch.from_arrays(list(out.values()), names=list(out))


def decode(data: bytes, kind: str, keys: frozenset[str] | None = None, metadata: bool = True):
    """The elements of one kind in a primitive block, as an Arrow batch."""
    b = _block(data)
    wanted = {"node": (1, 2), "way": (3,), "relation": (4,)}[kind]
    found = [(number, value) for group in b.groups for number, _, value in wire.fields(group) if number in wanted]
    if kind != "node" and found:
        try:
            return _batch(b, [value for _, value in found], kind, keys, metadata)
        except ValueError:  # unusual ones are read one by one, which tells what is wrong with broken ones
            pass
    rows = _Rows(kind, keys, metadata)
    for number, value in found:
        rows.dense(b, value) if number == 2 else rows.one(b, value)
    return rows.batch()


class _Part(InputPartition):
    def __init__(self, path: str, blobs: list[tuple[int, int]]):
        self.path, self.blobs = path, blobs


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path")
        self.kind = options.get("element", "node")
        if self.kind not in MEMBER_TYPES:
            raise ValueError(f"element should be one of {', '.join(MEMBER_TYPES)}")
        self.per = int(options.get("blobs", 16))
        self.metadata = str(options.get("metadata", "true")).lower() == "true"
        keys = options.get("tagkeys", options.get("tagKeys"))
        self.keys = frozenset(keys.split(",")) if keys is not None else None

    def partitions(self) -> list[InputPartition]:
        read_header(self.path)
        with open_file(self.path) as f:
            blobs = [(o, s) for kind, o, s in index_blobs(f) if kind == "OSMData"]
        return [_Part(self.path, blobs[k : k + self.per]) for k in range(0, len(blobs), self.per)] or [_Part(self.path, [])]

    def read(self, partition: _Part) -> Iterator:
        with open_file(partition.path) as f:
            for offset, size in partition.blobs:
                f.seek(offset)
                batch = decode(payload(f.read(size)), self.kind, self.keys, self.metadata)
                if batch.num_rows:
                    yield batch


class PbfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "osmpbf"

    def schema(self) -> str:
        return {"node": NODE, "way": WAY, "relation": RELATION}[self.options.get("element", "node")]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def load(spark: SparkSession, path: str, **options) -> MapData:
    """Nodes, ways, relations and header of a file. Options as for the data source."""
    found = read_header(path)
    spark.dataSource.register(PbfSource)
    frames = {}
    for kind in MEMBER_TYPES:
        reader = spark.read.format("osmpbf").option("element", kind)
        for k, v in options.items():
            reader = reader.option(k, str(v).lower() if isinstance(v, bool) else v)
        frames[f"{kind}s"] = reader.load(path)
    return MapData(**frames, header=found)


def blocks(spark: SparkSession, path: str):
    """seq, type, offset, size of the blobs of a file, from their headers only."""
    with open_file(path) as f:
        rows = [(k, *b) for k, b in enumerate(index_blobs(f))]
    return spark.createDataFrame(rows, "seq long, type string, offset long, size long")


def ingest(spark: SparkSession, path: str, folder: str, metadata: bool = True) -> MapData:
    """Decode once into Parquet, nodes in spatial order so that boxes prune row groups, and read that; what is there whole is not decoded again."""
    from pyspark.sql import functions as F

    from ..plans import cache

    data = load(spark, path, metadata=metadata)
    cell = F.floor((F.col("lon") + 180) * 10) * 4096 + F.floor((F.col("lat") + 90) * 10)
    nodes = data.nodes.repartitionByRange(cell).sortWithinPartitions(cell, "id")
    parts = (("nodes", lambda: nodes), ("ways", lambda: data.ways), ("relations", lambda: data.relations))
    return MapData(*[cache.materialize(spark, folder, name, make) for name, make in parts], data.header)
