import json
import lzma
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mapquarry.api import OSM
from mapquarry.model import NODE, RELATION, WAY, Header, MapData
from mapquarry.operators import edit, selection
from mapquarry.plans import cache
from mapquarry.sources import catalog, geoparquet, pbf, wire, writer


@pytest.fixture(scope="module")
def data(spark):
    meta = (3, 77, 1_600_000_000, True)
    nodes = [(i, round(24.0 + x, 7), round(60.0 + y, 7), t, *meta) for i, x, y, t in [(1, 0.0, 0.0, {}), (2, 0.1, 0.0, {"shop": "bakery", "name": "Ä"}), (3, 0.1, 0.1, {}), (4, 0.0, 0.1, {}), (5, 0.5, 0.5, {}), (6, 0.6, 0.5, {}), (-7, -104.4410082, -33.9085134, {})]]
    ways = [(10, [1, 2, 3, 4, 1], {"building": "yes"}, *meta), (11, [3, 5, 6], {"highway": "residential", "oneway": "yes"}, *meta), (12, [5, 6, 99], {"highway": "motorway"}, *meta), (13, [2, 3, 4, 2], {}, *meta)]
    members = lambda *m: [{"member_id": i, "member_type": t, "member_role": r} for i, t, r in m]
    relations = [(20, members((13, "way", "outer")), {"type": "multipolygon", "landuse": "forest"}, *meta), (21, members((20, "relation", ""), (2, "node", "label")), {"type": "site"}, *meta), (22, members((11, "way", ""), (12, "way", "")), {"route": "bus", "type": "route"}, *meta)]
    return MapData(spark.createDataFrame(nodes, NODE), spark.createDataFrame(ways, WAY), spark.createDataFrame(relations, RELATION), Header((24.0, 60.0, 24.6, 60.5)))


@pytest.fixture(scope="module")
def path(data, tmp_path_factory):
    return writer.write(data, str(tmp_path_factory.mktemp("map") / "x.osm.pbf"), partitions=2)


def rows(frame):
    return sorted((json.loads(r[0]) for r in frame.select(F.to_json(F.struct(*sorted(c for c in frame.columns if c != "visible")))).collect()), key=lambda r: r["id"])


def test_round_trip(spark, data, path):
    got = pbf.load(spark, path)
    assert got.header.bounds == (24.0, 60.0, 24.6, 60.5)
    for k in ("nodes", "ways", "relations"):
        assert rows(getattr(got, k)) == rows(getattr(data, k)), k


def test_wire_arrays():
    v = np.array([0, 1, 127, 128, 300, 2**40, -1, -(2**62)])
    assert wire.unpack_signed(wire.pack_signed(v)).tolist() == v.tolist()
    assert wire.unpack(wire.pack(np.array([0, 127, 128, 2**35]))).tolist() == [0, 127, 128, 2**35]
    assert wire.unpack(b"").tolist() == []


def _file(tmp_path, *blobs, name="hand.osm.pbf"):
    out = b""
    for kind, blob in blobs:
        head = wire.field(1, kind.encode()) + wire.field(3, len(blob))
        out += struct.pack(">I", len(head)) + head + blob
    (tmp_path / name).write_bytes(out)
    return str(tmp_path / name)


HEAD = ("OSMHeader", wire.field(1, wire.field(4, b"OsmSchema-V0.6")))


def test_plain_nodes_by_hand_with_offsets(spark, tmp_path):
    # strings "", "k", "v"; granularity 1000, lat_offset 5, lon_offset -7; one node 42 at 3, -2 in units
    block = b"\x0a\x08\x0a\x00\x0a\x01k\x0a\x01v"
    node = b"\x08\x54" + b"\x12\x01\x01" + b"\x1a\x01\x02" + b"\x40\x06" + b"\x48\x03"
    block += wire.field(2, wire.field(1, node)) + wire.field(17, 1000) + wire.field(19, 5) + wire.field(20, -7)
    for blob in (wire.field(1, block), wire.field(3, zlib.compress(block)), wire.field(4, lzma.compress(block))):
        f = _file(tmp_path, HEAD, ("Unknown", b""), ("OSMData", blob))
        r = pbf.load(spark, f).nodes.collect()
        assert len(r) == 1 and r[0].id == 42 and r[0].tags == {"k": "v"}
        assert r[0].lat == (3 * 1000 + 5) / 1e9 and r[0].lon == (-2 * 1000 - 7) / 1e9
        assert (r[0].version, r[0].timestamp, r[0].visible) == (-1, 0, False)


def test_broken_files(tmp_path):
    with pytest.raises(pbf.MapFileError):
        pbf.read_header(_file(tmp_path, ("OSMData", wire.field(1, b""))))
    with pytest.raises(pbf.UnsupportedMapFile):
        pbf.read_header(_file(tmp_path, ("OSMHeader", wire.field(1, wire.field(4, b"LocationsOnWays")))))
    for raw in (b"\0\0", struct.pack(">I", 1 << 20) + b"x", struct.pack(">I", 9) + b"abc"):
        (tmp_path / "b.osm.pbf").write_bytes(raw)
        with pytest.raises(pbf.MapFileError):
            pbf.read_header(str(tmp_path / "b.osm.pbf"))


def test_layers(spark, path):
    osm = OSM(path, spark=spark)
    b = osm.get_buildings().collect()
    assert [(r.id, r.geometry.type, r.building) for r in b] == [(10, "Polygon", "yes")]
    land = {r.id: r for r in osm.get_landuse().collect()}
    assert set(land) == {20} and land[20].geometry.type == "Polygon" and json.loads(land[20].tags)["members"][0]["member_id"] == 13
    pois = osm.get_pois().collect()
    assert [(r.id, r.osm_type, r.shop, r.lon) for r in pois] == [(2, "node", "bakery", 24.1)]
    every = osm.get_data_by_custom_criteria(None, tags_as_columns=["shop"])
    # 11, 12 and 13 are members of kept relations; 21 has no way to draw
    assert {r.id for r in every.select("id").collect()} == {2, 10, 20, 22}
    ways = osm.get_data_by_custom_criteria(None, tags_as_columns=["shop"], keep_relations=False, keep_nodes=False)
    assert {r.id for r in ways.select("id").collect()} == {10, 11, 12}
    assert OSM(path, spark=spark, compact=True).get_buildings().columns.count("building") == 1


def test_network_and_graph(spark, path):
    osm = OSM(path, spark=spark)
    net = osm.get_network("driving", nodes=True)
    assert sorted((r.u, r.v) for r in net.edges.collect()) == [(3, 5), (5, 6), (5, 6)]
    n, e = osm.to_graph(net, retain_all=True)
    assert e.count() == 2 + 2 and {r.id for r in n.collect()} == {3, 5, 6}
    n, e = osm.to_graph(net)
    assert {r.id for r in n.collect()} == {5, 6}
    n, e = osm.to_graph(net, retain_all=True, simplify=True)
    # 5 has two neighbours and four edge ends, so the walk from 3 passes it, and the one from 6 ends there
    assert sorted((r.u, r.v) for r in e.collect()) == [(3, 6), (6, 5)]
    with pytest.raises(ImportError):
        osm.to_graph(net, "igraph")
    assert osm.get_network("all").edges.count() == 2
    with pytest.raises(ValueError):
        osm.get_network("flying")
    assert osm.get_network("driving", custom_filter='["highway"="motorway"]').edges.count() == 1


def test_box_and_crop(spark, path, tmp_path):
    osm = OSM(path, bounding_box=[23.9, 59.9, 24.2, 60.2], spark=spark)
    assert {r.id for r in osm.get_network("all").edges.collect()} == {11}
    out = pbf.load(spark, osm.to_pbf(str(tmp_path / "cut.osm.pbf")))
    assert {r.id for r in out.ways.collect()} == {10, 11, 13}
    assert {r.id for r in out.nodes.collect()} == {1, 2, 3, 4, 5, 6}
    assert {r.id for r in out.relations.collect()} == {20, 21, 22}


def test_straddling_and_completion(data):
    inside = data.ways.where("id = 11")
    assert [(r.relation_id, r.n_total, r.n_present) for r in selection.straddling(data.relations, inside).collect()] == [(22, 2, 1)]
    assert [r.id for r in selection.missing_members(data.relations, inside, data.ways).collect()] == [12]


def test_closure_follows_relations(data):
    ids = data.relations.where("id = 21").select("id")
    none = ids.where("false")
    got = selection.closure(data, ids, none, none)
    assert {r.id for r in got.relations.collect()} == {20, 21}
    assert {r.id for r in got.ways.collect()} == {13} and {r.id for r in got.nodes.collect()} == {2, 3, 4}


def test_closure_follows_deep_relations(spark, data):
    """A chain of relations deeper than 100 levels."""
    chain = spark.range(1000, 1103).selectExpr("id", "array(named_struct('member_id', id + 1, 'member_type', 'relation', 'member_role', '')) AS members")
    ids = spark.createDataFrame([(1000,)], "id long")
    none = ids.where("false")
    got = selection.closure(data.at(relations=chain), ids, none, none)
    assert got.relations.count() == 103


def test_edit(spark, path, tmp_path):
    osm = OSM(path, spark=spark)
    point = lambda *p: {"type": "Point", "rings": [[{"x": x, "y": y} for x, y in p]], "part_of": [0]}
    line = {"type": "LineString", "rings": [[{"x": 1.0, "y": 1.0}, {"x": 1.1, "y": 1.0}]], "part_of": [0]}
    from mapquarry.functions.geometry import GEOMETRY

    change = spark.createDataFrame([(10, "way", "school", 2.0, True, None), (None, None, "bench", None, None, point((1.0, 1.0))), (None, None, "wall", None, None, line)], f"id long, osm_type string, kind string, levels double, open boolean, geometry {GEOMETRY}")
    out = pbf.load(spark, osm.write_pbf(change, str(tmp_path / "e.osm.pbf")))
    w = {r.id: r for r in out.ways.collect()}
    assert w[10].tags == {"kind": "school", "levels": "2", "open": "yes"} and w[11].tags == {"highway": "residential", "oneway": "yes"}
    new = [r for r in w.values() if r.id < 0]
    assert len(new) == 1 and new[0].tags == {"kind": "wall"} and len(new[0].refs) == 2
    bench = [r for r in out.nodes.collect() if r.tags == {"kind": "bench"}]
    assert len(bench) == 1 and bench[0].id == new[0].refs[0] and bench[0].id < -7
    sub = pbf.load(spark, osm.write_pbf(change.where("id = 10"), str(tmp_path / "s.osm.pbf"), subset_only=True))
    assert {r.id for r in sub.ways.collect()} == {10} and {r.id for r in sub.nodes.collect()} == {1, 2, 3, 4}
    with pytest.raises(ValueError):
        edit.apply(osm.data(), change.where("kind = 'bench'").withColumn("geometry", F.lit(None).cast(GEOMETRY)).withColumn("geometry", F.expr("named_struct('type','MultiPolygon','rings',array(array(named_struct('x',1d,'y',1d))),'part_of',array(0))")))


def test_geoparquet(spark, path, tmp_path):
    osm = OSM(path, spark=spark)
    out = geoparquet.write(osm.get_buildings(), str(tmp_path / "b"))
    r = spark.read.parquet(out).collect()
    assert r[0].geometry[:5] == b"\x01\x03\x00\x00\x00" and len(r[0].geometry) == 9 + 4 + 5 * 16
    import pyarrow.parquet as pq

    parts = [str(p) for p in (tmp_path / "b").iterdir() if p.suffix == ".parquet"]
    assert parts and not [p for p in (tmp_path / "b").iterdir() if p.suffix == ".tmp"]
    for p in parts:
        about = json.loads(pq.read_metadata(p).metadata[b"geo"])["columns"]["geometry"]
        assert about["geometry_types"] == ["Polygon"] and about["encoding"] == "WKB" and len(about["bbox"]) == 4


def test_cache(spark, path, tmp_path):
    osm = OSM(path, spark=spark, cache_directory=str(tmp_path / "c"))
    calls = []

    def make():
        calls.append(1)
        return spark.range(1)

    for _ in range(2):
        assert osm.cached("buildings", make, a=1).count() == 1
    assert len(calls) == 1 and len(osm.list_cache()) == 1
    osm.cached("buildings", make, a=2)
    assert len(calls) == 2 and len(osm.clear_cache()) == 2 and osm.list_cache() == []
    assert cache.key(path, a=1) != cache.key(path, a=2)


def test_catalog(spark):
    c = spark.createDataFrame([("eu", "europe", "", "u/eu", -10.0, 35.0, 40.0, 70.0), ("fi", "finland", "europe", "u/fi", 19.0, 59.0, 32.0, 70.5), ("ga1", "georgia", "europe", "u/ga", 40.0, 41.0, 47.0, 44.0), ("ga2", "georgia", "usa", "u/ga-us", -86.0, 30.0, -80.0, 35.0), ("na", "north_america", "", "u/na", -170.0, 5.0, -50.0, 84.0)], catalog.COLUMNS)
    assert catalog.resolve(c, "Finland ") == "u/fi" and catalog.resolve(c, "north america") == "u/na" and catalog.resolve(c, "usa/georgia") == "u/ga-us"
    for bad in ("georgia", "atlantis"):
        with pytest.raises(catalog.NotFound):
            catalog.resolve(c, bad)
    assert catalog.by_box(c, [24, 60, 25, 61]) == "u/fi" and catalog.by_box(c, [0, 40, 1, 41]) == "u/eu"
    for bad in ([30, 60, 50, 61], [170, -80, 171, -79]):
        with pytest.raises(catalog.NotFound):
            catalog.by_box(c, bad)
    assert catalog.crop_name((24.93, 60.16, 24.96, 60.18)) == "bbox_24.93_60.16_24.96_60.18.osm.pbf"


def test_places(spark, path, tmp_path):
    import shutil

    from mapquarry.sources import places

    c = spark.createDataFrame([("t", "testland", "", "http://example.com/t.osm.pbf", 20.0, 55.0, 30.0, 65.0)], catalog.COLUMNS)
    fetched = []

    def fetch(url, to):
        fetched.append(url)
        shutil.copy(path, to)

    folder = str(tmp_path / "d")
    for _ in range(2):
        assert places.get_data(c, "Testland", folder, fetch).endswith("t.osm.pbf")
    assert fetched == ["http://example.com/t.osm.pbf"] and places.downloads(folder) == ["t.osm.pbf"]
    cut = places.get_data_by_geocoding(c, "Somewhere", folder, lambda q: {"bounds": [23.9, 59.9, 24.2, 60.2]}, fetch, spark=spark)
    assert cut.endswith("bbox_23.9_59.9_24.2_60.2.osm.pbf") and pbf.load(spark, cut).ways.count() == 3
    assert places.clear_downloads(folder, "t.osm.pbf") == ["t.osm.pbf"] and len(places.clear_downloads(folder)) == 1
    with pytest.raises(NotImplementedError):
        places.geocode("x")
    with pytest.raises(NotImplementedError):
        places.get_data(c, "testland", folder)
    assert places.slug("Île, de-France!") == "le_de_france"


def test_blocks_nodes_and_names(spark, path):
    from mapquarry.sources import graphs

    b = pbf.blocks(spark, path).orderBy("seq").collect()
    assert [r.type for r in b][0] == "OSMHeader" and all(r.type == "OSMData" for r in b[1:]) and len(b) >= 4
    osm = OSM(path, spark=spark)
    assert osm.get_nodes().where("geometry.type = 'Point'").count() == 7
    net = osm.get_network("driving", nodes=True)
    n, e = graphs.renamed(net.nodes, net.edges)
    assert {"osmid", "x", "y"} <= set(n.columns) and {"osmid", "key", "u", "v"} <= set(e.columns)


def test_history_file(spark, tmp_path):
    from mapquarry.model import MapData

    t = 1_500_000_000
    nodes = spark.createDataFrame([(1, 1.0, 1.0, {"a": "1"}, 1, 1, t, True), (2, 1.1, 1.0, {}, 1, 1, t, True), (2, 1.15, 1.0, {}, 2, 1, t + 50, True), (3, 1.2, 1.0, {}, 1, 1, t + 500, True)], NODE)
    ways = spark.createDataFrame([(5, [1, 2], {"highway": "path", "name": "old"}, 1, 1, t, True), (5, [1, 2, 3], {"highway": "track"}, 2, 1, t + 600, True), (6, [1, 2], {"highway": "path"}, 1, 1, t, True), (6, [1, 2], {"highway": "path"}, 2, 1, t + 10, False)], WAY)
    header = Header(None, ("OsmSchema-V0.6", "DenseNodes", "HistoricalInformation"))
    file = writer.write(MapData(nodes, ways, spark.createDataFrame([], RELATION), header), str(tmp_path / "x.osh.pbf"))
    osm = OSM(file, spark=spark)
    assert osm.history and rows(osm._whole.nodes) == rows(nodes)
    with pytest.raises(NotImplementedError):
        osm.to_pbf(str(tmp_path / "y.osm.pbf"))
    then = {r.id: (r.highway, r.name, len(r.geometry.rings)) for r in osm.get_network("all", timestamp=t + 100).edges.collect()}
    assert then == {5: ("path", "old", 1), 6: ("path", None, 1)}  # what was deleted shows its last state
    later = {r.id: (r.highway, r.name, len(r.geometry.rings)) for r in osm.get_network("all", timestamp=t + 1000).edges.collect()}
    assert later[5] == ("track", "old", 2)
    strict = OSM(file, spark=spark, history_mode="strict")
    assert {r.id for r in strict.get_network("all", timestamp=t + 100).edges.collect()} == {5}
