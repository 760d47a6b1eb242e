"""One object for one map file: layers, networks, graphs, crops and edits."""

from __future__ import annotations

import warnings
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import validate
from .functions import geometry as G
from .functions import presets
from .functions.tag_sets import BASIC, COLUMNS
from .model import MapData
from .operators import edit, features, history, network, selection, tag_filter
from .operators import simplify as simplification
from .plans import cache, storage
from .sources import geoparquet, pbf, writer


class OSM:
    """Takes a MapData, or a file that is decoded once, at its first use, into Parquet (in cache_directory if given, else in the shared folder).

    Layers and networks of a file are kept in cache_directory, if given. bounding_box: four bounds or a
    polygon (see selection.normal_box). With keep_metadata=False metadata isn't decoded. engine and workers are accepted for compatibility: Spark schedules the work. Empty results are
    empty tables. compact=True leaves out tag columns that no row has, at the cost of a pass.
    anywhere=True keeps places of a file that are off the globe (a MapData tells that by itself).
    """

    def __init__(self, source: str | MapData, bounding_box=None, keep_metadata: bool = True, complete_relations: bool = False, engine: str = "in_memory", workers=None, cache_directory: str | None = None, spark: SparkSession | None = None, compact: bool = False, history_mode: str = "last", anywhere: bool = False):
        validate.choice("engine", engine, ("in_memory", "out_of_core"))
        self.spark = spark or SparkSession.getActiveSession()
        self.path = None if isinstance(source, MapData) else validate.map_file(source)
        self.box = selection.normal_box(bounding_box) if bounding_box is not None else None
        self.keep_metadata = validate.flag("keep_metadata", keep_metadata)
        self.complete_relations = validate.flag("complete_relations", complete_relations)
        self.anywhere = validate.flag("anywhere", anywhere)
        self.compact, self.cache_directory = validate.flag("compact", compact), cache_directory
        self.strict = validate.choice("history_mode", history_mode, ("last", "strict")) == "strict"
        self.history = self.path is not None and history.is_history(self.path)
        self._given = source if isinstance(source, MapData) else None
        self._now: tuple[int, MapData] | None = None
        self._cut: int | None = None

    @property
    def _whole(self) -> MapData:
        if self._given is None:
            metadata = self.keep_metadata or self.history
            if self.cache_directory:
                folder = f"{self.cache_directory.rstrip('/')}/{cache.key(self.path, name='parsed', metadata=metadata)}"
            else:
                folder = f"{storage.checkpoint_dir(self.spark)}/map-{uuid4().hex}"
            self._given = pbf.ingest(self.spark, self.path, folder, metadata).at(anywhere=self.anywhere)
        return self._given

    @property
    def header(self):
        return self._whole.header if self._given else pbf.read_header(self.path)

    def data(self, timestamp=None) -> MapData:
        """The extract, for a history file as it was at the timestamp (kept until another one is asked for)."""
        if not self.history:
            return self._whole
        seconds = history.moment(timestamp)
        if self._now is None or self._now[0] != seconds:
            w = self._whole
            kept = w.at(nodes=history.as_of(w.nodes, seconds, strict=self.strict), ways=history.as_of(w.ways, seconds, strict=self.strict, fold_tags=True), relations=history.as_of(w.relations, seconds, strict=self.strict))
            if self._now:
                for f in (self._now[1].nodes, self._now[1].ways, self._now[1].relations):
                    f.unpersist()
            self._now = (seconds, kept.persist())
        return self._now[1]

    def _columns(self, default: list[str], tags_to_keep, extra_attributes, custom=None) -> list[str]:
        out = validate.keys("tags_to_keep", tags_to_keep) or list(default)
        out += [k for k in (validate.keys("extra_attributes", extra_attributes) or []) + tag_filter.filter_keys(custom) if k not in out]
        return out

    def _layer(self, custom, columns: list[str], timestamp, **kinds) -> DataFrame:
        layer = features.Layer(custom, columns, metadata=self.keep_metadata or self.history, compact=self.compact, **kinds)
        if layer.relations and not self.complete_relations:
            straddling_warning(self, timestamp)
        data = self.data(timestamp)
        return self.cached("layer", lambda: features.features(data, layer, self.box, self.complete_relations), layer=repr(layer), complete=self.complete_relations, anywhere=data.anywhere, moment=self._now and self._now[0])

    def _keyed(self, key: str, custom_filter, tags_to_keep, extra_attributes, timestamp, default=None, **kinds) -> DataFrame:
        custom = tag_filter.compiled(custom_filter)
        custom = tag_filter.with_key(custom, key) if custom is not None else (default or {key: [True]})
        return self._layer(custom, self._columns(COLUMNS[key], tags_to_keep, extra_attributes), timestamp, **kinds)

    def get_buildings(self, custom_filter=None, extra_attributes=None, timestamp=None, tags_to_keep=None) -> DataFrame:
        return self._keyed("building", custom_filter, tags_to_keep, extra_attributes, timestamp, nodes=False)

    def get_landuse(self, custom_filter=None, extra_attributes=None, timestamp=None, tags_to_keep=None) -> DataFrame:
        return self._keyed("landuse", custom_filter, tags_to_keep, extra_attributes, timestamp)

    def get_natural(self, custom_filter=None, extra_attributes=None, timestamp=None, tags_to_keep=None) -> DataFrame:
        return self._keyed("natural", custom_filter, tags_to_keep, extra_attributes, timestamp)

    def get_boundaries(self, boundary_type: str = "administrative", name: str | None = None, custom_filter=None, extra_attributes=None, timestamp=None, tags_to_keep=None) -> DataFrame:
        """boundary_type counts only without a custom filter. name is a pattern for the name tag."""
        kind = validate.boundary(boundary_type)
        default = {"boundary": [True] if kind == "all" else [kind]}
        out = self._keyed("boundary", custom_filter, tags_to_keep, extra_attributes, timestamp, default, nodes=False)
        if validate.pattern("name", name) is None:
            return out
        if "name" not in out.columns:
            raise ValueError("there is no name column to search")
        return out.where(F.col("name").rlike(name))

    def get_pois(self, custom_filter=None, extra_attributes=None, timestamp=None, tags_to_keep=None) -> DataFrame:
        custom = tag_filter.compiled(custom_filter) if custom_filter is not None else {k: [True] for k in ("amenity", "shop", "tourism")}
        union = list(dict.fromkeys(c for k in tag_filter.filter_keys(custom) for c in COLUMNS.get(k, BASIC)))
        return self._layer(custom, self._columns(union, tags_to_keep, extra_attributes), timestamp)

    def get_data_by_custom_criteria(self, custom_filter, osm_keys_to_keep=None, filter_type: str = "keep", tags_as_columns=None, keep_nodes: bool = True, keep_ways: bool = True, keep_relations: bool = True, extra_attributes=None, timestamp=None, keep_other_tags: bool = True) -> DataFrame:
        """Any elements. Without a filter every tagged one; osm_keys_to_keep replaces the filter's gate keys."""
        custom = tag_filter.compiled(custom_filter)
        for n, v in (("keep_nodes", keep_nodes), ("keep_ways", keep_ways), ("keep_relations", keep_relations), ("keep_other_tags", keep_other_tags)):
            validate.flag(n, v)
        if not (keep_nodes or keep_ways or keep_relations):
            raise ValueError("nothing is kept: one of keep_nodes, keep_ways and keep_relations should be True")
        known = COLUMNS if custom is None else [k for k in tag_filter.filter_keys(custom) if k in COLUMNS]
        default = list(dict.fromkeys(c for k in known for c in COLUMNS[k])) or tag_filter.filter_keys(custom)
        columns = self._columns(default, tags_as_columns, extra_attributes)
        return self._layer(custom, columns, timestamp, gate=validate.keys("osm_keys_to_keep", osm_keys_to_keep), filter_type=validate.choice("filter_type", filter_type, ("keep", "exclude")), nodes=keep_nodes, ways=keep_ways, relations=keep_relations, other_tags=keep_other_tags)

    def get_nodes(self, timestamp=None) -> DataFrame:
        """All nodes as points."""
        nodes = self.data(timestamp).nodes
        return nodes.withColumn("geometry", G.point(F.col("lon"), F.col("lat")))

    def get_network(self, network_type: str = "walking", extra_attributes=None, nodes: bool = False, timestamp=None, custom_filter=None, filter_type: str | None = None, tags_to_keep=None) -> network.Network:
        """Edges by way, or with nodes by segment and with the nodes of their ends. Presets exclude; advanced filters keep by default."""
        kind = network_type.lower() if isinstance(network_type, str) else ""
        custom, gate = presets.preset(kind), ["highway"]
        how = "exclude"
        if custom_filter is not None:
            custom = tag_filter.compiled(custom_filter)
            advanced = isinstance(custom, tag_filter.Dnf)
            how = validate.choice("filter_type", filter_type, ("keep", "exclude")) if filter_type is not None else "keep" if advanced else "exclude"
            gate = custom.gate() if advanced else gate
        columns = self._columns(COLUMNS["highway"], tags_to_keep, extra_attributes, custom if custom_filter is not None else None)
        data = self.data(timestamp)
        ways = network.select_ways(data.ways, custom, gate, how)
        made = network.network(ways, data.nodes, kind, columns, self.box, validate.flag("nodes", nodes), self.keep_metadata or self.history, self.compact, data.anywhere)
        about = {"network": kind, "filter": repr((custom, gate, how)), "columns": columns, "by_segment": nodes, "metadata": self.keep_metadata, "compact": self.compact, "anywhere": data.anywhere, "moment": self._now and self._now[0]}
        edges = self.cached("edges", lambda: made.edges, **about)
        return made.at(edges=edges, nodes=self.cached("nodes", lambda: made.nodes, **about) if nodes else None)

    def to_graph(self, net: network.Network, graph_type: str = "frames", direction: str = "oneway", retain_all: bool = False, force_bidirectional: bool = False, simplify: bool = False, simplify_kwargs: dict | None = None):
        """Directed (nodes, edges) as tables, or an object of a graph library if that is installed."""
        if net.nodes is None:
            raise ValueError("a graph needs a network read with nodes=True")
        edges, points = network.directed_edges(net, direction, force_bidirectional), net.nodes
        if simplify:
            numbered = edges.withColumn("row_id", F.col("id") * (1 << 24) + F.col("seq") * 2 + F.col("reversed").cast("long"))
            edges, points = simplification.simplify(numbered, points, **(simplify_kwargs or {}))
        if not retain_all:
            points, edges = network.largest_strong_part(edges, points)
        if graph_type == "frames":
            return points, edges
        from .sources import graphs

        return graphs.export(graph_type, points, edges, net.type)

    def to_pbf(self, output_path: str, keep_relations: bool = True, workers=None, compact: bool = True, repack: bool = True) -> str:
        """Write the part in the box: its nodes, whole ways with their nodes, and relations that hold any of them."""
        if self.history:
            raise pbf.UnsupportedMapFile("a history file cannot be cropped")
        if self.box is None:
            raise ValueError("cropping needs a bounding box")
        from dataclasses import replace

        cut = selection.crop(self._whole, self.box, validate.flag("keep_relations", keep_relations))
        return writer.write(cut.at(header=replace(self.header, bounds=selection.bounds_of(self.box))), validate.map_file(output_path))

    def write_pbf(self, data: DataFrame | list[DataFrame], output_path: str, subset_only: bool = False) -> str:
        """Write the file with the tags of a feature table (or several) laid over it and its new rows added; later rows win."""
        from dataclasses import replace

        if self.history:
            raise pbf.UnsupportedMapFile("a history file cannot be edited")
        frames = [data] if isinstance(data, DataFrame) else list(data)
        if not frames:
            raise ValueError("there is no table to write")
        whole = frames[0]
        for f in frames[1:]:
            whole = whole.unionByName(f, allowMissingColumns=True)
        out = edit.apply(self._whole, whole, validate.flag("subset_only", subset_only))
        r = selection.bounds(out.nodes).first()
        box = tuple(r) if r and r[0] is not None else None
        return writer.write(out.at(header=replace(self.header, bounds=box)), validate.map_file(output_path))

    def to_geoparquet(self, frame: DataFrame, folder: str) -> str:
        return geoparquet.write(frame, folder)

    def cached(self, name: str, make, **parameters) -> DataFrame:
        """make() kept in cache_directory under the file's state, box and parameters."""
        if not self.cache_directory or not self.path:
            return make()
        key = cache.key(self.path, name=name, box=self.box, **parameters)
        return cache.materialize(self.spark, self.cache_directory, key, make)

    def list_cache(self) -> list[str]:
        return cache.kept(self.cache_directory) if self.cache_directory else []

    def clear_cache(self, all_files: bool = False) -> list[str]:
        return cache.clear(self.cache_directory, None if all_files else self.path) if self.cache_directory else []


def straddling_warning(osm: OSM, timestamp=None) -> int:
    """How many relations the box cuts (counted once for each object); warns if any are."""
    if osm.box is None:
        return 0
    if osm._cut is None:
        data = osm.data(timestamp)
        ways = selection.ways_touching(data.ways, data.nodes.where(selection.in_box(osm.box)))
        osm._cut = selection.straddling(data.relations, ways).count()
    if osm._cut:
        warnings.warn(f"{osm._cut} relations reach over the box and are incomplete; complete_relations=True reads them whole", UserWarning, stacklevel=2)
    return osm._cut
