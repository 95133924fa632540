"""Storing a graph: tables laid out for lookups by key, with upserts."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph, StoredEdges
from ..lineage import cut
from ..operators import links, sync
from ..schema import EDGES, EXTRACTION_VERSION, FILES, METADATA, NODES, REFS, as_edges, as_nodes, as_refs, conform

_LEAST_BUCKETS = 8
_LAYOUTS = [("edges_out", "source", "target"), ("edges_in", "target", "source")]


class GraphStore:
    """Versioned folders of Parquet: nodes by kind, edges by kind in both directions.

    Edges are stored twice, in buckets of the source and of the target and sorted within, so that a walk joins
    them without moving them and a lookup from either end reads few buckets and row groups; the kind folder
    prunes whole partitions. An end with more than `hub_edges` edges is spread over several buckets, and there
    are as many buckets as hold `bucket_edges` each. A write makes a new version folder and then moves the
    pointer, so readers never see half a graph.
    """

    def __init__(self, spark: SparkSession, root: str, bucket_edges: int = 4_000_000, hub_edges: int = 1_000_000):
        self.spark, self.root = spark, root.rstrip("/")
        self.bucket_edges, self.hub_edges = bucket_edges, hub_edges

    def _path(self, version: str, name: str) -> str:
        return f"{self.root}/{version}/{name}"

    def version(self) -> str | None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/versions")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        row = self.spark.read.schema("version string, at timestamp").json(f"{self.root}/versions").orderBy(F.desc("at")).first()
        return row["version"] if row else None

    def write(self, g: Graph, metadata: DataFrame | None = None) -> str:
        version = uuid.uuid4().hex
        # Range partitioning cuts by (kind, key), so one frequent kind or hub spreads over many files.
        nodes = as_nodes(g.nodes)
        nodes.repartitionByRange("kind", "id").sortWithinPartitions("kind", "name").write.partitionBy("kind").parquet(
            self._path(version, "nodes"))
        edges = cut(as_edges(g.edges), "edges")
        count = edges.count()
        buckets = max(_LEAST_BUCKETS, -(-count // self.bucket_edges))
        for name, key, other in _LAYOUTS:
            hubs = cut(links.hub_slots(edges, key, self.hub_edges, count), "hubs")
            hubs.coalesce(1).write.parquet(self._path(version, f"{name}_hubs"))
            rows = links.dealt(edges, key, other, hubs, buckets)
            rows.write.partitionBy("kind").bucketBy(buckets, "key").sortBy("key").format("parquet").option(
                "path", self._path(version, name)).saveAsTable(self._table(version, name))
        self.spark.range(1).select(F.lit(buckets).alias("buckets")).write.json(self._path(version, "layout"))
        empty = self.spark.createDataFrame([], FILES)
        (g.files if g.files is not None else empty).write.parquet(self._path(version, "files"))
        refs = g.refs if g.refs is not None else self.spark.createDataFrame([], REFS)
        as_refs(refs).write.parquet(self._path(version, "refs"))
        meta = metadata if metadata is not None else self.spark.createDataFrame([], METADATA)
        written = self.spark.sql(f"select '{sync.VERSION_KEY}' as key, '{EXTRACTION_VERSION}' as value, unix_millis(current_timestamp()) as updated_at")
        sync.upsert(meta, conform(written, METADATA), "key").write.parquet(self._path(version, "metadata"))
        self.spark.sql("select current_timestamp() as at").selectExpr(f"'{version}' as version", "at").write.mode(
            "append").json(f"{self.root}/versions")
        return version

    def _read(self, version: str, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self._path(version, name))

    def _table(self, version: str, name: str) -> str:
        """Catalog name of a bucketed table; the same folder of another store has another name."""
        return f"strandgraph_{version}_{name}"

    def _bucketed(self, version: str, name: str) -> DataFrame:
        """A layout of the edges with its buckets, made known to this session's catalog if need be."""
        known = self._table(version, name)
        if not self.spark.catalog.tableExists(known):
            buckets = self.spark.read.schema("buckets int").json(self._path(version, "layout")).first()["buckets"]
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in EDGES.fields if f.name != "kind")
            self.spark.sql(f"create table if not exists {known} (key string, {columns}, kind string) using parquet "
                           f"partitioned by (kind) clustered by (key) sorted by (key) into {buckets} buckets "
                           f"location '{self._path(version, name)}'")
            self.spark.catalog.recoverPartitions(known)
        return self.spark.table(known)

    def read(self, version: str | None = None) -> Graph:
        version = version or self.version()
        sides = [self._bucketed(version, name) for name, _, _ in _LAYOUTS]
        hubs = [self._read(version, f"{name}_hubs", "id string, slots int") for name, _, _ in _LAYOUTS]
        return Graph(self._read(version, "nodes", NODES), sides[0].select(EDGES.names),
                     self._read(version, "files", FILES), self._read(version, "refs", REFS), StoredEdges(*sides, *hubs))

    def incoming(self, version: str | None = None) -> DataFrame:
        """Edges in the layout that serves lookups by target."""
        return self._bucketed(version or self.version(), "edges_in").select(EDGES.names)

    def metadata(self, version: str | None = None) -> DataFrame:
        stored = self._read(version or self.version(), "metadata", METADATA)
        last = F.max_by(F.struct("value", "updated_at"), "updated_at").alias("m")
        return conform(stored.groupBy("key").agg(last).select("key", "m.*"), METADATA)

    def set_metadata(self, key: str, value: str) -> None:
        """Stores one entry for the present version; the latest entry of a key counts."""
        row = self.spark.sql("select unix_millis(current_timestamp()) as updated_at").select(
            F.lit(key).alias("key"), F.lit(value).alias("value"), "updated_at")
        conform(row, METADATA).write.mode("append").parquet(self._path(self.version(), "metadata"))

    def replace_files(self, fresh: Graph, paths: DataFrame) -> str:
        """Drop the given files, add what was extracted anew, write the next version. Edges from
        other files into the given ones are kept where their targets live on."""
        stored, added = self.read(), as_nodes(fresh.nodes)
        kept = sync.remove_files(stored, paths)
        nodes = sync.upsert(kept.nodes, added, "id")
        edges = kept.edges.unionByName(sync.inbound_edges(stored, paths, added)).unionByName(
            sync.with_valid_ends(as_edges(fresh.edges), nodes))
        files = kept.files.unionByName(fresh.files) if fresh.files is not None else kept.files
        refs = kept.refs.unionByName(as_refs(fresh.refs)) if fresh.refs is not None else kept.refs
        return self.write(Graph(nodes, edges, files, refs), self.metadata())
