"""The graph handle: lazy DataFrames for nodes, edges, files and unresolved references."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut, union_all
from .operators.links import Links
from .schema import any_kind

def edge_priority(kind: str = "kind") -> Column:
    """Order in which a breadth-first walk prefers edges: containment, calls, the rest."""
    return F.when(F.col(kind) == "contains", 0).when(F.col(kind) == "calls", 1).otherwise(2)


@dataclass(frozen=True)
class StoredEdges:
    """Edges at rest in both layouts, each with a `key` column, and the hubs of either end: (id, slots)."""

    out: DataFrame
    into: DataFrame
    out_hubs: DataFrame
    into_hubs: DataFrame


@dataclass(frozen=True)
class Graph:
    """Directed labelled multigraph. `edges` is a bag and its endpoints exist in `nodes`.

    `stored` holds the same edges in buckets, for graphs read from a store.
    """

    nodes: DataFrame
    edges: DataFrame
    files: DataFrame | None = None
    refs: DataFrame | None = None
    stored: StoredEdges | None = None

    def adjacency(
        self,
        direction: str = "outgoing",
        kinds: list[str] | None = None,
        node_kinds: list[str] | None = None,
        exclude: list[str] | None = None,
    ) -> DataFrame:
        """Edges as (src, dst, kind, line, prio) in the direction of travel."""
        adj = union_all([_view(self.edges, *ends, kinds, exclude) for ends in _ENDS[direction]])
        if node_kinds:
            adj = adj.join(self._of_kinds(node_kinds), "dst", "left_semi")
        return adj

    def links(
        self,
        direction: str = "outgoing",
        kinds: list[str] | None = None,
        node_kinds: list[str] | None = None,
        exclude: list[str] | None = None,
    ) -> Links:
        """The same edges for a walk, which asks for those that leave a frontier."""
        if self.stored is None:
            return Links.of(self.adjacency(direction, kinds, node_kinds, exclude))
        sides = {"source": (self.stored.out, self.stored.out_hubs), "target": (self.stored.into, self.stored.into_hubs)}
        ends = _ENDS[direction]
        parts = tuple(_view(sides[src][0], src, dst, kinds, exclude, "key") for src, dst in ends)
        hubs = union_all([sides[src][1] for src, _ in ends])
        if len(ends) > 1:
            hubs = hubs.groupBy("id").agg(F.max("slots").alias("slots"))
        return Links(parts, "key", hubs, self._of_kinds(node_kinds) if node_kinds else None)

    def _of_kinds(self, node_kinds: list[str]) -> DataFrame:
        return self.nodes.filter(F.col("kind").isin(node_kinds)).select(F.col("id").alias("dst"))

    def seeds(self, condition: Column) -> DataFrame:
        return self.nodes.filter(condition).select("id")

    def materialised(self) -> "Graph":
        """Write nodes and edges once; iterative callers then scan compact tables. Nodes are dealt out evenly, since
        texts cost far more to search than to read and a scan does not split what one task has written."""
        parts = int(self.nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return replace(self, nodes=cut(self.nodes.repartition(parts, "id"), "nodes"), edges=cut(self.edges, "edges"), stored=None)


_ENDS = {
    "outgoing": [("source", "target")], "incoming": [("target", "source")],
    "both": [("source", "target"), ("target", "source")],
}


def _view(edges: DataFrame, src: str, dst: str, kinds: list[str] | None, exclude: list[str] | None, *extra: str) -> DataFrame:
    edges = edges.filter(any_kind("kind", kinds))
    if exclude:
        edges = edges.filter(~F.col("kind").isin(exclude))
    line = F.col("line") if "line" in edges.columns else F.lit(None).cast("int")
    return edges.select(*extra, F.col(src).alias("src"), F.col(dst).alias("dst"), "kind",
                        line.alias("line"), edge_priority().alias("prio"))
