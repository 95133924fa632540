"""Incremental upkeep: snapshot diffs, deletions and re-resolution scope.

Edges that point into a changed file follow their targets to the fresh nodes; `refs_to_resolve`
names the references a change touches, for those that want them resolved anew.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph
from ..lineage import cut, union_all
from .sieve import without

VERSION_KEY = "extraction_version"


def diff(stored: DataFrame, current: DataFrame, trust_stat: bool = False) -> DataFrame:
    """(path, change) with change added, removed or modified: files(path, content_hash, ...).

    With `trust_stat` a file whose size and time agree counts as unchanged without comparing
    hashes, which lets the scan skip file contents.
    """
    old = stored.select("path", F.struct(*[c for c in stored.columns if c != "path"]).alias("old"))
    new = current.select("path", F.struct(*[c for c in current.columns if c != "path"]).alias("new"))
    same = F.col("old.content_hash") == F.col("new.content_hash")
    if trust_stat:
        same = ((F.col("old.size") == F.col("new.size")) & (F.col("old.modified_at") == F.col("new.modified_at"))) | same
    change = (
        F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed")
        .when(~F.coalesce(same, F.lit(False)), "modified")
    )
    return old.join(new, "path", "full_outer").select("path", change.alias("change")).filter("change is not null")


def stat_changed(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Paths whose size or time differ; only their contents need reading and hashing."""
    old = stored.select("path", "size", "modified_at")
    return current.select("path", "size", "modified_at").join(old, ["path", "size", "modified_at"], "left_anti").select("path")


def remove_files(g: Graph, paths: DataFrame) -> Graph:
    """Graph without the given files: their nodes, every edge at those nodes, their references."""
    paths = cut(paths.select("path").distinct(), "paths")
    gone = g.nodes.join(paths.withColumnRenamed("path", "file_path"), "file_path", "left_semi").select("id")
    gone = cut(gone, "gone")  # used at both edge ends and for the references
    nodes = g.nodes.join(paths.withColumnRenamed("path", "file_path"), "file_path", "left_anti")
    edges = without(g.edges, gone, "source", "target")
    files = g.files.join(paths, "path", "left_anti") if g.files is not None else None
    refs = without(g.refs, gone, "from_node_id") if g.refs is not None else None
    return Graph(nodes, edges, files, refs)


def inbound_edges(g: Graph, paths: DataFrame, fresh: DataFrame) -> DataFrame:
    """Edges from other files into changed ones, led to the fresh nodes that take their targets' place.

    A target is known again by file, kind and qualified name, since ids change with the line; of
    several the one nearest in line is meant, then the smallest id. Targets that are gone lose their edges.
    """
    paths = paths.select(F.col("path").alias("file_path")).distinct()
    place = ["file_path", "kind", "qualified_name"]
    old = cut(g.nodes.join(paths, "file_path", "left_semi").select("id", *place, "start_line"), "changed")
    new = fresh.select(*place, F.col("id").alias("new_id"), F.col("start_line").alias("new_line"))
    apart = F.struct(F.abs(F.col("start_line") - F.col("new_line")), "new_id")
    moved = old.join(new, place).groupBy("id").agg(F.min_by("new_id", apart).alias("new_id"))
    inward = g.edges.join(old.select(F.col("id").alias("source")), "source", "left_anti")
    return inward.join(moved.withColumnRenamed("id", "target"), "target").withColumn("target", F.col("new_id")).select(*g.edges.columns)


def upsert(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Rows of `fresh` replace stored rows of the same key; of equal fresh keys the latest stays.

    A row without a time is older than any with one; other ties go by the values of the row.
    """
    kept = stored.join(fresh.select(key).distinct(), key, "left_anti")
    time = ["updated_at"] if "updated_at" in fresh.columns else []
    values = [f.name for f in fresh.schema if f.name not in (key, *time) and f.dataType.typeName() != "map"]
    latest = Window.partitionBy(key).orderBy(*[F.desc_nulls_last(c) for c in time + values])
    last = fresh.withColumn("_rn", F.row_number().over(latest)).filter("_rn = 1")
    return kept.select(*stored.columns).unionByName(last.select(*stored.columns))


def with_valid_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends exist; the others are dropped on insert."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(
        ids.withColumnRenamed("id", "target"), "target", "left_semi").select(*edges.columns)


def delete_refs(refs: DataFrame, keys: DataFrame) -> DataFrame:
    return refs.join(keys.select("from_node_id", "reference_name", "reference_kind").distinct(),
                     ["from_node_id", "reference_name", "reference_kind"], "left_anti")


def refs_to_resolve(refs: DataFrame, old_nodes: DataFrame, new_nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """References in changed files, and those anywhere that use a name a change touched."""
    changed = changed.select(F.col("path").alias("file_path")).distinct()
    inside = refs.join(changed, "file_path", "left_semi")
    touched = union_all([n.join(changed, "file_path", "left_semi").select("name") for n in (old_nodes, new_nodes)]).distinct()
    last = F.element_at(F.split("reference_name", r"::|[./]"), -1)
    outside = refs.join(changed, "file_path", "left_anti").withColumn("name", last).join(touched, "name", "left_semi")
    return inside.unionByName(outside.select(*inside.columns))


def pending_after(events: DataFrame, started: DataFrame) -> DataFrame:
    """Paths still pending once a sync is over: events(path, ts), started(ts) with one row.

    A sync clears only events up to its start, later ones survive.
    """
    latest = events.groupBy("path").agg(F.max("ts").alias("ts"))
    return latest.join(F.broadcast(started.agg(F.max("ts").alias("started"))), F.col("ts") > F.col("started")).select("path", "ts")


def stale_results(results: DataFrame, pending: DataFrame) -> DataFrame:
    """Result files that wait for a sync."""
    return results.select("file_path").distinct().join(
        pending.select(F.col("path").alias("file_path")), "file_path", "left_semi")


def is_stale(metadata: DataFrame, version: str) -> bool:
    """True when the stored graph was extracted by another version."""
    row = metadata.filter(F.col("key") == VERSION_KEY).select("value").first()
    return row is None or row["value"] != version
