"""Point and set lookups, stored-order scans and summary counts."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import is_low_value_file
from ..graph import Graph
from ..schema import any_kind


# -- nodes ------------------------------------------------------------------

def nodes_by_kind(g: Graph, kind: str) -> DataFrame:
    return g.nodes.filter(F.col("kind") == kind)


def iterate_nodes_by_kind(g: Graph, kind: str):
    """Stream nodes to the caller one partition at a time."""
    return nodes_by_kind(g, kind).toLocalIterator(prefetchPartitions=True)


def nodes_by_file(g: Graph, path: str) -> DataFrame:
    return g.nodes.filter(F.col("file_path") == path).orderBy("start_line", "id")


def nodes_by_name(g: Graph, name: str) -> DataFrame:
    return g.nodes.filter(F.col("name") == name)


def nodes_by_qualified_name(g: Graph, qualified_name: str) -> DataFrame:
    return g.nodes.filter(F.col("qualified_name") == qualified_name)


def nodes_by_lower_name(g: Graph, lowered: str) -> DataFrame:
    return g.nodes.filter(F.lower("name") == lowered)


def nodes_by_ids(g: Graph, ids: DataFrame) -> DataFrame:
    """Nodes named by an `id` column; missing ids are left out."""
    return g.nodes.join(ids.select("id").distinct(), "id", "left_semi")


def distinct_names(g: Graph) -> DataFrame:
    return g.nodes.select("name").distinct()


# -- edges ------------------------------------------------------------------

def outgoing(g: Graph, ids: DataFrame, kinds: list[str] | None = None,
             provenance: str | None = None) -> DataFrame:
    edges = g.edges.filter(any_kind("kind", kinds))
    if provenance:
        edges = edges.filter(F.col("provenance") == provenance)
    return edges.join(ids.select(F.col("id").alias("source")).distinct(), "source", "left_semi")


def incoming(g: Graph, ids: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    edges = g.edges.filter(any_kind("kind", kinds))
    return edges.join(ids.select(F.col("id").alias("target")).distinct(), "target", "left_semi")


def edges_between(g: Graph, ids: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Edges whose two ends both lie in the id set."""
    ids = ids.select("id").distinct()
    return (
        g.edges.filter(any_kind("kind", kinds))
        .join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
        .join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    )


# -- files and references ---------------------------------------------------

def files_by_path(g: Graph) -> DataFrame:
    return g.files.orderBy("path")


def file_paths(g: Graph) -> DataFrame:
    return g.files.select("path").orderBy("path")


def last_indexed_at(g: Graph) -> DataFrame:
    return g.files.agg(F.max("indexed_at").alias("last_indexed_at"))


def unresolved(g: Graph) -> DataFrame:
    return g.refs


def unresolved_batch(g: Graph, offset: int, limit: int) -> DataFrame:
    return g.refs.orderBy("file_path", "line", "col", "reference_name", "from_node_id").offset(offset).limit(limit)


def unresolved_by_files(g: Graph, paths: DataFrame) -> DataFrame:
    return g.refs.join(paths.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi")


def unresolved_by_name(g: Graph, name: str) -> DataFrame:
    return g.refs.filter(F.col("reference_name") == name)


def unresolved_count(g: Graph) -> DataFrame:
    return g.refs.agg(F.count("*").alias("refs"))


# -- summaries --------------------------------------------------------------

def counts_by(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias(name))


def totals(g: Graph) -> DataFrame:
    """One row of node and edge counts."""
    n = g.nodes.agg(F.count("*").alias("node_count"))
    return n.crossJoin(g.edges.agg(F.count("*").alias("edge_count")))  # one row on each side


def stats(g: Graph) -> DataFrame:
    """Counts in long form: (section, key, n)."""
    def part(df: DataFrame, section: str, key: str) -> DataFrame:
        return df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")).select(
            F.lit(section).alias("section"), "key", "n")

    out = part(g.nodes, "nodes_by_kind", "kind").unionByName(part(g.edges, "edges_by_kind", "kind"))
    if g.files is not None:
        out = out.unionByName(part(g.files, "files_by_language", "language"))
    return out


def in_file_edges(g: Graph) -> DataFrame:
    """Number of edges whose ends share a file, per file."""
    at = g.nodes.select("id", "file_path")
    src, dst = at.withColumnRenamed("id", "source"), at.withColumnRenamed("id", "target")
    # Edges out of one file into one target are counted before they move to it, so a hub gets few rows of a file.
    into = g.edges.select("source", "target").join(src, "source").groupBy("target", "file_path").agg(F.count("*").alias("k"))
    return into.join(dst, ["target", "file_path"]).groupBy("file_path").agg(F.sum("k").alias("edge_count"))


def dominant_file(g: Graph, floor: int = 20) -> DataFrame:
    """File with most in-file edges, low-value files left out, and the count of the next one."""
    top = in_file_edges(g).filter(~is_low_value_file("file_path")).orderBy(F.desc("edge_count"), "file_path").limit(2)
    rank = Window.orderBy(F.desc("edge_count"), "file_path")  # two rows
    kept = top.select(
        "file_path", "edge_count", F.row_number().over(rank).alias("rn"),
        F.coalesce(F.lead("edge_count").over(rank), F.lit(0)).alias("next_edge_count"))
    return kept.filter((F.col("rn") == 1) & (F.col("edge_count") >= floor)).drop("rn")


def top_route_file(g: Graph, least_share: float = 0.3) -> DataFrame:
    """File holding most routes, if it holds at least three and 30 % of all routes; low-value files left out."""
    routes = g.nodes.filter(F.col("kind") == "route").groupBy("file_path").agg(F.count("*").alias("route_count"))
    kept = routes.filter(~is_low_value_file("file_path"))
    best = kept.agg(F.min(F.struct((-F.col("route_count")).alias("n"), "file_path")).alias("b"), F.sum("route_count").alias("total_routes"))
    return best.select(F.col("b.file_path").alias("file_path"), (-F.col("b.n")).alias("route_count"), "total_routes").filter(
        (F.col("route_count") >= 3) & (F.col("route_count") >= least_share * F.col("total_routes")))


def routing_manifest(g: Graph, limit: int = 40) -> DataFrame:
    """Route-to-handler table of the first `limit` routes, low-value handlers left out."""
    r = g.nodes.filter(F.col("kind") == "route").select(
        F.col("id").alias("source"), F.col("name").alias("url"),
        F.col("file_path").alias("route_file"), F.col("start_line").alias("route_line"))
    h = g.nodes.filter(F.col("kind").isin("function", "method", "class")).select(
        F.col("id").alias("target"), F.col("name").alias("handler"),
        F.col("file_path").alias("handler_file"), F.col("start_line").alias("handler_line"),
        F.col("kind").alias("handler_kind"))
    edges = g.edges.filter(F.col("kind").isin("references", "calls")).select("source", "target")
    rows = (
        edges.join(r, "source").join(h.filter(~is_low_value_file("handler_file")), "target")
        .orderBy("route_file", "route_line", "source", "target").limit(limit)
    )
    per_file = Window.partitionBy("handler_file")  # at most `limit` rows in all
    everything = Window.partitionBy()
    rows = rows.withColumn("in_file", F.count("*").over(per_file))
    first = F.struct((-F.col("in_file")).alias("n"), F.col("route_file"), F.col("route_line"),
                     F.col("source"), F.col("target"), F.col("handler_file"))
    return rows.select(
        "url", "handler", "handler_file", "handler_line", "handler_kind",
        F.count("*").over(everything).alias("total_routes"),
        F.min(first).over(everything)["handler_file"].alias("top_handler_file"),
    ).filter(F.col("total_routes") >= 3)
