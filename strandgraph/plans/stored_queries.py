"""Registered queries over graphs in storage: walks of edges at rest, edges kept up to date by changes."""

import uuid

from pyspark.sql import functions as F

from ..graph import Graph
from ..lineage import checkpoint_root, cut, unsent
from ..operators import derive, resolve, traversal
from ..schema import as_edges, as_nodes
from ..sources.supports import SupportLog
from ..sources.tables import GraphStore
from . import graph_queries
from . import resolve_queries as R
from . import views as V
from .projections import flow, part_nodes, star

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return add


def _folder(spark, name: str) -> str:
    return f"{checkpoint_root(spark)}/strandgraph/{name}-{uuid.uuid4().hex}"


def _at_rest(g: Graph) -> Graph:
    """The graph as a store gives it back."""
    store = GraphStore(g.nodes.sparkSession, _folder(g.nodes.sparkSession, "store"), hub_edges=100_000)
    store.write(g)
    return store.read()


# -- walks of a stored graph --------------------------------------------------------

@query("stored_callers_d3", graph_queries.ORACLES["callers_d3"])
def _(spark, sf):
    g = _at_rest(flow(spark, sf))
    return traversal.callers_within(g, g.seeds(F.col("qualified_name") == "Brand#12::cold widget"), 3).select("id", "depth")


@query("stored_bfs_both", graph_queries.ORACLES["bfs_both"])
def _(spark, sf):
    g = _at_rest(star(spark, sf))
    return traversal.bfs(g, g.seeds(F.col("name") == "NATION_3"), "both", max_depth=3).select("id", "depth")


@query("stored_impact_d3", graph_queries.ORACLES["impact_d3"])
def _(spark, sf):
    g = _at_rest(star(spark, sf))
    return traversal.impact(g, g.seeds(F.col("name") == "NATION_7"), 3)


# -- edges after a change --------------------------------------------------------------
# Parts are defined in one file per brand and type and call the parts that follow them in an order by name.
# One file changes: a third of its parts goes, a third is renamed.

_FILE = "catalog/Brand#12/Medium.java"


def _states(spark, sf) -> tuple[Graph, Graph]:
    nodes = cut(part_nodes(spark, sf), "parts")
    refs = R.flow_refs(Graph(nodes, flow(spark, sf).edges))
    key = F.substring_index("id", ":", -1).cast("long") % 3
    inside = F.col("file_path") == _FILE
    later = nodes.filter(~inside | (key != 0)).withColumn(
        "name", F.when(inside & (key == 1), F.concat(F.lit("new "), "name")).otherwise(F.col("name")))
    return tuple(_with_files(n, refs) for n in (nodes, cut(later, "parts")))


def _with_files(nodes, refs) -> Graph:
    files = nodes.selectExpr("concat('file:', file_path) as id", "'file' as kind", "substring_index(file_path, '/', -1) as name",
                             "file_path", "language").distinct()
    contains = nodes.selectExpr("concat('file:', file_path) as source", "id as target", "'contains' as kind", "start_line as line")
    kept = refs.join(unsent(nodes.select(F.col("id").alias("from_node_id"))), "from_node_id", "left_semi").select(*refs.columns)
    return Graph(as_nodes(nodes.unionByName(as_nodes(files))), as_edges(contains), None, resolve.with_ref_id(cut(kept.drop("ref_id"), "refs")))


def _exact(g: Graph, refs):
    return resolve.exact_name(g.nodes, refs, resolve.EDGE_OF)


def _synced(spark, sf) -> SupportLog:
    old, new = _states(spark, sf)
    log = SupportLog(spark, _folder(spark, "supports"))
    log.create(derive.supports(old, old.refs, _exact).unionByName(derive.structure(old)))
    log.append(derive.change(old, new, spark.createDataFrame([(_FILE,)], "path string"), _exact), 1)
    return log


def _derived_sql(state: str, where: str, name: str) -> str:
    """Supports of all edges of one state, each reference resolved against all definitions of that state."""
    exact = R._exact_sql().replace("JOIN nodes c", f"JOIN defs_{state} c").replace("FROM refs r", f"FROM refs_{state} r")
    for cte in ("scored", "best", "exact"):
        exact = exact.replace(f"{cte} AS (", f"{cte}_{state} AS (").replace(f"FROM {cte}\n", f"FROM {cte}_{state}\n").replace(
            f"FROM {cte} ", f"FROM {cte}_{state} ").replace(f"FROM {cte})", f"FROM {cte}_{state})")
    return f"""
  defs_{state} AS MATERIALIZED (SELECT * REPLACE ({name} AS name) FROM nodes WHERE {where}),
  refs_{state} AS MATERIALIZED (SELECT r.* FROM refs r JOIN defs_{state} d ON d.id = r.from_node_id), {exact},
  state_{state} AS (
    SELECT from_node_id AS source, target, 'calls' AS kind, line, count(*) AS n FROM exact_{state} GROUP BY ALL
    UNION ALL SELECT 'file:'||file_path, id, 'contains', start_line, count(*) FROM defs_{state} GROUP BY ALL)"""


_KEY = "string_split(id, ':')[2]::BIGINT % 3"
_OLD = _derived_sql("old", "TRUE", "name")
_NEW = _derived_sql("new", f"file_path <> '{_FILE}' OR {_KEY} <> 0",
                    f"CASE WHEN file_path = '{_FILE}' AND {_KEY} = 1 THEN 'new '||name ELSE name END")


@query("sync_edges", V.flow("SELECT source, target, kind, line, n FROM state_new", R._refs_sql(), _NEW))
def _(spark, sf):
    return _synced(spark, sf).supports()


@query("sync_rows_written", V.flow("""
  SELECT source, target, kind, line, sum(n)::BIGINT AS n FROM (
    SELECT * FROM state_new UNION ALL SELECT source, target, kind, line, -n FROM state_old)
  GROUP BY ALL HAVING sum(n) <> 0""", R._refs_sql(), _OLD, _NEW))
def _(spark, sf):
    return _synced(spark, sf).part(1)
