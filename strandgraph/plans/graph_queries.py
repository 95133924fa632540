"""Registered graph queries and their oracle SQL."""

from pyspark.sql import functions as F

from ..operators import rank, scans, structure, traversal
from ..schema import CALLER_KINDS
from .projections import flow, heirs, star, table
from . import views as V

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return add


def _in(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


CALLERS = _in(CALLER_KINDS)
NODE = ["id", "kind", "name"]


# -- scans and counts ---------------------------------------------------------

@query("stats_by_kind", V.star("SELECT kind, count(*) AS n FROM nodes GROUP BY kind"))
def _(spark, sf):
    return scans.counts_by(star(spark, sf).nodes, "kind")


@query("stats_by_edge", V.star("SELECT kind, count(*) AS n FROM edges GROUP BY kind"))
def _(spark, sf):
    return scans.counts_by(star(spark, sf).edges, "kind")


@query("stats_totals", V.star(
    "SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count"))
def _(spark, sf):
    return scans.totals(star(spark, sf))


@query("files_by_language", V.star(
    "SELECT language, count(DISTINCT file_path) AS n FROM nodes GROUP BY language"))
def _(spark, sf):
    files = star(spark, sf).nodes.select(F.col("file_path").alias("path"), "language").distinct()
    return scans.counts_by(files, "language")


@query("node_lookup", V.star("""
  SELECT id, kind, name, file_path FROM nodes
  WHERE id IN (SELECT 'order:'||o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')"""))
def _(spark, sf):
    ids = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(
        F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("id"))
    return scans.nodes_by_ids(star(spark, sf), ids).select("id", "kind", "name", "file_path")


@query("nodes_by_kind", V.star("SELECT id, kind, name FROM nodes WHERE kind = 'interface'"))
def _(spark, sf):
    return scans.nodes_by_kind(star(spark, sf), "interface").select(*NODE)


@query("nodes_by_file", V.star(
    "SELECT id, kind, name, start_line FROM nodes WHERE file_path = 'geo/r3/n3.py'"))
def _(spark, sf):
    return scans.nodes_by_file(star(spark, sf), "geo/r3/n3.py").select(*NODE, "start_line")


@query("nodes_by_name", V.star("SELECT id, kind, name FROM nodes WHERE name = 'cold widget'"))
def _(spark, sf):
    return scans.nodes_by_name(star(spark, sf), "cold widget").select(*NODE)


@query("nodes_by_qualified_name", V.star(
    "SELECT id, kind, name FROM nodes WHERE qualified_name = 'Brand#12::cold widget'"))
def _(spark, sf):
    return scans.nodes_by_qualified_name(star(spark, sf), "Brand#12::cold widget").select(*NODE)


@query("nodes_by_lower_name", V.star("SELECT id, kind, name FROM nodes WHERE lower(name) = 'nation_7'"))
def _(spark, sf):
    return scans.nodes_by_lower_name(star(spark, sf), "nation_7").select(*NODE)


@query("distinct_names", V.star("SELECT DISTINCT name FROM nodes"))
def _(spark, sf):
    return scans.distinct_names(star(spark, sf))


@query("outgoing", V.star("""
  SELECT source, target, kind, line FROM edges
  WHERE source IN (SELECT id FROM nodes WHERE kind = 'interface' AND is_exported)"""))
def _(spark, sf):
    g = star(spark, sf)
    return scans.outgoing(g, g.seeds(F.expr("kind = 'interface' and is_exported"))).select(
        "source", "target", "kind", "line")


@query("incoming", V.star("""
  SELECT source, target, kind, line FROM edges
  WHERE kind = 'calls' AND target IN (SELECT id FROM nodes WHERE name = 'cold widget')"""))
def _(spark, sf):
    g = star(spark, sf)
    return scans.incoming(g, g.seeds(F.col("name") == "cold widget"), ["calls"]).select(
        "source", "target", "kind", "line")


@query("edges_between", V.star("""
  SELECT e.source, e.target, e.kind, e.line FROM edges e
  WHERE e.source IN (SELECT id FROM nodes WHERE is_exported)
    AND e.target IN (SELECT id FROM nodes WHERE is_exported)"""))
def _(spark, sf):
    g = star(spark, sf)
    return scans.edges_between(g, g.seeds(F.col("is_exported"))).select("source", "target", "kind", "line")


# -- one hop ------------------------------------------------------------------

@query("callers_d1", V.star(f"""
  SELECT target AS id, source AS caller, kind, line FROM edges
  WHERE kind IN ({CALLERS}) AND source <> target"""))
def _(spark, sf):
    return traversal.callers(star(spark, sf))


@query("callees_d1", V.star(f"""
  SELECT source AS id, target AS callee, kind, line FROM edges
  WHERE kind IN ({CALLERS}) AND source <> target"""))
def _(spark, sf):
    return traversal.callees(star(spark, sf))


@query("usages", V.star("""
  SELECT e.target AS id, e.source AS "user", n.name AS user_name, n.kind AS user_kind, e.kind, e.line
  FROM edges e JOIN nodes n ON e.source = n.id
  WHERE e.target IN (SELECT id FROM nodes WHERE kind = 'interface')"""))
def _(spark, sf):
    g = star(spark, sf)
    return traversal.usages(g, g.seeds(F.col("kind") == "interface"))


@query("children", V.star("SELECT source AS id, target AS child FROM edges WHERE kind = 'contains'"))
def _(spark, sf):
    return traversal.children(star(spark, sf))


@query("outline", V.star("""
  SELECT e.source AS id, e.target AS child, n.kind, n.name, n.start_line
  FROM edges e JOIN nodes n ON e.target = n.id
  WHERE e.kind = 'contains' AND e.source IN (SELECT id FROM nodes WHERE kind = 'module')"""))
def _(spark, sf):
    g = star(spark, sf)
    return structure.outline(g, g.seeds(F.col("kind") == "module")).drop("signature")


@query("trail", V.star(f"""
  SELECT side, id, other, line, rank FROM (
    SELECT side, id, other, line, row_number() OVER (PARTITION BY side, id ORDER BY line, other) AS rank
    FROM (SELECT side, id, other, min(line) AS line FROM (
            SELECT 'caller' AS side, target AS id, source AS other, line FROM edges
            WHERE kind IN ({CALLERS}) AND source <> target
            UNION ALL
            SELECT 'callee', source, target, line FROM edges
            WHERE kind IN ({CALLERS}) AND source <> target)
          WHERE id IN (SELECT id FROM nodes WHERE kind = 'function')
          GROUP BY side, id, other))
  WHERE rank <= 5"""))
def _(spark, sf):
    g = star(spark, sf)
    return traversal.trail(g, g.seeds(F.col("kind") == "function"), 5).withColumn(
        "rank", F.col("rank").cast("long"))


# -- many hops ----------------------------------------------------------------

def reach_sql(base: str, start: str, travel: str, depth: int | None, keep: str = "depth >= 0",
              projection=V.star, **kw) -> str:
    bound = f"AND r.depth < {depth}" if depth is not None else "AND r.depth < 40"
    walk = f"""
    adj AS MATERIALIZED ({travel}),
    reach(id, depth) AS (
      SELECT id, 0 FROM nodes WHERE {start}
      UNION
      SELECT a.dst, r.depth + 1 FROM reach r JOIN adj a ON a.src = r.id WHERE TRUE {bound})"""
    return projection(base.format(keep=keep), walk, **kw)


MIN_DEPTH = "SELECT * FROM (SELECT id, min(depth) AS depth FROM reach GROUP BY id) WHERE {keep}"
OUT = "SELECT DISTINCT source AS src, target AS dst FROM edges"
INC = "SELECT DISTINCT target AS src, source AS dst FROM edges"
BOTH = f"{OUT} UNION {INC}"


@query("bfs_out", reach_sql(MIN_DEPTH, "name = 'ASIA'", OUT, 3))
def _(spark, sf):
    g = star(spark, sf)
    return traversal.bfs(g, g.seeds(F.col("name") == "ASIA"), max_depth=3).select("id", "depth")


@query("bfs_in", reach_sql(MIN_DEPTH, "name = 'cold widget'", INC, 3))
def _(spark, sf):
    g = star(spark, sf)
    return traversal.bfs(g, g.seeds(F.col("name") == "cold widget"), "incoming", max_depth=3).select("id", "depth")


@query("bfs_both", reach_sql(MIN_DEPTH, "name = 'NATION_3'", BOTH, 3))
def _(spark, sf):
    g = star(spark, sf)
    return traversal.bfs(g, g.seeds(F.col("name") == "NATION_3"), "both", max_depth=3).select("id", "depth")


@query("bfs_kind_filtered", reach_sql(
    MIN_DEPTH, "name = 'NATION_3'",
    f"SELECT * FROM ({BOTH.replace('FROM edges', 'FROM edges WHERE kind IN (' + _in(['contains', 'implements']) + ')')})"
    " WHERE dst IN (SELECT id FROM nodes WHERE kind IN ('module', 'interface', 'function'))", 3))
def _(spark, sf):
    g = star(spark, sf)
    return traversal.bfs(g, g.seeds(F.col("name") == "NATION_3"), "both", ["contains", "implements"],
                         ["module", "interface", "function"], max_depth=3).select("id", "depth")


@query("bfs_limited", reach_sql(
    """SELECT id, depth FROM (
         SELECT id, depth, row_number() OVER (ORDER BY depth, prio, id) AS rn FROM (
           SELECT m.id, m.depth, CASE WHEN m.depth = 0 THEN 2 ELSE (
               SELECT min(CASE e.kind WHEN 'contains' THEN 0 WHEN 'calls' THEN 1 ELSE 2 END)
               FROM edges e JOIN (SELECT id, min(depth) AS depth FROM reach GROUP BY id) p ON e.source = p.id
               WHERE e.target = m.id AND p.depth = m.depth - 1) END AS prio
           FROM (SELECT id, min(depth) AS depth FROM reach GROUP BY id) m))
       WHERE rn <= 1000""", "name = 'ASIA'", OUT, 3))
def _(spark, sf):
    g = star(spark, sf)
    return traversal.bfs(g, g.seeds(F.col("name") == "ASIA"), max_depth=3, limit=1000).select("id", "depth")


@query("callers_d3", reach_sql(MIN_DEPTH, "qualified_name = 'Brand#12::cold widget'", INC, 3, "depth > 0", V.flow))
def _(spark, sf):
    g = flow(spark, sf)
    seeds = g.seeds(F.col("qualified_name") == "Brand#12::cold widget")
    return traversal.callers_within(g, seeds, 3).select("id", "depth")


@query("callees_d2", reach_sql(MIN_DEPTH, "qualified_name = 'Brand#12::cold widget'", OUT, 2, "depth > 0", V.flow))
def _(spark, sf):
    g = flow(spark, sf)
    seeds = g.seeds(F.col("qualified_name") == "Brand#12::cold widget")
    return traversal.callees_within(g, seeds, 2).select("id", "depth")


@query("callgraph_d2", V.flow("""
  SELECT id, 'focal' AS role, 0 AS depth FROM up WHERE depth = 0
  UNION ALL SELECT id, 'caller', min(depth) FROM up GROUP BY id HAVING min(depth) > 0
  UNION ALL SELECT id, 'callee', min(depth) FROM down GROUP BY id HAVING min(depth) > 0""", """
  up(id, depth) AS (
    SELECT id, 0 FROM nodes WHERE qualified_name = 'Brand#12::cold widget'
    UNION SELECT e.source, depth + 1 FROM up JOIN edges e ON e.target = up.id WHERE depth < 2),
  down(id, depth) AS (
    SELECT id, 0 FROM nodes WHERE qualified_name = 'Brand#12::cold widget'
    UNION SELECT e.target, depth + 1 FROM down JOIN edges e ON e.source = down.id WHERE depth < 2)"""))
def _(spark, sf):
    g = flow(spark, sf)
    return traversal.call_graph(g, g.seeds(F.col("qualified_name") == "Brand#12::cold widget"), 2)


def _hierarchy(body: str) -> str:
    return V.star(body, """
      up(id, depth) AS (
        SELECT id, 0 FROM nodes WHERE kind = 'interface'
        UNION SELECT e.target, depth + 1 FROM up JOIN edges e ON e.source = up.id
        WHERE e.kind IN ('extends', 'implements') AND depth < 9),
      down(id, depth) AS (
        SELECT id, 0 FROM nodes WHERE kind = 'interface'
        UNION SELECT e.source, depth + 1 FROM down JOIN edges e ON e.target = down.id
        WHERE e.kind IN ('extends', 'implements') AND depth < 9)""")


_UP = "SELECT id, 'up' AS side, min(depth) AS depth FROM up GROUP BY id HAVING min(depth) > 0"
_DOWN = "SELECT id, 'down' AS side, min(depth) AS depth FROM down GROUP BY id HAVING min(depth) > 0"


@query("type_hierarchy_up", _hierarchy(_UP))
def _(spark, sf):
    g = star(spark, sf)
    return traversal.type_hierarchy(g, g.seeds(F.col("kind") == "interface"), ("up",))


@query("type_hierarchy_both", _hierarchy(f"{_UP} UNION ALL {_DOWN}").replace(
    "kind = 'interface'", "name = 'cold widget'"))
def _(spark, sf):
    g = star(spark, sf)
    return traversal.type_hierarchy(g, g.seeds(F.col("name") == "cold widget"))


@query("ancestors", V.star("SELECT id, ancestor, level FROM chain", """
  parent AS MATERIALIZED (SELECT target AS cur, min(source) AS up FROM edges WHERE kind = 'contains' GROUP BY target),
  chain(id, ancestor, level) AS (
    SELECT n.id, p.up, 1 FROM nodes n JOIN parent p ON n.id = p.cur
    UNION ALL SELECT c.id, p.up, level + 1 FROM chain c JOIN parent p ON c.ancestor = p.cur)"""))
def _(spark, sf):
    return traversal.ancestors(star(spark, sf))


@query("impact_d3", V.star("SELECT id, min(depth) AS depth FROM hit GROUP BY id", """
  step AS MATERIALIZED (
    SELECT DISTINCT e.source AS src, e.target AS dst, 0 AS cost FROM edges e JOIN nodes n ON e.source = n.id
    WHERE e.kind = 'contains'
      AND n.kind IN ('class', 'interface', 'struct', 'trait', 'protocol', 'module', 'enum')
    UNION ALL
    SELECT DISTINCT target, source, 1 FROM edges WHERE kind <> 'contains'),
  hit(id, depth) AS (
    SELECT id, 0 FROM nodes WHERE name = 'NATION_7'
    UNION SELECT s.dst, h.depth + s.cost FROM hit h JOIN step s ON s.src = h.id WHERE h.depth < 3)"""))
def _(spark, sf):
    g = star(spark, sf)
    return traversal.impact(g, g.seeds(F.col("name") == "NATION_7"), 3)


@query("shortest_path_len", reach_sql(
    MIN_DEPTH, "qualified_name = 'Brand#12::cold widget'", OUT, None, projection=V.flow))
def _(spark, sf):
    g = flow(spark, sf)
    return traversal.shortest_distance(g, g.seeds(F.col("qualified_name") == "Brand#12::cold widget"))


@query("shortest_path", V.flow("SELECT depth AS step, id FROM back", """
  adj AS MATERIALIZED (SELECT DISTINCT source AS src, target AS dst FROM edges),
  reach(id, depth) AS (
    SELECT id, 0 FROM nodes WHERE qualified_name = 'Brand#12::cold widget'
    UNION SELECT a.dst, depth + 1 FROM reach JOIN adj a ON a.src = reach.id WHERE depth < 16),
  dist AS MATERIALIZED (SELECT id, min(depth) AS depth FROM reach GROUP BY id),
  parent AS MATERIALIZED (
    SELECT d.id, d.depth, min(p.id) AS parent FROM dist d JOIN adj a ON a.dst = d.id
    JOIN dist p ON p.id = a.src AND p.depth = d.depth - 1 GROUP BY d.id, d.depth),
  goal AS (
    SELECT id, depth FROM dist WHERE id IN (SELECT id FROM nodes WHERE qualified_name = 'Brand#5::red plate')
    ORDER BY depth, id LIMIT 1),
  back(id, depth) AS (
    SELECT id, depth FROM goal
    UNION ALL SELECT p.parent, p.depth - 1 FROM back b JOIN parent p ON p.id = b.id AND p.depth = b.depth)"""))
def _(spark, sf):
    g = flow(spark, sf)
    return traversal.shortest_path(
        g, g.seeds(F.col("qualified_name") == "Brand#12::cold widget"),
        g.seeds(F.col("qualified_name") == "Brand#5::red plate"))


# -- files ----------------------------------------------------------------------

E_FILE = """
  e_file AS MATERIALIZED (
    SELECT DISTINCT s.file_path AS file, t.file_path AS depends_on
    FROM edges e JOIN nodes s ON e.source = s.id JOIN nodes t ON e.target = t.id
    WHERE e.kind <> 'contains' AND s.file_path <> t.file_path)"""


@query("file_edges", V.star("SELECT file, depends_on FROM e_file", E_FILE))
def _(spark, sf):
    return traversal.file_edges(star(spark, sf))


@query("file_dependencies", V.star(
    "SELECT file, depends_on FROM e_file WHERE file LIKE 'geo/r1/%'", E_FILE))
def _(spark, sf):
    g = star(spark, sf)
    files = g.nodes.filter(F.col("file_path").startswith("geo/r1/")).select(F.col("file_path").alias("path"))
    return traversal.file_dependencies(g, files)


@query("file_dependents", V.flow(
    "SELECT file, depends_on FROM e_file WHERE depends_on LIKE 'catalog/Brand#7/%'", E_FILE))
def _(spark, sf):
    g = flow(spark, sf)
    files = g.nodes.filter(F.col("file_path").startswith("catalog/Brand#7/")).select(F.col("file_path").alias("path"))
    return traversal.file_dependents(g, files).select("file", "depends_on")


@query("affected_files", V.heirs(
    "SELECT DISTINCT file AS path FROM hit WHERE regexp_matches(file, '\\.spec\\.|\\.test\\.|/__tests__/|/tests?/|/e2e/|/spec/')",
    E_FILE, """
  hit(file, depth) AS (
    SELECT 'catalog/Brand#7/small.go', 0
    UNION SELECT e.file, depth + 1 FROM hit JOIN e_file e ON e.depends_on = hit.file
    WHERE depth < 5 AND NOT regexp_matches(hit.file, '\\.spec\\.|\\.test\\.|/__tests__/|/tests?/|/e2e/|/spec/'))"""))
def _(spark, sf):
    g = heirs(spark, sf)
    changed = g.nodes.filter(F.col("file_path") == "catalog/Brand#7/small.go").select(
        F.col("file_path").alias("path")).distinct()
    return traversal.affected_tests(g, changed)


@query("scc_cycles", V.heirs("""
  SELECT min(least(a.src, b.id)) AS component, b.id, count(*) AS size
  FROM mutual a JOIN (SELECT DISTINCT src AS id FROM mutual) b ON TRUE
  WHERE a.dst = b.id GROUP BY b.id""", """
  adj AS MATERIALIZED (SELECT DISTINCT source AS src, target AS dst FROM edges WHERE source <> target),
  closure(src, dst) AS (
    SELECT src, dst FROM adj UNION SELECT c.src, a.dst FROM closure c JOIN adj a ON c.dst = a.src),
  pairs AS MATERIALIZED (SELECT * FROM closure),
  both_ways AS MATERIALIZED (
    SELECT a.src, a.dst FROM pairs a JOIN pairs b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst),
  mutual AS MATERIALIZED (SELECT src, dst FROM both_ways UNION SELECT src, src FROM both_ways)"""))
def _(spark, sf):
    g = heirs(spark, sf)
    return structure.cycles(g.edges.select(F.col("source").alias("src"), F.col("target").alias("dst")))


@query("circular_files", V.star("""
  SELECT min(a.src) AS component, a.dst AS id, count(*) AS size
  FROM pairs a JOIN pairs b ON a.src = b.dst AND a.dst = b.src GROUP BY a.dst HAVING count(*) > 1""",
    E_FILE, """
  closure(src, dst) AS (
    SELECT file, depends_on FROM e_file
    UNION SELECT c.src, a.depends_on FROM closure c JOIN e_file a ON c.dst = a.file),
  pairs AS MATERIALIZED (SELECT * FROM closure)"""))
def _(spark, sf):
    return structure.circular_dependencies(star(spark, sf))


# -- structure --------------------------------------------------------------------

@query("node_metrics", V.star("""
  SELECT n.id, coalesce(i.n, 0) AS incoming_edge_count, coalesce(o.n, 0) AS outgoing_edge_count,
         coalesce(o.calls, 0) AS call_count, coalesce(i.calls, 0) AS caller_count,
         coalesce(o.kids, 0) AS child_count,
         CASE n.kind WHEN 'module' THEN 1 WHEN 'class' THEN 2 WHEN 'interface' THEN 2
                     WHEN 'method' THEN 3 ELSE 0 END::BIGINT AS depth
  FROM nodes n
  LEFT JOIN (SELECT target, count(*) AS n, count(*) FILTER (kind = 'calls') AS calls FROM edges GROUP BY target) i
    ON n.id = i.target
  LEFT JOIN (SELECT source, count(*) AS n, count(*) FILTER (kind = 'calls') AS calls,
                    count(*) FILTER (kind = 'contains') AS kids FROM edges GROUP BY source) o
    ON n.id = o.source"""))
def _(spark, sf):
    return structure.node_metrics(star(spark, sf))


@query("dead_code", V.star("""
  SELECT id, kind, name FROM nodes WHERE kind IN ('function', 'method', 'class') AND NOT is_exported
  AND id NOT IN (SELECT target FROM edges WHERE kind <> 'contains')"""))
def _(spark, sf):
    return structure.dead_code(star(spark, sf)).select(*NODE)


@query("exported", V.star("SELECT id, kind, name FROM nodes WHERE is_exported"))
def _(spark, sf):
    return structure.exported(star(spark, sf)).select(*NODE)


@query("qualified_glob", V.star("""
  SELECT id, kind, name FROM nodes WHERE qualified_name LIKE 'Brand#_::cold %'
  AND kind IN ('class', 'function', 'method', 'interface', 'type_alias', 'variable', 'constant')"""))
def _(spark, sf):
    return structure.by_qualified_name(star(spark, sf), "Brand#?::cold *").select(*NODE)


@query("module_structure", V.star("""
  SELECT DISTINCT regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS dir, file_path AS path FROM nodes"""))
def _(spark, sf):
    return structure.module_structure(star(spark, sf))


@query("filtered_subgraph", V.star("""
  SELECT source, target, kind, line FROM edges
  WHERE source IN (SELECT id FROM nodes WHERE NOT is_exported AND kind IN ('module', 'class', 'interface', 'method', 'function'))
    AND target IN (SELECT id FROM nodes WHERE NOT is_exported AND kind IN ('module', 'class', 'interface', 'method', 'function'))"""))
def _(spark, sf):
    return structure.filtered_subgraph(star(spark, sf), ~F.col("is_exported")).edges.select(
        "source", "target", "kind", "line")


@query("node_context", V.star("""
  SELECT e.source AS id, 'children' AS section, e.target AS node, e.kind FROM edges e
    WHERE e.kind = 'contains' AND e.source IN (SELECT id FROM nodes WHERE kind = 'interface')
  UNION ALL
  SELECT target, 'ancestors', source, NULL FROM edges
    WHERE kind = 'contains' AND target IN (SELECT id FROM nodes WHERE kind = 'interface')
  UNION ALL
  SELECT s.target, 'ancestors', r.source, NULL FROM edges s JOIN edges r ON s.source = r.target
    WHERE s.kind = 'contains' AND r.kind = 'contains'
      AND s.target IN (SELECT id FROM nodes WHERE kind = 'interface')
  UNION ALL
  SELECT target, 'incoming', source, kind FROM edges
    WHERE kind <> 'contains' AND target IN (SELECT id FROM nodes WHERE kind = 'interface')
  UNION ALL
  SELECT source, 'outgoing', target, kind FROM edges
    WHERE kind <> 'contains' AND source IN (SELECT id FROM nodes WHERE kind = 'interface')"""))
def _(spark, sf):
    g = star(spark, sf)
    return structure.context_of(g, g.seeds(F.col("kind") == "interface"))


# Path pattern of files that are tests, samples or fixtures, used by the oracle.
TEST_SQL = (
    "(regexp_matches(lower(file_path), '/(tests|test|__tests__|spec|specs|testlib|testing|integration|samples?|"
    "examples?|fixtures?|benchmarks?|demos?)/|^(tests?|specs?|integration|samples?|examples?|fixtures?|benchmarks?|demos?)/')"
    " OR regexp_matches(lower(regexp_extract(file_path, '[^/]*$')), '^test[_.]|[._-](tests?|specs?)\\.[a-z0-9]+$')"
    " OR regexp_matches(regexp_extract(file_path, '[^/]*$'), '(Test|Tests|TestCase|Tester|Spec|Specs)\\.[A-Za-z0-9]+$')"
    " OR regexp_matches(file_path, '(^|/)[A-Za-z0-9]*(Test|Tests|Spec)/'))"
)


@query("blast_radius", V.flow(f"""
  SELECT id, count(*)::BIGINT AS callers, count(DISTINCT file_path) AS caller_files,
         count(DISTINCT CASE WHEN {TEST_SQL} THEN file_path END) AS test_files
  FROM (SELECT DISTINCT target AS id, source FROM edges WHERE source <> target) e
  JOIN (SELECT id AS source, file_path FROM nodes) n ON e.source = n.source GROUP BY id"""))
def _(spark, sf):
    g = flow(spark, sf)
    return structure.blast_radius(g, g.nodes.select("id"))


@query("polymorphic_supertypes", V.star("""
  SELECT target AS id, count(DISTINCT source) AS inheritors FROM edges
  WHERE kind IN ('extends', 'implements') GROUP BY target HAVING count(DISTINCT source) >= 3"""))
def _(spark, sf):
    return structure.polymorphic_types(star(spark, sf))


LOW_SQL = "regexp_matches(lower({c}), '(?:^|/)(tests?|__tests?__|spec)/')"


@query("dominant_file", V.star(f"""
  SELECT file_path, edge_count, next_edge_count FROM (
    SELECT file_path, edge_count, coalesce(lead(edge_count) OVER w, 0) AS next_edge_count, row_number() OVER w AS rn
    FROM (SELECT s.file_path, count(*) AS edge_count FROM edges e JOIN nodes s ON e.source = s.id
          JOIN nodes t ON e.target = t.id WHERE s.file_path = t.file_path
          GROUP BY s.file_path)
    WHERE NOT {LOW_SQL.format(c='file_path')}
    WINDOW w AS (ORDER BY edge_count DESC, file_path))
  WHERE rn = 1 AND edge_count >= 20"""))
def _(spark, sf):
    return scans.dominant_file(star(spark, sf))


@query("in_file_edges", V.flow("""
  SELECT s.file_path, count(*) AS edge_count FROM edges e JOIN nodes s ON e.source = s.id
  JOIN nodes t ON e.target = t.id WHERE s.file_path = t.file_path GROUP BY s.file_path"""))
def _(spark, sf):
    return scans.in_file_edges(flow(spark, sf))


# Orders play the part of routes here: an order leads to the parts that fulfil it.
def _routes(spark, sf):
    g = star(spark, sf)
    kind = F.when(F.col("kind") == "class", "route").otherwise(F.col("kind"))
    nodes = g.nodes.withColumn("kind", kind)
    up = g.edges.filter("kind = 'contains'").select(F.col("source").alias("c"), F.col("target").alias("source"))
    calls = g.edges.filter("kind = 'calls'").join(up, "source").select(
        F.col("c").alias("source"), "target", "kind", "line")
    from ..graph import Graph
    return Graph(nodes, calls)


_ROUTE_CTE = """
  rnodes AS (SELECT * REPLACE (CASE kind WHEN 'class' THEN 'route' ELSE kind END AS kind) FROM nodes),
  redges AS (SELECT c.source, e.target, e.kind FROM edges e JOIN edges c ON e.source = c.target
             WHERE e.kind = 'calls' AND c.kind = 'contains')"""


@query("top_route_file", V.star(f"""
  SELECT file_path, route_count, total_routes FROM (
    SELECT *, sum(route_count) OVER ()::BIGINT AS total_routes, row_number() OVER (ORDER BY route_count DESC, file_path) AS rn
    FROM (SELECT file_path, count(*) AS route_count FROM rnodes
          WHERE kind = 'route' GROUP BY file_path)
    WHERE NOT {LOW_SQL.format(c='file_path')})
  WHERE rn = 1 AND route_count >= 3 AND route_count >= 0.02 * total_routes""", _ROUTE_CTE))
def _(spark, sf):
    # Customers spread evenly over the nation files, so the share that counts as a top file is lowered.
    return scans.top_route_file(_routes(spark, sf), least_share=0.02)


@query("routing_manifest", V.star(f"""
  SELECT url, handler, handler_file, handler_line, handler_kind, count(*) OVER () AS total_routes,
         first_value(handler_file) OVER (ORDER BY in_file DESC, route_file, route_line, source, target) AS top_handler_file
  FROM (SELECT *, count(*) OVER (PARTITION BY handler_file) AS in_file FROM (
    SELECT r.name AS url, h.name AS handler, h.file_path AS handler_file, h.start_line AS handler_line,
           h.kind AS handler_kind, r.file_path AS route_file, r.start_line AS route_line, e.source, e.target
    FROM redges e JOIN rnodes r ON e.source = r.id JOIN rnodes h ON e.target = h.id
    WHERE r.kind = 'route' AND h.kind IN ('function', 'method', 'class') AND NOT {LOW_SQL.format(c='h.file_path')}
    ORDER BY route_file, route_line, e.source, e.target LIMIT 40))""", _ROUTE_CTE))
def _(spark, sf):
    return scans.routing_manifest(_routes(spark, sf))


@query("induced_edges", V.star("""
  SELECT source, target, kind, line FROM edges
  WHERE kind IN ('calls', 'extends', 'implements', 'references', 'overrides')
    AND source IN (SELECT id FROM nodes WHERE is_exported) AND target IN (SELECT id FROM nodes WHERE is_exported)"""))
def _(spark, sf):
    g = star(spark, sf)
    return rank.recover_edges(g, g.seeds(F.col("is_exported"))).select("source", "target", "kind", "line")
