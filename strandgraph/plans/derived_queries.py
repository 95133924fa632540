"""Registered queries for inferred edges, intervals, ranking and upkeep, with oracle SQL."""

from pyspark.sql import functions as F

from ..graph import Graph
from ..lineage import union_all
from ..operators import ordered, rank, synth, sync, traversal
from ..schema import as_edges, as_nodes
from ..streaming import watch
from . import views as V
from .projections import flow, table

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return add


# -- inferred edges -----------------------------------------------------------

def _supply(spark, sf):
    return table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey").join(
        table(spark, sf, "part").select("p_partkey", "p_brand", "p_name"), F.expr("l_partkey = p_partkey"))


def supply_types(spark, sf) -> Graph:
    """Suppliers as classes and brands as interfaces, both with one method per part name they carry."""
    supply = _supply(spark, sf).select("l_suppkey", "p_brand", "p_name").distinct()
    own = supply.select("l_suppkey", "p_name").distinct()
    brand = table(spark, sf, "part").select("p_brand", "p_name").distinct()
    s, b = "concat('s:', l_suppkey)", "concat('b:', p_brand)"
    lang = "'java' as language"
    nodes = union_all([
        own.selectExpr(f"{s} as id", "'class' as kind", f"{s} as name", "'s' as file_path", lang).distinct(),
        brand.selectExpr(f"{b} as id", "'interface' as kind", f"{b} as name", "'b' as file_path", lang).distinct(),
        own.selectExpr(f"concat({s}, '/', p_name) as id", "'method' as kind", "p_name as name", "'s' as file_path", lang),
        brand.selectExpr(f"concat({b}, '/', p_name) as id", "'method' as kind", "p_name as name", "'b' as file_path", lang),
    ])
    edges = union_all([
        own.selectExpr(f"{s} as source", f"concat({s}, '/', p_name) as target", "'contains' as kind"),
        brand.selectExpr(f"{b} as source", f"concat({b}, '/', p_name) as target", "'contains' as kind"),
        supply.selectExpr(f"{s} as source", f"{b} as target", "'implements' as kind").distinct(),
    ])
    return Graph(as_nodes(nodes), as_edges(edges))


@query("synth_override", """
  SELECT 'b:'||b.p_brand||'/'||b.p_name AS source, 's:'||i.l_suppkey||'/'||o.p_name AS target
    FROM (SELECT DISTINCT l_suppkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey) i
    JOIN (SELECT DISTINCT l_suppkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey) o USING (l_suppkey)
    JOIN (SELECT DISTINCT p_brand, p_name FROM part) b ON b.p_brand = i.p_brand AND b.p_name = o.p_name""")
def _(spark, sf):
    return synth.interface_overrides(supply_types(spark, sf)).select("source", "target")


@query("synth_structural_implements", """
  WITH have AS (SELECT DISTINCT l_suppkey, p_brand||p_name AS item FROM lineitem JOIN part ON l_partkey = p_partkey),
  want AS (SELECT DISTINCT l_orderkey, p_brand||p_name AS item FROM lineitem JOIN part ON l_partkey = p_partkey),
  need AS (SELECT l_orderkey, count(*) AS n FROM want GROUP BY l_orderkey),
  got AS (SELECT w.l_orderkey, h.l_suppkey, count(*) AS n FROM want w JOIN have h USING (item) GROUP BY 1, 2)
  SELECT 'struct:'||g.l_suppkey AS source, 'iface:'||g.l_orderkey AS target
    FROM got g JOIN need d ON g.l_orderkey = d.l_orderkey AND g.n = d.n""")
def _(spark, sf):
    items = _supply(spark, sf).withColumn("item", F.concat("p_brand", "p_name"))
    struct, iface = "concat('struct:', l_suppkey)", "concat('iface:', l_orderkey)"
    nodes, edges = [], []
    for kind, key in (("struct", struct), ("interface", iface)):
        rows = items.selectExpr(f"{key} as owner", "item").distinct()
        nodes.append(rows.selectExpr("owner as id", f"'{kind}' as kind", "owner as name").distinct())
        nodes.append(rows.selectExpr("concat(owner, '/', item) as id", "'method' as kind", "item as name"))
        edges.append(rows.selectExpr("owner as source", "concat(owner, '/', item) as target", "'contains' as kind"))
    g = Graph(as_nodes(union_all(nodes).selectExpr("*", "'go' as language", "'a.go' as file_path")), as_edges(union_all(edges)))
    return synth.go_implements(g).select("source", "target")


@query("synth_event_channel", """
  WITH e AS (SELECT props||' '||date_trunc('day', ts)::DATE AS channel, event_type, 'user:'||user_id AS id FROM events),
  d AS (SELECT DISTINCT channel, id FROM e WHERE event_type = 'click'),
  h AS (SELECT DISTINCT channel, id FROM e WHERE event_type = 'purchase')
  SELECT channel, id, 'dispatcher' AS role FROM d WHERE channel IN (SELECT channel FROM h)
  UNION ALL SELECT channel, id, 'handler' FROM h WHERE channel IN (SELECT channel FROM d)""")
def _(spark, sf):
    e = table(spark, sf, "events").selectExpr(
        "concat(props, ' ', cast(ts as date)) as channel", "event_type", "concat('user:', user_id) as id")
    return synth.channel(e.filter("event_type = 'click'"), e.filter("event_type = 'purchase'"))


# -- intervals ------------------------------------------------------------------

_POINTS = """
  points AS (SELECT DISTINCT a.file_path, b.start_line AS line FROM edges e
             JOIN nodes a ON e.source = a.id JOIN nodes b ON e.target = b.id)"""


@query("enclosing_interval", V.flow("""
  SELECT file_path, line, id FROM (
    SELECT p.file_path, p.line, n.id, row_number() OVER (PARTITION BY p.file_path, p.line ORDER BY n.start_line DESC, n.id) AS rn
    FROM points p JOIN nodes n ON n.file_path = p.file_path AND n.start_line <= p.line AND n.end_line >= p.line)
  WHERE rn = 1""", _POINTS))
def _(spark, sf):
    g = flow(spark, sf)
    a = g.nodes.selectExpr("id as source", "file_path")
    b = g.nodes.selectExpr("id as target", "start_line as line")
    points = g.edges.select("source", "target").distinct().join(a, "source").join(b, "target").select("file_path", "line")
    return ordered.enclosing(points, g.nodes)


@query("cluster_ranges", V.flow("""
  SELECT file_path, island, min(start_line) AS "start", max(end_line) AS "end", count(*) AS n FROM (
    SELECT *, sum(brk) OVER (PARTITION BY file_path ORDER BY start_line, rn ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM (
      SELECT *, CASE WHEN rn = 1 OR start_line > max(end_line) OVER (
          PARTITION BY file_path ORDER BY start_line, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 8
          THEN 1 ELSE 0 END AS brk
      FROM (SELECT file_path, start_line, end_line,
                   row_number() OVER (PARTITION BY file_path ORDER BY start_line, end_line) AS rn FROM nodes)))
  GROUP BY file_path, island"""))
def _(spark, sf):
    nodes = flow(spark, sf).nodes
    out = ordered.islands(nodes, ["file_path"], F.col("start_line"), F.col("end_line"), gap=8, bucket=1000)
    return out.select("file_path", "island", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "n")


@query("debounce_sessions", """
  SELECT user_id, island, count(*) AS events, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM (
    SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM (
      SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 2 HOUR
                THEN 0 ELSE 1 END AS brk FROM events))
  GROUP BY user_id, island""")
def _(spark, sf):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    out = ordered.islands(table(spark, sf, "events"), ["user_id"], us, us, gap=2 * 3600e6, bucket=24 * 3600e6)
    return out.selectExpr("user_id", "island", "n as events", "cast(start as bigint) as first_us", "cast(`end` as bigint) as last_us")


@query("change_bursts", """
  SELECT project, count(*) AS events, epoch_us(max(ts)) AS last_us FROM (
    SELECT *, sum(brk) OVER (PARTITION BY project ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM (
      SELECT 'user_'||user_id AS project, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)
        < INTERVAL 60 SECOND THEN 0 ELSE 1 END AS brk FROM events))
  GROUP BY project, island""")
def _(spark, sf):
    changes = table(spark, sf, "events").selectExpr("concat('user_', user_id) as project", "props as path", "cast(ts as timestamp) as ts")
    return watch.bursts(changes, quiet_ms=60_000).select("project", "events", F.unix_micros("last_ts").alias("last_us"))


@query("previous_event", """
  SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events""")
def _(spark, sf):
    events = table(spark, sf, "events")
    out = ordered.previous(events, ["user_id"], ["ts", "event_id"], F.to_date("ts"), "event_type", "before")
    return out.select("event_id", "before")


_CHANNEL_SQL = """
  WITH e AS (SELECT props||' '||date_trunc('day', ts)::DATE AS channel, event_type, 'user:'||user_id AS id, event_id % 1000 AS line FROM events),
  d AS (SELECT channel, id, min(line)::INTEGER AS line FROM e WHERE event_type = 'click' GROUP BY ALL),
  h AS (SELECT DISTINCT channel, id FROM e WHERE event_type = 'purchase')
"""


def _event_graph(spark, sf) -> Graph:
    """Users who click emit, users who purchase handle, through a channel for each payload and day."""
    e = table(spark, sf, "events").selectExpr(
        "concat(props, ' ', cast(ts as date)) as channel", "event_type", "concat('user:', user_id) as id",
        "cast(event_id % 1000 as int) as line", "cast(null as string) as at")
    edges = synth._through(e.filter("event_type = 'click'"), e.filter("event_type = 'purchase'").withColumn("line", F.lit(None).cast("int")), "event-emitter")
    users = e.select("id").distinct().withColumn("kind", F.lit("function"))
    return Graph(users, edges)


@query("callers_through_channel", _CHANNEL_SQL + """
  SELECT h.id, d.id AS caller, d.line FROM h JOIN d USING (channel) WHERE h.id <> d.id""")
def _(spark, sf):
    g = _event_graph(spark, sf)
    return traversal.callers(g, g.nodes).select("id", "caller", "line")


@query("impact_through_channel", _CHANNEL_SQL + """
  , hop AS (SELECT DISTINCT d.id AS a, h.id AS b FROM h JOIN d USING (channel) WHERE h.id <> d.id),
  one AS (SELECT DISTINCT b AS id FROM hop WHERE a = 'user:7' AND b <> 'user:7'),
  two AS (SELECT DISTINCT b AS id FROM hop WHERE a IN (SELECT id FROM one))
  SELECT id, 1 AS depth FROM one UNION ALL SELECT id, 2 FROM two WHERE id <> 'user:7' AND id NOT IN (SELECT id FROM one)""")
def _(spark, sf):
    g = _event_graph(spark, sf)
    return traversal.callees_within(g, g.seeds(F.col("id") == "user:7"), 2).select("id", "depth")


# -- relevance --------------------------------------------------------------------

def _ppr_sql(rounds: int = 25) -> list[str]:
    steps = ["""
  w AS MATERIALIZED (
    SELECT src, dst, count(*) AS w FROM (
      SELECT source AS src, target AS dst FROM edges WHERE source <> target
      UNION ALL SELECT target, source FROM edges WHERE source <> target) GROUP BY src, dst)""", """
  share AS MATERIALIZED (SELECT src, dst, w * 1.0::DOUBLE / sum(w) OVER (PARTITION BY src) AS share FROM w)""", """
  seed AS MATERIALIZED (
    SELECT n.id, CASE WHEN n.name = 'cold widget' THEN 1.0::DOUBLE / count(*) FILTER (n.name = 'cold widget') OVER () ELSE 0 END AS r,
           n.id NOT IN (SELECT src FROM w) AS alone FROM nodes n)""", """
  s0 AS MATERIALIZED (SELECT id, r AS s FROM seed)"""]
    for n in range(1, rounds + 1):
        steps.append(f"""
  s{n} AS MATERIALIZED (
    SELECT d.id, 0.75 * (coalesce(m.s, 0) + CASE WHEN d.alone THEN p.s ELSE 0 END) + 0.25 * d.r AS s
    FROM seed d JOIN s{n - 1} p ON p.id = d.id
    LEFT JOIN (SELECT dst, sum(q.s * share) AS s FROM share JOIN s{n - 1} q ON q.id = src GROUP BY dst) m ON m.dst = d.id)""")
    return steps


@query("ppr_25", V.flow("SELECT id, round(s, 6) AS score FROM s25", *_ppr_sql()))
def _(spark, sf):
    g = flow(spark, sf)
    return rank.relevance(g, g.seeds(F.col("name") == "cold widget")).select("id", F.round("score", 6).alias("score"))


@query("flow_named")
def _(spark, sf):
    g = flow(spark, sf)
    return rank.flow_chain(g, g.seeds(F.col("name").isin("cold widget", "red plate")))


# -- upkeep -------------------------------------------------------------------------

@query("sync_diff", """
  WITH old AS (SELECT 'doc/'||doc_id AS path, sha256(text) AS content_hash FROM documents),
  new AS (SELECT 'doc/'||d.doc_id AS path, CASE WHEN quality = 1 THEN sha256(upper(text)) ELSE sha256(text) END AS content_hash
          FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE coalesce(toxic, 0) = 0
          UNION ALL SELECT 'page/'||page_id, sha256(html) FROM pages)
  SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed'
         ELSE 'modified' END AS change
  FROM old o FULL JOIN new n ON o.path = n.path WHERE o.content_hash IS DISTINCT FROM n.content_hash""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    labels = table(spark, sf, "labels").selectExpr("doc_id as l_id", "quality", "toxic")
    old = docs.selectExpr("concat('doc/', doc_id) as path", "sha2(text, 256) as content_hash")
    new = docs.join(labels, F.expr("doc_id = l_id"), "left").filter("coalesce(toxic, 0) = 0").selectExpr(
        "concat('doc/', doc_id) as path", "sha2(if(quality = 1, upper(text), text), 256) as content_hash")
    pages = table(spark, sf, "pages").selectExpr("concat('page/', page_id) as path", "sha2(html, 256) as content_hash")
    return sync.diff(old, new.unionByName(pages))


@query("remove_files", V.star("""
  SELECT 'node' AS part, count(*) AS n FROM nodes WHERE file_path NOT LIKE 'geo/r1/%'
  UNION ALL
  SELECT 'edge', count(*) FROM edges
  WHERE source NOT IN (SELECT id FROM nodes WHERE file_path LIKE 'geo/r1/%')
    AND target NOT IN (SELECT id FROM nodes WHERE file_path LIKE 'geo/r1/%')"""))
def _(spark, sf):
    from .projections import star
    g = star(spark, sf)
    paths = g.nodes.filter(F.col("file_path").startswith("geo/r1/")).select(F.col("file_path").alias("path"))
    left = sync.remove_files(g, paths)
    n = left.nodes.agg(F.count("*").alias("n")).select(F.lit("node").alias("part"), "n")
    return n.unionByName(left.edges.agg(F.count("*").alias("n")).select(F.lit("edge").alias("part"), "n"))


@query("valid_edges", V.star("""
  SELECT source, target, kind, line FROM edges WHERE target IN (SELECT id FROM nodes WHERE is_exported)
  AND source IN (SELECT id FROM nodes WHERE is_exported)"""))
def _(spark, sf):
    from .projections import star
    g = star(spark, sf)
    return sync.with_valid_ends(g.edges.select("source", "target", "kind", "line"), g.nodes.filter("is_exported"))


@query("pending_paths", """
  SELECT path, max(ts) AS ts FROM (SELECT 'user/'||user_id AS path, epoch_us(ts) AS ts FROM events)
  GROUP BY path HAVING max(ts) > (SELECT epoch_us(max(ts)) FROM events WHERE event_type = 'signup')""")
def _(spark, sf):
    events = table(spark, sf, "events").selectExpr("concat('user/', user_id) as path", "unix_micros(cast(ts as timestamp)) as ts", "event_type")
    return sync.pending_after(events.select("path", "ts"), events.filter("event_type = 'signup'").select("ts"))
