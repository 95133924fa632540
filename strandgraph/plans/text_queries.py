"""Registered queries for files, text extraction, imports and context pieces, with oracle SQL."""

from pyspark.sql import functions as F

from ..functions import paths as P
from ..graph import Graph
from ..operators import context, imports, ordered, resolve, scans, search, structure, synth, traversal
from ..schema import as_edges, as_nodes
from ..sources import files as S
from .. import tools
from . import views as V
from .projections import document_nodes, flow, star, table

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return add


def document_files(spark, sf):
    return table(spark, sf, "documents").selectExpr(
        "concat(source, '/', lang, '/doc_', doc_id, '.txt') as path", "text as content", "n_chars as size", "cast(0 as bigint) as modified_at")


DOC_PATH = "source||'/'||lang||'/doc_'||doc_id||'.txt'"


# -- files ----------------------------------------------------------------------

@query("content_hash", f"SELECT {DOC_PATH} AS path, sha256(text) AS content_hash, 'unknown' AS language FROM documents")
def _(spark, sf):
    return S.with_content(document_files(spark, sf)).select("path", "content_hash", "language")


@query("size_exceeded", f"""
  SELECT {DOC_PATH} AS path, 'size_exceeded' AS code, 'warning' AS severity FROM documents WHERE n_chars > 10000""")
def _(spark, sf):
    files = document_files(spark, sf).withColumn("errors", S.size_error(limit=10_000)).filter("errors is not null")
    return files.select("path", F.col("errors")[0]["code"].alias("code"), F.col("errors")[0]["severity"].alias("severity"))


@query("language_by_path", V.star("""
  SELECT file_path, CASE regexp_extract(file_path, '(\\.[^./]*)$', 1) WHEN '.ts' THEN 'typescript' WHEN '.js' THEN 'javascript'
    WHEN '.java' THEN 'java' WHEN '.kt' THEN 'kotlin' WHEN '.go' THEN 'go' WHEN '.py' THEN 'python' ELSE 'unknown' END AS detected,
    file_path NOT LIKE '%.tbl' AS is_source, count(*) AS n
  FROM nodes GROUP BY file_path"""))
def _(spark, sf):
    return star(spark, sf).nodes.groupBy("file_path").agg(F.count("*").alias("n")).select(
        "file_path", S.language_of("file_path").alias("detected"), S.is_source_file("file_path").alias("is_source"), "n")


@query("ignored_paths", """
  SELECT p, regexp_matches(p, '(^|/)(out|build|dist|target|obj|vendor|coverage|venv)/') AS ignored, n FROM (
    SELECT CASE lang WHEN 'de' THEN 'build/' WHEN 'es' THEN 'src/out/' ELSE 'src/' END||source||'/a.py' AS p, count(*) AS n
    FROM documents GROUP BY 1)""")
def _(spark, sf):
    rows = table(spark, sf, "documents").selectExpr(
        "concat(case lang when 'de' then 'build/' when 'es' then 'src/out/' else 'src/' end, source, '/a.py') as p")
    return rows.groupBy("p").agg(F.count("*").alias("n")).select("p", S.is_ignored("p").alias("ignored"), "n")


@query("source_snippet", f"""
  SELECT 'doc:'||doc_id AS id, length(array_to_string(list_slice(string_split(text, chr(10)), 1,
    len(string_split(text, chr(10)))), chr(10))) AS chars FROM documents""")
def _(spark, sf):
    return S.snippet(document_nodes(spark, sf), document_files(spark, sf)).select("id", F.length("code").cast("long").alias("chars"))


@query("numbered_lines", f"""
  SELECT path, line, md5(text) AS digest FROM (
    SELECT {DOC_PATH} AS path, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line,
           unnest(string_split(text, chr(10))) AS text FROM documents)""")
def _(spark, sf):
    lines = S.numbered(document_files(spark, sf))
    return lines.select("path", F.col("line").cast("long").alias("line"), F.md5("text").alias("digest"))


@query("find_file", V.star("SELECT DISTINCT file_path AS path FROM nodes WHERE file_path LIKE '%/n3.py'"))
def _(spark, sf):
    files = star(spark, sf).nodes.select(F.col("file_path").alias("path")).distinct()
    return S.find_file(files, "N3.py")


@query("files_glob", V.star("""
  SELECT DISTINCT file_path AS path FROM nodes WHERE regexp_matches(file_path, 'catalog/.*/[^/]*\\.ts')"""))
def _(spark, sf):
    files = star(spark, sf).nodes.select(F.col("file_path").alias("path")).distinct()
    return files.filter(F.col("path").rlike(structure.path_glob_regex("catalog/**/*.ts")))


@query("folder_tree", V.star("""
  SELECT array_to_string(string_split(file_path, '/')[1:k], '/') AS folder, count(*) AS files FROM (
    SELECT file_path, unnest(range(1, len(string_split(file_path, '/')))) AS k FROM (SELECT DISTINCT file_path FROM nodes))
  GROUP BY 1"""))
def _(spark, sf):
    g = star(spark, sf)
    files = g.nodes.select(F.col("file_path").alias("path")).distinct()
    return tools.Tools(Graph(g.nodes, g.edges, files)).tree()


# -- text -------------------------------------------------------------------------

@query("href_imports", """
  SELECT page_id, target, count(*) AS n FROM (
    SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS target FROM pages) GROUP BY page_id, target""")
def _(spark, sf):
    links = synth.matches(table(spark, sf, "pages").select("page_id", "html"), "html", r'href="([^"]+)"')
    return links.groupBy("page_id", F.col("g1").alias("target")).agg(F.count("*").alias("n"))


@query("match_lines", """
  SELECT doc_id, line, count(*) AS n FROM (
    SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, unnest(string_split(text, chr(10))) AS text FROM documents),
    LATERAL (SELECT unnest(regexp_extract_all(text, '[a-z]tion')) AS m) GROUP BY doc_id, line""")
def _(spark, sf):
    hits = synth.matches(table(spark, sf, "documents").select("doc_id", "text"), "text", "([a-z]tion)", 1, line=True)
    return hits.groupBy("doc_id", F.col("match_line").cast("long").alias("line")).agg(F.count("*").alias("n"))


@query("script_calls", """
  SELECT page_id, name, count(*) AS n FROM (
    SELECT page_id, unnest(regexp_extract_all(html, '<script>[^<]*"</p>";(\\w+)\\(', 1)) AS name FROM pages) GROUP BY page_id, name""")
def _(spark, sf):
    hits = synth.matches(table(spark, sf, "pages").select("page_id", "html"), "html", r'<script>[^<]*"</p>";(\w+)\(')
    return hits.groupBy("page_id", F.col("g1").alias("name")).agg(F.count("*").alias("n"))


# -- imports ------------------------------------------------------------------------

@query("import_paths", V.star("""
  SELECT DISTINCT s.file_path, 'geo.'||regexp_extract(t.file_path, '(r[0-9]+)', 1)||'.'||regexp_extract(t.file_path, '(n[0-9]+)\\.', 1) AS source,
         t.file_path AS target_path
  FROM edges e JOIN nodes s ON e.source = s.id JOIN nodes t ON e.target = t.id WHERE e.kind = 'references'"""))
def _(spark, sf):
    g = star(spark, sf)
    at = g.nodes.select("id", "file_path")
    uses = g.edges.filter("kind = 'references'").select("source", "target").distinct().join(
        at.selectExpr("id as source", "file_path"), "source").join(at.selectExpr("id as target", "file_path as t"), "target")
    wanted = uses.selectExpr("file_path", "'python' as language",
                             "replace(regexp_replace(t, '[.]py$', ''), '/', '.') as source").distinct()
    return imports.resolve_paths(wanted, g.nodes.select(F.col("file_path").alias("path")))


@query("reexport_chase", """
  SELECT 'c'||conv_id||'/0.ts' AS target_path, 'topic' AS exported_name, 'node:'||conv_id||':'||max(turn) AS target
  FROM conversations GROUP BY conv_id""")
def _(spark, sf):
    # Every turn passes on what the next one exports; the last turn declares it.
    turns = table(spark, sf, "conversations").select("conv_id", "turn")
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    nodes = as_nodes(last.selectExpr("concat('node:', conv_id, ':', turn) as id", "'function' as kind", "'topic' as name",
                                     "concat('c', conv_id, '/', turn, '.ts') as file_path", "'typescript' as language"))
    path = "concat('c', conv_id, '/', {}, '.ts')"
    forwards = turns.join(last.withColumnRenamed("turn", "m"), "conv_id").filter("turn < m").selectExpr(
        f"{path.format('turn')} as path", "'*' as exported_name", f"{path.format('turn + 1')} as inner_path", "'*' as inner_name")
    wanted = last.selectExpr(f"{path.format('0')} as target_path", "'topic' as exported_name")
    return imports.chase(wanted, nodes, forwards)


@query("method_on_type", """
  SELECT 'T'||conv_id||'_0' AS type_name, 'answer' AS method, 'java' AS language, 'm:'||conv_id AS target
  FROM conversations GROUP BY conv_id""")
def _(spark, sf):
    # Each turn is a type that extends the next one; only the last declares the method.
    turns = table(spark, sf, "conversations").select("conv_id", "turn")
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("m"))
    name = "concat('T', conv_id, '_', {})"
    types = turns.selectExpr(f"{name.format('turn')} as id", "'class' as kind", f"{name.format('turn')} as name", "'T.java' as file_path", "'java' as language")
    method = last.selectExpr("concat('m:', conv_id) as id", "'method' as kind", "'answer' as name",
                             f"concat({name.format('m')}, '::answer') as qualified_name", "'T.java' as file_path", "'java' as language")
    edges = turns.join(last, "conv_id").filter("turn < m").selectExpr(
        f"{name.format('turn')} as source", f"{name.format('turn + 1')} as target", "'extends' as kind")
    g = Graph(as_nodes(types).unionByName(as_nodes(method)), as_edges(edges))
    calls = last.selectExpr(f"{name.format('0')} as type_name", "'answer' as method", "'java' as language")
    return resolve.method_on_type(g, calls)


# -- context pieces -------------------------------------------------------------------

@query("term_hits", V.with_ctes(V.DOC_NODES, body="""
  SELECT id, max(s) + 5 * (count(*) - 1) AS score FROM (
    SELECT id, 3 AS s FROM docs WHERE contains(lower(docstring), 'tion') UNION ALL
    SELECT id, 7 FROM docs WHERE contains(lower(docstring), 'edble') UNION ALL
    SELECT id, 4 FROM docs WHERE contains(lower(docstring), 'aient')) GROUP BY id"""))
def _(spark, sf):
    docs = document_nodes(spark, sf).withColumn("lower", F.lower("docstring"))
    found = F.array_compact(F.array(*[
        F.when(F.col("lower").contains(w), F.struct(F.lit(w).alias("term"), F.lit(s).alias("score")))
        for w, s in (("tion", 3), ("edble", 7), ("aient", 4))]))
    hits = docs.select("id", F.explode(found).alias("h")).select("id", "h.term", "h.score")
    return context.accumulate(hits)


@query("co_occurrence", V.flow("""
  SELECT id, 1.0::DOUBLE + 20 * (k - 1) AS score FROM nodes
  JOIN (SELECT file_path, count(DISTINCT lower(name)) AS k FROM nodes GROUP BY file_path) USING (file_path)"""))
def _(spark, sf):
    hits = flow(spark, sf).nodes.withColumn("score", F.lit(1.0))
    return context.co_occurrence(hits).select("id", "score")


@query("per_file_cap", V.star("""
  SELECT id, file_path FROM (
    SELECT id, file_path, row_number() OVER (PARTITION BY file_path ORDER BY
      CASE WHEN kind IN ('class', 'interface') THEN 3 WHEN kind IN ('method', 'function') THEN 1 ELSE 0 END
      + CASE WHEN is_exported THEN 10 ELSE 0 END DESC, id) AS rn FROM nodes) WHERE rn <= 5"""))
def _(spark, sf):
    return context.per_file_cap(star(spark, sf).nodes, 5, F.col("is_exported")).select("id", "file_path")


@query("group_factor", V.star("""
  SELECT id, CASE WHEN k >= 2 THEN 1 + k * 0.5 WHEN is_exported THEN 0.3 ELSE 0.6 END::DOUBLE AS factor FROM (
    SELECT id, is_exported, (contains(lower(name), 'widget') OR list_contains(d, 'widget') OR contains(lower(name), 'wid') OR list_contains(d, 'wid'))::INT
      + (contains(lower(name), 'catalog') OR list_contains(d, 'catalog'))::INT + (contains(lower(name), 'cold') OR list_contains(d, 'cold'))::INT AS k
    FROM (SELECT *, string_split(lower(regexp_extract(file_path, '^(.*)/[^/]*$', 1)), '/') AS d FROM nodes))"""))
def _(spark, sf):
    groups = context.term_groups(["widget", "catalog", "cold", "wid"])
    factor = context.group_factor(groups, F.col("is_exported"), F.lit(False))
    return star(spark, sf).nodes.select("id", factor.cast("double").alias("factor"))


@query("greedy_clusters", V.flow("""
  SELECT file_path, island FROM walk WHERE taken""", """
  isl AS MATERIALIZED (
    SELECT file_path, island, min(start_line) AS s, max(end_line) AS e, count(*) AS score FROM (
      SELECT *, sum(brk) OVER (PARTITION BY file_path ORDER BY start_line, rn ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM (
        SELECT *, CASE WHEN rn = 1 OR start_line > max(end_line) OVER (PARTITION BY file_path ORDER BY start_line, rn
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 8 THEN 1 ELSE 0 END AS brk
        FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY start_line, end_line) AS rn FROM nodes)))
    GROUP BY file_path, island)""", """
  ordered AS MATERIALIZED (
    SELECT file_path, island, 10 * (e - s + 1) AS chars,
           row_number() OVER (PARTITION BY file_path ORDER BY score::DOUBLE / (e - s + 1) DESC, score DESC, e - s + 1, s) AS k FROM isl),
  walk AS (
    SELECT file_path, island, k, chars AS used, 1 AS n, TRUE AS taken FROM ordered WHERE k = 1
    UNION ALL
    SELECT o.file_path, o.island, o.k, CASE WHEN w.used + o.chars + 19 <= 3800 THEN w.used + o.chars + 19 ELSE w.used END, w.n,
           w.used + o.chars + 19 <= 3800
    FROM walk w JOIN ordered o ON o.file_path = w.file_path AND o.k = w.k + 1)"""))
def _(spark, sf):
    nodes = flow(spark, sf).nodes
    isl = ordered.islands(nodes, ["file_path"], F.col("start_line"), F.col("end_line"), gap=8, bucket=1000)
    rows = isl.select("file_path", "island", "start", "end", F.col("n").alias("score"), F.lit(1).alias("importance"),
                      (10 * (F.col("end") - F.col("start") + 1)).alias("chars"))
    return context.pick_clusters(rows, 3800)


@query("output_calls", V.star("""
  SELECT language, files, CASE WHEN files < 500 THEN 1 WHEN files < 5000 THEN 2 WHEN files < 15000 THEN 3 WHEN files < 25000 THEN 4 ELSE 5 END AS calls
  FROM (SELECT language, count(DISTINCT name) AS files FROM nodes GROUP BY language)"""))
def _(spark, sf):
    rows = star(spark, sf).nodes.groupBy("language").agg(F.countDistinct("name").alias("files"))
    return rows.withColumn("calls", context.call_budget(F.col("files")))


@query("context_search")
def _(spark, sf):
    g = star(spark, sf).materialised()
    ctx = context.find(g, "cold widget catalog Customer#000000001", search_limit=5, max_nodes=30)
    return ctx.nodes.select("id", "kind", "name", "file_path", "is_root", F.round("score", 6).alias("score"))


@query("explore_files")
def _(spark, sf):
    g = flow(spark, sf).materialised()
    ctx = context.find(g, "cold widget catalog", search_limit=5, max_nodes=60)
    return context.file_ranking(ctx, "cold widget catalog").select("file_path", "points", "hits", F.round("mass", 6).alias("mass"))


# -- tools ----------------------------------------------------------------------------

@query("tool_callers", V.flow("""
  SELECT d.file_path||'|'||d.qualified_name AS definition, e.source AS id, min(e.line) AS line
  FROM edges e JOIN nodes d ON e.target = d.id AND d.name = 'cold widget' WHERE e.source <> e.target
  GROUP BY 1, 2 ORDER BY 1, CASE WHEN FALSE THEN 1 ELSE 0 END, (SELECT file_path FROM nodes n WHERE n.id = e.source),
    (SELECT start_line FROM nodes n WHERE n.id = e.source), 2 LIMIT 100"""))
def _(spark, sf):
    return tools.Tools(flow(spark, sf)).callers("cold widget", limit=100).select("definition", "id", "line")


@query("tool_impact_edges", V.flow("""
  SELECT DISTINCT e.source, e.target, e.kind FROM edges e
  WHERE e.source IN (SELECT id FROM hit) AND e.target IN (SELECT id FROM hit)""", """
  hit(id, depth) AS (
    SELECT id, 0 FROM nodes WHERE name = 'cold widget'
    UNION SELECT e.source, depth + 1 FROM hit h JOIN edges e ON e.target = h.id WHERE h.depth < 1)"""))
def _(spark, sf):
    return tools.Tools(flow(spark, sf)).impact_edges("cold widget", 1)


@query("tool_node_at_line", V.flow("""
  SELECT id, name FROM nodes WHERE name = 'cold widget' AND start_line <= 120 AND end_line >= 120
  UNION ALL
  SELECT id, name FROM (SELECT id, name FROM nodes WHERE name = 'cold widget' ORDER BY abs(start_line - 120), id LIMIT 1)
  WHERE NOT EXISTS (SELECT 1 FROM nodes WHERE name = 'cold widget' AND start_line <= 120 AND end_line >= 120)"""))
def _(spark, sf):
    g = flow(spark, sf)
    defs = g.nodes.filter("name = 'cold widget'")
    return tools.at_line(defs, 120).select("id", "name")


@query("status", V.star("""
  SELECT 'nodes_by_kind' AS section, kind AS key, count(*) AS n FROM nodes GROUP BY kind
  UNION ALL SELECT 'edges_by_kind', kind, count(*) FROM edges GROUP BY kind
  UNION ALL SELECT 'files_by_language', language, count(*) FROM (SELECT DISTINCT file_path, language FROM nodes) GROUP BY language"""))
def _(spark, sf):
    g = star(spark, sf)
    files = g.nodes.select(F.col("file_path").alias("path"), "language").distinct()
    return scans.stats(Graph(g.nodes, g.edges, files))


@query("edge_labels", V.flow("""
  SELECT 'callback via '||name||' @'||file_path||':'||start_line AS label, count(*) AS n FROM nodes GROUP BY 1"""))
def _(spark, sf):
    rows = flow(spark, sf).nodes.select(F.lit("calls").alias("kind"), F.create_map(
        F.lit("synthesizedBy"), F.lit("callback"), F.lit("via"), "name",
        F.lit("registeredAt"), F.concat_ws(":", "file_path", F.col("start_line").cast("string"))).alias("metadata"))
    return rows.groupBy(tools.edge_label().alias("label")).agg(F.count("*").alias("n"))


@query("generated_last", V.star("""
  SELECT language, bool_or(regexp_matches(file_path, 'Grpc\\.java$')) AS any_generated, count(*) AS n FROM nodes GROUP BY language"""))
def _(spark, sf):
    return star(spark, sf).nodes.groupBy("language").agg(
        F.bool_or(P.is_generated_file("file_path")).alias("any_generated"), F.count("*").alias("n"))


@query("conversation_depth", V.with_ctes(body="""
  SELECT 'turn:'||conv_id||':'||turn AS id, turn - (SELECT min(turn) FROM conversations c WHERE c.conv_id = t.conv_id) AS depth
  FROM conversations t"""  , *["unused AS (SELECT 1)"]))
def _(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn")
    turn = "concat('turn:', conv_id, ':', {})"
    nodes = as_nodes(turns.selectExpr(f"{turn.format('turn')} as id", "'method' as kind", "'t' as name", "'c' as file_path", "'unknown' as language"))
    after = turns.selectExpr("conv_id", "turn - 1 as turn")
    edges = as_edges(turns.join(after, ["conv_id", "turn"]).selectExpr(
        f"{turn.format('turn')} as source", f"{turn.format('turn + 1')} as target", "'calls' as kind"))
    first = turns.groupBy("conv_id").agg(F.min("turn").alias("turn")).selectExpr(f"{turn.format('turn')} as id")
    return traversal.shortest_distance(Graph(nodes, edges), first).select("id", F.col("depth").cast("long").alias("depth"))


@query("like_wildcards", V.star("""
  SELECT id, name FROM nodes WHERE name ILIKE '%co_d%g%' OR qualified_name ILIKE '%co_d%g%' ORDER BY
   CASE WHEN name ILIKE 'co_d%g%' THEN 0 ELSE 1 END, length(name), id LIMIT 50"""))
def _(spark, sf):
    return search.like(star(spark, sf).nodes, "co_d%g", limit=50).select("id", "name")
