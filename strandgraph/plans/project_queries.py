"""Registered queries for packages, mounts and scopes of a project, with oracle SQL."""

from pyspark.sql import functions as F

from ..graph import Graph
from ..lineage import cut, union_all
from ..operators import mounts, packages, resolve, scopes
from ..schema import as_edges, as_nodes, as_refs
from ..sources import ignores
from .projections import table

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return add


# -- receivers of a declared type -----------------------------------------------
# Orders are methods of their customer's class. Returned line items declare a variable of their
# supplier's type, filled orders a field; the other line items call a method on one of these names.

@query("resolve_typed_receiver", """
  WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderkey % 10000000 * 10 AS base FROM orders),
  l AS (SELECT o_orderkey, o_custkey, base + l_linenumber AS line, l_suppkey, l_partkey, l_quantity, l_returnflag
        FROM lineitem JOIN o ON l_orderkey = o_orderkey),
  uses AS (SELECT DISTINCT o_orderkey, o_custkey, line, 'v'||(l_partkey % 5) AS name, 'm'||(l_quantity::BIGINT % 20) AS method
           FROM l WHERE l_returnflag <> 'R'),
  local AS (SELECT o_orderkey, line, 'v'||(l_suppkey % 5) AS name, min('S'||l_suppkey) AS type FROM l WHERE l_returnflag = 'R' GROUP BY ALL),
  field AS (SELECT o_custkey, base AS line, 'v'||(o_orderkey % 5) AS name, 'S'||(o_custkey % 10) AS type FROM o WHERE o_orderstatus = 'F'),
  a AS (SELECT u.o_orderkey, u.line, u.name, arg_max(d.type, d.line) AS type FROM uses u JOIN local d
        ON d.o_orderkey = u.o_orderkey AND d.name = u.name AND d.line <= u.line GROUP BY ALL),
  b AS (SELECT u.o_orderkey, u.line, u.name, arg_max(d.type, d.line) AS type FROM uses u JOIN field d
        ON d.o_custkey = u.o_custkey AND d.name = u.name AND d.line <= u.line GROUP BY ALL),
  c AS (SELECT o_custkey, name, arg_min(type, line) AS type FROM field GROUP BY ALL),
  typed AS (SELECT u.*, coalesce(a.type, b.type, c.type) AS type FROM uses u LEFT JOIN a USING (o_orderkey, line, name)
            LEFT JOIN b USING (o_orderkey, line, name) LEFT JOIN c USING (o_custkey, name)),
  own AS (SELECT DISTINCT 'S'||l_suppkey AS type, 'm'||(l_partkey % 20) AS method FROM lineitem WHERE l_linenumber = 1),
  up AS (SELECT DISTINCT 'S'||s_suppkey AS type, 'N'||s_nationkey||'::m'||(c_custkey % 20) AS target, 'm'||(c_custkey % 20) AS method
         FROM supplier JOIN customer ON c_nationkey = s_nationkey)
  SELECT 'order:'||t.o_orderkey AS from_node_id, t.name||'.'||t.method AS reference_name, t.line::INT AS line,
         CASE WHEN own.type IS NOT NULL THEN t.type||'::'||t.method ELSE up.target END AS target
  FROM typed t LEFT JOIN own ON own.type = t.type AND own.method = t.method
  LEFT JOIN up ON up.type = t.type AND up.method = t.method
  WHERE t.type IS NOT NULL AND (own.type IS NOT NULL OR up.type IS NOT NULL)""")
def _(spark, sf):
    base = "cast(o_orderkey % 10000000 * 10 as int)"
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    supplier, customer = table(spark, sf, "supplier"), table(spark, sf, "customer")
    items = lines.join(orders, F.expr("l_orderkey = o_orderkey"))

    def member(df, owner: str, method: str):
        return df.selectExpr(f"concat({owner}, '::m', {method} % 20) as id", "'method' as kind", f"concat('m', {method} % 20) as name",
                             f"concat({owner}, '::m', {method} % 20) as qualified_name").distinct()

    def of_type(df, owner: str, kind: str):
        return df.selectExpr(f"{owner} as id", f"'{kind}' as kind", f"{owner} as name", f"{owner} as qualified_name").distinct()

    own, nation = "concat('S', l_suppkey)", "concat('N', c_nationkey)"
    nodes = union_all([
        of_type(supplier, "concat('S', s_suppkey)", "class"), member(lines.filter("l_linenumber = 1"), own, "l_partkey"),
        of_type(customer, nation, "interface"), member(customer, nation, "c_custkey"),
        of_type(customer, "concat('customer:', c_custkey)", "class"), of_type(orders, "concat('order:', o_orderkey)", "method")])
    nodes = as_nodes(nodes.selectExpr("*", "'a.java' as file_path", "'java' as language"))
    edges = as_edges(union_all([
        supplier.selectExpr("concat('S', s_suppkey) as source", "concat('N', s_nationkey) as target", "'implements' as kind"),
        orders.selectExpr("concat('customer:', o_custkey) as source", "concat('order:', o_orderkey) as target", "'contains' as kind")]))
    refs = items.filter("l_returnflag != 'R'").selectExpr(
        "concat('order:', o_orderkey) as from_node_id", "concat('v', l_partkey % 5, '.m', cast(l_quantity as bigint) % 20) as reference_name",
        "'calls' as reference_kind", f"{base} + l_linenumber as line", "'a.java' as file_path", "'java' as language").distinct()
    refs = cut(as_refs(refs), "refs")  # typed_receiver gives them their identity
    declared = items.filter("l_returnflag = 'R'").selectExpr(
        "concat('order:', o_orderkey) as scope", f"{base} + l_linenumber as line", "concat('v', l_suppkey % 5) as name",
        "concat('S', l_suppkey) as type_name", "false as hoisted").unionByName(orders.filter("o_orderstatus = 'F'").selectExpr(
            "concat('customer:', o_custkey) as scope", f"{base} as line", "concat('v', o_orderkey % 5) as name",
            "concat('S', o_custkey % 10) as type_name", "true as hoisted"))
    key = ["from_node_id", "reference_name", "line"]
    return scopes.typed_receiver(Graph(nodes, edges), refs, cut(declared, "declared"), keep=key).select(*key, "target")


# -- packages ---------------------------------------------------------------------
# Page URLs as imports of four kinds of project: a host is a package, a host with its first folder
# one of its own where the host name has an even length; the last kind is known to its own folder only.

_URL = r"^https?://([^/?#]+)/([^/?#]*)/([^/?#]*)"


@query("import_packages", f"""
  WITH p AS (SELECT page_id, page_id % 4 AS kind, regexp_extract(url, '{_URL}', 1) AS host, regexp_extract(url, '{_URL}', 2) AS lang,
             regexp_extract(url, '{_URL}', 3) AS leaf FROM pages WHERE regexp_matches(url, '{_URL}')),
  q AS (SELECT *, CASE WHEN kind = 1 THEN replace(replace(host, '.', '_'), '-', '_') ELSE host END AS name,
               CASE kind WHEN 0 THEN 'go' WHEN 1 THEN 'rust' WHEN 2 THEN 'npm' ELSE 'own/'||host END AS place,
               CASE WHEN kind = 1 THEN '::' ELSE '/' END AS sep FROM p WHERE leaf <> ''),
  f AS (SELECT DISTINCT kind, place||CASE WHEN length(host) % 2 = 0 AND page_id % 8 < 4 THEN '/deep/'||name||'/'||lang ELSE '/'||name||'/'||lang END
          ||'/'||leaf AS base FROM q),
  r AS (SELECT q.*, place||'/main'||page_id AS at, name||sep||lang||sep||leaf AS source FROM q),
  hit AS (SELECT r.page_id, r.source, f.base, r.name||r.sep||r.lang AS prefix, 0 AS o, r.kind
          FROM r JOIN f ON f.kind = r.kind AND length(r.host) % 2 = 0 AND f.base = r.place||'/deep/'||r.name||'/'||r.lang||'/'||r.leaf
          UNION ALL SELECT r.page_id, r.source, f.base, r.name, 1, r.kind
          FROM r JOIN f ON f.kind = r.kind AND f.base = r.place||'/'||r.name||'/'||r.lang||'/'||r.leaf)
  SELECT page_id, source, arg_min(prefix, o) AS prefix,
         arg_min(base||CASE kind WHEN 0 THEN '/a.go' WHEN 1 THEN '.rs' ELSE '.ts' END, o) AS target_path
  FROM hit GROUP BY page_id, source""")
def _(spark, sf):
    url = _URL.replace("\\", "\\\\")
    p = table(spark, sf, "pages").select("page_id", "url").filter(F.col("url").rlike(_URL)).selectExpr(
        "page_id", "cast(page_id % 4 as int) as kind", *[f"regexp_extract(url, '{url}', {i}) as {n}" for i, n in ((1, "host"), (2, "lang"), (3, "leaf"))])
    p = cut(p.filter("leaf != ''").selectExpr(
        "*", "if(kind = 1, regexp_replace(host, '[.-]', '_'), host) as name", "if(kind = 1, '::', '/') as sep",
        "case kind when 0 then 'go' when 1 then 'rust' when 2 then 'npm' else concat('own/', host) end as place",
        "element_at(array('go', 'rust', 'typescript', 'typescript'), kind + 1) as language"), "package-pages")
    deep = "length(host) % 2 = 0"
    family = "case kind when 0 then 'go' when 1 then 'rust' else 'web' end as family"
    within = "if(kind = 3, place, '') as within"
    roots = p.selectExpr(family, "name as prefix", "concat(place, '/', name) as folder", within).unionByName(
        p.filter(deep).selectExpr(family, "concat(name, sep, lang) as prefix", "concat(place, '/deep/', name, '/', lang) as folder", within)).distinct()
    files = p.selectExpr("language", f"concat(place, if({deep} and page_id % 8 < 4, '/deep/', '/'), name, '/', lang, '/', leaf,"
                                     " element_at(array('/a.go', '.rs', '.ts', '.ts'), kind + 1)) as path").distinct()
    uses = p.selectExpr("page_id", "concat(place, '/main', page_id) as file_path", "language", "concat(name, sep, lang, sep, leaf) as source")
    found = packages.package_paths(uses, roots, files)
    return uses.join(found, ["file_path", "source"]).select("page_id", "source", "prefix", "target_path")


# -- mounts -------------------------------------------------------------------------

@query("routes_mounted", """
  WITH RECURSIVE m AS (SELECT DISTINCT p_partkey AS id, CASE WHEN p_partkey > 0 THEN (p_partkey - 1) // 2 END AS parent,
                              '/'||p_size||CASE WHEN p_type = 'SMALL' THEN '' ELSE '/'||lower(p_type) END AS prefix FROM part),
  w AS (SELECT id, id AS root, prefix AS path, 1 AS depth FROM m WHERE parent IS NULL
        UNION ALL SELECT m.id, w.root, w.path||m.prefix, w.depth + 1 FROM m JOIN w ON m.parent = w.id),
  calls AS (SELECT DISTINCT o_orderpriority, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
  SELECT l_partkey AS part, depth::INT AS depth, CASE o_orderpriority WHEN '1-URGENT' THEN 'POST' ELSE 'GET' END||' '||
         regexp_replace('/'||path||'/'||lower(o_orderpriority), '/+', '/', 'g') AS name
  FROM calls JOIN w ON w.id = l_partkey""")
def _(spark, sf):
    """Parts mounted under one another as a heap; priorities of their orders are routes on them."""
    part = table(spark, sf, "part").selectExpr(
        "p_partkey as id", "if(p_partkey > 0, (p_partkey - 1) div 2, null) as parent",
        "concat('/', p_size, if(p_type = 'SMALL', '', concat('/', lower(p_type)))) as prefix")
    sites = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.expr("l_orderkey = o_orderkey")).select(
        F.col("l_partkey").alias("id"), "o_orderpriority").distinct()
    verb = F.when(F.col("o_orderpriority") == "1-URGENT", "POST").otherwise("GET")
    return sites.join(mounts.compose(part), "id").select(
        F.col("id").alias("part"), "depth",
        F.concat_ws(" ", verb, mounts.joined(F.col("path"), F.lower("o_orderpriority"))).alias("name"))


# -- ignore rules of many folders -----------------------------------------------------
# Every source has rules for its documents, every language below it brings some back, the root leaves
# out one language's folders but for those it names.

@query("ignored_nested", """
  WITH d AS (SELECT doc_id::VARCHAR AS n, source||'/'||lang||'/doc_'||doc_id||'.txt' AS path, source, lang FROM documents)
  SELECT path, coalesce(lang = 'es' OR CASE
           WHEN n LIKE '%11' THEN FALSE
           WHEN n LIKE '_3%' THEN lang = 'de'
           WHEN n LIKE '%1' OR n LIKE '%5' OR n LIKE '%6' THEN TRUE
           ELSE FALSE END, FALSE) AS ignored
  FROM d""")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "lang")
    paths = d.selectExpr("concat(source, '/', lang, '/doc_', doc_id, '.txt') as path")
    files = union_all([
        d.selectExpr("concat(source, '/.gitignore') as path", "'# by number\n*1.txt\n**/doc_*[56].txt\nen/doc_?3*.txt\n' as content").distinct(),
        d.selectExpr("concat(source, '/', lang, '/.gitignore') as path",
                     "concat('!doc_?3*.txt\n', if(lang = 'de', '/doc_?3*.txt\n', ''), '!*11.txt') as content").distinct(),
        d.limit(1).selectExpr("'.gitignore' as path", "'/*/es/\n!doc_1.txt' as content")])
    return ignores.ignored(paths, ignores.rules(files))
