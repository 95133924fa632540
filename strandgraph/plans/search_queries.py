"""Registered search queries over documents and star nodes, with oracle SQL."""

import re
import uuid

from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..graph import Graph
from ..lineage import checkpoint_root
from ..operators import search
from ..operators.segments import SegmentedIndex
from . import views as V
from .graph_queries import TEST_SQL
from .projections import document_nodes, star

QUERIES, ORACLES = {}, {}

FTS_TEXT = "thanedble tionly anea"


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return add


def bm25_sql(phrases: list[list[str]]) -> tuple[str, str]:
    """CTEs and final SELECT that score every document for single-word prefix phrases."""
    cols = {"id": 0, "name": 20, "qualified_name": 5, "docstring": 1}
    toks = ", ".join(
        f"regexp_extract_all(strip_accents(lower({c})), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+') AS t_{c}" for c in cols)
    length = " + ".join(f"len(t_{c})" for c in cols)
    hit = "len(list_filter(t_{c}, lambda x: starts_with(x, '{t}')))"
    feats = []
    for i, (token,) in enumerate(phrases):
        feats.append(" + ".join(f"{w} * {hit.format(c=c, t=token)}" for c, w in cols.items()) + f" AS tf{i}")
        feats.append(" + ".join(hit.format(c=c, t=token) for c in cols) + f" AS any{i}")
    idf = ", ".join(
        f"CASE WHEN ln((count(*) - count(*) FILTER (any{i} > 0) + 0.5) / (count(*) FILTER (any{i} > 0) + 0.5)) > 0 "
        f"THEN ln((count(*) - count(*) FILTER (any{i} > 0) + 0.5) / (count(*) FILTER (any{i} > 0) + 0.5)) "
        f"ELSE 1e-6 END AS idf{i}" for i in range(len(phrases)))
    score = " + ".join(f"idf{i} * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / avglen))"
                       for i in range(len(phrases)))
    matched = " OR ".join(f"any{i} > 0" for i in range(len(phrases)))
    ctes = f"""
    tok AS MATERIALIZED (SELECT id, {toks} FROM docs),
    feats AS MATERIALIZED (SELECT id, {length} AS len, {', '.join(feats)} FROM tok),
    stat AS MATERIALIZED (SELECT avg(len) AS avglen, {idf} FROM feats),
    hits AS MATERIALIZED (SELECT id, {score} AS score FROM feats, stat WHERE {matched})"""
    return ctes, "SELECT id, round(score, 6) AS score FROM hits"


_CTES, _BODY = bm25_sql(T.fts_phrases(FTS_TEXT))


@query("search_fts_bm25", V.with_ctes(V.DOC_NODES, _CTES, body=_BODY))
def _(spark, sf):
    hits = search.fts(document_nodes(spark, sf), FTS_TEXT, ids_only=True)
    return hits.select("id", F.round("score", 6).alias("score"))


@query("search_fts_indexed", V.with_ctes(V.DOC_NODES, _CTES, body=_BODY))
def _(spark, sf):
    index = search.SearchIndex.build(document_nodes(spark, sf))
    return index.search(FTS_TEXT).select("id", F.round("score", 6).alias("score"))


@query("search_segments", V.with_ctes(V.DOC_NODES, _CTES, body=_BODY))
def _(spark, sf):
    """The index after three changes: stale texts and nodes that go later, new nodes, then corrections."""
    docs, part = document_nodes(spark, sf), F.pmod(F.crc32("id"), F.lit(3))
    index = SegmentedIndex(spark, f"{checkpoint_root(spark)}/strandgraph/index-{uuid.uuid4().hex}", most=2)
    later = docs.filter(part == 2).withColumn("id", F.concat(F.lit("old:"), "id"))
    index.add(docs.filter(part < 2).withColumn("docstring", F.when(part == 0, F.reverse("docstring")).otherwise(F.col("docstring"))).unionByName(later))
    index.add(docs.filter(part == 2))
    index.add(docs.filter(part == 0), gone=later)
    return index.read().search(FTS_TEXT).select("id", F.round("score", 6).alias("score"))


@query("search_cascade_indexed", None)
def _(spark, sf):
    g = Graph(document_nodes(spark, sf), star(spark, sf).edges)
    index = search.SearchIndex.build(g.nodes)
    return search.search(g, FTS_TEXT, limit=20, index=index).select("id", "name", F.round("score", 6).alias("score"))


def _path_sql(words: list[str], test_query: bool = False) -> str:
    file, folder = "lower(regexp_extract(file_path, '[^/]*$'))", "lower(regexp_extract(file_path, '^(.*)/[^/]*$', 1))"
    parts = [f"CASE WHEN contains({file}, '{w}') THEN 10 ELSE 0 END + CASE WHEN contains({folder}, '{w}') THEN 5 "
             f"WHEN contains(lower(file_path), '{w}') THEN 3 ELSE 0 END" for w in words]
    test = "0" if test_query else f"CASE WHEN {TEST_SQL} THEN 15 ELSE 0 END"
    return f"({' + '.join(parts)} - {test})"


def _name_sql(query_text: str) -> str:
    whole = re.sub(r"\s+", "", query_text).lower()
    words = query_text.lower().split()
    one = f"WHEN lower(name) IN ({', '.join(repr(w) for w in words)}) THEN 60" if len(words) > 1 else ""
    every = (f"WHEN {' AND '.join(f'''contains(lower(name), '{w}')''' for w in words)} THEN 15"
             if len(words) > 1 else "")
    return (f"(CASE WHEN lower(name) = '{whole}' THEN 80 {one} WHEN starts_with(lower(name), '{whole}') "
            f"THEN floor(10.5 + 30.0 * {len(whole)} / length(name)) {every} "
            f"WHEN contains(lower(name), '{whole}') THEN 10 ELSE 0 END)")


@query("search_cascade", V.with_ctes(V.DOC_NODES, _CTES, f"""
  exact AS (SELECT id FROM docs WHERE lower(name) IN ('thanedble', 'tionly', 'anea')),
  pool AS (SELECT id, score FROM hits UNION ALL
           SELECT id, (SELECT max(score) FROM hits) FROM exact WHERE id NOT IN (SELECT id FROM hits))""",
    body=f"""
  SELECT id, name, round(pool.score + 10 + {_path_sql(['thanedble', 'tionly', 'anea'])}
         + {_name_sql(FTS_TEXT)}, 6) AS score
  FROM pool JOIN docs USING (id) ORDER BY pool.score + 10 + {_path_sql(['thanedble', 'tionly', 'anea'])}
         + {_name_sql(FTS_TEXT)} DESC, id LIMIT 20"""))
def _(spark, sf):
    g = Graph(document_nodes(spark, sf), star(spark, sf).edges)
    return search.search(g, FTS_TEXT, limit=20).select("id", "name", F.round("score", 6).alias("score"))


ORACLES["search_cascade_indexed"] = ORACLES["search_cascade"]


@query("search_filters", V.star("""
  SELECT id, name, 1.0::DOUBLE AS score FROM nodes WHERE kind IN ('function') AND language IN ('go')
  ORDER BY name, id LIMIT 500"""))
def _(spark, sf):
    return search.by_filters(star(spark, sf).nodes, ["function"], ["go"], 500).select("id", "name", "score")


@query("search_filters_ranked", V.star(f"""
  SELECT id, name, (1 + 10 + {_path_sql(['function', 'kotlin', 'catalog'])} )::DOUBLE AS score
  FROM nodes WHERE kind = 'function' AND language = 'kotlin'
  ORDER BY score DESC, id LIMIT 200"""))
def _(spark, sf):
    hits = search.search(star(spark, sf), "kind:function lang:kotlin path:catalog", limit=200)
    return hits.select("id", "name", "score")


@query("search_like", V.star("""
  SELECT id, name, (CASE WHEN name = 'plate' THEN 1.0 WHEN name ILIKE 'plate%' THEN 0.9
    WHEN name ILIKE '%plate%' THEN 0.8 WHEN qualified_name ILIKE '%plate%' THEN 0.7 ELSE 0.5 END)::DOUBLE AS score
  FROM nodes WHERE name ILIKE '%plate%' OR qualified_name ILIKE '%plate%'
  ORDER BY score DESC, length(name), id LIMIT 100"""))
def _(spark, sf):
    return search.like(star(spark, sf).nodes, "plate").select("id", "name", "score")


@query("search_fuzzy", V.star("""
  SELECT id, name, (1.0 / (1 + d))::DOUBLE AS score
  FROM (SELECT id, name, levenshtein(lower(name), 'cold wigdet') AS d FROM nodes)
  WHERE d <= 2 ORDER BY d, name, id LIMIT 100"""))
def _(spark, sf):
    return search.fuzzy(star(spark, sf).nodes, "cold wigdet").select("id", "name", "score")


@query("exact_name_colocated", V.star("""
  SELECT id, name, score FROM (
    SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY score DESC, id) AS best FROM (
      SELECT n.*, 1.0 + CASE WHEN file_path IN (
          SELECT file_path FROM nodes WHERE lower(name) IN (
            SELECT lower(name) FROM nodes WHERE lower(name) IN ('nation_3', 'nation_4', 'cold widget')
            GROUP BY 1 HAVING count(DISTINCT file_path) < 10)) THEN 20.0 ELSE 0.0 END::DOUBLE AS score
      FROM nodes n WHERE lower(name) IN ('nation_3', 'nation_4', 'cold widget')))
  WHERE best <= 17 ORDER BY score DESC, id LIMIT 50"""))
def _(spark, sf):
    return search.exact_names(star(spark, sf).nodes, ["NATION_3", "NATION_4", "cold widget"]).select("id", "name", "score")


@query("substring", V.star("""
  SELECT id, name FROM nodes WHERE name ILIKE '%widget%' AND NOT name ILIKE 'widget%'"""))
def _(spark, sf):
    return search.name_substring(star(spark, sf).nodes, "widget", limit=None, exclude_prefix=True).select("id", "name")


@query("name_bonus", V.star(f"SELECT id, {_name_sql('cold wi')}::DOUBLE AS bonus FROM nodes"))
def _(spark, sf):
    return star(spark, sf).nodes.select("id", T.name_bonus("name", "cold wi").alias("bonus"))


@query("path_relevance", V.star(f"SELECT id, {_path_sql(['catalog', 'small', 'brand'])} AS score FROM nodes"))
def _(spark, sf):
    return star(spark, sf).nodes.select("id", T.path_relevance("file_path", "catalog small Brand").alias("score"))


@query("kind_bonus", V.star("""
  SELECT kind, (CASE kind WHEN 'function' THEN 10 WHEN 'method' THEN 10 WHEN 'class' THEN 8
    WHEN 'interface' THEN 9 WHEN 'module' THEN 4 WHEN 'namespace' THEN 4 ELSE 0 END * count(*))::BIGINT AS bonus
  FROM nodes GROUP BY kind"""))
def _(spark, sf):
    return star(spark, sf).nodes.groupBy("kind").agg(F.sum(T.kind_bonus()).alias("bonus"))


@query("test_file_flag", V.star(f"SELECT DISTINCT file_path, {TEST_SQL} AS is_test FROM nodes"))
def _(spark, sf):
    return star(spark, sf).nodes.select("file_path", P.is_test_file("file_path").alias("is_test")).distinct()


@query("generated_file_flag", V.star("""
  SELECT language, count(*) FILTER (regexp_matches(file_path, 'Grpc\\.java$|\\.pb\\.go$|\\.min\\.m?js$')) AS generated,
         count(*) AS n FROM nodes GROUP BY language"""))
def _(spark, sf):
    return star(spark, sf).nodes.groupBy("language").agg(
        F.count_if(P.is_generated_file("file_path")).alias("generated"), F.count("*").alias("n"))


@query("symbol_match", V.star("""
  SELECT id, kind, name FROM nodes WHERE name = 'order_1' OR name = 'Customer#000000001::order_1'
    OR (name = 'order_1' AND contains(qualified_name, 'Customer#000000001::order_1'))"""))
def _(spark, sf):
    nodes = star(spark, sf).nodes
    return nodes.filter(T.matches_symbol("order_1")).select("id", "kind", "name")


@query("qualified_symbol_match", V.star("""
  SELECT id, kind, name FROM nodes WHERE name = 'cold widget' AND (
    contains(qualified_name, 'Brand#12::cold widget')
    OR list_contains(string_split(file_path, '/'), 'Brand#12'))"""))
def _(spark, sf):
    return star(spark, sf).nodes.filter(T.matches_symbol("Brand#12::cold widget")).select("id", "kind", "name")


@query("definition_groups", V.star("""
  SELECT file_path||'|'||qualified_name AS definition, count(*) AS n FROM nodes
  WHERE name = 'cold widget' GROUP BY 1"""))
def _(spark, sf):
    g = star(spark, sf)
    hits = search.symbol_matches(g, "cold widget")
    return search.definitions(hits).groupBy("definition").agg(F.count("*").alias("n"))


@query("rank_terms_spread", V.with_ctes(V.DOC_NODES, body="""
  SELECT id, len(list_filter(['tion', 'edble', 'aient'], lambda w: contains(lower(docstring), w))) AS hits FROM docs"""))
def _(spark, sf):
    words = ["tion", "edble", "aient"]
    lower = F.lower("docstring")
    hits = sum((lower.contains(w).cast("long") for w in words), F.lit(0).cast("long"))
    return document_nodes(spark, sf).select("id", hits.alias("hits"))
