"""Query parsing, scores and full-text ranking."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from strandgraph.functions import paths as P
from strandgraph.functions import text as T
from strandgraph.graph import Graph
from strandgraph.operators import search
from strandgraph.schema import as_nodes


@pytest.mark.parametrize("raw,text,kinds,langs,paths,names", [
    ("authenticate user", "authenticate user", [], [], [], []),
    ("kind:function auth", "auth", ["function"], [], [], []),
    ("kind:Function auth", "kind:Function auth", [], [], [], []),
    ("lang:TypeScript language:go x", "x", [], ["typescript", "go"], [], []),
    ('path:"src/some dir/x" y', "y", [], [], ["src/some dir/x"], []),
    ("name:foo", "", [], [], [], ["foo"]),
    ("TODO: http://x.y kind:", "TODO: http://x.y kind:", [], [], [], []),
    ("", "", [], [], [], []),
])
def test_parse_query(raw, text, kinds, langs, paths, names):
    q = T.parse_query(raw)
    assert (q.text, q.kinds, q.languages, q.paths, q.names) == (text, kinds, langs, paths, names)


def test_terms_and_stems():
    assert T.search_terms("getUserName of the cache", stems=False) == ["getusername", "get", "user", "name", "cache"]
    assert "cache" in T.stem_variants("caching") and "evict" in T.stem_variants("eviction")
    assert T.stem_variants("class") == [] and "entry" in T.stem_variants("entries")
    assert [T.is_distinctive(t) for t in ("flat", "Screen", "setLast", "a_b", "REST")] == [False, False, True, True, True]


@pytest.mark.parametrize("path,want", [
    ("src/foo_test.go", True), ("FooTest.kt", True), ("latest.kt", False), ("src/test/x.py", True), ("tests/x.py", True),
    ("jvmTest/x.kt", True), ("manifest/x.kt", False), ("examples/x.ts", True), ("src/a.spec.ts", True), ("src/core.ts", False)])
def test_is_test_file(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(P.is_test_file("p")).first()[0] is want


def test_shared_dirs(spark):
    df = spark.createDataFrame([("a/b/c.ts", "a/b/d.ts"), ("a/b/c.ts", "a/x/d.ts"), ("c.ts", "d.ts"), ("a/b.ts", "z/b.ts")], "a string, b string")
    assert [r[0] for r in df.select(P.shared_dirs(F.col("a"), F.col("b"))).collect()] == [2, 1, 0, 0]


def nodes(spark, rows):
    return as_nodes(spark.createDataFrame(
        [(f"n{i}", "function", n, f"src/{n}.ts", "typescript", d) for i, (n, d) in enumerate(rows)],
        "id string, kind string, name string, file_path string, language string, docstring string"))


ROWS = [("getUser", "fetch the user é"), ("scrape_loop", "loop over scrape targets"), ("getUserName", "user user user"),
        ("Émile", "école user"), ("loop", "scrape loop loops looping"), ("other", None)]


@pytest.mark.parametrize("query", ["user", "scrape_loop", "loop user", "ecole", "fetch:: zzz"])
def test_bm25_equals_sqlite(spark, query):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(id, name, qualified_name, docstring, signature)")
    for i, (n, d) in enumerate(ROWS):
        con.execute("insert into t values (?,?,?,?,?)", (f"n{i}", n, n, d, None))
    words = query.replace("::", " ").split()
    match = " OR ".join(f'"{w}"*' for w in words)
    want = {r[0]: round(-r[1], 6) for r in con.execute("select id, bm25(t,0,20,5,1,2) from t where t match ?", (match,))}
    df = nodes(spark, ROWS)
    got = {r["id"]: round(r["score"], 6) for r in search.fts(df, query).collect()}
    assert got == want
    indexed = {r["id"]: round(r["score"], 6) for r in search.SearchIndex.build(df).search(query).collect()}
    assert indexed == want


def test_cascade_falls_back(spark):
    g = Graph(nodes(spark, ROWS), None)
    assert [r["name"] for r in search.search(g, "UserName", limit=5).collect()][0] == "getUserName"
    assert [r["name"] for r in search.search(g, "getUssr", limit=5).collect()] == ["getUser"]
    assert search.search(g, "qqqqqq", limit=5).count() == 0
    assert {r["name"] for r in search.search(g, "user path:getUserName", limit=5).collect()} == {"getUserName"}


def test_symbol_forms(spark):
    df = as_nodes(spark.createDataFrame([
        ("1", "method", "request", "Session::request", "src/session.py", "python"),
        ("2", "function", "run", "run", "src/stage_apply.rs", "rust"), ("3", "file", "util.ts", "src/util.ts", "src/util.ts", "typescript")],
        "id string, kind string, name string, qualified_name string, file_path string, language string"))

    def hit(symbol):
        return [r["id"] for r in df.filter(T.matches_symbol(symbol)).collect()]

    assert hit("Session.request") == ["1"] and hit("stage_apply::run") == ["2"] and hit("crate::stage_apply::run") == ["2"]
    assert hit("util") == ["3"] and hit("Other.request") == []


def test_many_terms_equal_single_searches(spark):
    from strandgraph.operators import context

    df = nodes(spark, ROWS)
    many = context.search_many(df, ["user", "loop", "scrape"], None).collect()
    for term in ("user", "loop", "scrape"):
        one = {(r["id"], round(r["score"], 6)) for r in search.search(Graph(df, None), term).collect()}
        assert {(r["id"], round(r["score"], 6)) for r in many if r["term"] == term} == one


def test_every_match_is_ranked(spark):
    """An exact name behind many better full-text hits, rare names behind many namesakes, kinds in a fuzzy search."""
    many = [(f"n{i:04}", "function", "walker", f"walker walker {i}", f"src/{i}.py") for i in range(700)]
    many += [("z1", "function", "walk", None, "lib/z.py"), ("z2", "class", "Walkerr", None, "lib/z.py"), ("z3", "function", "helper", None, "lib/z.py")]
    df = as_nodes(spark.createDataFrame([(i, k, n, n, d, p, "python") for i, k, n, d, p in many],
                                        "id string, kind string, name string, qualified_name string, docstring string, file_path string, language string"))
    g = Graph(df, None)
    assert [r.id for r in search.search(g, "walk", limit=1).collect()] == ["z1"]
    assert {r.id for r in search.search(g, "kind:class walkerx", limit=5).collect()} == {"z2"}
    named = df.withColumn("file_path", F.when(F.col("id") == "n0699", "lib/z.py").otherwise(F.col("file_path")))
    best = search.exact_names(named, ["walker", "helper"], limit=2).collect()
    assert {r.id for r in best} == {"n0699", "z3"} and {r.score for r in best} == {21.0}


def test_segments_follow_changes(spark, tmp_path):
    import random

    from strandgraph.operators.segments import SegmentedIndex

    rnd, live = random.Random(4), {}
    index = SegmentedIndex(spark, f"{tmp_path}/index", most=3)
    assert index.read().search("user").count() == 0
    words = ["user", "loop", "scrape", "fetch", "userName", "école", "x9"]
    for turn in range(6):
        changed = {f"n{rnd.randrange(14)}": " ".join(rnd.choices(words, k=rnd.randrange(6))) or None for _ in range(6)}
        gone = rnd.sample(sorted(live), min(len(live), 2)) if turn else []
        live = {k: v for k, v in live.items() if k not in gone} | changed
        frame = lambda rows: as_nodes(spark.createDataFrame([(i, "function", i, i, d, "a.py", "python") for i, d in rows.items()],
                                                            "id string, kind string, name string, qualified_name string, docstring string, file_path string, language string"))
        index.add(frame(changed), spark.createDataFrame([(i,) for i in gone if i not in changed], "id string"))
        index = SegmentedIndex(spark, f"{tmp_path}/index", most=3)  # as after a restart
        assert index.state()["total"] == len(live) and len(index.state()["segments"]) <= 3
        for query in ("user", "fetch loop", "ecole:scrape"):
            want = {(r.id, round(r.score, 6)) for r in search.fts(frame(live), query).collect()}
            assert {(r.id, round(r.score, 6)) for r in index.read().search(query).collect()} == want
    old = index.read()
    before = old.search("user").count()
    index.merge()
    assert old.search("user").count() == before == index.read().search("user").count() and len(index.state()["segments"]) == 1
    plan = index.read()._term("user", True)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(term,user)" in plan
