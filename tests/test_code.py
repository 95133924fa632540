"""Extraction, resolution, inferred edges and tools on source text."""

import pytest
from pyspark.sql import functions as F

import sources
from strandgraph.graph import Graph
from strandgraph.operators import imports, resolve, sync, synth, traversal
from strandgraph.schema import as_edges, as_nodes, as_refs
from strandgraph.sources import files as S
from strandgraph.sources import frameworks as FW
from strandgraph.sources.pipeline import build
from strandgraph.sources.tables import GraphStore
from strandgraph.tools import Tools


@pytest.fixture(scope="module")
def project(spark):
    files = sources.frame(spark, {**sources.FILES, "app/web.py": "import flask\n"})
    return build(files).materialised(), files


def linked(g, kind):
    n = g.nodes.select("id", "name")
    rows = g.edges.filter(F.col("kind") == kind).join(n.selectExpr("id as source", "name as s"), "source").join(
        n.selectExpr("id as target", "name as t"), "target").select("s", "t").collect()
    return {(r["s"], r["t"]) for r in rows}


def test_symbols_and_edges(spark, project):
    g, files = project
    names = {(r["kind"], r["qualified_name"]) for r in g.nodes.filter("kind != 'file'").select("kind", "qualified_name").collect()}
    assert {("class", "Derived"), ("method", "Derived::format"), ("method", "Service::save"), ("method", "Server::Get"),
            ("struct", "Server"), ("route", "app/service.py::GET /users/<id>"), ("method", "User::getName")} <= names
    assert {("main", "processValue"), ("processValue", "formatValue"), ("run", "format")} <= linked(g, "calls")
    assert ("Derived", "Base") in linked(g, "extends") and ("Derived", "Formatter") in linked(g, "implements")
    assert ("Server", "Store") in linked(g, "implements") and ("main", "Derived") in linked(g, "instantiates")
    assert ("GET /users/<id>", "get_user") in linked(g, "references")
    assert ("main.ts", "utils.ts") in linked(g, "imports") and ("Service", "save") in linked(g, "contains")
    tools = Tools(g, files)
    assert {r["name"] for r in tools.callers("formatValue").collect()} == {"processValue", "format"}
    assert "main" in {r["name"] for r in tools.impact("formatValue", 3).collect()}
    assert tools.node("formatValue").first()["code"].startswith("export function formatValue")
    assert "unusedHelper" in {r["name"] for r in __import__("strandgraph.operators.structure", fromlist=["x"]).dead_code(g).collect()}


def test_store_round_trip(spark, project, tmp_path):
    g, _ = project
    store = GraphStore(spark, str(tmp_path))
    assert store.version() is None
    store.write(g)
    back = store.read()
    assert back.nodes.count() == g.nodes.count() and back.edges.count() == g.edges.count()
    assert not sync.is_stale(store.metadata(), "1") and sync.is_stale(store.metadata(), "2")
    store.set_metadata("branch", "main")
    store.set_metadata("branch", "topic")
    gone = spark.createDataFrame([("src/utils.ts",)], "path string")
    store.replace_files(Graph(g.nodes.limit(0), g.edges.limit(0)), gone)
    assert {r.key: r.value for r in store.metadata().collect()} == {"branch": "topic", "extraction_version": "1"}
    left = store.read()
    assert left.nodes.filter("file_path = 'src/utils.ts'").count() == 0
    assert sync.with_valid_ends(left.edges, left.nodes).count() == left.edges.count()


def test_changed_file_keeps_its_callers(spark, tmp_path):
    """A callee moves down a line: its node is fresh, calls from other files follow it."""
    n = nodes(spark, [("a1", "function", "main", "main", "a.ts", "typescript", 1, None), ("b1", "function", "help", "help", "b.ts", "typescript", 1, None),
                      ("b9", "function", "gone", "gone", "b.ts", "typescript", 9, None)])
    e = as_edges(spark.createDataFrame([("a1", "b1", "calls"), ("a1", "b9", "calls"), ("b1", "b9", "calls")], "source string, target string, kind string"))
    store = GraphStore(spark, str(tmp_path))
    store.write(Graph(n, e))
    fresh = nodes(spark, [("b2", "function", "help", "help", "b.ts", "typescript", 2, None), ("b5", "function", "new", "new", "b.ts", "typescript", 5, None)])
    links = as_edges(spark.createDataFrame([("b2", "b5", "calls"), ("b2", "nowhere", "calls")], "source string, target string, kind string"))
    store.replace_files(Graph(fresh, links), spark.createDataFrame([("b.ts",)], "path string"))
    left = store.read()
    assert {r["id"] for r in left.nodes.collect()} == {"a1", "b2", "b5"}
    assert {(r["source"], r["target"]) for r in left.edges.collect()} == {("a1", "b2"), ("b2", "b5")}


def test_comments_and_strings(spark):
    from strandgraph.sources import extract as X
    texts = {"javascript": 'const s = "http // no"; f(); // gone\n/* a\nb */ const t = \'/* kept */\';\nx = `// ${y}`', "python": 's = "# kept" # gone\n"""doc\nmore"""\nt = 1',
             "ruby": "=begin\nnot code\n=end\nx = '#a' # gone", "lua": "--[[ a\nb ]] x = 1 -- gone", "go": "a := 'x' // gone\nb()",
             "kotlin": 'val s = """a // kept\n"b" /* kept */""" // gone\nf()', "rust": 'let s = r#"a " // kept"#; g(); // gone', "java": "char c = '\"'; // gone"}
    df = spark.createDataFrame(list(texts.items()), "language string, content string")
    got = {r["language"]: r["c"] for r in df.select("language", X.strip_comments(F.col("content")).alias("c")).collect()}
    assert got == {"javascript": 'const s = "http // no"; f(); \n\n const t = \'/* kept */\';\nx = `// ${y}`', "python": 's = "# kept" \n\n\nt = 1',
                   "ruby": "\n\n\nx = '#a' ", "lua": "\n x = 1 ", "go": "a := 'x' \nb()",
                   "kotlin": 'val s = """a // kept\n"b" /* kept */""" \nf()', "rust": 'let s = r#"a " // kept"#; g(); ', "java": "char c = '\"'; "}


def test_ignore_rules(spark):
    rules = S.ignore_rules("*.log\n/only/top\nsub/*.ts\n!sub/keep.ts\ntmp/\n# note\n!vendor/\ndocs/**/x?.py")
    paths = {"a.log": True, "d/a.log": True, "only/top/a.ts": True, "x/only/top/a.ts": False, "sub/a.ts": True, "sub/keep.ts": False, "y/sub/a.ts": False,
             "q/tmp/a.ts": True, "tmp": False, "vendor/a.go": False, "node_modules/a.ts": True, "docs/a/b/x1.py": True, "docs/x1.py": True, "docs/xx1.py": False}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r["p"]: r["i"] for r in df.select("p", S.is_ignored("p", rules).alias("i")).collect()} == paths


def test_existing_and_empty_search(spark):
    from strandgraph.operators import search
    n = nodes(spark, [("p", "class", "PermissionEngine", "PermissionEngine", "a.ts", "typescript", 1, None)])
    r = refs(spark, [("x", "permissionEngine.check", "calls", 1, "b.ts", "typescript"), ("x", "other.check", "calls", 1, "b.ts", "typescript")])
    assert [x["reference_name"] for x in resolve.existing(n, r).collect()] == ["permissionEngine.check"]
    assert search.SearchIndex.build(n).search("").count() == 0


def test_scan_rules(spark, tmp_path):
    for path, text in {"src/a.ts": "x", "node_modules/b.ts": "x", "src/c.txt": "x", "vendor/d.go": "x", "h/e.h": "class A { public: };"}.items():
        f = tmp_path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    assert {r["path"] for r in S.scan(spark, str(tmp_path)).collect()} == {"src/a.ts", "h/e.h"}
    read = {r["path"]: r["language"] for r in S.read_contents(spark, str(tmp_path), gitignore="!vendor/").collect()}
    assert read == {"src/a.ts": "typescript", "h/e.h": "cpp", "vendor/d.go": "go"}


def refs(spark, rows):
    return resolve.with_ref_id(as_refs(spark.createDataFrame(
        rows, "from_node_id string, reference_name string, reference_kind string, line int, file_path string, language string")))


def nodes(spark, rows):
    return as_nodes(spark.createDataFrame(
        rows, "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, return_type string"))


def test_decoys_give_no_edge(spark):
    n = nodes(spark, [("a", "class", "Battery", "Battery", "android/B.java", "java", 1, None),
                      ("f1", "function", "handler", "handler", "x/a.ts", "typescript", 1, None),
                      ("f2", "function", "handler", "handler", "y/b.ts", "typescript", 1, None)])
    r = refs(spark, [("q", "Battery", "references", 1, "src/x.ts", "typescript"),
                     ("q", "handler", "function_ref", 1, "z/c.ts", "typescript"), ("f1", "handler", "function_ref", 2, "x/a.ts", "typescript")])
    values = {x["ref_id"].split("|")[0]: x["target"] for x in resolve.function_value(n, r).collect()}
    assert values == {"f1": "f2"}  # two foreign handlers are ambiguous; a function is not its own callback
    assert resolve.exact_name(n, r.filter("reference_kind = 'references'")).count() == 0


def test_call_chain_and_supertypes(spark):
    n = nodes(spark, [("mk", "method", "make", "Factory::make", "a.java", "java", 1, "Child"), ("c", "class", "Child", "Child", "a.java", "java", 2, None),
                      ("p", "class", "Parent", "Parent", "a.java", "java", 3, None), ("m", "method", "go", "Parent::go", "a.java", "java", 4, None)])
    g = Graph(n, as_edges(spark.createDataFrame([("c", "p", "extends")], "source string, target string, kind string")))
    r = refs(spark, [("x", "Factory.make().go", "calls", 1, "b.java", "java"), ("y", "Child().go", "calls", 1, "b.java", "java"),
                     ("z", "Factory.make().stop", "calls", 1, "b.java", "java")])
    assert {x["ref_id"][0]: x["target"] for x in resolve.call_chain(g, r).collect()} == {"x": "m", "y": "m"}


def test_this_member_and_promotions(spark):
    n = nodes(spark, [("s", "method", "start", "A::start", "a.ts", "typescript", 1, None), ("t", "method", "tick", "A::tick", "a.ts", "typescript", 5, None),
                      ("A", "class", "A", "A", "a.ts", "typescript", 0, None), ("I", "interface", "I", "I", "a.ts", "typescript", 9, None)])
    g = Graph(n, as_edges(spark.createDataFrame([], "source string, target string, kind string")))
    r = refs(spark, [("s", "this.tick", "function_ref", 2, "a.ts", "typescript"), ("A", "I", "extends", 1, "a.ts", "typescript"), ("s", "A", "calls", 3, "a.ts", "typescript")])
    got = resolve.this_member(g, r)
    assert [(x["target"], x["confidence"]) for x in got.collect()] == [("t", 0.95)]
    answers = got.unionByName(resolve.exact_name(n, r.filter("reference_kind != 'function_ref'")))
    assert {(x["source"], x["target"], x["kind"]) for x in resolve.edges_from(g, r, answers).collect()} == {
        ("s", "t", "references"), ("A", "I", "implements"), ("s", "A", "instantiates")}


def test_import_paths_and_reexports(spark):
    files = sources.frame(spark, {
        "src/main.ts": "import { inner as mine } from './lib';\nimport * as util from '@/util';\nmine();\nutil.help();\n",
        "src/lib/index.ts": "export { deep as inner } from './deep';\nexport * from '../util';\n",
        "src/lib/deep.ts": "export function deep() {\n}\n", "src/util.ts": "export function help() {\n}\n"})
    paths = {(r["file_path"], r["source"]): r["target_path"] for r in imports.resolve_paths(
        imports.mappings(files).unionByName(imports.reexports(files).selectExpr(
            "file_path", "language", "'' as local_name", "source", "exported_name", "false as is_default", "false as is_namespace")), files).collect()}
    assert paths[("src/main.ts", "./lib")] == "src/lib/index.ts" and paths[("src/main.ts", "@/util")] == "src/util.ts"
    assert paths[("src/lib/index.ts", "../util")] == "src/util.ts"
    g = build(files)
    assert {("main.ts", "deep"), ("main.ts", "help")} <= linked(g, "calls")


def test_text_rules(spark):
    files = sources.frame(spark, {
        "bus.js": "function onSaved() {\n}\nfunction setup(bus) {\n  bus.on('saved', onSaved);\n}\nfunction save(bus) {\n  bus.emit('saved');\n}\n",
        "app.go": 'package a\n\nfunc (c *Ctx) Next() {\n\tc.handlers[c.index](c)\n}\n\nfunc auth() {\n}\n\nfunc setup(r *E) {\n\tr.Use(auth)\n}\n',
        "view.jsx": "function Child() {\n  return null;\n}\nfunction Page() {\n  return <Child />;\n}\n",
        "list.swift": "func run() {\n  validators.forEach { $0() }\n}\nfunc add(v: V) {\n  validators.append(v)\n}\n"})
    g = build(files)
    rules = {(r["metadata"]["synthesizedBy"]) for r in g.edges.filter("provenance = 'heuristic'").select("metadata").collect()}
    names = {r.id: r.name for r in g.nodes.collect()}
    seed = lambda name: g.seeds(F.col("name") == name)
    assert "save" in {names[r.caller] for r in traversal.callers(g, seed("onSaved")).collect()}
    assert "onSaved" in {names[r.callee] for r in traversal.callees(g, seed("save")).collect()}
    reached = {names[r.id]: (r.depth, names[r.parent]) for r in traversal.callers_within(g, seed("onSaved"), 1).collect()}
    assert reached["save"] == (1, "onSaved") and not any(i.startswith("channel:") for i in reached)
    assert not traversal.frontier(g.adjacency("both"), seed("save")).filter("id like 'channel:%'").count()
    assert {"event-emitter", "gin-middleware-chain", "jsx-render", "closure-collection"} <= rules


def test_rules_without_text(spark):
    rows = [("st", "struct", "Svc", "Svc", "a/svc.go", "go", 1, None), ("st.A", "method", "A", "Svc::A", "a/other.go", "go", 1, None),
            ("if", "interface", "I", "I", "b.go", "go", 1, None), ("if.A", "method", "A", "I::A", "b.go", "go", 2, None),
            ("x", "method", "find", "com.x.UserMapper::find", "m.xml", "xml", 3, None), ("j", "method", "find", "UserMapper::find", "U.java", "java", 4, None),
            ("f1", "file", "F.dfm", "F.dfm", "F.dfm", "pascal", 1, None), ("f2", "file", "F.pas", "F.pas", "F.pas", "pascal", 1, None),
            ("pg", "component", "P", "P", "r/+page.svelte", "svelte", 1, None), ("ld", "function", "load", "load", "r/+page.server.ts", "typescript", 2, None),
            ("fabric-component:1", "component", "Map", "Map", "M.ts", "typescript", 1, None), ("nv", "class", "MapView", "MapView", "M.kt", "kotlin", 1, None),
            ("expo-module:a", "method", "go", "M::go", "a.kt", "kotlin", 1, None), ("expo-module:b", "method", "go", "M::go", "a.swift", "swift", 1, None)]
    g = Graph(nodes(spark, rows), as_edges(spark.createDataFrame([("if", "if.A", "contains")], "source string, target string, kind string")))
    got = {(r["source"], r["target"], r["kind"]) for r in synth.synthesize(g).collect()}
    assert got == {("st", "st.A", "contains"), ("st", "if", "implements"), ("j", "x", "calls"), ("f2", "f1", "references"),
                   ("pg", "ld", "references"), ("fabric-component:1", "nv", "calls"), ("expo-module:a", "expo-module:b", "calls"),
                   ("expo-module:b", "expo-module:a", "calls"), ("if.A", "st.A", "calls")}


def test_superset_pairs_against_brute_force(spark):
    have = {"o1": "abc", "o2": "ab", "o3": "bcd", "o4": "d"}
    want = {"w1": "ab", "w2": "d", "w3": "abcd", "w4": "bc", "w5": "e"}
    h = spark.createDataFrame([(o, i) for o, s in have.items() for i in s], "owner string, item string")
    w = spark.createDataFrame([(o, i) for o, s in want.items() for i in s], "id string, item string")
    got = {(r["owner"], r["id"]) for r in synth.superset_pairs(h, w).collect()}
    assert got == {(o, i) for o, s in have.items() for i, t in want.items() if set(t) <= set(s)}


def test_routes_of_frameworks(spark):
    files = sources.frame(spark, {
        "server.js": "const express = require('express');\napp.get('/a/:id', auth, show);\nfunction show() {\n}\n",
        "cats.ts": "import { Get } from '@nestjs/common';\n@Controller('cats')\nexport class Cats {\n  @Get('all')\n  list() {\n  }\n}\n",
        "U.java": "import org.springframework.web;\n@RequestMapping(\"/api\")\npublic class U {\n  @GetMapping(\"/u\")\n  public String u() {\n  }\n}\n",
        "main.go": 'package m\nimport "github.com/gin-gonic/gin"\nfunc r(g *E) {\n\tg.GET("/ping", ping)\n}\nfunc ping() {\n}\n',
        "src/routes/blog/[slug]/+page.svelte": "<p/>"})
    got = {r["name"] for r in build(files).nodes.filter("kind = 'route'").select("name").collect()}
    assert {"GET /a/:id", "GET /cats/all", "GET /api/u", "GET /ping", "/blog/:slug"} <= got
    assert set(FW.detect(files)) >= {"express", "nestjs", "spring", "go-http"}


def test_call_chains_give_way_to_longer_ones_only(spark):
    from strandgraph.operators import context

    edges = [(a, b) for chain in ("abcde", "pqr", "xyz") for a, b in zip(chain, chain[1:])] + [("a", "q")]
    nodes = as_nodes(spark.createDataFrame([(i, "function", i, "a.py", "python") for i in "abcdepqrxyz"], "id string, kind string, name string, file_path string, language string")).withColumn(
        "is_root", F.col("id").isin(*"acepqrxz"))
    ctx = context.Context(nodes, spark.createDataFrame([(a, b, "calls") for a, b in edges], "source string, target string, kind string"), "high")
    found = ["".join(r.path) for r in context.call_paths(ctx, keep=10).collect()]
    assert found == ["abcde", "pqr", "aqr", "xyz"] or sorted(found) == ["abcde", "aqr", "pqr", "xyz"]
    assert ["".join(r.path) for r in context.call_paths(ctx, keep=1).collect()][0] in ("abcde", "aqr", "pqr")


def test_answers_carry_columns_of_their_references(spark):
    """Ten lines apart counts more than a smaller id, equal distances go to the smaller id, beyond the reach the smallest wins."""
    defs = [("f:a", "run", 100), ("f:b", "run", 120), ("f:c", "run", 900), ("f:d", "other::run", 901)]
    nodes = as_nodes(spark.createDataFrame(
        [(i, "function", "run" if n == "run" else "go", n, "src/a.ts", "typescript", at) for i, n, at in defs],
        "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int"))
    lines = [("x", 119), ("y", 110), ("z", 895), ("far", 5000), ("edge", 399), ("none", None)]
    refs = resolve.with_ref_id(as_refs(spark.createDataFrame(
        [(i, "run", "calls", n, "src/a.ts", "typescript") for i, n in lines],
        "from_node_id string, reference_name string, reference_kind string, line int, file_path string, language string")))
    got = resolve.exact_name(nodes, refs, ["from_node_id", "line"])
    want = {("x", 119): "f:b", ("y", 110): "f:a", ("z", 895): "f:c", ("far", 5000): "f:a", ("edge", 399): "f:a", ("none", None): "f:a"}
    assert {(r["from_node_id"], r["line"]): r["target"] for r in got.collect()} == want
    whole = resolve.resolve(Graph(nodes, as_edges(spark.createDataFrame([], "source string, target string, kind string"))), refs, keep=resolve.EDGE_OF)
    assert {r["from_node_id"]: r["target"] for r in whole.collect()} == {k[0]: v for k, v in want.items()}
    g = Graph(nodes, None)
    bare = resolve.edges_from(g, refs, whole.select(*resolve.OUT))
    carried = resolve.edges_from(g, refs, whole)
    assert sorted(map(str, bare.collect())) == sorted(map(str, carried.collect()))
    # Answers that carry their references' columns are not joined with them again.
    exact = resolve.edges_from(g, refs, resolve.exact_name(nodes, refs, resolve.EDGE_OF))
    plan = exact._jdf.queryExecution().analyzed().toString()
    assert "ref_id" not in "".join(x for x in plan.split("\n") if "Join" in x)
