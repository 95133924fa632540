"""Packages, mounts, scopes and component files on small fixtures."""

import itertools

import pytest
from pyspark.sql import functions as F

import sources
from strandgraph.operators import mounts, ordered, packages, scopes
from strandgraph.sources.pipeline import build

PROJECT = {
    "lib/Tool.java": "package lib;\n\npublic class Tool {\n    public void work() {\n    }\n}\n",
    "lib/Saw.java": "package lib;\n\npublic class Saw extends Tool {\n    public void cut() {\n    }\n}\n",
    "lib/Other.java": "package lib;\n\npublic class Other {\n    public void work() {\n    }\n    public void cut() {\n    }\n}\n",
    "app/Use.java": "package app;\n\npublic class Use {\n    private Other t;\n\n    public void run(Saw s) {\n        s.cut();\n        t.work();\n"
                    "        Tool t = new Tool();\n        t.work();\n    }\n}\n",
    "web/Page.vue": "<template>\n  <Card @click=\"save\"/>\n</template>\n<script>\nfunction save() {\n  return 1;\n}\n</script>\n",
    "web/Card.vue": "<template>\n  <p/>\n</template>\n",
    "src/routes/+page.svelte": "<script>\n  export let data;\n</script>\n",
    "src/routes/+page.ts": "export function load() {\n  return 1;\n}\n",
    "db/UserMapper.java": "package db;\n\npublic interface UserMapper {\n    int findAll();\n}\n",
    "db/UserMapper.xml": "<mapper\n  namespace=\"db.UserMapper\">\n  <select id=\"findAll\">\n  </select>\n</mapper>\n",
    "ios/A.swift": "class AModule: Module {\n  func definition() {\n    Name(\"Alpha\")\n    AsyncFunction(\"go\") {\n    }\n  }\n}\n",
    "android/A.kt": "class AModule : Module() {\n  fun definition() {\n    Name(\"Alpha\")\n    AsyncFunction(\"go\") {\n    }\n  }\n}\n",
    "android/B.kt": "class BModule : Module() {\n  fun definition() {\n    Name(\"Beta\")\n    AsyncFunction(\"go\") {\n    }\n  }\n}\n",
    "kit/src/index.ts": "export function tool() {\n  return 1;\n}\n",
    "web/use.ts": "import { tool } from '@acme/kit';\n\nexport function call() {\n  return tool();\n}\n",
    "other/tool.ts": "export function tool() {\n  return 2;\n}\n",
}
MANIFESTS = {"kit/package.json": '{"name": "@acme/kit"}', "package.json": "not json", "x/Cargo.toml": None}


@pytest.fixture(scope="module")
def project(spark):
    manifests = spark.createDataFrame(list(MANIFESTS.items()), "path string, content string")
    return build(sources.frame(spark, PROJECT), manifests=manifests).materialised()


def links(g, **where):
    n = g.nodes.select("id", "qualified_name", "file_path", "language")
    e = g.edges
    for column, value in where.items():
        e = e.filter(F.col(column) == value)
    rows = e.join(n.toDF("source", "s", "sf", "sl"), "source").join(n.toDF("target", "t", "tf", "tl"), "target")
    return {(r["s"], r["t"], r["sf"], r["tf"]) for r in rows.collect()}


def test_receivers_by_declared_type(project):
    calls = {(s, t) for s, t, _, _ in links(project, kind="calls")}
    assert {("Use::run", "Saw::cut"), ("Use::run", "Other::work"), ("Use::run", "Tool::work")} <= calls
    assert ("Use::run", "Other::cut") not in calls


def test_component_files(project):
    comps = {(r["name"], r["file_path"]) for r in project.nodes.filter("kind = 'component'").collect()}
    assert {("Page", "web/Page.vue"), ("Card", "web/Card.vue"), ("+page", "src/routes/+page.svelte")} <= comps
    every = links(project)
    assert {("Page", "Card", "web/Page.vue", "web/Card.vue"), ("Page", "Page::save", "web/Page.vue", "web/Page.vue")} <= every
    assert ("+page", "load", "src/routes/+page.svelte", "src/routes/+page.ts") in every


def test_mapper_namespace_and_module_names(project):
    calls = links(project, kind="calls")
    assert ("UserMapper::findAll", "db.UserMapper::findAll", "db/UserMapper.java", "db/UserMapper.xml") in calls
    pairs = {(s, t, sf, tf) for s, t, sf, tf in calls if s.endswith("::go") and sf != tf}
    assert ("Alpha::go", "Alpha::go", "ios/A.swift", "android/A.kt") in pairs
    assert not any("B.kt" in sf + tf for _, _, sf, tf in pairs)


def test_workspace_package(project):
    assert ("call", "tool", "web/use.ts", "kit/src/index.ts") in links(project, kind="calls")


def test_manifest_roots(spark):
    texts = {"a/go.mod": "// x\nmodule example.org/m\n\ngo 1.2\n", "c/Cargo.toml": "[package]\nversion = \"1\"\nname = \"my-crate\"\n[deps]\nname = \"no\"\n",
             "w/package.json": '{"name": "@s/p"}', "w/tsconfig.json": '{"compilerOptions": {"baseUrl": "./src", "paths": {"@ui/*": ["ui/*"], "top": ["top.ts"]}}}',
             "e/go.mod": "", "b/package.json": "{", "n/go.mod": None, "z.txt": "module no"}
    df = spark.createDataFrame(list(texts.items()), "path string, content string")
    got = {tuple(r) for r in packages.manifest_roots(df).collect()}
    assert got == {("go", "example.org/m", "a", ""), ("rust", "my_crate", "c/src", ""), ("web", "@s/p", "w", ""),
                   ("web", "@ui", "w/src/ui", "w"), ("web", "top", "w/src/top.ts", "w")}
    assert packages.manifest_roots(df.limit(0)).count() == 0


def test_package_paths(spark):
    roots = spark.createDataFrame([("rust", "k", "k/src", ""), ("go", "m.org/a", "", ""), ("web", "@", "src", ""), ("web", "@", "in/src", "in"),
                                   ("web", "@/x", "deep", ""), ("go", "m.org/a/b", "bb", "")], "family string, prefix string, folder string, within string")
    files = spark.createDataFrame([("k/src/net/mod.rs", "rust"), ("k/src/net/tcp.rs", "rust"), ("b/c/z_test.go", "go"), ("b/c/y.go", "go"), ("bb/d/x.go", "go"),
                                   ("src/q.ts", "typescript"), ("in/src/q.ts", "typescript"), ("deep/y.ts", "typescript"), (None, "go")], "path string, language string")
    uses = [("r.rs", "rust", "k::net::Conn"), ("r.rs", "rust", "k::net::tcp::open"), ("m.go", "go", "m.org/a/b/c"), ("m.go", "go", "m.org/a/b/d"),
            ("in/p/u.ts", "typescript", "@/q"), ("o/u.ts", "typescript", "@/q"), ("o/u.ts", "typescript", "@/x/y"), ("o/u.ts", "typescript", "@x/q"),
            ("o/u.py", "python", "k"), ("o/u.ts", "typescript", None), (None, "go", "m.org/a/b/c")]
    df = spark.createDataFrame(uses + uses[:2], "file_path string, language string, source string")
    got = {(r["file_path"], r["source"]): (r["target_path"], r["prefix"]) for r in packages.package_paths(df, roots, files).collect()}
    assert got == {("r.rs", "k::net::Conn"): ("k/src/net/mod.rs", "k"), ("r.rs", "k::net::tcp::open"): ("k/src/net/tcp.rs", "k"),
                   ("m.go", "m.org/a/b/c"): ("b/c/y.go", "m.org/a"), ("m.go", "m.org/a/b/d"): ("bb/d/x.go", "m.org/a/b"),
                   ("in/p/u.ts", "@/q"): ("in/src/q.ts", "@"), ("o/u.ts", "@/q"): ("src/q.ts", "@"), ("o/u.ts", "@/x/y"): ("deep/y.ts", "@/x")}


def ways(rows):
    """All simple ways to a root, one step at a time."""
    rows = set(rows)
    ids = {i for i, _, _ in rows}
    out, queue = [], [((i,), p, x or "") for i, p, x in rows]
    while queue:
        way, up, path = queue.pop()
        if up is None or up not in ids:
            out.append((way[0], up if up is not None else way[-1], path, len(way)))
        elif up not in way:
            queue += [(way + (up,), p, (x or "") + path) for i, p, x in rows if i == up]
    return sorted(out)


def test_mounts(spark):
    chain = [(f"c{i}", f"c{i - 1}" if i else None, f"/{i}") for i in range(21)]
    rows = chain + [("a", "c3", "/a"), ("a", "c7", "/b"), ("a", "c7", "/b"), ("b", "a", None), ("x", "y", "/x"), ("y", "x", "/y"), ("z", "x", "/z"),
                    ("s", "s", "/s"), ("w", "z", "/w"), ("w", "c2", "/v"), ("o", "gone", "/o"), ("y", "c1", "/in"), (None, "a", "/n")]
    df = spark.createDataFrame(rows, "id string, parent string, prefix string")
    got = sorted((r["id"], r["root"], r["path"], r["depth"]) for r in mounts.compose(df).collect())
    assert got == ways([r for r in rows if r[0]])
    assert mounts.compose(df.limit(0)).count() == 0


def test_as_of(spark):
    points = [(k, o, n) for n, (k, o) in enumerate(itertools.product(["a", "b", None], [None, 0, 1, 5, 9000, 40000]))]
    facts = [("a", 1, "x"), ("a", 1, "u"), ("a", 5000, "y"), ("b", 9000, "z"), ("b", None, "n"), ("c", 0, "c")]
    p = spark.createDataFrame(points, "k string, o long, n int")
    f = spark.createDataFrame(facts, "k string, o long, v string")
    got = {r["n"]: r["v"] for r in ordered.as_of(p, f, ["k"], "o", "v").collect()}

    def plain(k, o):
        seen = [(fo, [fv]) for fk, fo, fv in facts if fk == k and fo is not None and o is not None and fo <= o]
        return None if k is None or not seen else min(fv for fk, fo, fv in facts if fk == k and fo == max(seen)[0])

    assert got == {n: plain(k, o) for k, o, n in points}


def test_declarations(spark):
    text = {"a.cpp": ["Foo* a = 0;", "ns::Bar<int> b;", "auto c = new Baz();", "return d;", "auto e = std::make_unique<Q>(1);", "const W &f = g();"],
            "b.java": ["List<String> a;", "private a.b.Foo c, d;", "void f(Foo[] x, int y) {", "var z = new Zed();"],
            "c.kt": ["val a: Foo = b()", "val c = Bar(1)", "class K(private val d: Dep)"]}
    rows = [(p, {"cpp": "cpp", "java": "java", "kt": "kotlin"}[p.split(".")[1]], i, t) for p, ts in text.items() for i, t in enumerate(ts, 1)]
    lines = spark.createDataFrame(rows, "path string, language string, line int, text string")
    none = spark.createDataFrame([], "id string, kind string, file_path string, start_line int, end_line int")
    got = {(r["scope"], r["name"], r["type_name"]) for r in scopes.declarations(lines, none).collect()}
    want = {("file:a.cpp", n, t) for n, t in [("a", "Foo"), ("b", "Bar"), ("c", "Baz"), ("e", "Q"), ("f", "W")]}
    want |= {("file:b.java", n, t) for n, t in [("a", "List"), ("c", "Foo"), ("x", "Foo"), ("z", "Zed")]}
    want |= {("file:c.kt", n, t) for n, t in [("a", "Foo"), ("c", "Bar"), ("d", "Dep")]}
    assert got == want
