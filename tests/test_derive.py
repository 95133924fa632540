"""Edges kept up to date by changes, against edges derived anew from the whole graph."""

from strandgraph.graph import Graph
from strandgraph.operators import derive, resolve
from strandgraph.schema import as_edges, as_nodes, as_refs
from strandgraph.sources.supports import SupportLog

NODE = "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, end_line int"
REF = "from_node_id string, reference_name string, reference_kind string, line int, file_path string, language string"


def graph(spark, defs, calls):
    """Definitions (file, kind, qualified name, line) and references (file, holder, name, kind, line) of one language."""
    ident = {(f, q): f"{f}:{q}:{n}" for f, _, q, n in defs}
    nodes = as_nodes(spark.createDataFrame(
        [(ident[f, q], kind, q.split("::")[-1], q, f, "java", n, n + 5) for f, kind, q, n in defs], NODE))
    inside = [(ident[f, q.rsplit("::", 1)[0]], ident[f, q], "contains", n) for f, _, q, n in defs if "::" in q]
    edges = as_edges(spark.createDataFrame(inside, "source string, target string, kind string, line int"))
    refs = as_refs(spark.createDataFrame([(ident[f, h], name, kind, n, f, "java") for f, h, name, kind, n in calls], REF))
    return Graph(nodes, edges, None, resolve.with_ref_id(refs))


DEFS = [
    ("src/Base.java", "class", "Base", 1), ("src/Base.java", "method", "Base::open", 3), ("src/Base.java", "method", "Base::close", 9),
    ("src/Mid.java", "class", "Mid", 1), ("src/Leaf.java", "class", "Leaf", 1), ("src/Leaf.java", "method", "Leaf::run", 4),
    ("lib/Util.java", "class", "Util", 1), ("lib/Util.java", "method", "Util::open", 2), ("lib/Util.java", "method", "Util::pack", 20),
    ("app/Main.java", "class", "Main", 1), ("app/Main.java", "method", "Main::main", 2), ("app/Other.java", "class", "Other", 1),
]
CALLS = [
    ("src/Mid.java", "Mid", "Base", "extends", 1), ("src/Leaf.java", "Leaf", "Mid", "extends", 1), ("src/Leaf.java", "Leaf::run", "open", "calls", 5),
    ("app/Main.java", "Main::main", "Util.pack", "calls", 3), ("app/Main.java", "Main::main", "Util.pack", "calls", 4),
    ("app/Main.java", "Main::main", "Leaf.open", "calls", 5), ("app/Main.java", "Main::main", "close", "calls", 6),
    ("app/Main.java", "Main::main", "missing", "calls", 7), ("app/Main.java", "Main::main", "Other", "instantiates", 8),
]


def rows(df):
    return sorted(tuple(r) for r in df.select(*derive.EDGE, "n").collect())


def whole(g):
    return rows(derive.supports(g, g.refs).unionByName(derive.structure(g)))


def test_changes_lead_to_the_graph_built_anew(spark, tmp_path):
    log, before = SupportLog(spark, str(tmp_path / "log")), graph(spark, DEFS, CALLS)
    log.create(derive.supports(before, before.refs).unionByName(derive.structure(before)))
    assert rows(log.supports()) == whole(before)
    # Base moves down and loses one method, a missing name appears elsewhere, one of two equal calls goes.
    defs = [(f, k, q, n + 10 if f == "src/Base.java" else n) for f, k, q, n in DEFS if q != "Base::close"]
    defs += [("lib/New.java", "class", "New", 1), ("lib/New.java", "method", "New::missing", 2)]
    steps = [
        (defs, CALLS, ["src/Base.java", "lib/New.java"]),
        ([d for d in defs if d[0] != "lib/Util.java"], CALLS[:4] + CALLS[5:], ["lib/Util.java", "app/Main.java"]),
    ]
    for seq, (d, c, paths) in enumerate(steps, 1):
        after = graph(spark, d, c)
        change = derive.change(before, after, spark.createDataFrame([(p,) for p in paths], "path string"))
        want = whole(after)
        log.append(change, seq)
        assert rows(log.supports()) == want
        if seq == 1:
            log.append(change, seq)  # repeated after a failure
            assert rows(log.supports()) == want
            assert any("New::missing" in r[1] for r in want) and not any("Base::close" in r[1] for r in want)
            assert not any("Util::pack" in str(r) or "Other" in str(r) for r in log.part(1).collect())  # untouched
        before = after


def test_empty_states(spark):
    empty = Graph(as_nodes(spark.createDataFrame([], NODE)), as_edges(spark.createDataFrame([], "source string, target string, kind string")),
                  None, resolve.with_ref_id(as_refs(spark.createDataFrame([], REF))))
    full = graph(spark, DEFS[:3], [("src/Base.java", "Base::open", "close", "calls", 4), ("src/Base.java", "Base", None, "calls", None)])
    paths = spark.createDataFrame([("src/Base.java",), ("src/Base.java",)], "path string")
    by_name = lambda g, refs: resolve.exact_name(g.nodes, refs)
    there = rows(derive.change(empty, full, paths, by_name))
    back = rows(derive.change(full, empty, paths, by_name))
    assert there and there == sorted((*r[:4], -r[4]) for r in back)
