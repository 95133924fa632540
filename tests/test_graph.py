"""Traversal and structure on small hand-made and random graphs."""

import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from strandgraph.graph import Graph
from strandgraph.operators import rank, structure, traversal
from strandgraph.schema import as_edges, as_nodes


def graph(spark, edges, nodes=None):
    names = nodes or {n: "function" for e in edges for n in e[:2]}
    n = spark.createDataFrame([(i, k, i, f"{i}.ts", "typescript") for i, k in names.items()] or [("x", "function", "x", "x.ts", "typescript")],
                              "id string, kind string, name string, file_path string, language string")
    rows = [(s, t, k if k else "calls", 1) for s, t, *rest in edges for k in [rest[0] if rest else "calls"]]
    e = spark.createDataFrame(rows, "source string, target string, kind string, line int")
    return Graph(as_nodes(n), as_edges(e))


def seed(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def depths(df):
    return {r["id"]: r["depth"] for r in df.collect()}


def test_self_loops_and_parallel_edges(spark):
    g = graph(spark, [("a", "a"), ("a", "b"), ("a", "b")])
    assert traversal.callers(g, seed(spark, "a")).count() == 0
    assert traversal.callers(g, seed(spark, "b")).count() == 2
    assert depths(traversal.bfs(g, seed(spark, "a"))) == {"a": 0, "b": 1}


def test_missing_seed_and_no_edges(spark):
    g = graph(spark, [("a", "b")])
    assert depths(traversal.callers_within(g, seed(spark, "nope"), 3)) == {}


def test_random_bfs_matches_plain_python(spark):
    rng = random.Random(7)
    edges = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(90)]
    adj = defaultdict(set)
    for s, t in edges:
        adj[s].add(t)
    want, queue = {"n0": 0}, deque(["n0"])
    while queue:
        at = queue.popleft()
        for nxt in adj[at]:
            if nxt not in want:
                want[nxt] = want[at] + 1
                queue.append(nxt)
    g = graph(spark, edges + [("n0", "n0")])
    assert depths(traversal.bfs(g, seed(spark, "n0"))) == want


def test_long_chain_compacts_levels(spark):
    n = 16
    g = graph(spark, [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(n)])
    assert max(depths(traversal.bfs(g, seed(spark, "c00"))).values()) == n


def test_shortest_path(spark):
    g = graph(spark, [("a", "b"), ("b", "d"), ("a", "c"), ("c", "d"), ("d", "e"), ("x", "y")])
    path = traversal.shortest_path(g, seed(spark, "a"), seed(spark, "e"))
    assert [r["id"] for r in path.orderBy("step").collect()] == ["a", "b", "d", "e"]
    assert traversal.shortest_path(g, seed(spark, "a"), seed(spark, "y")).count() == 0
    assert traversal.shortest_path(g, seed(spark, "a"), seed(spark, "a")).count() == 1


def test_impact_closes_containers_but_does_not_climb(spark):
    kinds = {"C": "class", "m1": "method", "m2": "method", "u": "function", "v": "function", "w": "function"}
    g = graph(spark, [("C", "m1", "contains"), ("C", "m2", "contains"), ("u", "m1"), ("v", "u"), ("w", "v")], kinds)
    assert depths(traversal.impact(g, seed(spark, "C"), 2)) == {"C": 0, "m1": 0, "m2": 0, "u": 1, "v": 2}
    assert depths(traversal.impact(g, seed(spark, "m1"), 1)) == {"m1": 0, "u": 1}


def test_ancestors_stop_on_cycles(spark):
    g = graph(spark, [("a", "b", "contains"), ("b", "a", "contains"), ("b", "c", "contains")])
    rows = {(r["id"], r["ancestor"]) for r in traversal.ancestors(g, seed(spark, "c")).collect()}
    assert rows == {("c", "b"), ("c", "a")}


def test_type_hierarchy_both_ways(spark):
    g = graph(spark, [("B", "A", "extends"), ("C", "B", "implements"), ("D", "C", "calls")])
    rows = {(r["id"], r["side"]) for r in traversal.type_hierarchy(g, seed(spark, "B")).collect()}
    assert rows == {("A", "up"), ("C", "down")}


@pytest.mark.parametrize("edges,want", [
    ([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d")], {"a": {"a", "b", "c"}, "d": {"d", "e"}}),
    ([("a", "b"), ("b", "c")], {}),
])
def test_cycles(spark, edges, want):
    pairs = spark.createDataFrame(edges, "src string, dst string")
    got = defaultdict(set)
    for r in structure.cycles(pairs).collect():
        got[r["component"]].add(r["id"])
    assert dict(got) == want


def test_relevance_with_salts_equals_without(spark):
    edges = [("hub", f"s{i}") for i in range(12)] + [("s0", "s1"), ("t", "u")]
    g = graph(spark, edges, {**{n: "function" for e in edges for n in e}, "alone": "function"})
    plain = {r["id"]: r["score"] for r in rank.relevance(g, seed(spark, "s0", "alone")).collect()}
    salted = {r["id"]: r["score"] for r in rank.relevance(g, seed(spark, "s0", "alone"), rows_per_salt=3).collect()}
    assert plain.keys() == salted.keys()
    assert all(abs(plain[k] - salted[k]) < 1e-12 for k in plain)
    assert abs(sum(plain.values()) - 1) < 1e-9 and plain["alone"] == 0.5 and plain["t"] == 0


def test_flow_chain_bridges_one_unnamed_hop(spark):
    g = graph(spark, [("a", "x"), ("x", "b"), ("b", "c"), ("a", "p"), ("p", "q"), ("q", "z")])
    rows = rank.flow_chain(g, seed(spark, "a", "b", "c", "z")).orderBy("step").collect()
    assert [r["id"] for r in rows] == ["a", "x", "b", "c"]


def test_dead_code_and_globs(spark):
    g = graph(spark, [("a", "b"), ("f", "c", "contains")])
    assert {r["id"] for r in structure.dead_code(g).collect()} == {"a", "f", "c"}
    assert structure.path_glob_regex("src/**/*.ts") == "src/.*/[^/]*\\.ts"
    assert {r["id"] for r in structure.by_qualified_name(g, "?").collect()} == {"a", "b", "c", "f"}
