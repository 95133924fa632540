"""Walks over edges at rest in buckets, against the same walks over plain tables."""

import pytest
from pyspark.sql import functions as F

from strandgraph.graph import Graph
from strandgraph.operators import links, traversal
from strandgraph.schema import as_edges, as_nodes
from strandgraph.sources.tables import GraphStore


def edge_rows():
    """A hub that calls 60 nodes and is called by 40, a tree of containers, a cycle, a loop and parallel edges."""
    rows = [("hub", f"n{i}", "calls", i) for i in range(60)] + [(f"m{i}", "hub", "references", i) for i in range(40)]
    rows += [("box", "hub", "contains", 1), ("box", "inner", "contains", 2), ("inner", "n3", "contains", 3)]
    return rows + [("n1", "n2", "calls", 5), ("n2", "n1", "calls", 5), ("n2", "n2", "calls", 6), ("n1", "n2", "calls", 7), ("n2", "hub", "calls", None)]


@pytest.fixture(scope="module")
def graphs(spark, tmp_path_factory):
    rows = edge_rows()
    ids = sorted({r[0] for r in rows} | {r[1] for r in rows})
    nodes = as_nodes(spark.createDataFrame([(i, "class" if i in ("box", "inner") else "function", i, "a.ts", "typescript") for i in ids],
                                           "id string, kind string, name string, file_path string, language string"))
    plain = Graph(nodes, as_edges(spark.createDataFrame(rows, "source string, target string, kind string, line int")))
    store = GraphStore(spark, str(tmp_path_factory.mktemp("store")), hub_edges=9)
    version = store.write(plain)
    spark.sql(f"drop table strandgraph_{version}_edges_in")  # another session's catalog does not know it
    return plain, store.read()


WALKS = [
    lambda g, s: traversal.bfs(g, s, max_depth=3),
    lambda g, s: traversal.bfs(g, s, "both", max_depth=2),
    lambda g, s: traversal.bfs(g, s, "incoming", ["calls", "references"], ["function"]),
    lambda g, s: traversal.callers_within(g, s, 2),
    lambda g, s: traversal.impact(g, s, 3),
    lambda g, s: traversal.shortest_distance(g, s),
    lambda g, s: traversal.shortest_path(g, s, g.seeds(F.col("id") == "n59")).withColumnRenamed("step", "depth"),
]


@pytest.mark.parametrize("few, start", [(500, "m7"), (500, "none"), (0, "box"), (0, "n2")])
def test_walks_are_the_same(spark, graphs, monkeypatch, few, start):
    monkeypatch.setattr(links, "FEW", few)
    plain, stored = graphs
    assert stored.edges.count() == len(edge_rows())
    for walk in WALKS:
        want, got = ([tuple(r) for r in walk(g, g.seeds(F.col("id") == start)).select("id", "depth").collect()] for g in graphs)
        assert sorted(got) == sorted(want)


def test_hubs_lie_in_slots_of_bounded_size(graphs):
    out = graphs[1].stored.out.groupBy("key", "source").count().collect()
    assert {r["source"] for r in out if "\u0001" in r["key"]} == {"hub"}
    assert sum(r["count"] for r in out if r["source"] == "hub") == 60 and max(r["count"] for r in out) < 25


def test_edges_stay_where_they_are(spark, graphs, monkeypatch):
    """A large frontier is shuffled to the buckets; a small one prunes them."""
    level = graphs[1].nodes.select("id")
    monkeypatch.setattr(links, "FEW", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = graphs[1].links("outgoing").leaving(level)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scan = next(x for x in plan.split("\n") if "edges_out[" in x)
    assert "Bucketed: true" in scan
    joined = plan[:plan.index("edges_out[")]
    assert "SortMergeJoin" in joined and "Exchange" not in joined
    monkeypatch.setattr(links, "FEW", 500)
    plan = graphs[1].links("outgoing").leaving(level.filter("id = 'n1'"))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "PushedFilters: [In(key" in plan or "EqualTo(key" in plan
