"""Sieves keep rows without a partner out of shuffles and change no result."""

import pytest
from pyspark.sql import functions as F

from strandgraph.graph import Graph
from strandgraph.lineage import cut
from strandgraph.operators import links, sieve, sync, traversal
from strandgraph.schema import as_edges, as_nodes


@pytest.fixture
def always(spark, monkeypatch):
    """Sieves of any size, and no side that Spark broadcasts by itself."""
    monkeypatch.setattr(sieve, "LEAST", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def pairs(spark, rows):
    return spark.createDataFrame(rows, "source string, target string")


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


ROWS = [("a", "b"), ("a", "b"), ("b", "c"), ("c", "d"), (None, "d"), ("e", None), (None, None), ("d", "a"), ("d", "e")]


@pytest.mark.parametrize("ids", [["a"], ["c", "c", "x"], [None, "e"], []])
def test_without_is_two_anti_joins(spark, always, ids):
    gone = cut(spark.createDataFrame([(i,) for i in ids], "id string"), "gone")
    want = [r for r in ROWS if not any(x is not None and x in ids for x in r)]
    assert got(sieve.without(pairs(spark, ROWS), gone, "source", "target").select("source", "target")) == sorted(want, key=str)


def test_every_id_passes_and_few_others(spark, always):
    ids = cut(spark.range(5000).selectExpr("concat('order:', id) as id"), "ids")
    one = sieve.Sieve.of(ids)
    rows = spark.range(10000).selectExpr("concat('order:', id) as source", "id < 5000 as own")
    n = {r["own"]: r["count"] for r in one.passing(rows, "source").groupBy("own").count().collect()}
    assert n[True] == 5000 and n.get(False, 0) < 1000


def test_small_sets_have_none(spark):
    assert sieve.Sieve.of(cut(spark.range(10).selectExpr("cast(id as string) as id"), "ids")) is None


@pytest.fixture
def graph(spark):
    rows = [(f"n{i}", f"n{(i * 7) % 40}", "calls", i) for i in range(80)] + [("n1", "n1", "contains", 1), ("n2", None, "calls", 1)]
    nodes = spark.createDataFrame([(f"n{i}", "function", f"n{i}", f"f{i % 5}.ts", "go") for i in range(80)],
                                  "id string, kind string, name string, file_path string, language string")
    return Graph(as_nodes(nodes), as_edges(spark.createDataFrame(rows, "source string, target string, kind string, line int")))


def test_remove_files_sieves_edges_before_they_move(spark, graph, always):
    left = sync.remove_files(graph, spark.createDataFrame([("f1.ts",), ("f1.ts",)], "path string"))
    gone = {f"n{i}" for i in range(80) if i % 5 == 1}
    want = [r for r in graph.edges.select("source", "target", "line").collect() if r[0] not in gone and r[1] not in gone]
    assert got(left.edges.select("source", "target", "line")) == sorted(map(tuple, want), key=str)
    assert left.nodes.count() == 64
    assert "BroadcastHashJoin" in plan(left.edges)


@pytest.mark.parametrize("direction", ["outgoing", "incoming", "both"])
def test_a_walk_sieves_links_before_they_move(spark, graph, monkeypatch, direction):
    seeds = graph.seeds(F.col("id").isin("n3", "n4"))
    want = got(traversal.bfs(graph, seeds, direction, max_depth=3))
    monkeypatch.setattr(sieve, "LEAST", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert got(traversal.bfs(graph, seeds, direction, max_depth=3)) == want
        assert "BroadcastHashJoin" in plan(graph.links(direction).written().leaving(cut(seeds, "seeds")))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
