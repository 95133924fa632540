"""Edges of a store are dealt to buckets, hubs over several keys."""

import pytest
from pyspark.sql import functions as F

from strandgraph.operators import links


@pytest.mark.parametrize("cells", [1, 3, 1 << 16])
def test_hubs_are_counted_in_full_cells_only(spark, monkeypatch, cells):
    monkeypatch.setattr(links, "_CELLS", cells)
    rows = [("hub", f"t{i}") for i in range(11)] + [("x", "t1")] * 3 + [(f"s{i}", "t1") for i in range(30)] + [(None, "t2")] * 2
    df = spark.createDataFrame(rows, "source string, target string")
    assert [tuple(r) for r in links.hub_slots(df, "source", 4).collect()] == [("hub", 3)]
    assert [tuple(r) for r in links.hub_slots(df, "target", 4).collect()] == [("t1", 9)]


def test_edges_are_dealt_one_bucket_a_partition(spark):
    edges = spark.createDataFrame([(f"n{i % 40}", f"n{(i * 7) % 40}", "calls", i, 0) for i in range(80)],
                                  "source string, target string, kind string, line int, col int")
    hubs = links.hub_slots(edges, "source", 1)
    rows = links.dealt(edges, "source", "target", hubs, 8)
    assert rows.columns == ["key", *edges.columns] and rows.count() == 80
    at = rows.select("key", F.spark_partition_id().alias("part"), F.pmod(F.hash("key"), F.lit(8)).alias("bucket"))
    assert at.filter("part != bucket").isEmpty()
