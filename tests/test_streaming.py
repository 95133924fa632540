"""Debounced change streams and catch-up syncs."""

import datetime as dt
import json

from pyspark.sql import functions as F

from strandgraph.operators import ordered
from strandgraph.streaming import watch


def write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def at(sec):
    return (dt.datetime(2024, 1, 1) + dt.timedelta(seconds=sec)).isoformat()


def test_bounds():
    assert [watch.debounce_ms(v) for v in (None, "x", 5, 99_999, "500")] == [2000, 2000, 100, 60_000, 500]


def test_bursts_on_a_stream(spark, tmp_path):
    src = tmp_path / "in"
    write(src, "a.json", [{"project": "p", "path": "a", "ts": at(s)} for s in (0, 1, 2)] + [{"project": "p", "path": "b", "ts": at(10)}])
    write(src, "b.json", [{"project": "p", "path": "z", "ts": at(500)}])
    stream = watch.bursts(watch.change_stream(spark, str(src)))
    out = stream.writeStream.format("memory").queryName("bursts").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    out.awaitTermination(120)
    rows = {(r["project"], r["events"]) for r in spark.table("bursts").collect()}
    assert rows == {("p", 3), ("p", 1)}


def test_sync_sees_each_path_once(spark, tmp_path):
    src, seen = tmp_path / "in", []
    write(src, "a.json", [{"project": "p", "path": p, "ts": at(i)} for i, p in enumerate("aab")])
    q = watch.run_sync(watch.change_stream(spark, str(src)), lambda df, n: seen.extend(r["path"] for r in df.collect()),
                       str(tmp_path / "cp"), available_now=True)
    q.awaitTermination(120)
    assert sorted(seen) == ["a", "b"]


def test_islands_across_buckets(spark):
    df = spark.createDataFrame([("k", 0, 3), ("k", 9, 10), ("k", 11, 30), ("k", 24, 25), ("k", 40, 41)], "k string, s int, e int")
    rows = ordered.islands(df, ["k"], F.col("s"), F.col("e"), gap=2, bucket=10).orderBy("start").collect()
    assert [(r["start"], r["end"], r["n"]) for r in rows] == [(0, 3, 1), (9, 30, 3), (40, 41, 1)]
