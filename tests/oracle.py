"""Compares registered queries with their oracle SQL: `python tests/oracle.py [sf] [name ...]`."""

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session(cpus: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("strandgraph")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def cell(v):
    if isinstance(v, float):
        return f"{v:.6f}"
    if isinstance(v, bool) or v is None:
        return str(v)
    return str(v)


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, name: str, fn, sql: str | None):
    t0 = time.time()
    df = fn(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return True, f"{name}: {len(rows)} rows, no oracle, {t1 - t0:.1f}s"
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    note = f"{name}: spark {len(rows)} rows {t1 - t0:.1f}s, oracle {len(want)} rows {t2 - t1:.1f}s"
    if sorted(cols) != sorted(df.columns):
        return False, f"{note} COLUMNS {sorted(df.columns)} != {sorted(cols)}"
    a, b = canon(df.columns, rows), canon(cols, want)
    if a != b:
        left = [x for x in a if x not in set(b)][:3]
        right = [x for x in b if x not in set(a)][:3]
        return False, f"{note} VALUES spark-only {left} oracle-only {right}"
    return True, note


def main():
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = session(), connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    bad = 0
    for name in names:
        try:
            ok, note = compare(spark, con, sf_dir, name, queries[name], oracle.get(name))
        except Exception as e:  # report and go on with the next query
            ok, note = False, f"{name}: {type(e).__name__} {str(e)[:900]}"
        bad += not ok
        print(("ok   " if ok else "FAIL ") + note, flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    sys.exit(1 if bad else 0)


if __name__ == "__main__":
    main()
