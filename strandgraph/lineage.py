"""Cutting lineage in iterative jobs through tables in the shared checkpoint folder."""

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_CONF = "spark.checkpoint.dir"


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder named by the cluster; a local one only in local mode without a setting."""
    root = spark.conf.get(_CONF, None) or spark.sparkContext.getConf().get(_CONF, None)
    if root:
        return root.rstrip("/")
    root = spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_CONF} to a folder all executors share")
    root = tempfile.mkdtemp(prefix="strandgraph-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def cut(df: DataFrame, label: str = "step", folders: list[str] = ()) -> DataFrame:
    """Write `df` once and read it back.

    Unlike a checkpointed frame the result carries file-size statistics, so Catalyst
    broadcasts it in later joins only while it is below the broadcast threshold, and it
    survives the loss of any executor. `folders` are low-cardinality columns to partition by.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/strandgraph/{label}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*folders) if folders else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_measured(df: DataFrame, measures: dict[str, Column], condition: Column, label: str = "step") -> tuple[DataFrame, dict]:
    """Write the rows that meet a condition and measure all rows in the same pass."""
    seen = Observation()
    out = cut(df.observe(seen, *[m.alias(k) for k, m in measures.items()]).filter(condition), label)
    return out, seen.get


def unsent(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the graph and must not pass through the driver.

    The size of a written table is that of its files. Repeated values and columns that are not read make it many times
    smaller than its rows in memory, so Spark would still broadcast millions of nodes.
    """
    return df.hint("merge")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
