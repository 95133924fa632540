"""Supports of derived edges in shared storage: a base and the signed changes since."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lineage import union_all
from ..operators.derive import EDGE

_ROWS = "source string, target string, kind string, line int, n long"
_LOG = T.StructType([T.StructField("folder", T.StringType()), T.StructField("seq", T.LongType())])


class SupportLog:
    """Immutable folders of (source, target, kind, line, n) and a log that names those that count.

    A sync appends the rows that changed and nothing else. A folder counts once its log entry is written,
    so a failed sync leaves no trace; entries of the same `seq` count once, so a repeated one does no harm.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _add(self, rows: DataFrame, seq: int) -> str:
        folder = f"part-{seq}-{uuid.uuid4().hex}"
        rows.select(*EDGE, F.col("n").cast("long").alias("n")).write.parquet(f"{self.root}/{folder}")
        self.spark.range(1).select(F.lit(folder).alias("folder"), F.lit(seq).cast("long").alias("seq")).write.mode(
            "append").json(f"{self.root}/log")
        return folder

    def create(self, supports: DataFrame) -> None:
        """The base: all edges with their supports."""
        self._add(supports, 0)

    def append(self, change: DataFrame, seq: int) -> None:
        """Signed supports of one sync; `seq` counts syncs from 1."""
        self._add(change, seq)

    def _folders(self) -> list[str]:
        log = self.spark.read.schema(_LOG).json(f"{self.root}/log")
        named = log.groupBy("seq").agg(F.min("folder").alias("folder")).orderBy("seq")
        return [r["folder"] for r in named.collect()]

    def part(self, seq: int) -> DataFrame:
        return self._read(self._folders()[seq])

    def _read(self, folder: str) -> DataFrame:
        return self.spark.read.schema(_ROWS).parquet(f"{self.root}/{folder}")

    def supports(self) -> DataFrame:
        """Edges of the present state with their supports. The base is not shuffled for edges no change names,
        as long as the changes are small enough to be broadcast."""
        base, *later = [self._read(f) for f in self._folders()]
        if not later:
            return base
        changes = union_all(later).groupBy(*EDGE).agg(F.sum("n").alias("d"))
        same = F.expr(" and ".join(f"b.{c} <=> c.{c}" for c in EDGE))
        b, c = base.alias("b"), changes.alias("c")
        kept = b.join(c, same, "left").select(*[f"b.{x}" for x in EDGE], (F.col("b.n") + F.coalesce("c.d", F.lit(0))).alias("n"))
        added = c.join(b, same, "left_anti").select(*EDGE, F.col("d").alias("n"))
        return kept.unionByName(added).filter("n > 0")

    def edges(self) -> DataFrame:
        return self.supports().select(*EDGE)
