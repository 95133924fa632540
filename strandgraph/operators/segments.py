"""A full-text index in immutable segments that follows a changing graph.

Every change writes one segment: postings sorted by term, the token count of each node, and the ids it takes
out of earlier segments (deleted nodes, and the nodes it holds itself). A posting lives while no later segment
took its id out. A log row names the live segments in order and the totals of the live corpus, so a query reads
the log, the row groups of its words in each segment, and the ids taken out. Readers keep the segments of the
log row they saw; nothing is overwritten.

Segments behind the first are merged into one when there are more than `most`, and all of them once those
behind the first hold more nodes than it does; so a node is rewritten a number of times that grows with the
logarithm of the corpus.
"""

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut, union_all
from .search import SearchIndex

_LOG = "turn long, segments array<string>, nodes array<long>, total long, length long"
_POSTINGS = "term string, id string, col int, len long, pos array<int>"


class SegmentedIndex:
    """Index below `root`, a folder all executors share; one writer at a time."""

    def __init__(self, spark: SparkSession, root: str, most: int = 8):
        self.spark, self.root, self.most = spark, root.rstrip("/"), most

    def state(self) -> dict:
        """The last log row: live segments in order, nodes written to each, live nodes and tokens."""
        try:
            row = self.spark.read.schema(_LOG).json(f"{self.root}/log").orderBy(F.desc("turn")).first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            row = None
        return row.asDict() if row else {"turn": 0, "segments": [], "nodes": [], "total": 0, "length": 0}

    def _commit(self, turn: int, segments: list[str], nodes: list[int], total: int, length: int) -> None:
        row = self.spark.createDataFrame([(turn, segments, nodes, total, length)], _LOG)
        row.coalesce(1).write.mode("append").json(f"{self.root}/log")

    def _read(self, segment: str, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{segment}/{name}")

    def _live(self, segments: list[str], name: str, schema: str) -> DataFrame:
        """Rows of the segments that no later one of them took out."""
        every = union_all([self._read(s, name, schema).withColumn("segment", F.lit(i)) for i, s in enumerate(segments)])
        if len(segments) == 1:
            return every.drop("segment")
        gone = union_all([self._read(s, "gone", "id string").select(F.col("id").alias("gone"), F.lit(i).alias("by")) for i, s in enumerate(segments) if i])
        return every.join(gone, (F.col("id") == F.col("gone")) & (F.col("by") > F.col("segment")), "left_anti").drop("segment")

    def add(self, nodes: DataFrame, gone: DataFrame | None = None) -> str:
        """Takes in new and changed nodes (unique ids), and takes out the ids in `gone`. Writes one segment."""
        state, segment = self.state(), uuid.uuid4().hex
        words = cut(SearchIndex.words(nodes), "tokens")
        SearchIndex.sorted_postings(words).write.parquet(f"{self.root}/{segment}/postings")
        words.select("id", "len").write.parquet(f"{self.root}/{segment}/lengths")
        out = words.select("id") if gone is None else words.select("id").unionByName(gone.select("id")).distinct()
        out.write.parquet(f"{self.root}/{segment}/gone")
        size = F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("len")
        fresh, lost = words.agg(*size).first(), None
        if state["segments"]:
            held = self._live(state["segments"], "lengths", "id string, len long")
            lost = held.join(self._read(segment, "gone", "id string"), "id", "left_semi").agg(*size).first()
        total = state["total"] + fresh.n - (lost.n if lost else 0)
        length = state["length"] + fresh.len - (lost.len if lost else 0)
        self._commit(state["turn"] + 1, [*state["segments"], segment], [*state["nodes"], fresh.n], total, length)
        if len(state["segments"]) + 1 > self.most:
            held = [*state["nodes"], fresh.n]
            self.merge(0 if sum(held[1:]) > held[0] else 1)
        return segment

    def merge(self, start: int = 0) -> None:
        """Makes one segment of those from place `start` on."""
        state = self.state()
        segments = state["segments"][start:]
        if len(segments) < 2:
            return
        name = uuid.uuid4().hex
        postings = self._live(segments, "postings", _POSTINGS)
        postings.repartitionByRange("term", "id").sortWithinPartitions("term").write.parquet(f"{self.root}/{name}/postings")
        lengths = cut(self._live(segments, "lengths", "id string, len long"), "lengths")
        lengths.write.parquet(f"{self.root}/{name}/lengths")
        gone = union_all([self._read(s, "gone", "id string") for s in segments]).distinct()
        (gone if start else gone.limit(0)).write.parquet(f"{self.root}/{name}/gone")
        self._commit(state["turn"] + 1, [*state["segments"][:start], name], [*state["nodes"][:start], lengths.count()], state["total"], state["length"])

    def read(self) -> SearchIndex:
        """The index as of now; later changes do not touch it."""
        state = self.state()
        if not state["segments"]:
            return SearchIndex(self.spark.createDataFrame([], _POSTINGS), 0, 0)
        return SearchIndex(self._live(state["segments"], "postings", _POSTINGS), state["total"], state["length"])
