"""Edges as a walk asks for them: all edges that leave a frontier.

A stored graph keeps its edges twice, in buckets by either end. A walk leaves them where they are: up to
`FEW` keys of a frontier become literals, so that Spark opens only their buckets and row groups; a larger frontier
is shuffled to the buckets, or broadcast while it is below Spark's threshold. Edges of a hub lie under several keys,
so that no bucket holds all of them; a frontier asks for every key of its hubs. Links that do not rest are joined as a
table; a sieve of a large frontier keeps the edges of other ends out of the shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut, union_all
from .sieve import Sieve

#: Most keys of a frontier that are given to the scan as literals.
FEW = 500

#: Least number of cells in which edges are counted to find hubs.
_CELLS = 1 << 16


@dataclass(frozen=True)
class Links:
    """Tables of (src, dst, kind, line, prio) in the direction of travel, looked up by `key`.

    For a stored graph `hubs`(id, slots) names the ends under several keys and `keep`(dst) the far ends wanted.
    """

    parts: tuple[DataFrame, ...]
    key: str = "src"
    hubs: DataFrame | None = None
    keep: DataFrame | None = None

    @staticmethod
    def of(edges: DataFrame) -> Links:
        """Links over any table with src and dst."""
        return Links((edges,))

    @property
    def resting(self) -> bool:
        return self.hubs is not None

    def written(self) -> Links:
        """The same links as a table of their own; links of a stored graph are one already."""
        return self if self.resting else replace(self, parts=(cut(union_all(list(self.parts)), "adjacency"),))

    def keys(self, level: DataFrame) -> DataFrame:
        """(src, key) of a frontier(id): the id itself as key, and one more for each further slot of a hub."""
        if not self.resting:
            return level.select(F.col("id").alias(self.key))
        slots = F.explode(F.sequence(F.lit(0), F.coalesce("slots", F.lit(1)) - 1))
        return level.select("id").join(self.hubs, "id", "left").select("id", slots.alias("slot")).select(
            F.col("id").alias("src"), key_of("id", "slot").alias(self.key))

    def leaving(self, level: DataFrame) -> DataFrame:
        """Edges whose near end is in `level`(id), a stored table of distinct ids."""
        keys = self.keys(level)
        if not self.resting:
            sieve = Sieve.of(level)
            parts = self.parts if sieve is None else [sieve.passing(p, self.key) for p in self.parts]
            return union_all([p.join(keys, self.key) for p in parts])
        few = [r[0] for r in keys.select(self.key).limit(FEW + 1).collect()]
        if len(few) <= FEW:
            out = union_all([p.filter(F.col(self.key).isin(few)) for p in self.parts])
        else:
            # The near end is known with the key and need not be read from the edges once more.
            out = union_all([p.drop("src").join(keys, self.key) for p in self.parts])
        if self.keep is not None:
            out = out.join(self.keep, "dst", "left_semi")
        return out.drop(self.key)


def key_of(end: str, slot: str) -> Column:
    """Bucket key of an edge end: the end itself in its first slot."""
    return F.when(F.col(slot) == 0, F.col(end)).otherwise(F.concat_ws("\u0001", F.col(end), F.col(slot).cast("string")))


def hub_slots(edges: DataFrame, end: str, most: int, count: int = 0) -> DataFrame:
    """(id, slots) of the ends with more than `most` of `count` edges; at most edges / `most` rows.

    Edges are first counted by a hash of their end, in so many cells that hardly one is above `most` without a hub;
    only the ends in such cells are counted themselves.
    """
    cells = max(_CELLS, 16 * count // most)
    rows = edges.select(F.col(end).alias("id"), F.pmod(F.xxhash64(end), F.lit(cells)).alias("cell"))
    full = rows.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("cell")
    return rows.join(F.broadcast(full), "cell", "left_semi").groupBy("id").agg(F.count("*").alias("n")).filter(
        F.col("n") > most).select("id", F.ceil(F.col("n") / most).cast("int").alias("slots"))


def dealt(edges: DataFrame, end: str, other: str, hubs: DataFrame, buckets: int) -> DataFrame:
    """Edges with their bucket key, one bucket a partition; those of a hub are spread over its slots by a hash of the
    row's other values. The key is put in behind the shuffle, since it repeats the end."""
    slot = F.coalesce(F.pmod(F.xxhash64(other, "kind", "line", "col"), F.col("slots")), F.lit(0)).cast("int")
    rows = edges.join(hubs.withColumnRenamed("id", end), end, "left").withColumn("slot", slot).select(*edges.columns, "slot")
    return rows.repartition(buckets, key_of(end, "slot")).select(key_of(end, "slot").alias("key"), *edges.columns)
