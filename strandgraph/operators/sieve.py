"""Sieves of ids: rows that surely have no partner stay out of the shuffle of a join.

A sieve has a bit for each value of a hash of the ids, about eight bits an id, 32 MB at most. Blocks of 4096 bits are
rows of a table that Spark broadcasts. A row whose bit is not set has no id of the set; one whose bit is set may have one,
which the join that follows decides. Sets of more ids than the sieve has room for let more rows pass, never fewer.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut

#: Smaller sets are left to the join, which broadcasts most of them.
LEAST = 100_000
_MOST_BITS = 1 << 28


@dataclass(frozen=True)
class Sieve:
    """`blocks`(block, words): 64 words of 64 bits each."""

    blocks: DataFrame
    bits: int

    @staticmethod
    def of(ids: DataFrame) -> Sieve | None:
        """Sieve of a stored table of ids; none for a small one."""
        count = ids.count()
        if count < LEAST:
            return None
        bits = max(1 << 12, min(1 << (8 * count - 1).bit_length(), _MOST_BITS))
        words = ids.select(_spot("id", bits).alias("spot")).groupBy(F.shiftright("spot", 6).alias("word")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 as int))")).alias("set"))
        filled = F.map_from_entries(F.collect_list(F.expr("struct(word & 63, set)")))
        blocks = words.groupBy(F.shiftright("word", 6).alias("block")).agg(filled.alias("filled")).selectExpr(
            "block", "transform(sequence(0L, 63L), i -> coalesce(filled[i], 0L)) as words")
        return Sieve(cut(blocks, "sieve"), bits)

    def marked(self, rows: DataFrame, *columns: str) -> DataFrame:
        """Rows with `_may`: whether one of the columns may hold an id of the set."""
        may = F.lit(False)
        for n, column in enumerate(columns):
            spot, block, words = _spot(column, self.bits), f"_block{n}", f"_words{n}"
            rows = rows.join(F.broadcast(self.blocks.toDF(block, words)), F.shiftright(spot, 12) == F.col(block), "left")
            word = F.col(words)[(F.shiftright(spot, 6).bitwiseAND(63)).cast("int")]
            may = may | (F.coalesce(word, F.lit(0)).bitwiseAND(_bit(spot)) != 0)
        extra = [c for n in range(len(columns)) for c in (f"_block{n}", f"_words{n}")]
        return rows.withColumn("_may", may).drop(*extra)

    def passing(self, rows: DataFrame, column: str) -> DataFrame:
        """The rows whose column may hold an id of the set."""
        return self.marked(rows, column).filter("_may").drop("_may")


def _spot(column: str, bits: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(bits).cast("bigint"))


def _bit(spot: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), spot.bitwiseAND(63).cast("int"))


def without(rows: DataFrame, ids: DataFrame, *columns: str) -> DataFrame:
    """Rows none of whose columns holds an id of a stored table of ids; only rows in doubt are shuffled."""
    def exact(left: DataFrame) -> DataFrame:
        for column in columns:
            left = left.join(ids.withColumnRenamed("id", column), column, "left_anti")
        return left

    sieve = Sieve.of(ids)
    if sieve is None:
        return exact(rows)
    marked = sieve.marked(rows, *columns)
    return marked.filter("not _may").drop("_may").unionByName(exact(marked.filter("_may").drop("_may")))
