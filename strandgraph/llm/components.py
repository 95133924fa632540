"""Connected components of an edge table by alternating star contractions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut


def _lowest(edges: DataFrame) -> DataFrame:
    """Per node the least of itself and its neighbours; a hub is a minimum, not a list."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(`id`, `label`) for every end of `edges` (`u`, `v`); the label is the least id of the component.

    Each turn points larger neighbours at the least one seen (large star) and then smaller ones
    (small star); the number of edges never grows and paths shrink as in pointer jumping. Ends when
    a turn changes nothing.
    """
    current = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_lowest(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.join(_lowest(large), "u")
        small = small.select("v", "m").union(small.select("u", "m")).toDF("u", "v").filter("u <> v").distinct()
        current = cut(small, "edges")
        state = tuple(current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    stars = current.select(F.col("u").alias("id"), F.col("v").alias("label"))
    return stars.unionByName(stars.select(F.col("label").alias("id"), "label").distinct())
