"""Order-dependent operators that stay parallel within one large group (J6, A11, W3).

A window over a whole group would sort it in one task. Here the ordering column is cut into
buckets; windows run per (group, bucket) and a small table with one row per bucket carries
the state from bucket to bucket.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], start: Column, end: Column, gap: float, bucket: float) -> DataFrame:
    """Merge intervals whose gap is at most `gap`: keys, island, start, end, n.

    `start` and `end` are numeric. Equal starts collapse before anything is ordered.
    """
    rows = df.select(*keys, start.cast("double").alias("s"), end.cast("double").alias("e"))
    rows = rows.groupBy(*keys, "s").agg(F.max("e").alias("e"), F.count("*").alias("n"))
    rows = rows.withColumn("b", F.floor(F.col("s") / bucket))
    inside = Window.partitionBy(*keys, "b").orderBy("s")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    # Furthest end of all earlier buckets, one row per bucket.
    carry = rows.groupBy(*keys, "b").agg(F.max("e").alias("m")).select(*keys, "b", F.max("m").over(across).alias("reach"))
    rows = rows.join(carry, [*keys, "b"]).withColumn("reach", F.greatest(F.max("e").over(before), "reach"))
    rows = rows.withColumn("cut", F.coalesce(F.col("s") > F.col("reach") + gap, F.lit(True)).cast("long"))
    rows = rows.withColumn("no", F.sum("cut").over(inside))
    # Number of cuts in all earlier buckets.
    offset = rows.groupBy(*keys, "b").agg(F.sum("cut").alias("c")).select(
        *keys, "b", F.coalesce(F.sum("c").over(across), F.lit(0)).alias("base"))
    rows = rows.join(offset, [*keys, "b"]).withColumn("island", F.col("no") + F.col("base"))
    return rows.groupBy(*keys, "island").agg(
        F.min("s").alias("start"), F.max("e").alias("end"), F.sum("n").alias("n"))


def previous(df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: str, name: str) -> DataFrame:
    """Value of the preceding row within a group; `bucket` is a coarse, monotone part of the order."""
    rows = df.withColumn("_b", bucket)
    inside = Window.partitionBy(*keys, "_b").orderBy(*order)
    last = rows.groupBy(*keys, "_b").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    across = Window.partitionBy(*keys).orderBy("_b")
    last = last.select(*keys, "_b", F.lag("_last").over(across).alias("_carry"))
    rows = rows.withColumn("_rn", F.row_number().over(inside)).withColumn("_prev", F.lag(value).over(inside))
    rows = rows.join(last, [*keys, "_b"])
    return rows.withColumn(name, F.when(F.col("_rn") == 1, F.col("_carry")).otherwise(F.col("_prev"))).drop(
        "_b", "_rn", "_prev", "_carry")


def enclosing(points: DataFrame, spans: DataFrame, width: int = 64) -> DataFrame:
    """Tightest span around each point: points(file_path, line), spans(id, file_path, start_line, end_line).

    Spans are laid over line buckets, so file and bucket make an equi-join. The span starting
    last wins, then the smallest id.
    """
    bins = F.sequence(F.floor(F.col("start_line") / width), F.floor(F.greatest("start_line", "end_line") / width))
    laid = spans.select("id", "file_path", "start_line", "end_line", F.explode(bins).alias("bin"))
    at = points.select("file_path", "line").distinct().withColumn("bin", F.floor(F.col("line") / width))
    hit = at.join(laid, ["file_path", "bin"]).filter("start_line <= line and end_line >= line")
    return hit.groupBy("file_path", "line").agg(
        F.min(F.struct((-F.col("start_line")).alias("neg"), F.col("id"))).alias("b")).select(
        "file_path", "line", F.col("b.id").alias("id"))


def as_of(points: DataFrame, facts: DataFrame, keys: list[str], order: str, value: str, width: int = 4096,
          otherwise: DataFrame | None = None) -> DataFrame:
    """Points with the value of the latest fact at or before them within their group, null if there is none.

    points(keys, order, ...), facts(keys, order, value); `order` is an integer. Facts of one place count as
    the smallest of them. Rows with a null order see nothing. `otherwise`(keys, value) has at most one row a group and
    gives the value of points that see no fact; it joins the buckets, so that points do not move for it.
    """
    known = facts.filter(F.col(order).isNotNull()).groupBy(*keys, order).agg(F.min(value).alias(value))
    known = known.select(*keys, order, value, F.lit(0).alias("_point"))
    rows = points.withColumn("_point", F.lit(1)).unionByName(known, allowMissingColumns=True)
    # Points without an order lie in a bucket of their own before all others.
    rows = rows.withColumn("_b", F.coalesce(F.floor(F.col(order) / width), F.lit(-(1 << 62))))
    inside = Window.partitionBy(*keys, "_b").orderBy(F.col(order), "_point").rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    last = rows.groupBy(*keys, "_b").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_last"))
    last = last.select(*keys, "_b", F.last("_last", ignorenulls=True).over(across).alias("_carry"))
    if otherwise is not None:
        last = last.join(otherwise.withColumnRenamed(value, "_else"), keys, "left").withColumn(
            "_carry", F.coalesce("_carry", "_else")).drop("_else")
    near = rows.withColumn("_near", F.last(value, ignorenulls=True).over(inside)).filter("_point = 1")
    joined = near.join(last, [*keys, "_b"], "left")
    return joined.withColumn(value, F.coalesce("_near", "_carry")).drop("_point", "_b", "_near", "_carry")
