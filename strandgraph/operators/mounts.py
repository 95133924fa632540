"""Prefixes composed along a tree of mounts, in as many rounds as the logarithm of its depth.

A router, a blueprint or a group is mounted under another one with a prefix. Every mount points at its
parent; pointer doubling joins each stretch of the way with the next one, so a chain of a thousand mounts
takes ten joins.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut, union_all


def compose(mounts: DataFrame) -> DataFrame:
    """Whole prefixes: mounts(id, parent, prefix) -> (id, root, path, depth), one row per way to a root.

    A null parent, or one that is no mount itself, ends the way. A unit mounted in several places has
    several ways, and so has all below it. Ways that meet a unit twice lead nowhere: a cycle gives no row,
    and what hangs on it only those rows that reach a root otherwise. Null prefixes are empty; equal mounts
    count once.
    """
    rows = mounts.filter("id is not null").select("id", "parent", F.coalesce("prefix", F.lit("")).alias("prefix")).distinct()
    ids = rows.select(F.col("id").alias("parent"), F.lit(True).alias("mounted")).distinct()
    rows = rows.join(ids, "parent", "left")
    open_ = cut(rows.select("id", F.when(F.col("mounted"), F.col("parent")).alias("up"), F.coalesce("parent", "id").alias("root"),
                            F.col("prefix").alias("path"), F.array("id").alias("way")), "mounts")
    done = [open_.filter("up is null")]
    # `step` holds every stretch of the present length and all shorter ones that reach a root.
    step, left = open_, open_.filter("up is not null and not array_contains(way, up)")
    while not left.isEmpty():
        nxt = step.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("root").alias("root2"),
                          F.col("path").alias("path2"), F.col("way").alias("way2"))
        longer = left.join(nxt, "up").filter(~F.arrays_overlap("way", "way2")).select(
            "id", F.col("up2").alias("up"), F.col("root2").alias("root"), F.concat("path2", "path").alias("path"),
            F.concat("way", "way2").alias("way"))
        longer = cut(longer.filter("up is null or not array_contains(way, up)"), "mounts")
        done.append(longer.filter("up is null"))
        left = longer.filter("up is not null")
        step = union_all([left, *done])
    return union_all(done).select("id", "root", "path", F.size("way").alias("depth"))


def joined(prefix: Column, path: Column) -> Column:
    """A prefix and a path with single slashes between their segments."""
    return F.regexp_replace(F.concat(F.lit("/"), F.coalesce(prefix, F.lit("")), F.lit("/"), path), "/+", "/")
