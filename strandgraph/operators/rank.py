"""Relevance by random walks, edge recovery and call flows."""

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..lineage import cut, union_all

# Edge kinds a random walk follows, and edge kinds restored among kept nodes.
WALK_KINDS = [
    "calls", "references", "extends", "implements", "overrides", "instantiates", "returns",
    "type_of", "imports",
]
RECOVERY_KINDS = ["calls", "extends", "implements", "references", "overrides"]
_ROWS_PER_SALT = 1_000_000


def relevance(g: Graph, seeds: DataFrame, rounds: int = 25, alpha: float = 0.25,
              rows_per_salt: int = _ROWS_PER_SALT) -> DataFrame:
    """Personalised PageRank over the undirected multigraph: (id, score) for every node.

    Nodes are numbered. The walk table is kept dealt out and sorted by (src, salt) once, so a round moves only the
    scores and sorts nothing but them. Nodes with very many neighbours are cut into salts, which keeps the
    partitions even; their score row is repeated once per salt. Only nodes that hold mass travel.
    """
    spark = g.nodes.sparkSession
    nodes = cut(g.nodes.select("id").distinct().withColumn("no", F.monotonically_increasing_id()), "walk-nodes")
    edges = g.edges.filter(F.col("kind").isin(WALK_KINDS) & (F.col("source") != F.col("target"))).select("source", "target")
    ends = edges.join(nodes.select(F.col("id").alias("source"), F.col("no").alias("a")), "source").join(
        nodes.select(F.col("id").alias("target"), F.col("no").alias("b")), "target")
    both = ends.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")),
                                         F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select("e.*")
    both = cut(both.groupBy("src", "dst").agg(F.count("*").alias("w")), "walk")
    degree = both.groupBy("src").agg(F.sum("w").alias("degree"), F.count("*").alias("rows"))
    degree = cut(degree.select(
        "src", "degree", F.ceil(F.col("rows") / rows_per_salt).cast("int").alias("salts")), "degree")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hubs = degree.filter("salts > 1").select(F.col("src").alias("no"), "salts")
    any_hub = not hubs.isEmpty()
    key = ["src", "salt"] if any_hub else ["src"]  # without hubs a round's scores already lie where the next one wants them
    walk = both.join(degree, "src").select(
        "src", F.pmod(F.xxhash64("dst"), F.col("salts")).cast("int").alias("salt"), "dst",
        (F.col("w") / F.col("degree")).alias("share"),
    ).select(*key, "dst", "share").repartition(parts, *key).sortWithinPartitions(*key).persist(StorageLevel.MEMORY_AND_DISK)

    start = cut(nodes.join(seeds.select("id").distinct(), "id", "left_semi").select("no"), "restart")
    count = start.count()
    if count == 0:
        start, count = nodes.select("no"), nodes.count()
    start = start.withColumn("r", F.lit(1.0 / max(count, 1)))
    has_edges = degree.select(F.col("src").alias("no"))
    isolated = start.join(has_edges, "no", "left_anti")  # keeps its mass in every round
    restart = cut(start.join(has_edges, "no", "left_semi"), "restart")
    score = restart.select("no", F.col("r").alias("s"))
    for n in range(1, rounds + 1):
        out = score.select(F.col("no").alias("src"), "s")
        if any_hub:
            out = score.join(hubs, "no", "left").select(
                F.col("no").alias("src"), "s",
                F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
        moved = walk.join(out, key).select(
            F.col("dst").alias("no"), ((1 - alpha) * F.col("s") * F.col("share")).alias("s"))
        back = restart.select("no", (alpha * F.col("r")).alias("s"))
        score = moved.unionByName(back).groupBy("no").agg(F.sum("s").alias("s"))
        if n % 5 == 0:
            score = cut(score, "score")
    score = cut(score.unionByName(isolated.select("no", F.col("r").alias("s"))), "score")
    walk.unpersist()
    return nodes.join(score, "no", "left").select("id", F.coalesce("s", F.lit(0.0)).alias("score"))


def recover_edges(g: Graph, ids: DataFrame) -> DataFrame:
    """Semantic edges between already selected nodes."""
    ids = ids.select("id").distinct()
    return (
        g.edges.filter(F.col("kind").isin(RECOVERY_KINDS))
        .join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
        .join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    )


def flow_chain(g: Graph, named: DataFrame, hops: int = 6, bridge: int = 1, kind: str = "calls") -> DataFrame:
    """Longest call chain between named symbols: (step, id), at least three nodes.

    From every named seed the search walks call edges up to `hops`, crossing at most `bridge`
    unnamed symbols in a row, and ends at a named symbol. State is (seed, id, streak): a node
    is entered again only with a shorter unnamed run, which can lead further. Ties go to the
    smallest ids.
    """
    spark = g.nodes.sparkSession
    adj = cut(g.edges.filter((F.col("kind") == kind) & (F.col("source") != F.col("target")))
              .select(F.col("source").alias("src"), F.col("target").alias("dst")).distinct(), "calls")
    named = cut(named.select("id").distinct(), "named").withColumn("is_named", F.lit(True))
    level = cut(named.select(F.col("id").alias("seed"), "id", F.lit(0).alias("depth"), F.lit(0).alias("streak"),
                             F.lit(None).cast("string").alias("prev"), F.lit(True).alias("is_named")), "flow")
    levels = [level]
    for depth in range(1, hops + 1):
        step = level.join(adj, F.col("id") == F.col("src")).select("seed", F.col("id").alias("prev"), F.col("dst").alias("id"), "streak")
        step = step.join(named, "id", "left").select(
            "seed", "id", F.lit(depth).alias("depth"), "prev", F.coalesce("is_named", F.lit(False)).alias("is_named"),
            F.when(F.col("is_named"), 0).otherwise(F.col("streak") + 1).alias("streak")).filter(F.col("streak") <= bridge)
        step = step.groupBy("seed", "id", "depth", "is_named").agg(F.min(F.struct("streak", "prev")).alias("best")).select(
            "seed", "id", "depth", F.col("best.streak").alias("streak"), F.col("best.prev").alias("prev"), "is_named")
        seen = union_all([lv.select("seed", "id") for lv in levels])
        level = cut(step.join(seen, ["seed", "id"], "left_anti"), "flow")
        if level.isEmpty():
            break
        levels.append(level)
    best = union_all(levels).filter("is_named and depth >= 2").orderBy(F.desc("depth"), "seed", "id").limit(1).first()
    chain = []
    if best is not None:
        seed, node = best["seed"], best["id"]
        for level in reversed(levels[: best["depth"] + 1]):
            row = level.filter((F.col("seed") == seed) & (F.col("id") == node)).first()
            chain.append(node)
            node = row["prev"]
    return spark.createDataFrame(list(enumerate(reversed(chain))), "step int, id string")
