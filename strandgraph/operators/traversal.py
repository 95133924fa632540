"""Multi-hop graph operators on one level-by-level kernel.

Every level is one join of the frontier with the adjacency table, a combine per reached
node (pre-aggregated before the shuffle, so hubs stay cheap) and an anti-join against the
nodes already seen. Each level is written once; "seen" is the union of the level tables,
so nothing is written twice. Nodes get their minimum depth, whatever the row order.

Channel nodes (an event between its emitters and handlers) are looked through: a step to a channel goes on
to its members at the same depth, and the channel itself is no result.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import is_affected_test
from ..graph import Graph, edge_priority
from ..lineage import cut, union_all
from ..schema import CALLER_KINDS, CHANNEL, CONTAINER_KINDS
from .links import Links

REACHED = ["id", "depth", "parent", "via_kind", "via_line"]
_COMPACT_EVERY = 12


def _start(seeds: DataFrame) -> DataFrame:
    return seeds.select("id").distinct().select(
        "id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"),
        F.lit(None).cast("string").alias("via_kind"), F.lit(None).cast("int").alias("via_line"))


def _expand(level: DataFrame, links: Links, depth: int) -> DataFrame:
    """Nodes one hop from `level`, each with its preferred edge."""
    best = F.min(F.struct("prio", "src", "kind", "line"))
    return (
        links.leaving(level)
        .groupBy(F.col("dst").alias("id")).agg(best.alias("via"))
        .select("id", F.lit(depth).alias("depth"), F.col("via.src").alias("parent"),
                F.col("via.kind").alias("via_kind"), F.col("via.line").alias("via_line"))
    )


def _seen(levels: list[DataFrame]) -> DataFrame:
    return union_all([lv.select("id") for lv in levels])


def frontier(
    adj: DataFrame | Links, seeds: DataFrame, max_depth: int | None = None, stop: DataFrame | None = None,
) -> DataFrame:
    """Nodes reachable from `seeds` with minimum depth and the edge that reached them.

    `adj` is asked once per level: links of a graph, or any stored table of (src, dst, kind, line, prio).
    Nodes listed in `stop` are reached but not expanded.
    """
    links = adj if isinstance(adj, Links) else Links.of(adj)
    level = cut(_start(seeds), "level")
    levels, hubs, depth = [level], [], 0
    while max_depth is None or depth < max_depth:
        depth += 1
        source = level if stop is None else level.join(stop, "id", "left_anti")
        level = cut(_expand(source, links, depth).join(_seen(levels + hubs), "id", "left_anti"), "level")
        hub = level.filter(F.col("id").startswith(CHANNEL))
        if not hub.isEmpty():
            hubs.append(hub)
            level = cut(_beyond(level, hub, links, depth).join(_seen(levels), "id", "left_anti"), "level")
        if level.isEmpty():
            break
        levels.append(level)
        if len(levels) > _COMPACT_EVERY:
            levels = [cut(union_all(levels), "levels")]
    return union_all(levels)


def _beyond(level: DataFrame, hub: DataFrame, links: Links, depth: int) -> DataFrame:
    """A level without its channels, with what they lead to; a member's parent is the node before the channel."""
    before = hub.select(F.col("id").alias("hub"), F.col("parent").alias("from"), F.col("via_line").alias("at"))
    past = _expand(hub, links, depth).join(before, F.col("parent") == F.col("hub")).select(
        "id", "depth", F.col("from").alias("parent"), "via_kind", F.col("at").alias("via_line"))
    past = past.filter(~F.col("id").startswith(CHANNEL))
    plain = level.filter(~F.col("id").startswith(CHANNEL))
    return plain.unionByName(past.join(plain.select("id"), "id", "left_anti"))


# -- one hop ----------------------------------------------------------------

def _neighbours(g: Graph, ids: DataFrame | None, near: str, far: str, kinds: list[str]) -> DataFrame:
    """(near, far, kind, line) of edges between different nodes. For given ids on the near side, a channel on
    the far side gives way to its members; without ids the channels stay, so that members are not paired."""
    edges = g.edges.filter(F.col("kind").isin(kinds) & (F.col("source") != F.col("target"))).select(near, far, "kind", "line")
    if ids is None:
        return edges
    asked = edges.join(ids.select(F.col("id").alias(near)).distinct(), near, "left_semi")
    channel = F.col(far).startswith(CHANNEL)
    hubs = asked.filter(channel).select(F.col(near).alias("_asked"), F.col(far).alias("_hub"))
    inner = edges.filter(F.col(near).startswith(CHANNEL)).withColumnRenamed(near, "_hub")
    through = hubs.join(inner, "_hub").select(F.col("_asked").alias(near), far, "kind", "line").filter(F.col(near) != F.col(far))
    return asked.filter(~channel).unionByName(through)


def callers(g: Graph, ids: DataFrame | None = None, kinds: list[str] = CALLER_KINDS) -> DataFrame:
    """Direct callers as a bag of edges; a node calling itself is not its own caller."""
    return _neighbours(g, ids, "target", "source", kinds).select(
        F.col("target").alias("id"), F.col("source").alias("caller"), "kind", "line")


def callees(g: Graph, ids: DataFrame | None = None, kinds: list[str] = CALLER_KINDS) -> DataFrame:
    return _neighbours(g, ids, "source", "target", kinds).select(
        F.col("source").alias("id"), F.col("target").alias("callee"), "kind", "line")


def usages(g: Graph, ids: DataFrame) -> DataFrame:
    """Every incoming edge, containment included, with the using node."""
    edges = g.edges.join(ids.select(F.col("id").alias("target")).distinct(), "target", "left_semi")
    users = g.nodes.select(F.col("id").alias("source"), F.col("name").alias("user_name"),
                           F.col("kind").alias("user_kind"))
    return edges.join(users, "source").select(
        F.col("target").alias("id"), F.col("source").alias("user"), "user_name", "user_kind", "kind", "line")


def children(g: Graph, ids: DataFrame | None = None) -> DataFrame:
    edges = g.edges.filter(F.col("kind") == "contains")
    if ids is not None:
        edges = edges.join(ids.select(F.col("id").alias("source")).distinct(), "source", "left_semi")
    return edges.select(F.col("source").alias("id"), F.col("target").alias("child"))


def trail(g: Graph, ids: DataFrame, k: int = 5) -> DataFrame:
    """The first `k` callers and callees of each node (a top-k report)."""
    both = callers(g, ids).select(F.lit("caller").alias("side"), "id", F.col("caller").alias("other"), "line")
    both = both.unionByName(
        callees(g, ids).select(F.lit("callee").alias("side"), "id", F.col("callee").alias("other"), "line"))
    best = both.groupBy("id", "side", "other").agg(F.min("line").alias("line"))
    # row_number() <= k lets Spark keep k rows per group before the shuffle.
    order = Window.partitionBy("id", "side").orderBy(F.col("line").asc_nulls_last(), "other")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


# -- many hops --------------------------------------------------------------

def bfs(g: Graph, seeds: DataFrame, direction: str = "outgoing", kinds: list[str] | None = None,
        node_kinds: list[str] | None = None, max_depth: int | None = None,
        limit: int | None = None) -> DataFrame:
    """Breadth-first traversal; `limit` keeps the first nodes by (depth, edge priority, id)."""
    reached = frontier(g.links(direction, kinds, node_kinds).written(), seeds, max_depth)
    if limit is not None:
        reached = reached.orderBy("depth", edge_priority("via_kind"), "id").limit(limit)
    return reached


def callers_within(g: Graph, seeds: DataFrame, max_depth: int) -> DataFrame:
    return frontier(g.links("incoming", CALLER_KINDS).written(), seeds, max_depth).filter("depth > 0")


def callees_within(g: Graph, seeds: DataFrame, max_depth: int) -> DataFrame:
    return frontier(g.links("outgoing", CALLER_KINDS).written(), seeds, max_depth).filter("depth > 0")


def call_graph(g: Graph, seeds: DataFrame, max_depth: int = 2) -> DataFrame:
    """Seeds with everything that calls them or is called by them, to a depth."""
    up = callers_within(g, seeds, max_depth).select("id", F.lit("caller").alias("role"), "depth")
    down = callees_within(g, seeds, max_depth).select("id", F.lit("callee").alias("role"), "depth")
    focal = seeds.select("id").distinct().select("id", F.lit("focal").alias("role"), F.lit(0).alias("depth"))
    return union_all([focal, up, down])


def type_hierarchy(g: Graph, seeds: DataFrame, directions: tuple[str, ...] = ("up", "down")) -> DataFrame:
    """Supertypes (up) and subtypes (down) of the seeds."""
    kinds = ["extends", "implements"]
    out = []
    for name, travel in (("up", "outgoing"), ("down", "incoming")):
        if name in directions:
            reached = frontier(g.links(travel, kinds).written(), seeds)
            out.append(reached.filter("depth > 0").select("id", F.lit(name).alias("side"), "depth"))
    return union_all(out)


def ancestors(g: Graph, seeds: DataFrame | None = None) -> DataFrame:
    """Containment chain of every seed (default: all nodes): (id, ancestor, level).

    Each node follows its first parent. Chains are as deep as source code nests, so one join
    per level suffices; a chain that closes on itself stops where it would repeat.
    """
    edges = g.edges.filter(F.col("kind") == "contains")
    parent = cut(edges.groupBy(F.col("target").alias("cur")).agg(F.min("source").alias("up")), "parent")
    base = (seeds or g.nodes).select("id").distinct()
    level = cut(
        base.join(parent, F.col("id") == F.col("cur"))
        .select("id", F.col("up").alias("ancestor"), F.lit(1).alias("level"),
                F.array("id", "up").alias("path")).filter("id != ancestor"), "chain")
    chains, n = [level], 1
    while not level.isEmpty():
        n += 1
        level = cut(
            level.join(parent, F.col("ancestor") == F.col("cur"))
            .filter(~F.array_contains("path", F.col("up")))
            .select("id", F.col("up").alias("ancestor"), F.lit(n).alias("level"),
                    F.concat("path", F.array("up")).alias("path")), "chain")
        chains.append(level)
    return union_all(chains).drop("path")


def impact(g: Graph, seeds: DataFrame, max_depth: int = 3) -> DataFrame:
    """Everything a change of the seeds may affect: (id, depth).

    Users of a node lie one step further out; the children of a container lie at the depth
    of the container, so containment is closed before each step.
    """
    users = g.links("incoming", exclude=["contains"]).written()
    containers = g.nodes.filter(F.col("kind").isin(CONTAINER_KINDS)).select("id")
    inner = g.links("outgoing", ["contains"])
    if not inner.resting:
        within = g.adjacency("outgoing", ["contains"]).join(containers.withColumnRenamed("id", "src"), "src", "left_semi")
        inner = Links.of(within).written()
    level = cut(_start(seeds), "level")
    levels = [level]
    for depth in range(max_depth):
        ring = [level]
        while True:
            if inner.resting:
                level = cut(containers.join(level.select("id"), "id"), "containers")
            level = cut(_expand(level, inner, depth).join(_seen(levels), "id", "left_anti"), "level")
            if level.isEmpty():
                break
            ring.append(level)
            levels.append(level)
        level = cut(_expand(union_all(ring), users, depth + 1).join(_seen(levels), "id", "left_anti"), "level")
        if level.isEmpty():
            break
        levels.append(level)
    return union_all(levels).select("id", "depth")


def shortest_path(g: Graph, source: DataFrame, target: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """One shortest path from the source set to the target set: (step, id), empty if none.

    Ties go to the smallest id: the target is the smallest among the nearest ones and each
    predecessor the smallest on the level before.
    """
    links = g.links("outgoing", kinds).written()
    target = cut(target.select("id").distinct(), "target")
    level = cut(_start(source), "level")
    levels = [level]
    while True:
        hit = level.join(target, "id", "left_semi").agg(F.min("id").alias("id")).first()["id"]
        if hit is not None:
            break
        nxt = links.leaving(level).groupBy(F.col("dst").alias("id")).agg(
            F.min("src").alias("parent"))
        nxt = nxt.select("id", F.lit(len(levels)).alias("depth"), "parent",
                         F.lit(None).cast("string").alias("via_kind"), F.lit(None).cast("int").alias("via_line"))
        level = cut(nxt.join(_seen(levels), "id", "left_anti"), "level")
        if level.isEmpty():
            break
        levels.append(level)
    spark = g.nodes.sparkSession
    path = []
    while hit is not None and levels:
        path.append(hit)
        row = levels.pop().filter(F.col("id") == hit).select("parent").first()
        hit = row["parent"]
    steps = [(i, node) for i, node in enumerate(reversed(path))]
    return spark.createDataFrame(steps, "step int, id string")


def shortest_distance(g: Graph, source: DataFrame, kinds: list[str] | None = None,
                      max_depth: int | None = None) -> DataFrame:
    """Hop count from the source set to every node it reaches."""
    return frontier(g.links("outgoing", kinds).written(), source, max_depth).select("id", "depth")


# -- files ------------------------------------------------------------------

def file_edges(g: Graph) -> DataFrame:
    """Distinct cross-file pairs (file, depends_on) over all edges but containment."""
    at = g.nodes.select("id", "file_path")
    pairs = g.edges.filter(F.col("kind") != "contains").select("source", "target").distinct()
    return (
        pairs.join(at.select(F.col("id").alias("source"), F.col("file_path").alias("file")), "source")
        .join(at.select(F.col("id").alias("target"), F.col("file_path").alias("depends_on")), "target")
        .filter(F.col("file") != F.col("depends_on")).select("file", "depends_on").distinct()
    )


def file_dependencies(g: Graph, files: DataFrame) -> DataFrame:
    return file_edges(g).join(files.select(F.col("path").alias("file")).distinct(), "file", "left_semi")


def file_dependents(g: Graph, files: DataFrame) -> DataFrame:
    return file_edges(g).join(
        files.select(F.col("path").alias("depends_on")).distinct(), "depends_on", "left_semi")


def affected_tests(g: Graph, changed: DataFrame, max_depth: int = 5, test_regex: str | None = None) -> DataFrame:
    """Test files that depend on the changed ones; the search does not go past a test."""
    adj = cut(file_edges(g).select(
        F.col("depends_on").alias("src"), F.col("file").alias("dst"), F.lit("depends").alias("kind"),
        F.lit(None).cast("int").alias("line"), F.lit(0).alias("prio")), "file-links")
    changed = changed.select(F.col("path").alias("id"))
    paths = union_all([changed, adj.select(F.col("dst").alias("id"))]).distinct()
    tests = paths.filter(is_affected_test("id", test_regex))
    reached = frontier(adj, changed, max_depth, stop=tests)
    return reached.filter(is_affected_test("id", test_regex)).select(F.col("id").alias("path"))
