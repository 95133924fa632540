"""Whole-graph structure queries."""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import dirname, is_test_file
from ..graph import Graph
from ..lineage import cut, union_all
from ..schema import CALLER_KINDS
from . import traversal

# Kinds seen by the glob lookup and by the filtered subgraph.
GLOB_KINDS = ["class", "function", "method", "interface", "type_alias", "variable", "constant"]
SUBGRAPH_KINDS = [
    "file", "module", "class", "struct", "interface", "trait", "function", "method",
    "variable", "constant", "enum", "type_alias",
]


def glob_regex(pattern: str) -> str:
    """Anchored regex of a glob where `*` is any run and `?` any one character."""
    body = "".join({"*": ".*", "?": "."}.get(ch, re.escape(ch)) for ch in pattern)
    return f"^{body}$"


def path_glob_regex(pattern: str) -> str:
    """Unanchored regex of a path glob: `**` crosses directories, `*` and `?` do not."""
    out = re.sub(r"\*\*|\*|\?|[^*?]+", lambda m: {"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(
        m.group(), re.escape(m.group())), pattern)
    return out


def affected_glob_regex(pattern: str) -> str:
    """Regex of a test-file filter: `**` needs at least one character."""
    return re.sub(r"\*\*|\*|[^*]+", lambda m: {"**": ".+", "*": "[^/]*"}.get(
        m.group(), re.escape(m.group())), pattern)


def by_qualified_name(g: Graph, pattern: str, kinds: list[str] = GLOB_KINDS) -> DataFrame:
    return g.nodes.filter(F.col("kind").isin(kinds) & F.col("qualified_name").rlike(glob_regex(pattern)))


def exported(g: Graph, path: str | None = None) -> DataFrame:
    nodes = g.nodes.filter("is_exported")
    return nodes.filter(F.col("file_path") == path) if path else nodes


def module_structure(g: Graph) -> DataFrame:
    """Directory of every file as rows (dir, path), so no directory is held in one task."""
    files = g.files.select("path") if g.files is not None else g.nodes.select(F.col("file_path").alias("path"))
    return files.distinct().select(dirname("path", ".").alias("dir"), "path")


def context_of(g: Graph, ids: DataFrame) -> DataFrame:
    """Surroundings of the given nodes as rows (id, section, node, kind, ord).

    Sections: ancestors, children, incoming, outgoing (both without containment), types,
    imports of the file the node lies in. Rows rather than arrays keep hub nodes safe.
    """
    ids = cut(ids.select("id").distinct(), "focal")
    none = F.lit(None).cast("string")

    def section(df: DataFrame, name: str, node: str, kind: Column = none) -> DataFrame:
        return df.select("id", F.lit(name).alias("section"), F.col(node).alias("node"), kind.alias("kind"))

    out_edges = g.edges.join(ids, F.col("source") == F.col("id")).select("id", "target", "kind")
    in_edges = g.edges.join(ids, F.col("target") == F.col("id")).select("id", "source", "kind")
    up = cut(traversal.ancestors(g, ids), "ancestors")
    files = up.join(g.nodes.filter("kind = 'file'").select(F.col("id").alias("ancestor")), "ancestor", "left_semi")
    first_file = files.groupBy("id").agg(F.min_by("ancestor", "level").alias("file"))
    imports = g.edges.filter("kind = 'imports'").join(first_file, F.col("source") == F.col("file"))
    return union_all([
        section(up, "ancestors", "ancestor"),
        section(out_edges.filter("kind = 'contains'"), "children", "target", F.col("kind")),
        section(in_edges.filter("kind != 'contains'"), "incoming", "source", F.col("kind")),
        section(out_edges.filter("kind != 'contains'"), "outgoing", "target", F.col("kind")),
        section(out_edges.filter("kind in ('type_of', 'returns')").select("id", "target").distinct(),
                "types", "target"),
        section(imports, "imports", "target", F.col("kind")),
    ])


def node_metrics(g: Graph, with_depth: bool = True) -> DataFrame:
    """Edge counts of every node and its containment depth.

    Both edge directions become one signed row set, so one pre-aggregated shuffle counts all.
    """
    def one(kind: str) -> Column:
        return (F.col("kind") == kind).cast("long")

    zero, single = F.lit(0).cast("long"), F.lit(1).cast("long")
    columns = ["i", "o", "c", "r", "k", "d", "node"]

    def rows(df: DataFrame, **values: Column) -> DataFrame:
        return df.select("id", *[values.get(c, zero).alias(c) for c in columns])

    parts = [rows(g.nodes.select("id"), node=single),
             rows(g.edges.select(F.col("source").alias("id"), "kind"), o=single, c=one("calls"), k=one("contains")),
             rows(g.edges.select(F.col("target").alias("id"), "kind"), i=single, r=one("calls"))]
    if with_depth:
        parts.append(rows(containment_depth(g), d=F.col("depth")))
    sums = union_all(parts).groupBy("id").agg(
        F.sum("i").alias("incoming_edge_count"), F.sum("o").alias("outgoing_edge_count"),
        F.sum("c").alias("call_count"), F.sum("r").alias("caller_count"), F.sum("k").alias("child_count"),
        F.max("d").alias("depth"), F.max("node").alias("_node"))
    if not with_depth:
        return sums.drop("depth", "_node")
    return sums.withColumn("depth", F.when(F.col("_node") == 1, F.col("depth")).otherwise(zero)).drop("_node")


def containment_depth(g: Graph) -> DataFrame:
    """(id, depth) of everything inside something else: the length of its chain of first parents.

    Depths go down from the outermost containers, so a node is written once and not once for each of its
    ancestors. Only what hangs on a cycle follows its own chain, which stops where it would repeat.
    """
    edges = g.edges.filter("kind = 'contains'")
    parent = edges.groupBy(F.col("target").alias("id")).agg(F.min("source").alias("up"))
    parent = cut(parent.filter("id != up"), "parent")  # a node that is its own parent is an outermost one
    top = parent.select(F.col("up").alias("id")).distinct().join(parent.select("id"), "id", "left_anti")
    level, levels, n = cut(top, "top"), [], 0
    while True:
        n += 1
        level = cut(parent.join(level.select(F.col("id").alias("up")), "up").select("id"), "depth")
        if level.isEmpty():
            break
        levels.append(level.withColumn("depth", F.lit(n).cast("long")))
    if not levels:
        levels = [parent.select("id").limit(0).withColumn("depth", F.lit(0).cast("long"))]
    found = union_all(levels)
    circling = cut(parent.join(found.select("id"), "id", "left_anti").select("id"), "circling")
    if circling.isEmpty():
        return found
    chains = traversal.ancestors(g, circling).groupBy("id").agg(F.max("level").cast("long").alias("depth"))
    return found.unionByName(chains)


def dead_code(g: Graph, kinds: list[str] | None = None) -> DataFrame:
    """Unexported nodes nothing but their container points at."""
    kinds = kinds or ["function", "method", "class"]
    used = g.edges.filter("kind != 'contains'").select(F.col("target").alias("id"))
    return g.nodes.filter(F.col("kind").isin(kinds) & ~F.col("is_exported")).join(used, "id", "left_anti")


def filtered_subgraph(g: Graph, condition: Column, kinds: list[str] = SUBGRAPH_KINDS) -> Graph:
    """Nodes passing a predicate and the edges among them."""
    nodes = g.nodes.filter(F.col("kind").isin(kinds) & condition)
    ids = nodes.select("id")
    edges = (
        g.edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
        .join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    )
    return Graph(nodes, edges, g.files, g.refs)


def _ends(pairs: DataFrame) -> DataFrame:
    """Keep edges whose source has an incoming and whose target has an outgoing edge, to a fixpoint."""
    n = pairs.count()
    while True:
        kept = cut(
            pairs.join(pairs.select(F.col("dst").alias("src")), "src", "left_semi")
            .join(pairs.select(F.col("src").alias("dst")), "dst", "left_semi"), "trim")
        m = kept.count()
        if m == n:
            return kept
        pairs, n = kept, m


def _spread(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """Largest label of any predecessor, to a fixpoint: labels(id, color), pairs(src, dst). Only labels that
    changed in a round are pushed in the next one."""
    changed = labels
    while True:
        pushed = pairs.join(changed, F.col("src") == F.col("id")).groupBy(F.col("dst").alias("id")).agg(F.max("color").alias("pushed"))
        nxt = cut(labels.join(pushed, "id", "left").select(
            "id", F.greatest("color", F.coalesce("pushed", "color")).alias("color"),
            (F.coalesce("pushed", "color") > F.col("color")).alias("changed")), "color")
        labels, changed = nxt.select("id", "color"), nxt.filter("changed").select("id", "color")
        if changed.isEmpty():
            return labels


def cycles(pairs: DataFrame) -> DataFrame:
    """Strongly connected components with more than one member: (component, id).

    Forward colouring with backward closure: after trimming edges that lie on no cycle, every
    node takes the largest id that reaches it; the nodes of a colour that can reach the
    colour's root are one component. Found components leave, the rest goes round again.
    `pairs` has columns src and dst.
    """
    rest = cut(pairs.filter("src != dst").select("src", "dst").distinct(), "pairs")
    found = []
    while True:
        rest = _ends(rest)
        if rest.isEmpty():
            break
        ids = union_all([rest.select(F.col("src").alias("id")), rest.select(F.col("dst").alias("id"))]).distinct()
        colors = _spread(ids.select("id", F.col("id").alias("color")), rest)
        within = cut(
            rest.join(colors.select(F.col("id").alias("src"), F.col("color").alias("c1")), "src")
            .join(colors.select(F.col("id").alias("dst"), F.col("color").alias("c2")), "dst")
            .filter("c1 = c2").select(F.col("dst").alias("src"), F.col("src").alias("dst"),
                                      F.lit("in").alias("kind"), F.lit(None).cast("int").alias("line"),
                                      F.lit(0).alias("prio")), "within")
        roots = colors.filter("id = color").select("id")
        members = traversal.frontier(within, roots).select("id")
        part = cut(members.join(colors, "id").select(F.col("color").alias("component"), "id"), "component")
        found.append(part)
        gone = part.select("id")
        rest = cut(rest.join(gone.withColumnRenamed("id", "src"), "src", "left_anti")
                   .join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti"), "pairs")
    if not found:
        return pairs.selectExpr("src as component", "dst as id", "cast(0 as bigint) as size").limit(0)
    every = union_all(found)
    sizes = every.groupBy("component").agg(F.count("*").alias("size"), F.min("id").alias("name")).filter("size > 1")
    return every.join(sizes, "component").select(F.col("name").alias("component"), "id", "size")


def circular_dependencies(g: Graph) -> DataFrame:
    """Groups of files that depend on each other in a circle."""
    pairs = traversal.file_edges(g).select(F.col("file").alias("src"), F.col("depends_on").alias("dst"))
    return cycles(pairs)


def blast_radius(g: Graph, roots: DataFrame) -> DataFrame:
    """Per root: distinct callers, caller files, test files among them."""
    edges = traversal.callers(g, roots).select("id", "caller").distinct()
    at = g.nodes.select(F.col("id").alias("caller"), "file_path")
    rows = edges.join(at, "caller")
    per_file = rows.groupBy("id", "file_path").agg(F.count("*").alias("n"))
    return per_file.groupBy("id").agg(
        F.sum("n").alias("callers"), F.count("*").alias("caller_files"),
        F.sum(is_test_file("file_path").cast("long")).alias("test_files"))


def polymorphic_types(g: Graph, least: int = 3) -> DataFrame:
    """Types that at least `least` others extend or implement."""
    kinds = ["extends", "implements"]
    return (
        g.edges.filter(F.col("kind").isin(kinds)).select("source", "target").distinct()
        .groupBy(F.col("target").alias("id")).agg(F.count("*").alias("inheritors"))
        .filter(F.col("inheritors") >= least)
    )


def outline(g: Graph, containers: DataFrame) -> DataFrame:
    """Members of containers with their position."""
    kids = traversal.children(g, containers)
    info = g.nodes.select(F.col("id").alias("child"), "kind", "name", "signature", "start_line")
    return kids.join(info, "child")


def fan_out_cap(edges: DataFrame, key: str, cap: int) -> DataFrame:
    """Edges of sources or targets with at most `cap` edges; generic hubs leave whole."""
    small = edges.groupBy(key).agg(F.count("*").alias("fan")).filter(F.col("fan") <= cap).select(key)
    return edges.join(small, key, "left_semi")


CALL_KINDS = CALLER_KINDS
