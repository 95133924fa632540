"""Edges derived from references, kept up to date by what a change touches.

An edge is supported by the references that resolve to it. A change resolves only references it can
reach, once against the old definitions and once against the new ones; the difference is a signed count per
edge. An edge whose support falls to zero is gone, one whose support rises from zero is new.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import basename
from ..graph import Graph
from ..lineage import cut, union_all
from . import resolve, traversal

EDGE = ["source", "target", "kind", "line"]
Resolver = Callable[[Graph, DataFrame], DataFrame]


def _words(name: str) -> Column:
    """Parts of a name or path, lower-cased, each also without its ending."""
    parts = F.split(F.lower(name), r"::|[./()#\\]+")
    return F.array_distinct(F.filter(parts, lambda w: w != ""))


def changed_files(paths: DataFrame) -> DataFrame:
    return paths.select(F.col("path").alias("file_path")).distinct()


def touched_words(old: Graph, new: Graph, paths: DataFrame) -> DataFrame:
    """(word) a change may give another meaning: words of the names defined in changed files before or after,
    of the files themselves, and of all subtypes of types defined there, which inherit what they offer."""
    files = changed_files(paths)
    names = []
    for g in (old, new):
        inside = cut(g.nodes.join(files, "file_path", "left_semi").select("id", "name", "kind"), "touched")
        names.append(inside.select("name"))
        below = traversal.type_hierarchy(g, inside, ("down",)).select("id").distinct()
        names.append(g.nodes.select("id", "name").join(below, "id").select("name"))
    names.append(files.select(basename("file_path").alias("name")))
    return union_all(names).select(F.explode(_words("name")).alias("word")).distinct()


def affected(refs: DataFrame, paths: DataFrame, words: DataFrame) -> DataFrame:
    """References of changed files, and those elsewhere with a touched word in their name.

    Names are matched once each, so a frequent name does not gather its references in one task.
    """
    files = changed_files(paths)
    inside = refs.join(files, "file_path", "left_semi")
    outside = refs.join(files, "file_path", "left_anti")
    names = outside.select("reference_name").distinct().withColumn("word", F.explode(_words("reference_name")))
    met = names.join(words, "word", "left_semi").select("reference_name").distinct()
    return inside.unionByName(outside.join(met, "reference_name", "left_semi"))


def _whole(g: Graph, refs: DataFrame) -> DataFrame:
    return resolve.resolve(g, refs, keep=resolve.EDGE_OF)


def supports(g: Graph, refs: DataFrame, resolver: Resolver = _whole) -> DataFrame:
    """(source, target, kind, line, n): edges with the number of references that give them."""
    refs = cut(refs, "refs")
    edges = resolve.edges_from(g, refs, resolver(g, refs))
    return edges.groupBy(*EDGE).agg(F.count("*").alias("n"))


def structure(g: Graph, paths: DataFrame | None = None) -> DataFrame:
    """Supports of the edges the graph itself brings, those that leave changed files if `paths` are given."""
    edges = g.edges
    if paths is not None:
        inside = g.nodes.join(changed_files(paths), "file_path", "left_semi").select(F.col("id").alias("source"))
        edges = edges.join(inside, "source", "left_semi")
    return edges.groupBy(*EDGE).agg(F.count("*").alias("n"))


def change(old: Graph, new: Graph, paths: DataFrame, resolver: Resolver = _whole) -> DataFrame:
    """Signed supports between two states that differ in the files `paths`: (source, target, kind, line, n), n not 0.

    Both graphs hold nodes, references and the edges that extraction itself gives; resolved ones are derived here.
    """
    words = cut(touched_words(old, new, paths), "words")
    signed = []
    for g, sign in ((old, -1), (new, 1)):
        for part in (supports(g, affected(g.refs, paths, words), resolver), structure(g, paths)):
            signed.append(part.withColumn("n", sign * F.col("n")))
    return union_all(signed).groupBy(*EDGE).agg(F.sum("n").alias("n")).filter("n != 0")
