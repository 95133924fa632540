"""From source files to a finished graph: extract, routes, resolve, infer."""

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..lineage import cut, union_all
from ..operators import imports, packages, resolve, scopes, synth
from ..schema import as_edges
from . import extract as X
from . import frameworks as FW


def build(files: DataFrame, aliases: dict[str, str] | None = None, manifests: DataFrame | None = None) -> Graph:
    """Graph of a source tree: files(path, language, content, ...) as `read_contents` gives them.

    `manifests`(path, content) as `read_manifests` gives them name the packages of the project.
    References stay with the graph, so a later sync can resolve them anew; edges are derived.
    """
    files = cut(files, "files")
    lines = cut(X.lines_of(files), "lines", ["language"])
    nodes, contains, raw = X.symbols(files, lines)
    refs = X.references(lines, nodes, raw)
    refs = cut(refs.unionByName(X.functions_as_values(lines, nodes, refs)).dropDuplicates(["ref_id"]), "refs")
    roots = None if manifests is None else cut(packages.manifest_roots(manifests), "roots")
    mounted = cut(FW.mounted_prefixes(lines, nodes, FW.mount_table(lines, nodes, files, aliases, roots)), "mounted")
    route_nodes, route_refs = FW.routes(lines, nodes, FW.detect(files), mounted, FW.module_prefixes(files, nodes))
    route_refs = cut(route_refs, "route-refs")
    nodes = nodes.unionByName(FW.with_module_prefixes(route_nodes, lines)).unionByName(FW.file_routes(files)).unionByName(FW.bridge_nodes(lines))
    nodes = cut(nodes.dropDuplicates(["id"]), "nodes")
    base = Graph(nodes, as_edges(contains), files, refs)

    handled = FW.resolve_handlers(nodes, route_refs.filter("reference_kind != 'imports'")).unionByName(
        FW.resolve_includes(nodes, files, route_refs, aliases, roots))
    declared = cut(scopes.declarations(lines, nodes), "declarations")
    chains = cut(scopes.scope_chains(base), "chains")
    strong = imports.via_import(nodes, files, refs, aliases, roots).unionByName(imports.jvm_import(nodes, refs)).unionByName(
        scopes.typed_receiver(base, refs, declared, chains))
    answers = resolve.resolve(base, refs, strong)
    first = answers.groupBy("ref_id").agg(F.min_by(F.struct("target", "confidence", "resolved_by"), F.struct(-F.col("confidence"), "resolved_by", "target")).alias("a")).select("ref_id", "a.*")
    every = cut(refs.unionByName(route_refs), "all-refs")
    found = cut(resolve.edges_from(base, every, first.unionByName(handled)), "resolved")
    # Second stage: calls on returned types and inherited members need the inheritance edges above.
    linked = Graph(nodes, base.edges.unionByName(as_edges(found)), files, every)
    open_ = every.join(first, "ref_id", "left_anti")
    late = resolve.edges_from(linked, open_, union_all([
        resolve.call_chain(linked, open_), resolve.this_member(linked, open_), scopes.typed_receiver(linked, open_, declared, chains)]).groupBy("ref_id").agg(
        F.min_by(F.struct("target", "confidence", "resolved_by"), F.struct(-F.col("confidence"), "resolved_by", "target")).alias("a")).select("ref_id", "a.*"))
    linked = replace(linked, edges=cut(linked.edges.unionByName(as_edges(late)), "edges"))
    inferred = cut(synth.synthesize(linked, files.select("path", "content")), "inferred")
    nodes = nodes.unionByName(synth.channel_nodes(inferred))
    counts = nodes.groupBy(F.col("file_path").alias("path")).agg(F.count("*").cast("int").alias("node_count"))
    return replace(linked, nodes=nodes, edges=cut(linked.edges.unionByName(as_edges(inferred)), "edges"),
                   files=files.drop("content").join(counts, "path", "left"))
