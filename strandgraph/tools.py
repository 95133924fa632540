"""The query surface: search, callers, callees, impact, explore, node, files, status."""

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions.paths import is_generated_file
from .graph import Graph
from .lineage import cut
from .operators import context, ordered, scans, search, structure, sync, traversal
from .sources import files as S

# Kinds that may be asked for by another name, and what inferred edges are called.
KIND_ALIAS = {"type": "type_alias"}
EDGE_LABELS = {
    "callback": "callback via {via}", "react-render": "React re-render via setState", "jsx-render": "renders <{via}>",
    "vue-handler": "Vue @{event} handler", "event-emitter": "event {event}", "interface-impl": "interface dispatch {via}",
    "closure-collection": "closure collection {field}", "flutter-build": "Flutter rebuild via setState",
    "cpp-override": "virtual override {via}", "rn-event-channel": "native event {event}",
    "gin-middleware-chain": "middleware {via}", "sveltekit-load": "SvelteKit {via}",
}
MAX_CHARS = 15_000


def clamp(value: int | None, low: int, high: int, default: int) -> int:
    return min(max(int(value if value is not None else default), low), high)


def edge_label():
    """Readable label of an inferred edge from its metadata."""
    by = F.col("metadata")["synthesizedBy"]
    out = None
    for name, text in EDGE_LABELS.items():
        parts = [F.coalesce(F.col("metadata")[p[1:-1]], F.lit("")) if p.startswith("{") else F.lit(p)
                 for p in re.split(r"(\{\w+\})", text) if p]
        label = F.concat(*parts)
        out = F.when(by == name, label) if out is None else out.when(by == name, label)
    at = F.coalesce(F.concat(F.lit(" @"), F.col("metadata")["registeredAt"]), F.lit(""))
    return F.concat(out.otherwise(F.col("kind")), at)


def truncate(text: str, most: int = MAX_CHARS) -> str:
    """Cut at the last line break before the limit."""
    if len(text) <= most:
        return text
    at = text.rfind("\n", 0, most)
    return text[: at if at > 0 else most] + "\n\n... (output truncated)"


def at_line(defs: DataFrame, line: int) -> DataFrame:
    """Definitions around a line, else the one that starts nearest to it."""
    holds = cut(defs.filter((F.col("start_line") <= line) & (F.col("end_line") >= line)), "at-line")
    return holds if not holds.isEmpty() else defs.orderBy(F.abs(F.col("start_line") - line), "id").limit(1)


class Tools:
    """Queries on one graph; `sources(path, content)` is needed where code is shown."""

    def __init__(self, graph: Graph, sources: DataFrame | None = None, pending: DataFrame | None = None):
        self.g, self.sources, self.pending = graph, sources, pending

    def search(self, query: str, kind: str | None = None, limit: int | None = None) -> DataFrame:
        """Ranked symbols, generated files last."""
        limit = clamp(limit, 1, 100, 10)
        kinds = [KIND_ALIAS.get(kind, kind)] if kind else None
        rows = search.search(self.g, query, kinds=kinds, limit=limit)
        return rows.orderBy(is_generated_file("file_path"), F.desc("score"), "id")

    def _definitions(self, symbol: str, file: str | None) -> DataFrame:
        return cut(search.definitions(search.symbol_matches(self.g, symbol), file), "definitions")

    def _neighbours(self, symbol: str, file: str | None, side: str, limit: int | None) -> DataFrame:
        defs = self._definitions(symbol, file)
        edges = traversal.callers(self.g, defs) if side == "caller" else traversal.callees(self.g, defs)
        keyed = edges.join(defs.select("id", "definition"), "id")
        first = keyed.groupBy("definition", F.col(side).alias("other")).agg(
            F.min(F.struct(F.coalesce("line", F.lit(0)).alias("line"), F.col("kind"))).alias("e"))
        info = self.g.nodes.select(F.col("id").alias("other"), "name", F.col("kind").alias("node_kind"), "file_path", "start_line")
        rows = first.join(info, "other").select(
            "definition", F.col("other").alias("id"), "name", "node_kind", "file_path", "start_line", F.col("e.kind").alias("via"), F.col("e.line").alias("line"))
        return rows.orderBy("definition", is_generated_file("file_path"), "file_path", "start_line", "id").limit(clamp(limit, 1, 100, 20))

    def callers(self, symbol: str, file: str | None = None, limit: int | None = None) -> DataFrame:
        return self._neighbours(symbol, file, "caller", limit)

    def callees(self, symbol: str, file: str | None = None, limit: int | None = None) -> DataFrame:
        return self._neighbours(symbol, file, "callee", limit)

    def impact(self, symbol: str, depth: int | None = None, file: str | None = None) -> DataFrame:
        """Nodes a change of any definition of the symbol may affect."""
        defs = self._definitions(symbol, file)
        reached = traversal.impact(self.g, defs, clamp(depth, 1, 10, 2))
        return reached.join(self.g.nodes.select("id", "kind", "name", "file_path", "start_line"), "id")

    def impact_edges(self, symbol: str, depth: int | None = None) -> DataFrame:
        """Distinct edges among the affected nodes."""
        ids = self.impact(symbol, depth).select("id")
        return scans.edges_between(self.g, ids).select("source", "target", "kind").distinct()

    def node(self, symbol: str, file: str | None = None, line: int | None = None, budget: int = 12_000) -> DataFrame:
        """Definitions of a symbol with code; file and line narrow but never empty the choice."""
        defs = self._definitions(symbol, file)
        if line is not None:
            defs = at_line(defs, line)
        coded = S.snippet(defs, self.sources)
        # Whole definitions while the size lasts: every code has a character, so `budget` rows are enough to fill it.
        first = [is_generated_file("file_path"), F.col("file_path"), F.col("start_line"), F.col("id")]
        lead = coded.filter(F.length("code") > 0).select("id", F.length("code").alias("size"), *[c.alias(f"_o{i}") for i, c in enumerate(first)])
        lead = lead.orderBy("_o0", "_o1", "_o2", "_o3").limit(budget)
        so_far = Window.orderBy("_o0", "_o1", "_o2", "_o3").rowsBetween(Window.unboundedPreceding, 0)
        fits = lead.withColumn("used", F.sum("size").over(so_far)).filter(F.col("used") <= budget).select("id", F.lit(True).alias("_fits"))
        return coded.join(F.broadcast(fits), "id", "left").withColumn(  # at most `budget` rows
            "code", F.when(F.col("_fits") | (F.length("code") == 0), F.col("code"))).select(coded.columns)

    def trail(self, symbol: str, k: int = 5) -> DataFrame:
        return traversal.trail(self.g, self._definitions(symbol, None), k)

    def file_view(self, path: str, offset: int = 1, limit: int = 2000, candidates: int | None = None) -> DataFrame:
        """Numbered lines of the file that answers to a path, if just one does, else all (or some) candidates."""
        hits = cut(S.find_file(self.sources, path), "file")
        if hits.limit(2).count() != 1:
            found = hits.select("path").orderBy("path")
            return found if candidates is None else found.limit(candidates)
        return S.numbered(hits, offset, limit).orderBy("line")

    def files(self, path: str | None = None, pattern: str | None = None, max_depth: int | None = None) -> DataFrame:
        """Indexed files, narrowed by folder, glob and depth."""
        rows = self.g.files
        folder = re.sub(r"^(\./|/|\.$)+", "", (path or "").replace("\\", "/")).rstrip("/")
        if folder:
            rows = rows.filter((F.col("path") == folder) | F.col("path").startswith(folder + "/"))
        if pattern:
            rows = rows.filter(F.col("path").rlike(structure.path_glob_regex(pattern)))
        if max_depth is not None:
            rows = rows.filter(F.size(F.split("path", "/")) <= max_depth)
        return rows.orderBy("path")

    def files_by_language(self) -> DataFrame:
        return self.g.files.groupBy("language").agg(F.count("*").alias("files"), F.sum("node_count").alias("symbols"))

    def tree(self) -> DataFrame:
        """Every folder with the number of files below it."""
        parts = F.split("path", "/")
        up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
        rows = self.g.files.filter(F.size(parts) > 1).select(F.explode(up).alias("folder"))
        return rows.groupBy("folder").agg(F.count("*").alias("files")).orderBy("folder")

    def status(self) -> DataFrame:
        """Counts in long form with size and pending changes."""
        rows = scans.stats(self.g)
        size = self.g.files.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("n")).select(
            F.lit("total").alias("section"), F.lit("bytes").alias("key"), "n")
        rows = rows.unionByName(size)
        if self.pending is not None:
            rows = rows.unionByName(self.pending.agg(F.count("*").alias("n")).select(
                F.lit("total").alias("section"), F.lit("pending").alias("key"), "n"))
        return rows

    def stale(self, results: DataFrame) -> DataFrame:
        """Files among the results that wait for a sync."""
        return sync.stale_results(results, self.pending)

    def affected(self, changed: DataFrame, depth: int = 5, pattern: str | None = None) -> DataFrame:
        regex = structure.affected_glob_regex(pattern) if pattern else None
        return traversal.affected_tests(self.g, changed, depth, regex).orderBy("path")

    def context(self, task: str, **options) -> context.Context:
        return context.find(self.g, task, **options)

    def explore(self, query: str, max_files: int | None = None) -> DataFrame:
        """Source sections of the most relevant files within the output budget: file, lines, text."""
        count = self.g.files.count()
        budget = context.output_budget(count)
        ctx = context.find(self.g, query, search_limit=8, depth=3, max_nodes=200, min_score=0.2)
        order = context.file_ranking(ctx, query).limit(clamp(max_files, 1, 20, budget["files"]))
        order = cut(order.withColumn("rank", F.monotonically_increasing_id()), "order")
        inside = ctx.nodes.join(order.select("file_path"), "file_path", "left_semi").filter("start_line > 0")
        weight = F.when(F.col("is_root"), 10).when(F.col("kind").isin("function", "method", "class"), 3).otherwise(1)
        spans = inside.filter("kind != 'file'").select("file_path", "start_line", "end_line", weight.alias("w"))
        edges = ctx.edges.filter("line > 0 and kind != 'contains'").join(
            inside.select(F.col("id").alias("source"), "file_path"), "source").select(
            "file_path", F.col("line").alias("start_line"), F.col("line").alias("end_line"), F.lit(2).alias("w")).distinct()
        spans = cut(spans.unionByName(edges), "spans")
        merged = cut(ordered.islands(spans, ["file_path"], F.col("start_line"), F.col("end_line"), budget["gap"], 1000), "islands")
        scored = spans.join(merged, "file_path").filter("start_line >= start and start_line <= end").groupBy(
            "file_path", "island", "start", "end").agg(F.sum("w").alias("score"), F.max("w").alias("importance"))
        text = self.sources.select(F.col("path").alias("file_path"), F.split("content", "\n").alias("_l"))
        first = F.greatest(F.col("start") - 3, F.lit(1)).cast("int")
        last = F.least(F.col("end") + 3, F.size("_l")).cast("int")
        coded = scored.join(text, "file_path").withColumn("first", first).withColumn("last", last).withColumn(
            "code", F.array_join(F.slice("_l", F.col("first"), F.greatest(F.col("last") - F.col("first") + 1, F.lit(0))), "\n")).drop("_l")
        coded = cut(coded.withColumn("chars", F.length("code")), "sections")
        picked = context.pick_clusters(coded, budget["per_file"])
        return coded.join(picked, ["file_path", "island"]).join(order.select("file_path", "rank"), "file_path").select(
            "rank", "file_path", "first", "last", "code").orderBy("rank", "first")

    def blast_radius(self, symbol: str) -> DataFrame:
        return structure.blast_radius(self.g, self._definitions(symbol, None))


def markdown(ctx: context.Context, blocks: DataFrame | None = None) -> str:
    """A context as text; its size is bounded by the limits it was found with."""
    rows = ctx.nodes.orderBy(F.desc("is_root"), F.desc("score"), "ord", "id").select(
        "name", "kind", "file_path", "start_line", "is_root").collect()
    out = ["## Code Context", "", context.summary(ctx), ""]
    if ctx.confidence == "low":
        out += ["> Low confidence: no symbol answers to more than one word of the query.", ""]
    for title, flag in (("### Entry Points", True), ("### Related Symbols", False)):
        out += [title, ""] + [f"- {r['name']} ({r['kind']}) - {r['file_path']}:{r['start_line']}" for r in rows if r["is_root"] is flag] + [""]
    if blocks is not None:
        for b in blocks.collect():
            out += [f"#### {b['name']} ({b['file_path']}:{b['start_line']})", "", f"```{b['language']}", b["content"], "```", ""]
    return truncate("\n".join(out))


def as_json(df: DataFrame) -> DataFrame:
    """Rows as JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))
