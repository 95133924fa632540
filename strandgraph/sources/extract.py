"""Extraction of nodes, edges and references from source text with Spark.

Files become lines, lines meet the patterns of their language, and blocks come from a window
over the opening and closing lines of each nesting level. Every step is a column expression,
so the work spreads by file and line; a file is at most one mebibyte, which bounds what any
window or array of one file holds.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph
from ..lineage import cut, union_all
from ..operators.ordered import enclosing
from ..operators.resolve import with_ref_id
from ..operators.traversal import ancestors
from ..schema import as_edges, as_nodes, as_refs
from . import rules as R

FN = ["function", "method", "component"]
COMPONENT_FILES = ["vue", "svelte", "astro"]
TYPES = ["class", "interface", "struct", "trait", "protocol", "enum", "module", "namespace"]


def node_id(kind: Column, path: Column, name: Column, line: Column) -> Column:
    """Stable id of a symbol: its kind and a digest of path, kind, name and line."""
    digest = F.sha2(F.concat_ws(":", path, kind, name, line.cast("string")), 256)
    return F.concat(kind, F.lit(":"), F.substring(digest, 1, 32))


def _by_language(mapping: dict[str, str], default: str, use) -> Column:
    """Apply the expression of each language; the default one elsewhere."""
    groups: dict[str, list[str]] = {}
    for lang, value in mapping.items():
        groups.setdefault(value, []).append(lang)
    out = None
    for value, langs in groups.items():
        cond = F.col("language").isin(langs)
        out = F.when(cond, use(value)) if out is None else out.when(cond, use(value))
    return use(default) if out is None else out.otherwise(use(default))


def strip_comments(content: Column) -> Column:
    """Blank comments (and Python's long strings); line breaks stay, so line numbers hold, and strings stay."""
    def blanked(pattern: str) -> Column:
        found = F.regexp_extract_all(content, F.lit(f"({pattern})"), 1)
        gaps = F.split(content, pattern, -1)
        kept = F.transform(found, lambda t: F.when(
            t.rlike("^(?:r#*)?[\"'`]") & ~((F.col("language") == "python") & t.rlike("^(\"\"\"|\'\'\')")), t).otherwise(F.regexp_replace(t, r"[^\n]", "")))
        return F.array_join(F.zip_with(gaps, kept, lambda g, t: F.concat(g, F.coalesce(t, F.lit("")))), "")

    patterns = {lang: "|".join(f"(?:{t})" for t in tokens) for lang, tokens in R.TOKENS.items()}
    return _by_language(patterns, "|".join(f"(?:{t})" for t in R.DEFAULT_TOKENS), blanked)


def lines_of(files: DataFrame) -> DataFrame:
    """(path, language, line, raw, text, depth, indent): one row per line."""
    clean = files.filter("content is not null").select("path", "language", "content", strip_comments(F.col("content")).alias("clean"))
    pairs = F.arrays_zip(F.split("content", "\n").alias("raw"), F.split("clean", "\n").alias("text"))
    rows = clean.select("path", "language", F.posexplode(pairs).alias("pos", "p")).select(
        "path", "language", (F.col("pos") + 1).alias("line"), "p.raw", "p.text")
    code = F.regexp_replace("text", r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|`[^`]*`", "")
    step = F.regexp_count(code, F.lit(r"\{")) - F.regexp_count(code, F.lit(r"\}"))
    upto = Window.partitionBy("path").orderBy("line")
    rows = rows.withColumn("step", step.cast("int")).withColumn("after", F.sum("step").over(upto).cast("int"))
    indent = F.length(F.regexp_extract(F.regexp_replace("text", "\t", "    "), "^( *)", 1))
    return rows.withColumn("indent", F.when(F.trim("text") != "", indent))


def _languages(lines: DataFrame) -> list[str]:
    """Languages present, at most as many as there are language tags."""
    return sorted(r["language"] for r in lines.select("language").distinct().collect())


def _definitions(lines: DataFrame) -> DataFrame:
    """(path, language, line, kind, name, supers): first rule that fits a line.

    One branch per language present; the stored lines are in language folders, so a branch
    reads its own folder and its generated code stays small.
    """
    branches = []
    for lang in _languages(lines):
        first = None
        for kind, pattern in R.DEFINITIONS.get(lang, []):
            supers = F.regexp_extract("text", pattern, 2) if _has_second_group(pattern) else F.lit("")
            hit = F.struct(F.lit(kind).alias("kind"), F.regexp_extract("text", pattern, 1).alias("name"), supers.alias("supers"))
            first = F.when(F.col("text").rlike(pattern), hit) if first is None else first.when(F.col("text").rlike(pattern), hit)
        if first is not None:
            branches.append(lines.filter(F.col("language") == lang).withColumn("d", first).filter("d is not null"))
    if not branches:
        branches = [lines.limit(0).withColumn("d", F.expr("named_struct('kind', '', 'name', '', 'supers', '')"))]
    rows = union_all(branches).select(
        "path", "language", "line", "raw", "text", "after", "step", "indent", "d.kind", "d.name", "d.supers")
    return rows.filter((F.col("name") != "") & ~F.col("name").isin(R.NOT_CALLS))


def _has_second_group(pattern: str) -> bool:
    import re
    return re.compile(pattern.replace("(?i)", "").replace("\\z", "\\Z")).groups >= 2


def _with_ends(defs: DataFrame, lines: DataFrame) -> DataFrame:
    """End line of every definition: the next line that closes its nesting level.

    Definitions and closing lines of one level form one ordered sequence; the end is the
    smallest closing line at or after the definition. A definition that opens no block ends
    where it starts.
    """
    indented = F.col("language").isin(R.INDENTED)
    level = F.when(indented, F.col("indent")).otherwise(F.col("after") - F.greatest("step", F.lit(0)))
    starts = defs.select("path", "line", F.lit(0).alias("closes"), level.alias("level"))
    braces = lines.filter(~indented & (F.col("step") <= 0) & F.col("text").contains("}")).select(
        "path", "line", F.lit(1).alias("closes"),
        F.explode(F.sequence("after", F.greatest(F.col("after") - F.col("step"), F.col("after")))).alias("level"))
    used = defs.filter(indented).select("path", F.col("indent").alias("level")).distinct()
    dedent = lines.filter(indented & F.col("indent").isNotNull()).select("path", "line", "indent", "text").join(
        used, "path").filter("indent <= level")
    shut = F.trim("text").rlike(r"(?i)^(end\b|end;|\}|\)|@end)")
    dedent = dedent.select("path", F.when(shut, F.col("line")).otherwise(F.col("line") - 1).alias("line"), F.lit(1).alias("closes"), "level",
                           F.col("line").alias("at"))
    seq = union_all([starts.withColumn("at", F.col("line")), braces.withColumn("at", F.col("line")), dedent])
    later = Window.partitionBy("path", "level").orderBy("at", F.desc("closes")).rowsBetween(1, Window.unboundedFollowing)
    ended = seq.withColumn("end_line", F.min(F.when(F.col("closes") == 1, F.col("line"))).over(later)).filter("closes = 0")
    total = lines.groupBy("path").agg(F.max("line").alias("total"))
    ended = defs.join(ended.select("path", "line", "end_line"), ["path", "line"]).join(total, "path")
    opens = (F.col("step") > 0) | indented | F.col("text").rlike(r"\)\s*$|^\s*(?:\w+\s+)*(?:class|interface|struct)\b[^;]*$")
    one_liner = F.col("text").rlike(r"\{.*\}\s*$") | F.col("kind").isin("constant", "variable", "field", "property", "type_alias")
    return ended.withColumn("end_line", F.when(one_liner | ~opens, F.col("line")).otherwise(
        F.greatest(F.col("line"), F.coalesce("end_line", F.when(indented, F.col("total")).otherwise(F.col("line")))))).drop("total")


def _comments(lines: DataFrame) -> DataFrame:
    """(path, line, docstring): comment block that ends right above a line."""
    mark = F.trim("raw").rlike(r"^(///?|/\*|\*|#|--|<!--)") & (F.trim("text") == "") | (F.trim("raw").rlike(r"^#") & ~F.trim("raw").rlike(r"^#\s*(include|define|if|endif|import)"))
    order = Window.partitionBy("path").orderBy("line")
    rows = lines.filter(mark & (F.trim("raw") != "")).select(
        "path", "line", F.regexp_replace(F.trim("raw"), r"^(/\*+|\*/|\*|///?!?|#+!?|--+)\s?|\s*\*/$", "").alias("t"))
    rows = rows.withColumn("run", F.col("line") - F.row_number().over(order))
    return rows.groupBy("path", "run").agg(
        (F.max("line") + 1).alias("line"),
        F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "t"))), lambda x: x["t"]), "\n")).alias("docstring")).drop("run")


def component_files(lines: DataFrame) -> DataFrame:
    """Definition rows for files that are one component each, over all their lines and named like them."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.\w+$", "")
    return lines.filter(F.col("language").isin(COMPONENT_FILES)).groupBy("path", "language").agg(F.max("line").alias("end_line")).select(
        "path", "language", F.lit(1).alias("line"), F.lit("").alias("raw"), F.lit("export").alias("text"), F.lit(0).alias("after"),
        F.lit(0).alias("step"), F.lit(0).alias("indent"), F.lit("component").alias("kind"), stem.alias("name"), F.lit("").alias("supers"), "end_line")


def mapper_namespaces(lines: DataFrame) -> DataFrame:
    """(file_path, namespace): what the root of an XML mapper puts before its statements."""
    pattern = r"\bnamespace\s*=\s*[\"']([^\"']+)[\"']"
    xml = lines.filter(F.col("language") == "xml")
    roots = xml.filter(F.col("text").rlike(r"<mapper\b")).groupBy("path").agg(F.min("line").alias("root"))
    # The attribute may stand on a later line of the tag.
    named = xml.filter(F.col("text").rlike(pattern)).join(roots, "path").filter("line >= root")
    return named.groupBy(F.col("path").alias("file_path")).agg(F.min_by(F.regexp_extract("text", pattern, 1), "line").alias("namespace"))


def symbols(files: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of files and definitions, and the `contains` edges among them."""
    ended = _with_ends(_definitions(lines), lines)
    defs = cut(ended.select(component_files(lines).columns).unionByName(component_files(lines)), "defs")
    text = F.col("text")
    receiver = F.regexp_extract("text", r"^func\s+\(\s*\w*\s*\*?(\w+)", 1)
    sig = F.regexp_extract("raw", r"(\([^)]*\)[^{=;]*)", 1)
    name = F.element_at(F.split("name", r"\.|:(?!:)"), -1)
    name = F.when(F.col("language").isin("pascal", "lua", "luau"), name).otherwise(F.col("name"))
    ret = F.coalesce(F.nullif(F.regexp_extract("raw", r"\)\s*(?:->|:)\s*&?([\w.<>:\[\]*|?]+)", 1), F.lit("")),
                     F.when(F.col("language") == "go", F.nullif(F.regexp_extract("raw", r"\)\s+\*?([\w.]+)\s*\{", 1), F.lit(""))))
    exported = (
        F.when(F.col("language") == "go", name.rlike("^[A-Z]")).when(F.col("language") == "python", ~name.startswith("_"))
        .when(F.col("language") == "rust", text.rlike(r"\bpub\b"))
        .when(F.col("language").isin("typescript", "tsx", "javascript", "jsx", "svelte", "vue", "astro"), text.rlike(r"^\s*export\b"))
        .otherwise(~text.rlike(r"\b(private|protected|static)\b")))
    nodes = defs.select(
        node_id(F.col("kind"), F.col("path"), name, F.col("line")).alias("id"), "kind", name.alias("name"),
        F.col("path").alias("file_path"), "language", F.col("line").alias("start_line"), "end_line",
        F.coalesce("indent", F.lit(0)).alias("start_column"), F.length("raw").alias("end_column"),
        F.nullif(F.trim(sig), F.lit("")).alias("signature"), ret.alias("return_type"),
        F.nullif(F.regexp_extract("text", r"\b(public|private|protected|internal|fileprivate)\b", 1), F.lit("")).alias("visibility"),
        exported.alias("is_exported"), text.rlike(r"\basync\b|\bsuspend\b").alias("is_async"), text.rlike(r"\bstatic\b").alias("is_static"),
        text.rlike(r"\babstract\b|=\s*0\s*;").alias("is_abstract"),
        F.when(text.rlike(r"\bactual\b"), F.array(F.lit("actual"))).when(text.rlike(r"\bexpect\b"), F.array(F.lit("expect"))).alias("decorators"),
        receiver.alias("receiver"), F.trim("supers").alias("supers"))
    docs = _comments(lines).withColumnRenamed("path", "file_path").withColumnRenamed("line", "start_line")
    nodes = cut(nodes.dropDuplicates(["id"]).join(docs, ["file_path", "start_line"], "left"), "symbols")
    # Parent: the tightest other definition around the line above the first statement.
    blocks = nodes.filter(F.col("end_line") > F.col("start_line"))
    inner = nodes.select("id", "file_path", "start_line")
    outer = blocks.select(F.col("id").alias("p"), "file_path", F.col("start_line").alias("ps"), F.col("end_line").alias("pe"))
    # A span shrunk by its own first line cannot contain itself.
    shrunk = outer.select(F.col("p").alias("id"), "file_path", (F.col("ps") + 1).alias("start_line"), F.col("pe").alias("end_line"))
    parent = enclosing(inner.select("file_path", F.col("start_line").alias("line")), shrunk)
    pairs = inner.join(parent.select("file_path", F.col("line").alias("start_line"), F.col("id").alias("parent")), ["file_path", "start_line"], "left")
    file_id = F.concat(F.lit("file:"), F.col("file_path"))
    contains = cut(pairs.select(F.coalesce("parent", file_id).alias("source"), F.col("id").alias("target"),
                                F.lit("contains").alias("kind"), F.col("start_line").alias("line")), "contains")
    chain = ancestors(Graph(nodes, contains)).filter(~F.col("ancestor").startswith("file:"))
    up = chain.join(nodes.select(F.col("id").alias("ancestor"), F.col("name").alias("up_name"), F.col("kind").alias("up_kind")), "ancestor")
    # Nesting depth bounds these lists.
    scopes = up.groupBy("id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("level")).alias("o"), F.col("up_name")))), lambda s: s["up_name"]).alias("scopes"),
        F.max_by("up_kind", -F.col("level")).alias("parent_kind"))
    nodes = nodes.join(scopes, "id", "left").join(mapper_namespaces(lines), "file_path", "left")
    qualified = F.concat_ws("::", F.array_compact(F.concat(
        F.array("namespace"), F.coalesce("scopes", F.array().cast("array<string>")),
        F.array(F.when(F.coalesce("receiver", F.lit("")) != "", F.col("receiver")), F.col("name")))))
    member = F.col("parent_kind").isin(TYPES[:6]) & (F.col("kind") == "function")
    nodes = cut(nodes.withColumn("qualified_name", qualified).withColumn(
        "kind", F.when(member, "method").otherwise(F.col("kind"))), "named")
    file_nodes = files.select(
        F.concat(F.lit("file:"), "path").alias("id"), F.lit("file").alias("kind"), F.element_at(F.split("path", "/"), -1).alias("name"),
        F.col("path").alias("qualified_name"), F.col("path").alias("file_path"), "language", F.lit(1).alias("start_line"),
        F.size(F.split(F.coalesce("content", F.lit("")), "\n")).alias("end_line"))
    return union_all([as_nodes(file_nodes), as_nodes(nodes)]), contains, nodes


def references(lines: DataFrame, nodes: DataFrame, raw: DataFrame) -> DataFrame:
    """Calls, instantiations, decorators, imports, supertypes and type uses as references."""
    def hits(pattern: str, kind: str, df: DataFrame = lines) -> DataFrame:
        return df.filter(F.col("text").rlike(pattern)).select(
            "path", "language", "line", F.explode(F.regexp_extract_all("text", F.lit(pattern), 1)).alias("name"), F.lit(kind).alias("kind"))

    defined = raw.select(F.col("file_path").alias("path"), F.col("start_line").alias("line"), "name").distinct()
    calls = hits(R.CALL, "calls").withColumn("name", F.regexp_replace("name", "->", "."))
    last = F.element_at(F.split("name", r"\.|::"), -1)
    fresh = lines.filter(F.col("text").rlike(R.NEW)).select("path", "line", F.explode(F.regexp_extract_all("text", F.lit(R.NEW), 1)).alias("name"))
    calls = calls.filter(~last.isin(R.NOT_CALLS)).join(defined, ["path", "line", "name"], "left_anti").join(fresh, ["path", "line", "name"], "left_anti")
    uses = hits(R.TYPE_USE, "references", lines.filter(F.col("language").isin(
        "typescript", "tsx", "python", "java", "kotlin", "swift", "csharp", "scala", "rust", "dart", "php")))
    imports = [hits(p, "imports", lines.filter(F.col("language") == lang))
               for lang in _languages(lines) for p in R.IMPORTS.get(lang, [])]
    decorators = hits(R.DECORATOR, "decorates", lines.filter(~F.col("language").isin("objc", "razor")))
    sites = cut(union_all([calls, hits(R.NEW, "instantiates"), uses, decorators, *imports]).distinct(), "sites")
    spans = nodes.filter(F.col("kind").isin(FN + TYPES)).select("id", "file_path", "start_line", "end_line")
    # A decorator stands above what it decorates.
    at = F.when(F.col("kind") == "decorates", F.col("line") + 1).otherwise(F.col("line"))
    sites = sites.withColumn("file_path", F.col("path")).withColumn("at", at)
    around = enclosing(sites.select("file_path", F.col("at").alias("line")), spans).withColumnRenamed("line", "at")
    sites = sites.join(around, ["file_path", "at"], "left").withColumn(
        "from", F.when(F.col("kind") == "imports", F.concat(F.lit("file:"), "path")).otherwise(F.coalesce("id", F.concat(F.lit("file:"), "path"))))
    refs = sites.select(F.col("from").alias("from_node_id"), F.col("name").alias("reference_name"), F.col("kind").alias("reference_kind"),
                        "line", F.lit(0).alias("col"), "file_path", "language")
    # Supertype lists: after `implements` everything is implemented, the rest is extended.
    words = r"([A-Za-z_][\w.]*)(?:<[^>]*>)?"
    sup = raw.filter("supers != ''").select("id", "file_path", "language", "start_line", F.split("supers", r"\bimplements\b").alias("s"))
    both = [("extends", 1), ("implements", 2)]
    supers = union_all([sup.select(
        F.col("id").alias("from_node_id"), F.explode(F.regexp_extract_all(
            F.regexp_replace(F.coalesce(F.try_element_at("s", F.lit(i)), F.lit("")), r"<[^>]*>|\bwhere\b.*", ""), F.lit(words), 1)).alias("reference_name"),
        F.lit(kind).alias("reference_kind"), F.col("start_line").alias("line"), F.lit(0).alias("col"), "file_path", "language") for kind, i in both])
    supers = supers.filter(~F.col("reference_name").isin("extends", "with", "public", "private", "protected", "virtual", "object", "metaclass", "Any"))
    return with_ref_id(as_refs(refs.unionByName(supers))).dropDuplicates(["ref_id"])


def functions_as_values(lines: DataFrame, nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """Names passed or assigned without a call; kept if the file defines or imports them (X10)."""
    pattern = r"(?:[(,=:]\s*&?)((?:this\.)?[A-Za-z_$][\w$]*)\s*(?=[,);}]|$)"
    sites = lines.filter(F.col("text").rlike(pattern)).select("path", "language", "line", F.explode(
        F.regexp_extract_all("text", F.lit(pattern), 1)).alias("name")).withColumn("file_path", F.col("path"))
    local = nodes.filter(F.col("kind").isin("function", "method")).select("file_path", "name")
    bound = refs.filter("reference_kind = 'imports'").select("file_path", F.element_at(F.split("reference_name", r"::|[./]"), -1).alias("name"))
    bare = F.regexp_replace("name", r"^this\.", "")
    kept = sites.withColumn("bare", bare).join(
        local.unionByName(bound).distinct().withColumnRenamed("name", "bare"), ["file_path", "bare"], "left_semi")
    spans = nodes.filter(F.col("kind").isin(FN + TYPES)).select("id", "file_path", "start_line", "end_line")
    around = enclosing(kept.select("file_path", "line"), spans)
    kept = kept.join(around, ["file_path", "line"], "left").withColumn("from", F.coalesce("id", F.concat(F.lit("file:"), "path")))
    first = kept.groupBy("from", "name", "file_path", "language").agg(F.min("line").alias("line"))
    return with_ref_id(as_refs(first.select(F.col("from").alias("from_node_id"), F.col("name").alias("reference_name"),
                                            F.lit("function_ref").alias("reference_kind"), "line", F.lit(0).alias("col"), "file_path", "language")))


def extract(files: DataFrame) -> Graph:
    """Graph of source files: files(path, language, content) -> nodes, contains edges, references."""
    lines = cut(lines_of(files), "lines", ["language"])
    nodes, contains, raw = symbols(files, lines)
    refs = cut(references(lines, nodes, raw), "refs")
    refs = refs.unionByName(functions_as_values(lines, nodes, refs)).dropDuplicates(["ref_id"])
    return Graph(nodes, as_edges(contains), files.drop("content"), refs)
