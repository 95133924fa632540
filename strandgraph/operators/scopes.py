"""Declared types of receivers: every use sees the latest declaration in its innermost scope.

Uses meet declarations by (scope, name) only; within such a group an as-of window finds the latest
one, so that a name declared and used often is never paired.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..lineage import cut, union_all
from .ordered import as_of, enclosing
from .resolve import REF_ID, method_on_type, with_ref_id
from .traversal import ancestors

TYPED_LANGUAGES = ["cpp", "java", "kotlin"]
# Words that stand before a name without being its type.
NOT_TYPES = "return new delete throw else case goto using typename namespace package import public private protected".split()
# Declaration patterns, (type, name) or (name, type) as told: language, pattern, group of type, group of name.
_END = r"\s*(?=[;=,)\[{(]|$)"
DECLARATIONS = [
    ("cpp", rf"([A-Za-z_][\w:]*)(?:\s*<[^;=(){{}}]*>)?(?:\s*[*&]+\s*|\s+)([A-Za-z_]\w*)\b{_END}", 1, 2),
    ("cpp", r"\bauto\s*[*&]*\s*([A-Za-z_]\w*)\s*=\s*(?:new\s+|(?:std::)?make_(?:unique|shared)\s*<\s*)([A-Za-z_][\w:]*)", 2, 1),
    ("cpp", r"\bauto\s*[*&]*\s*([A-Za-z_]\w*)\s*=\s*([A-Z]\w*)\s*[({]", 2, 1),
    ("java", rf"((?:[a-z_]\w*\.)*[A-Z]\w*)(?:\s*<[^;=(){{}}]*>)?(?:\s*\[\s*\])*(?:\.\.\.)?\s+([A-Za-z_$][\w$]*)\b{_END}", 1, 2),
    ("java", r"\bvar\s+([A-Za-z_$][\w$]*)\s*=\s*new\s+([A-Z]\w*)", 2, 1),
    ("kotlin", r"\b([A-Za-z_]\w*)\s*:\s*([A-Z]\w*)", 2, 1),
    ("kotlin", r"\b(?:val|var)\s+([A-Za-z_]\w*)\s*=\s*([A-Z]\w*)\s*\(", 2, 1),
]


def declarations(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """Typed names of source lines(path, language, line, text): scope, line, name, type_name, hoisted.

    The scope is the innermost type or function around the line, else the file. Members of a type are
    hoisted: they hold from its first line on. Members declared in a header also hold in the source
    file of its name, under the scope `stem:<path without ending>`.
    """
    found = []
    for language, pattern, type_at, name_at in DECLARATIONS:
        both = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), type_at).alias("t"),
                            F.regexp_extract_all("text", F.lit(pattern), name_at).alias("n"))
        found.append(lines.filter((F.col("language") == language) & F.col("text").rlike(pattern)).select(
            F.col("path").alias("file_path"), "language", "line", F.explode(both).alias("d")))
    rows = union_all(found).select("file_path", "language", "line", F.col("d.n").alias("name"), _simple(F.col("d.t")).alias("type_name"))
    rows = cut(rows.filter((F.col("type_name") != "") & ~F.col("type_name").isin([*NOT_TYPES, "auto", "var"])).distinct(), "declared")
    spans = nodes.filter(F.col("kind").isin("function", "method", "class", "interface", "struct", "enum", "trait", "namespace"))
    hoists = F.col("kind").isin("class", "interface", "struct", "enum", "trait", "namespace")
    around = enclosing(rows, spans.select("id", "file_path", "start_line", "end_line")).withColumnRenamed("id", "scope")
    inside = rows.join(around, ["file_path", "line"], "left").join(
        spans.select(F.col("id").alias("scope"), hoists.alias("in_type")), "scope", "left")
    own = inside.select(F.coalesce("scope", F.concat(F.lit("file:"), "file_path")).alias("scope"), "line", "name", "type_name",
                        F.coalesce("in_type", F.lit(False)).alias("hoisted"))
    header = rows.filter(F.col("file_path").rlike(r"(?i)\.(h|hpp|hxx)$")).select(
        _stem(F.col("file_path")).alias("scope"), "line", "name", "type_name", F.lit(True).alias("hoisted"))
    return own.unionByName(header)


def _simple(type_name: Column) -> Column:
    """Last part of a qualified type."""
    return F.element_at(F.split(type_name, r"::|\."), -1)


def _stem(path: Column) -> Column:
    return F.concat(F.lit("stem:"), F.regexp_replace(path, r"\.[^./]*$", ""))


def scope_chains(g: Graph) -> DataFrame:
    """(scope, at, level): every node with itself and all that contain it, and the header of its file last."""
    own = g.nodes.select(F.col("id").alias("scope"), F.col("id").alias("at"), F.lit(0).alias("level"))
    up = ancestors(g).select(F.col("id").alias("scope"), F.col("ancestor").alias("at"), "level")
    header = g.nodes.filter("language = 'cpp'").select(
        F.col("id").alias("scope"), _stem(F.col("file_path")).alias("at"), F.lit(2**31 - 1).alias("level"))
    return union_all([own, up, header])


def visible_types(uses: DataFrame, declared: DataFrame, chains: DataFrame) -> DataFrame:
    """Type of each use(use_id, scope, line, name): use_id, type_name. Uses that see none are left out.

    Per scope the latest declaration at or before the line counts, in a type else its first one; the
    innermost scope that has one wins. A null scope, line or name sees nothing.
    """
    key = ["at", "name"]
    facts = declared.select(F.col("scope").alias("at"), "name", F.col("line").cast("long").alias("line"), "type_name", "hoisted")
    points = uses.select("use_id", "scope", F.col("line").cast("long").alias("line"), "name").join(chains, "scope").join(
        facts.select(*key).distinct(), key, "left_semi").select("use_id", "level", *key, "line")
    first = facts.filter("hoisted").groupBy(*key).agg(F.min(F.struct("line", "type_name"))["type_name"].alias("type_name"))
    # Written once, since they are looked at twice: for their buckets and for their values.
    seen = as_of(cut(points, "points"), facts.select(*key, "line", "type_name"), key, "line", "type_name", otherwise=first)
    return seen.filter("type_name is not null").groupBy("use_id").agg(F.min_by("type_name", F.struct("level", "type_name")).alias("type_name"))


def typed_receiver(g: Graph, refs: DataFrame, declared: DataFrame, chains: DataFrame | None = None,
                   keep: Sequence[str] = ()) -> DataFrame:
    """`receiver.method` by the declared type of the receiver, on that type or its nearest supertype, at 0.9.

    Uses travel under a number, the other columns of a reference move once, for the answers only. `keep` names further
    ones for the answer; references without a `ref_id` get theirs from the columns it is made of.
    """
    pattern = r"^(?:this\.)?([A-Za-z_$][\w$]*)\.([A-Za-z_$][\w$]*)$"
    named = "ref_id" in refs.columns
    columns = dict.fromkeys(["from_node_id", "line", "language", *(["ref_id"] if named else REF_ID), *keep])
    calls = refs.filter(F.col("reference_name").rlike(pattern)).select(
        F.monotonically_increasing_id().alias("use_id"), *columns,
        F.regexp_extract("reference_name", pattern, 1).alias("_name"), F.regexp_extract("reference_name", pattern, 2).alias("_method"))
    calls = cut(calls, "typed-calls")
    uses = calls.select("use_id", F.col("from_node_id").alias("scope"), "line", F.col("_name").alias("name"))
    types = visible_types(uses, declared, scope_chains(g) if chains is None else chains)
    typed = cut(calls.select("use_id", F.col("_method").alias("method"), "language").join(types, "use_id"), "typed")
    hit = typed.join(method_on_type(g, typed), ["type_name", "method", "language"]).select("use_id", "target")
    out = calls.join(hit, "use_id")
    return (out if named else with_ref_id(out)).select(
        "ref_id", "target", F.lit(0.9).alias("confidence"), F.lit("instance-method").alias("resolved_by"), *keep)
