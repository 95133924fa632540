"""Import mappings, path resolution and re-export chasing."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import dirname
from ..lineage import cut, union_all
from .packages import package_paths
from .synth import matches

# Endings tried for an import path, in order, by language of the importing file.
PROBES = {
    "typescript": [".ts", ".tsx", ".d.ts", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js"],
    "javascript": [".js", ".jsx", ".mjs", ".cjs", "/index.js", "/index.jsx"],
    "tsx": [".tsx", ".ts", ".d.ts", ".js", ".jsx", "/index.tsx", "/index.ts", "/index.js"],
    "jsx": [".jsx", ".js", "/index.jsx", "/index.js"],
    "svelte": [".ts", ".js", ".svelte", ".tsx", ".jsx", "/index.ts", "/index.js", "/index.svelte"],
    "vue": [".ts", ".js", ".vue", ".tsx", ".jsx", "/index.ts", "/index.js", "/index.vue"],
    "astro": [".ts", ".js", ".astro", ".tsx", ".jsx", "/index.ts", "/index.js", "/index.astro"],
    "python": [".py", "/__init__.py"], "go": [".go"], "rust": [".rs", "/mod.rs"], "java": [".java"],
    "c": [".h", ".c"], "cpp": [".h", ".hpp", ".hxx", ".cpp", ".cc", ".cxx"], "csharp": [".cs"],
    "php": [".php"], "ruby": [".rb"], "objc": [".h", ".m", ".mm"],
}
# Path prefixes that stand for a folder unless the project says otherwise.
ALIASES = {"@/": "src/", "~/": "src/", "@src/": "src/", "src/": "src/", "@app/": "app/", "app/": "app/"}
WEB = ["typescript", "tsx", "javascript", "jsx", "svelte", "vue", "astro"]
MAPPING = "file_path, language, local_name, source, exported_name, is_default, is_namespace"


def normalised(path: Column) -> Column:
    """Path without `.` and `..` segments."""
    def step(acc: Column, seg: Column) -> Column:
        return F.when(seg.isin("", "."), acc).when(
            (seg == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(
            F.concat(acc, F.array(seg)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def _row(df: DataFrame, local: str, source: str, exported: str, default: str = "false", namespace: str = "false") -> DataFrame:
    return df.selectExpr("file_path", "language", f"{local} as local_name", f"{source} as source",
                         f"{exported} as exported_name", f"{default} as is_default", f"{namespace} as is_namespace")


def _parts(df: DataFrame, column: str) -> DataFrame:
    """One row per comma-separated `name as alias` part: (name, alias)."""
    part = F.trim(F.regexp_replace("part", r"^\s*type\s+", ""))
    rows = df.withColumn("part", F.explode(F.split(column, ","))).withColumn("part", part).filter("part != ''")
    return rows.select("*", F.regexp_extract("part", r"^([\w$*]+)", 1).alias("name"), F.coalesce(
        F.nullif(F.regexp_extract("part", r"\s(?:as|AS)\s+([\w$]+)", 1), F.lit("")),
        F.regexp_extract("part", r"^([\w$*]+)", 1)).alias("alias"))


def mappings(files: DataFrame) -> DataFrame:
    """Names a file binds by imports: file, local name, module, name in the module, flags."""
    f = files.filter("content is not null").selectExpr("path as file_path", "language", "content")
    web = f.filter(F.col("language").isin(WEB))
    clause = matches(web, "content", r"\bimport\s+(?:type\s+)?([\w$*{}\s,]+?)\s+from\s*['\"]([^'\"]+)['\"]", 2)
    braces = clause.withColumn("inner", F.regexp_extract("g1", r"\{([^}]*)\}", 1))
    named = _parts(braces, "inner")
    default = clause.withColumn("d", F.regexp_extract(F.trim("g1"), r"^([\w$]+)", 1)).filter("d != ''")
    space = clause.withColumn("ns", F.regexp_extract("g1", r"\*\s+as\s+([\w$]+)", 1)).filter("ns != ''")
    required = matches(web, "content", r"(?:const|let|var)\s+([\w$]+|\{[^}]*\})\s*=\s*require\(\s*['\"]([^'\"]+)['\"]\s*\)", 2)
    req_named = _parts(required.withColumn("inner", F.regexp_replace(F.regexp_extract("g1", r"\{([^}]*)\}", 1), ":", " as ")), "inner")
    py = f.filter("language = 'python'")
    from_ = _parts(matches(py, "content", r"(?m)^\s*from\s+([\w.]+)\s+import\s+\(?([\w\s,*]+?)\)?\s*$", 2), "g2")
    whole = _parts(matches(py, "content", r"(?m)^\s*import\s+([\w., ]+?)\s*$", 1).withColumn("g1", F.regexp_replace("g1", r"\.", "\u0001")), "g1")
    whole = whole.withColumn("part", F.regexp_replace("part", "\u0001", "."))
    go = matches(f.filter("language = 'go'"), "content", r"(?m)^\s*(?:import\s+)?(\w+\s+|_\s+|\.\s+)?\"([\w./\-]+)\"\s*$", 2)
    jvm = matches(f.filter("language in ('java', 'kotlin', 'scala')"), "content", r"(?m)^\s*import\s+(?:static\s+)?([\w.]+\.(\w+))(?:\s+as\s+(\w+))?", 3)
    php = matches(f.filter("language = 'php'"), "content", r"(?m)^\s*use\s+([\w\\]+\\(\w+))(?:\s+as\s+(\w+))?\s*;", 3)
    inc = matches(f.filter("language in ('c', 'cpp', 'objc')"), "content", r"(?m)^\s*#\s*(?:include|import)\s*[<\"]([^>\"]+)[>\"]", 1)
    out = union_all([
        _row(named, "alias", "g2", "name", "name = 'default'"),
        _row(default, "d", "g2", "'default'", "true"), _row(space, "ns", "g2", "'*'", "false", "true"),
        _row(req_named, "alias", "g2", "name"),
        _row(required.filter("not startswith(g1, '{')"), "g1", "g2", "'*'", "true", "true"),
        _row(from_, "alias", "g1", "name", "false", "name = '*'"),
        _row(whole, "if(contains(part, ' as '), alias, element_at(split(part, '[.]'), 1))", "regexp_extract(part, '^([a-zA-Z0-9_.]+)', 1)", "'*'", "false", "true"),
        _row(go, "if(trim(coalesce(g1, '')) != '', trim(g1), element_at(split(g2, '/'), -1))", "g2", "'*'", "false", "true"),
        _row(jvm, "if(coalesce(g3, '') != '', g3, g2)", "g1", "g2"),
        _row(php, "if(coalesce(g3, '') != '', g3, g2)", "g1", "g2"),
        _row(inc, "element_at(split(g1, '/'), -1)", "g1", "'*'", "false", "true"),
    ])
    return out.distinct()


def _bases(imports: DataFrame, aliases: dict[str, str], include_dirs: list[str], packages: dict[str, str]) -> DataFrame:
    """Candidate base paths of every (file, language, source) with their priority."""
    src, folder = F.col("source"), dirname("file_path")
    py = F.col("language") == "python"
    dots = F.length(F.regexp_extract("source", r"^(\.+)", 1))
    py_rel = F.concat_ws("/", folder, F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))),
                         F.regexp_replace(F.regexp_replace("source", r"^\.+", ""), r"\.", "/"))
    relative = F.when(py, py_rel).otherwise(F.concat_ws("/", folder, "source"))
    options = []
    for n, (prefix, target) in enumerate({**aliases, **packages, **ALIASES}.items()):
        options.append(F.when(src.startswith(prefix), F.struct(
            F.lit(10 + n).alias("prio"), F.concat(F.lit(target), F.expr(f"substring(source, {len(prefix) + 1})")).alias("base"))))
    plain = F.when(py | F.col("language").isin("java", "kotlin", "scala"), F.regexp_replace("source", r"\.", "/")).when(
        F.col("language") == "php", F.regexp_replace("source", r"\\", "/")).when(
        F.col("language") == "rust", F.regexp_replace(F.regexp_replace("source", "^crate::", "src/"), "::", "/")).otherwise(src)
    options.append(F.struct(F.lit(900).alias("prio"), plain.alias("base")))
    is_c = F.col("language").isin("c", "cpp", "objc")
    options.append(F.when(is_c, F.struct(F.lit(5).alias("prio"), F.concat_ws("/", folder, "source").alias("base"))))
    for n, inc in enumerate(include_dirs):
        options.append(F.when(is_c, F.struct(F.lit(1000 + n).alias("prio"), F.concat(F.lit(inc.rstrip("/") + "/"), src).alias("base"))))
    rel_only = F.array(F.struct(F.lit(0).alias("prio"), relative.alias("base")))
    return imports.select("file_path", "language", "source").distinct().withColumn(
        "o", F.explode(F.when(src.startswith("."), rel_only).otherwise(F.array_compact(F.array(*options))))).select(
        "file_path", "language", "source", "o.prio", normalised(F.col("o.base")).alias("base"))


def resolve_paths(imports: DataFrame, files: DataFrame, aliases: dict[str, str] | None = None,
                  include_dirs: list[str] = ("include", "src", "inc"), packages: dict[str, str] | None = None) -> DataFrame:
    """(file_path, source, target_path): the first existing candidate of every import.

    Candidates are few per import, so they meet the file table in one equi-join. `aliases` and
    `packages` map path prefixes and workspace package names to folders.
    """
    bases = _bases(imports, aliases or {}, list(include_dirs), packages or {})
    probes = None
    for lang, endings in PROBES.items():
        arr = F.array(*[F.lit(e) for e in endings], F.lit(""))
        probes = F.when(F.col("language") == lang, arr) if probes is None else probes.when(F.col("language") == lang, arr)
    cand = bases.select("file_path", "source", "prio", "base", F.posexplode(probes.otherwise(F.array(F.lit("")))).alias("pos", "ending"))
    cand = cand.select("file_path", "source", "prio", "pos", F.concat("base", "ending").alias("target_path"))
    hit = cand.join(files.select(F.col("path").alias("target_path")).distinct(), "target_path")
    return hit.groupBy("file_path", "source").agg(F.min(F.struct("prio", "pos", "target_path")).alias("b")).select(
        "file_path", "source", F.col("b.target_path").alias("target_path"))


def reexports(files: DataFrame) -> DataFrame:
    """`export {a as b} from` and `export * from`: (file_path, language, source, exported_name, inner_name)."""
    web = files.filter("content is not null").filter(F.col("language").isin(WEB)).selectExpr("path as file_path", "language", "content")
    named = _parts(matches(web, "content", r"\bexport\s+(?:type\s+)?\{([^}]*)\}\s*from\s*['\"]([^'\"]+)['\"]", 2), "g1")
    named = named.selectExpr("file_path", "language", "g2 as source", "alias as exported_name", "name as inner_name")
    star = matches(web, "content", r"\bexport\s+\*\s+from\s*['\"]([^'\"]+)['\"]", 1).selectExpr(
        "file_path", "language", "g1 as source", "'*' as exported_name", "'*' as inner_name")
    return named.unionByName(star).distinct()


def chase(wanted: DataFrame, nodes: DataFrame, forwards: DataFrame) -> DataFrame:
    """Definition of (target_path, exported_name), through re-exports: wanted plus `target`.

    forwards(path, exported_name, inner_path, inner_name). A name declared in the file wins, then
    a named re-export, then wildcard ones. (path, name) pairs seen before are not visited again.
    """
    key = ["target_path", "exported_name"]
    decl = nodes.filter("kind not in ('file', 'import', 'export')").groupBy(
        F.col("file_path").alias("at"), F.col("name").alias("as")).agg(F.min(F.struct(F.col("start_column"), F.col("id"))).alias("d"))
    decl = cut(decl.select("at", "as", F.col("d.id").alias("target")), "declared")
    # A default import means the first exported function or class of the file.
    default = nodes.filter("is_exported and kind in ('function', 'class', 'component')").groupBy(F.col("file_path").alias("at")).agg(
        F.min_by("id", F.struct("start_line", "id")).alias("target")).withColumn("as", F.lit("default"))
    decl = decl.unionByName(default.join(decl, ["at", "as"], "left_anti").select("at", "as", "target"))
    open_ = cut(wanted.select(*key).distinct().select("*", F.col("target_path").alias("at"), F.col("exported_name").alias("as"), F.lit(0).alias("rank")), "chase")
    seen, found = [open_], []
    while True:  # ends, since a (path, name) pair is visited once
        hit = cut(open_.join(decl, ["at", "as"]).groupBy(*key).agg(
            F.min(F.struct("rank", "target")).alias("b")).select(*key, F.col("b.target").alias("target")), "chase-hit")
        found.append(hit)
        left = open_.join(hit, key, "left_anti")
        named = left.join(forwards.filter("exported_name != '*'").selectExpr("path as at", "exported_name as `as`", "inner_path", "inner_name"), ["at", "as"])
        star = left.join(forwards.filter("exported_name = '*'").selectExpr("path as at", "inner_path"), "at").withColumn("inner_name", F.col("as"))
        nxt = named.select(*key, F.col("inner_path").alias("at"), F.col("inner_name").alias("as"), F.lit(0).alias("rank")).unionByName(
            star.select(*key, F.col("inner_path").alias("at"), F.col("inner_name").alias("as"), F.lit(1).alias("rank")))
        nxt = nxt.groupBy(*key, "at", "as").agg(F.min("rank").alias("rank"))
        open_ = cut(nxt.join(union_all(seen), [*key, "at", "as"], "left_anti"), "chase")
        if open_.isEmpty():
            break
        seen.append(open_)
    return union_all(found)


def import_targets(imports: DataFrame, files: DataFrame, aliases: dict[str, str] | None = None, roots: DataFrame | None = None) -> DataFrame:
    """(file_path, source, target_path): by package where module roots are given, else by path."""
    paths = resolve_paths(imports, files, aliases)
    if roots is None:
        return paths
    packaged = cut(package_paths(imports, roots, files).drop("prefix"), "package-paths")
    return packaged.unionByName(paths.join(packaged, ["file_path", "source"], "left_anti"))


def via_import(nodes: DataFrame, files: DataFrame, refs: DataFrame, aliases: dict[str, str] | None = None,
               roots: DataFrame | None = None) -> DataFrame:
    """References to imported names: (ref_id, target, confidence, resolved_by)."""
    binds = cut(mappings(files), "mappings")
    forwards = cut(reexports(files), "reexports")
    # A Rust name is asked for by its whole path, the statement binds nothing else.
    used = refs.filter("reference_kind = 'imports' and language = 'rust'").selectExpr("file_path", "language", "reference_name as source")
    asked = union_all([d.select("file_path", "language", "source") for d in (binds, forwards, used)])
    paths = cut(import_targets(asked, files, aliases, roots), "import-paths")
    inner = forwards.join(paths, ["file_path", "source"]).selectExpr(
        "file_path as path", "exported_name", "target_path as inner_path", "inner_name")
    binds = binds.join(paths, ["file_path", "source"])
    name = F.col("reference_name")
    head, tail = F.split(name, r"::|\.")[0], F.element_at(F.split(name, r"::|\."), -1)
    used = refs.filter("reference_kind != 'imports'").withColumn("local_name", head).withColumn("member", F.when(name != head, tail))
    used = used.join(binds, ["file_path", "local_name"]).select(
        "ref_id", "target_path", F.when(F.col("is_namespace") & F.col("member").isNotNull(), F.col("member")).otherwise(
            F.col("exported_name")).alias("exported_name"), "member", "is_namespace")
    used = used.filter("member is null or is_namespace")
    hit = chase(used, nodes, inner)
    named = used.join(hit, ["target_path", "exported_name"]).groupBy("ref_id").agg(F.min("target").alias("target")).select(
        "ref_id", "target", F.lit(0.9).alias("confidence"), F.lit("import").alias("resolved_by"))
    # The import statement itself leads to the file.
    file_id = nodes.filter("kind = 'file'").select(F.col("file_path").alias("target_path"), F.col("id").alias("target"))
    whole = refs.filter("reference_kind = 'imports'").withColumn("source", name).join(paths, ["file_path", "source"]).join(
        file_id, "target_path").select("ref_id", "target", F.lit(0.92).alias("confidence"), F.lit("import").alias("resolved_by"))
    return named.unionByName(whole)


def jvm_import(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """Fully qualified JVM names: the type whose path ends with the package, closest id on ties."""
    want = refs.filter((F.col("reference_kind") == "imports") & F.col("language").isin("java", "kotlin", "scala"))
    types = nodes.filter("kind in ('class', 'interface', 'enum', 'struct', 'trait')").select(
        "id", "name", F.regexp_replace("file_path", r"\.[^.]*$", "").alias("stem"))
    parts = F.split("stem", "/")
    keys = types.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(
        F.slice(parts, i, F.size(parts)), "."))).alias("reference_name"), "name").filter(
        F.element_at(F.split("reference_name", r"\."), -1) == F.col("name"))
    one = keys.groupBy("reference_name").agg(F.min("id").alias("target"))
    return want.join(one, "reference_name").select("ref_id", "target", F.lit(0.95).alias("confidence"), F.lit("import").alias("resolved_by"))
