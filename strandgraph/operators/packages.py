"""Imports that name a package of the project: the longest package prefix decides.

Module roots are rows. An import opens into the prefixes of its name and the folders above its file,
both as deep as names and folders nest, and meets the roots in one equi-join.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import dirname
from ..lineage import cut, union_all

FAMILY = {"go": "go", "rust": "rust", "typescript": "web", "tsx": "web", "javascript": "web", "jsx": "web",
          "svelte": "web", "vue": "web", "astro": "web"}
MANIFESTS = r"(^|/)(go\.mod|Cargo\.toml|package\.json|tsconfig(\.\w+)?\.json|jsconfig\.json)$"


def family_of(language: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in FAMILY.items() for x in pair])[language]


def _under(folder: Column, rest: Column) -> Column:
    """Path of `rest` below a folder, the root folder being empty."""
    rest = F.regexp_replace(rest, r"^(\./)+|/+$", "")
    return F.concat_ws("/", F.nullif(folder, F.lit("")), F.nullif(F.when(rest == ".", "").otherwise(rest), F.lit("")))


def manifest_roots(manifests: DataFrame) -> DataFrame:
    """Module roots a project declares: manifests(path, content) -> (family, prefix, folder, within).

    go.mod names a module path, Cargo.toml a crate (its sources lie in `src`), package.json a workspace
    package, and `paths` of tsconfig.json map prefixes for the files `within` its folder. Texts that are
    null or malformed declare nothing.
    """
    m = manifests.filter(F.col("path").rlike(MANIFESTS) & F.col("content").isNotNull())
    at = F.when(F.col("path").contains("/"), dirname("path")).otherwise("")
    m = cut(m.select(at.alias("at"), F.element_at(F.split("path", "/"), -1).alias("file"), "content"), "manifests")

    def named(file: str, family: str, pattern: str, folder: Column, clean=lambda c: c) -> DataFrame:
        name = F.regexp_extract("content", pattern, 1)
        return m.filter((F.col("file") == file) & (name != "")).select(
            F.lit(family).alias("family"), clean(name).alias("prefix"), folder.alias("folder"), F.lit("").alias("within"))

    go = named("go.mod", "go", r"(?m)^\s*module\s+\"?([^\s\"]+)", F.col("at"))
    crate = named("Cargo.toml", "rust", r"(?s)\[package\](?:(?!\n\s*\[).)*?\n\s*name\s*=\s*\"([^\"]+)\"",
                  _under(F.col("at"), F.lit("src")), lambda c: F.regexp_replace(c, "-", "_"))
    web = m.filter("file = 'package.json'").select(
        F.lit("web").alias("family"), F.get_json_object("content", "$.name").alias("prefix"), F.col("at").alias("folder"), F.lit("").alias("within"))
    ts = m.filter("file like '%config%.json'").withColumn(
        "base", F.coalesce(F.regexp_extract("content", r"\"baseUrl\"\s*:\s*\"([^\"]*)\"", 1), F.lit("")))
    block = F.regexp_extract("content", r"(?s)\"paths\"\s*:\s*\{([^}]*)\}", 1)
    entry = r"\"([^\"]+)\"\s*:\s*\[\s*\"([^\"]+)\""
    pairs = F.arrays_zip(F.regexp_extract_all(block, F.lit(entry), 1).alias("k"), F.regexp_extract_all(block, F.lit(entry), 2).alias("v"))
    ts = ts.withColumn("p", F.explode(pairs)).select(
        F.lit("web").alias("family"), F.regexp_replace("p.k", r"/\*$", "").alias("prefix"),
        _under(_under(F.col("at"), F.col("base")), F.regexp_replace("p.v", r"/?\*$", "")).alias("folder"), F.col("at").alias("within"))
    return union_all([go, crate, web, ts]).filter("coalesce(prefix, '') != ''").distinct()


def _prefixes(parts: Column, separator: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(
        F.array_join(F.slice(parts, F.lit(1), i), "\u0001").alias("head"), F.slice(parts, i + 1, F.size(parts)).alias("rest"), separator.alias("sep")))


def module_keys(files: DataFrame) -> DataFrame:
    """What a file answers to: (family, base, pos, target_path), the least `pos` being the closest form.

    A file answers to its path without ending; index, mod and lib files to their folder as well, index files
    below `src` also to the folder above; a Go file that is no test answers to its folder.
    """
    f = files.select("path", family_of(F.col("language")).alias("family")).filter("family is not null")
    stem = F.regexp_replace("path", r"(\.d\.ts|\.[^./]+)$", "")
    leaf = F.element_at(F.split(stem, "/"), -1)
    folder = F.when(F.col("path").contains("/"), dirname("path")).otherwise("")
    own = F.when(F.col("family") != "go", F.struct(stem.alias("base"), F.lit(0).alias("pos")))
    whole = F.when(((F.col("family") == "web") & (leaf == "index")) | ((F.col("family") == "rust") & leaf.isin("mod", "lib", "main"))
                   | ((F.col("family") == "go") & ~F.col("path").endswith("_test.go")), F.struct(folder.alias("base"), F.lit(1).alias("pos")))
    above = F.when((F.col("family") == "web") & (leaf == "index") & folder.rlike(r"(^|/)src$"),
                   F.struct(F.regexp_replace(folder, r"/?src$", "").alias("base"), F.lit(2).alias("pos")))
    return f.select("family", F.explode(F.array_compact(F.array(own, whole, above))).alias("k"), F.col("path").alias("target_path")).select(
        "family", "k.base", "k.pos", "target_path")


def package_paths(imports: DataFrame, roots: DataFrame, files: DataFrame) -> DataFrame:
    """(file_path, source, target_path, prefix): imports(file_path, language, source) that name a package.

    Of the roots whose prefix the import has, those within the deepest folder around the importing file come
    first, then the longest prefix; a root under which no file answers is passed over. What follows the
    prefix is a path below the root's folder; the last segments of a Rust path may be items and are dropped
    one by one. Null names resolve to nothing.
    """
    asked = imports.select("file_path", "source", family_of(F.col("language")).alias("family")).filter(
        "family is not null and source is not null and file_path is not null").distinct()
    rust = F.col("family") == "rust"
    parts = F.when(rust, F.split("source", "::")).otherwise(F.split("source", "/"))
    heads = asked.withColumn("p", F.explode(_prefixes(parts, F.when(rust, "::").otherwise("/")))).select(
        "file_path", "source", "family", F.replace(F.col("p.head"), F.lit("\u0001"), F.col("p.sep")).alias("prefix"), "p.rest")
    known = heads.join(roots.select("family", "prefix").distinct(), ["family", "prefix"], "left_semi")
    folders = F.split(dirname("file_path"), "/")
    above = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(folders)), lambda i: F.array_join(F.slice(folders, F.lit(1), i), "/")))
    above = F.when(F.col("file_path").contains("/"), above).otherwise(F.array(F.lit("")))
    hit = known.withColumn("within", F.explode(above)).join(roots, ["family", "prefix", "within"])
    drops = F.sequence(F.lit(0), F.when(rust, F.size("rest")).otherwise(0))
    base = F.concat_ws("/", F.nullif("folder", F.lit("")), F.nullif(F.array_join(F.expr("slice(rest, 1, size(rest) - drop)"), "/"), F.lit("")))
    cand = hit.withColumn("drop", F.explode(drops)).withColumn("base", base)
    found = cand.join(module_keys(files), ["family", "base"])
    depth = F.when(F.col("within") == "", 0).otherwise(F.size(F.split("within", "/")))
    order = F.struct((-depth).alias("d"), (-F.length("prefix")).alias("l"), "drop", "pos", "target_path", "prefix")
    return found.groupBy("file_path", "source").agg(F.min(order).alias("b")).select(
        "file_path", "source", F.col("b.target_path").alias("target_path"), F.col("b.prefix").alias("prefix"))
