"""Scanning a source tree with Spark's file source."""

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.packages import MANIFESTS
from . import ignores

# File ending to language.
EXTENSIONS = {
    ".ts": "typescript", ".tsx": "tsx", ".mts": "typescript", ".cts": "typescript", ".js": "javascript",
    ".mjs": "javascript", ".cjs": "javascript", ".xsjs": "javascript", ".xsjslib": "javascript",
    ".jsx": "jsx", ".py": "python", ".pyw": "python", ".go": "go", ".rs": "rust", ".java": "java",
    ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hxx": "cpp",
    ".cs": "csharp", ".cshtml": "razor", ".razor": "razor", ".php": "php", ".module": "php",
    ".install": "php", ".theme": "php", ".inc": "php", ".yml": "yaml", ".yaml": "yaml",
    ".twig": "twig", ".rb": "ruby", ".rake": "ruby", ".swift": "swift", ".kt": "kotlin",
    ".kts": "kotlin", ".dart": "dart", ".liquid": "liquid", ".svelte": "svelte", ".vue": "vue",
    ".astro": "astro", ".pas": "pascal", ".dpr": "pascal", ".dpk": "pascal", ".lpr": "pascal",
    ".dfm": "pascal", ".fmx": "pascal", ".scala": "scala", ".sc": "scala", ".lua": "lua",
    ".luau": "luau", ".m": "objc", ".mm": "objc", ".xml": "xml", ".properties": "properties",
}
# Directories and directory globs left out of a scan.
IGNORED_DIRS = (
    "node_modules bower_components jspm_packages web_modules .yarn .pnpm-store .next .nuxt .svelte-kit "
    ".turbo .vite .parcel-cache .angular .docusaurus storybook-static .vinxi .nitro out-tsc .vercel "
    ".netlify .wrangler dist build out .output coverage .nyc_output __pycache__ __pypackages__ .venv "
    "venv .pixi .pdm-build .mypy_cache .pytest_cache .ruff_cache .tox .nox .hypothesis "
    ".ipynb_checkpoints .eggs target .gradle obj vendor .build Pods Carthage DerivedData .swiftpm "
    ".dart_tool .pub-cache .cxx .externalNativeBuild vcpkg_installed .bloop .metals lua_modules "
    ".luarocks __history __recovery .cache"
).split()
IGNORED_GLOBS = ["*.egg-info", "cmake-build-*", "bazel-*"]
MAX_FILE_BYTES = 1024 * 1024
PLAY_ROUTES = r"(^|/)conf/routes$|\.routes$"
SHOPIFY_JSON = r"(?i)(^|/)(templates|sections)/.+\.json$"
LOOKS_CPP = (r"\bnamespace\b|\bclass\s+\w+\s*[:{]|\btemplate\s*<|\b(?:public|private|protected)\s*:|\bvirtual\b"
             r"|\busing\s+(?:namespace\b|\w+\s*=)")
LOOKS_OBJC = r"@(?:interface|implementation|protocol|synthesize)\b"


def extension(path: Column | str) -> Column:
    path = F.col(path) if isinstance(path, str) else path
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def language_of(path: Column | str, content: Column | None = None) -> Column:
    """Language by ending; a C header is tested for C++ and Objective-C."""
    path = F.col(path) if isinstance(path, str) else path
    ext = extension(path)
    by_ext = F.coalesce(F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])[ext], F.lit("unknown"))
    out = F.when(path.rlike(PLAY_ROUTES), "yaml").when(path.rlike(SHOPIFY_JSON), "liquid")
    if content is not None:
        out = out.when((ext == ".h") & content.rlike(LOOKS_CPP), "cpp").when((ext == ".h") & content.rlike(LOOKS_OBJC), "objc")
    return out.otherwise(by_ext)


def is_source_file(path: Column | str) -> Column:
    path = F.col(path) if isinstance(path, str) else path
    return path.rlike(PLAY_ROUTES) | path.rlike(SHOPIFY_JSON) | extension(path).isin(list(EXTENSIONS))


def _dir_regex(names: list[str]) -> str:
    return "(^|/)(" + "|".join("[^/]*".join(re.escape(p) for p in n.split("*")) for n in names) + ")/"


def _glob_regex(glob: str) -> str:
    """Regex of a gitignore glob: `*` and `?` stay within a segment, `**` goes across."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            out, i = out + "[" + glob[i + 1 : end].replace("!", "^", 1 if glob[i + 1] == "!" else 0) + "]", end + 1
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i]))
            i += 1
    return out


def ignore_rules(text: str) -> list[tuple[str, bool]]:
    """Rules of a gitignore file in order: (regex on the path below its folder, brought back).

    A rule with an inner or leading `/` holds from the folder on, others at any depth; a closing `/`
    asks for a directory.
    """
    rules = []
    for line in text.splitlines():
        rule = line.strip()
        if not rule or rule.startswith("#"):
            continue
        back, rule = rule.startswith("!"), rule.removeprefix("!")
        below = "/" if rule.endswith("/") else "(?:/|$)"
        body = rule.rstrip("/")
        head = "^" if "/" in body else "(?:^|/)"
        if body.strip("/"):
            rules.append((head + _glob_regex(body.lstrip("/")) + below, back))
    return rules


def is_ignored(path: Column | str, rules: list[tuple[str, bool]] = ()) -> Column:
    """In a directory left out by default, or by the last rule that matches. A default directory that a
    rule brings back by name is left to the rules."""
    path = F.col(path) if isinstance(path, str) else path
    back = [regex for regex, brought in rules if brought]
    names = [n for n in IGNORED_DIRS + IGNORED_GLOBS if not any(re.search(regex, f"{n}/") for regex in back)]
    out = path.rlike(_dir_regex(names))
    told = F.lit(None).cast("boolean")
    for regex, brought in rules:
        told = F.when(path.rlike(regex), F.lit(not brought)).otherwise(told)
    return out | F.coalesce(told, F.lit(False))


def _below(root: str) -> Column:
    return F.regexp_replace("path", f"^(file:)?/*{re.escape(root.lstrip('/'))}/", "")


def kept_by_ignore_files(root: str, files: DataFrame) -> DataFrame:
    """Files(path) that no .gitignore of their own or an upper folder below the root leaves out."""
    return ignores.ignored(files, ignores.rules(ignores.read_rule_files(files, root))).filter("not ignored").drop("ignored")


def scan(spark: SparkSession, root: str, gitignore: str = "", paths: DataFrame | None = None) -> DataFrame:
    """Source files below a root without their contents: path, size, modified_at, language.

    The content column is not selected, so the file source does not read it. `paths` (for
    example the listing of a version control system) narrows the scan. The .gitignore files of all
    folders hold; `gitignore` is the text of further rules of the root.
    """
    rules = ignore_rules(gitignore)
    root = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace("path", f"^(file:)?/*{re.escape(root.lstrip('/'))}/", "")
    files = files.select(F.col("path").alias("uri"), rel.alias("path"), F.col("length").alias("size"),
                         F.unix_millis("modificationTime").alias("modified_at"))
    files = files.filter(is_source_file("path") & ~is_ignored("path", rules))
    if paths is not None:
        files = files.join(paths.select("path").distinct(), "path", "left_semi")
    return kept_by_ignore_files(root, files).withColumn("language", language_of("path"))


def read_contents(spark: SparkSession, root: str, wanted: DataFrame | None = None, gitignore: str = "") -> DataFrame:
    """Files with content and hash; large ones carry a warning."""
    root = root.rstrip("/")
    rules = ignore_rules(gitignore)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace("path", f"^(file:)?/*{re.escape(root.lstrip('/'))}/", "")
    files = files.withColumn("path", rel).filter(is_source_file("path") & ~is_ignored("path", rules))
    if wanted is not None:
        files = files.join(wanted.select("path").distinct(), "path", "left_semi")
    kept = kept_by_ignore_files(root, files.select("path"))
    return with_content(files.join(kept, "path", "left_semi").select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified_at"),
                                     F.col("content").cast("string").alias("content")))


def read_manifests(spark: SparkSession, root: str, gitignore: str = "") -> DataFrame:
    """(path, content) of the files that name the packages of a project."""
    root = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace("path", f"^(file:)?/*{re.escape(root.lstrip('/'))}/", "")
    return files.withColumn("path", rel).filter(F.col("path").rlike(MANIFESTS) & ~is_ignored("path", ignore_rules(gitignore))).select(
        "path", F.col("content").cast("string").alias("content"))


def size_error(path: str = "path", size: str = "size", limit: int = MAX_FILE_BYTES) -> Column:
    """Array with a `size_exceeded` warning for files above the limit, else null; nothing is left out for it."""
    error = F.struct(F.format_string("large source file: %d bytes", F.col(size)).alias("message"),
                     F.col(path).alias("file_path"), F.lit(None).cast("int").alias("line"),
                     F.lit(None).cast("int").alias("column"), F.lit("warning").alias("severity"),
                     F.lit("size_exceeded").alias("code"))
    return F.when(F.col(size) > limit, F.array(error))


def with_content(files: DataFrame, limit: int = MAX_FILE_BYTES) -> DataFrame:
    """Add hash, language and warnings to (path, size, modified_at, content)."""
    return files.withColumn("content_hash", F.sha2("content", 256)).withColumn(
        "language", language_of("path", F.col("content"))).withColumn("errors", size_error(limit=limit))


# Languages whose leaf keys may hold secrets; only the key is ever shown.
CONFIG_LANGUAGES = ["yaml", "properties"]


def snippet(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """Source lines of nodes, 1-based and inclusive; configuration keys show no value."""
    text = sources.select(F.col("path").alias("file_path"), F.split("content", "\n").alias("_lines"))
    span = F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0))
    code = F.array_join(F.slice("_lines", F.col("start_line"), span), "\n")
    leaf = F.col("language").isin(CONFIG_LANGUAGES) & (F.col("kind") != "file")
    return nodes.filter("start_line > 0").join(text, "file_path").withColumn(
        "code", F.when(leaf, F.col("name")).otherwise(code)).drop("_lines")


def find_file(files: DataFrame, wanted: str) -> DataFrame:
    """Files answering to a path: exact, else by suffix, else by substring, case-folded."""
    want = wanted.lower().removeprefix("./")
    path = F.lower("path")
    tier = F.when(path == want, 0).when(path.endswith("/" + want), 1).when(path.contains(want), 2)
    hit = files.withColumn("tier", tier).filter("tier is not null")
    best = hit.agg(F.min("tier").alias("best"))
    return hit.join(F.broadcast(best), F.col("tier") == F.col("best")).drop("tier", "best")


def numbered(sources: DataFrame, offset: int = 1, limit: int | None = None) -> DataFrame:
    """Lines of files with their numbers, from `offset`, if asked at most `limit` per file."""
    lines = F.slice(F.split("content", "\n"), offset, limit if limit is not None else 2**31 - 1)
    return sources.select("path", F.posexplode(lines).alias("pos", "text")).select(
        "path", (F.col("pos") + offset).alias("line"), "text")
