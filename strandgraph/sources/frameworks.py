"""Framework routes as declarative rules: detect, extract, resolve.

A rule applies to the files of its languages when its detection pattern occurs in any file of
the project. Its pattern is matched line by line; the groups named in `groups` give the HTTP
verb, the path and the handler. Rules without a handler group take the next function below.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import dirname
from ..lineage import cut, union_all
from ..operators import imports, mounts
from ..operators.ordered import enclosing
from ..operators.resolve import with_ref_id
from ..operators.synth import matches
from ..schema import as_nodes, as_refs
from .extract import node_id

JS = ["typescript", "javascript", "tsx", "jsx"]
_VERB = "get|post|put|patch|delete|options|head|all|any"


@dataclass(frozen=True)
class RouteRule:
    framework: str
    languages: tuple[str, ...]
    detect: str
    pattern: str
    groups: tuple[str, ...]  # of verb, path, handler, in the order of the pattern's groups
    verb: str = "ANY"        # when no group names one
    ref_kind: str = "references"


# How the frameworks spell their routes.
ROUTES = [
    RouteRule("express", tuple(JS), r"['\"](express|koa-router|@koa/router|fastify|hono)['\"]",
              rf"\.({_VERB})\(\s*['\"`]([^'\"`]+)['\"`]\s*,.*?([\w.]+)\s*\)\s*;?\s*$", ("verb", "path", "handler"), ref_kind="calls"),
    RouteRule("nestjs", ("typescript",), r"@nestjs/", r"^\s*@(Get|Post|Put|Patch|Delete|Options|Head|All)\(\s*(?:['\"`]([^'\"`]*)['\"`])?", ("verb", "path")),
    RouteRule("nestjs", ("typescript",), r"@nestjs/", r"^\s*@(?:MessagePattern|EventPattern|SubscribeMessage)\(\s*['\"`]([^'\"`]+)['\"`]", ("path",), "MESSAGE"),
    RouteRule("react-router", tuple(JS), r"react-router", r"<Route\b[^>]*\bpath=['\"{]+([^'\"}]+)['\"}]+[^>]*\b(?:element=\{\s*<|component=\{)\s*(\w+)", ("path", "handler")),
    RouteRule("flask", ("python",), r"\bflask\b", r"^\s*@\w+\.route\(\s*['\"]([^'\"]*)['\"](?:.*?\bmethods\s*=\s*[\[(]\s*['\"](\w+)['\"])?", ("path", "verb"), "GET"),
    RouteRule("flask", ("python",), r"\bflask", r"\.add\w*[Rr]esource\(\s*(\w+)\s*,\s*['\"]([^'\"]+)['\"]", ("handler", "path")),
    RouteRule("fastapi", ("python",), r"\bfastapi\b", rf"^\s*@\w+\.({_VERB})\(\s*['\"]([^'\"]+)['\"]", ("verb", "path")),
    RouteRule("django", ("python",), r"\bdjango\b", r"\b(?:re_)?(?:path|url)\(\s*r?['\"]([^'\"]*)['\"]\s*,\s*(?!include\()([\w.]+)", ("path", "handler")),
    RouteRule("django", ("python",), r"\bdjango\b", r"\b(?:re_)?(?:path|url)\(\s*r?['\"]([^'\"]*)['\"]\s*,\s*include\(\s*\(?\s*['\"]([\w.]+)['\"]", ("path", "handler"), ref_kind="imports"),
    RouteRule("rails", ("ruby",), r"Rails\.application\.routes|ActionController",
              r"^\s*(get|post|put|patch|delete|match)\s+['\"]([^'\"]+)['\"]\s*(?:=>|,\s*to:)\s*['\"]([\w/]+#\w+)['\"]", ("verb", "path", "handler")),
    RouteRule("laravel", ("php",), r"Illuminate\\|Route::", rf"Route::({_VERB}|match)\(\s*['\"]([^'\"]+)['\"]\s*,\s*\[\s*\w+::class\s*,\s*['\"](\w+)['\"]", ("verb", "path", "handler")),
    RouteRule("laravel", ("php",), r"Illuminate\\|Route::", rf"Route::({_VERB})\(\s*['\"]([^'\"]+)['\"]\s*,\s*['\"](\w+@\w+)['\"]", ("verb", "path", "handler")),
    RouteRule("laravel", ("php",), r"Illuminate\\|Route::", r"Route::(?:resource|apiResource)\(\s*['\"]([^'\"]+)['\"]\s*,\s*\\?(?:\w+\\)*(\w+)", ("path", "handler"), "RESOURCE"),
    RouteRule("spring", ("java", "kotlin"), r"org\.springframework", r"^\s*@(Get|Post|Put|Patch|Delete|Request)Mapping\s*(?:\(\s*(?:value\s*=\s*|path\s*=\s*)?\{?\s*\"([^\"]*)\")?", ("verb", "path")),
    RouteRule("go-http", ("go",), r"gin-gonic|go-chi|gorilla/mux|net/http|labstack/echo|gofiber",
              r"\.(GET|POST|PUT|PATCH|DELETE|OPTIONS|HEAD|Any|Get|Post|Put|Patch|Delete|HandleFunc|Handle)\(\s*\"([^\"]+)\"\s*,.*?([\w.]+)\s*\)", ("verb", "path", "handler")),
    RouteRule("axum", ("rust",), r"\baxum\b", r"\.route\(\s*\"([^\"]+)\"\s*,\s*(get|post|put|patch|delete)\(\s*([\w:]+)", ("path", "verb", "handler")),
    RouteRule("actix", ("rust",), r"\bactix_web\b|\brocket\b", r"^\s*#\[(get|post|put|patch|delete)\(\s*\"([^\"]+)\"", ("verb", "path")),
    RouteRule("aspnet", ("csharp",), r"Microsoft\.AspNetCore|System\.Web", r"^\s*\[Http(Get|Post|Put|Patch|Delete)(?:\(\s*\"([^\"]*)\"\s*\))?", ("verb", "path")),
    RouteRule("aspnet", ("csharp",), r"Microsoft\.AspNetCore|WebApplication", r"\.Map(Get|Post|Put|Patch|Delete)\(\s*\"([^\"]+)\"\s*,\s*([\w.]+)\s*\)", ("verb", "path", "handler")),
    RouteRule("play", ("yaml",), r".", r"^(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+(/\S*)\s+@?([\w.]+)", ("verb", "path", "handler")),
    RouteRule("vapor", ("swift",), r"import Vapor", r"\.(get|post|put|patch|delete)\(\s*\"([^\"]+)\".*use:\s*([\w.]+)", ("verb", "path", "handler")),
    RouteRule("drupal", ("yaml",), r"_controller|_form", r"^\s*path:\s*['\"]?(/[^'\"\s]*)", ("path",)),
    RouteRule("svelte-kit", ("svelte",), r"\$app/|@sveltejs/kit", r"goto\(\s*['\"]([^'\"]+)['\"]", ("path",), "NAVIGATE"),
]

# Frameworks whose routes are their files: path pattern, folder, framework.
FILE_ROUTES = [
    (r"(?:^|/)src/routes/(.*?)/?\+(?:page|server|layout)\.", "svelte-kit"),
    (r"(?:^|/)pages/(.*?)(?:/?index)?\.(?:vue|astro|tsx|jsx)$", "pages"),
    (r"(?:^|/)server/api/(.*?)(?:/?index)?(?:\.(?:get|post|put|delete))?\.(?:ts|js)$", "nuxt-api"),
    (r"(?:^|/)app/(.*?)/?(?:page|route)\.(?:tsx|jsx|ts|js)$", "next-app"),
]
# Components and bridge modules found by one pattern each: id prefix, kind, languages, pattern.
BRIDGES = [
    ("expo-module", "method", ("kotlin", "swift"), r"\b(?:Async)?Function\(\s*\"(\w+)\""),
    ("fabric-component", "component", tuple(JS), r"\bcodegenNativeComponent<[^>]*>\(\s*['\"](\w+)['\"]"),
    ("fabric-component", "component", tuple(JS), r"\brequireNativeComponent(?:<[^>]*>)?\(\s*['\"](\w+)['\"]"),
    ("rn-method", "method", ("objc",), r"RCT_EXPORT_METHOD\(\s*(\w+)"),
    ("rn-method", "method", ("objc",), r"RCT_REMAP_METHOD\(\s*(\w+)\s*,"),
    ("swiftui-view", "component", ("swift",), r"\bstruct\s+(\w+)\s*:\s*(?:some\s+)?View\b"),
    ("react-component", "component", ("tsx", "jsx"), r"^\s*(?:export\s+)?(?:default\s+)?(?:function|const)\s+([A-Z]\w*)\s*[(=:]"),
]


# Actions of a Rails resource: verb, what follows the resource, action; the first is of plural ones only.
RESTFUL = [("GET", "", "index"), ("POST", "", "create"), ("GET", "/new", "new"), ("GET", "/:id", "show"),
           ("GET", "/:id/edit", "edit"), ("PATCH", "/:id", "update"), ("DELETE", "/:id", "destroy")]
_QUOTED = r"['\"`]([^'\"`]*)['\"`]"
# How one router is put under another: languages, pattern, what its groups are. A `source` is
# a module, a `child` a name of the file, `parent` the router it is put under.
MOUNTS = [
    (tuple(JS), rf"\b(\w+)\.use\(\s*{_QUOTED}\s*,(?:.*,)?\s*([\w.]+)\s*\)", ("parent", "prefix", "child")),
    (tuple(JS), rf"\b(\w+)\.use\(\s*{_QUOTED}\s*,(?:.*,)?\s*require\(\s*['\"]([^'\"]+)['\"]\s*\)", ("parent", "prefix", "source")),
    (("python",), rf"\b(\w+)\.include_router\(\s*([\w.]+)(?:.*?\bprefix\s*=\s*{_QUOTED})?", ("parent", "child", "prefix")),
    (("python",), rf"\b(\w+)\.register_blueprint\(\s*([\w.]+)(?:.*?\burl_prefix\s*=\s*{_QUOTED})?", ("parent", "child", "prefix")),
    (("python",), r"\b(?:re_)?path\(\s*r?['\"]\^?([^'\"]*)['\"]\s*,\s*include\(\s*\(?\s*['\"]([\w.]+)['\"]", ("prefix", "source")),
    (("go",), r"\b(\w+)\s*:?=\s*(\w+)\.(?:Group|PathPrefix)\(\s*\"([^\"]*)\"", ("child", "parent", "prefix")),
]
# Prefixes a router gets where it is made: languages, pattern of name and prefix.
OWN_PREFIXES = [(("python",), rf"^\s*(\w+)\s*=\s*(?:\w+\.)?(?:APIRouter|Blueprint)\(.*?\b(?:url_)?prefix\s*=\s*{_QUOTED}")]
# The router a route line names.
ROUTER = r"(?:^|[^\w.])@?(\w+)\.(?i:route|get|post|put|patch|delete|options|head|all|any|handlefunc|handle)\("


def detect(files: DataFrame) -> list[str]:
    """Frameworks whose mark occurs in some file; one aggregation over all files."""
    rules = {r.framework: r for r in ROUTES}
    row = files.filter("content is not null").agg(*[
        F.max(F.col("language").isin(list(r.languages)) & F.col("content").rlike(r.detect)).alias(r.framework.replace("-", "_"))
        for r in rules.values()]).first()
    return [name for name in rules if row[name.replace("-", "_")]]


def _next_function(sites: DataFrame, nodes: DataFrame, reach: int = 10) -> DataFrame:
    """The function that starts within a few lines below each (file_path, line)."""
    fns = nodes.filter("kind in ('function', 'method')").select("file_path", F.col("start_line").alias("at"), "id", "name")
    below = sites.select("file_path", "line").distinct().withColumn(
        "at", F.explode(F.sequence(F.col("line"), F.col("line") + reach)))
    return below.join(fns, ["file_path", "at"]).groupBy("file_path", "line").agg(F.min_by("name", F.struct("at", "id")).alias("below"))


def _clean(path: Column) -> Column:
    return F.regexp_replace(F.concat(F.lit("/"), path), "/+", "/")


def mount_table(lines: DataFrame, nodes: DataFrame, files: DataFrame, aliases: dict[str, str] | None = None,
                roots: DataFrame | None = None) -> DataFrame:
    """Routers of a project and what they are put under: (id, parent, prefix).

    A unit is a file or a router variable of a file, in Go one of a function. A name goes to the module it is
    imported from; a variable that nobody mounts hangs on its file, so mounting the file mounts it.
    """
    sites = []
    for languages, pattern, groups in MOUNTS:
        got = {g: F.nullif(F.regexp_extract("text", pattern, i), F.lit("")) for i, g in enumerate(groups, 1)}
        sites.append(lines.filter(F.col("language").isin(list(languages)) & F.col("text").rlike(pattern)).select(
            F.col("path").alias("file_path"), "language", "line",
            *[got.get(g, F.lit(None).cast("string")).alias(g) for g in ("parent", "prefix", "child", "source")]))
    sites = cut(union_all(sites), "mount-sites")
    own = union_all([lines.filter(F.col("language").isin(list(languages)) & F.col("text").rlike(p)).select(
        _unit(F.col("path"), F.regexp_extract("text", p, 1)).alias("id"), F.regexp_extract("text", p, 2).alias("own"))
        for languages, p in OWN_PREFIXES]).groupBy("id").agg(F.min("own").alias("own"))
    # Names of these files and the modules behind them; a Python name may itself be a module.
    here = files.join(sites.selectExpr("file_path as path").distinct(), "path", "left_semi")
    binds = imports.mappings(here).select("file_path", "language", "local_name", "source", "exported_name")
    inner = F.when(F.col("language") == "python", F.concat("source", F.when(F.col("source").endswith("."), "").otherwise("."), "exported_name"))
    binds = cut(binds.withColumn("inner", F.when(F.col("exported_name") != "*", inner)), "mount-names")
    asked = union_all([binds.select("file_path", "language", "source"), sites.filter("source is not null").select("file_path", "language", "source"),
                       binds.filter("inner is not null").select("file_path", "language", F.col("inner").alias("source"))])
    paths = cut(imports.import_targets(asked, files, aliases, roots), "mount-paths")
    to = paths.select("file_path", F.col("source").alias("inner"), F.col("target_path").alias("module"))
    binds = binds.join(paths, ["file_path", "source"], "left").join(to, ["file_path", "inner"], "left").groupBy(
        "file_path", F.col("local_name").alias("head")).agg(F.min(F.struct(
            F.coalesce("module", "target_path").alias("path"), F.col("module").isNotNull().alias("whole"), "exported_name")).alias("b"))
    head, tail = F.split("child", r"\.")[0], F.when(F.col("child").contains("."), F.element_at(F.split("child", r"\."), -1))
    rows = sites.withColumn("head", head).join(binds, ["file_path", "head"], "left").join(paths, ["file_path", "source"], "left")
    scope = _go_scope(rows, nodes)
    rows = rows.join(scope, ["file_path", "line"], "left").withColumn("place", F.concat("file_path", F.coalesce("scope", F.lit(""))))
    whole_file = F.col("b.whole") | F.col("b.exported_name").isin("*", "default") | F.col("language").isin(JS)
    variable = F.when(F.col("language").isin(JS), "").otherwise(F.coalesce(tail, F.when(whole_file, "").otherwise(F.col("b.exported_name"))))
    child = F.when(F.col("source").isNotNull(), F.when(F.col("target_path").isNotNull(), _unit(F.col("target_path"), F.lit("")))).when(
        F.col("b.path").isNotNull(), _unit(F.col("b.path"), variable)).otherwise(_unit(F.col("place"), F.col("head")))
    mounted = rows.select(child.alias("id"), _unit(F.col("place"), F.coalesce("parent", F.lit(""))).alias("parent"), "prefix",
                          F.col("child").isNotNull().alias("named")).filter("id is not null")
    mounted = cut(mounted.join(own, "id", "left").select("id", "parent", _clean(F.concat_ws("/", F.coalesce("prefix", F.lit("")), F.coalesce("own", F.lit("")))).alias("prefix")), "mounted")
    # Units that are only parents, or only have a prefix of their own, hang on their file.
    loose = mounted.selectExpr("parent as id").unionByName(own.select("id")).distinct().join(mounted, "id", "left_anti").join(own, "id", "left")
    loose = loose.filter("id not like '%|'").select("id", _unit(_file_of(F.col("id")), F.lit("")).alias("parent"), F.col("own").alias("prefix"))
    return union_all([mounted, loose])


def _unit(path: Column, variable: Column) -> Column:
    return F.concat(path, F.lit("|"), variable)


def _file_of(unit: Column) -> Column:
    return F.regexp_replace(unit, r"(#\d+)?\|[^|]*$", "")


def _go_scope(sites: DataFrame, nodes: DataFrame) -> DataFrame:
    """(file_path, line, scope): mark of the Go function around a line."""
    spans = nodes.filter("kind in ('function', 'method') and language = 'go'")
    around = enclosing(sites.filter("language = 'go'"), spans.select("id", "file_path", "start_line", "end_line"))
    return around.join(spans.select("id", "start_line"), "id").select("file_path", "line", F.concat(F.lit("#"), "start_line").alias("scope"))


def mounted_prefixes(lines: DataFrame, nodes: DataFrame, mount_rows: DataFrame) -> DataFrame:
    """(file_path, line, mount): prefixes of the routers that lines name, one row per way to a root."""
    ways = mounts.compose(cut(mount_rows, "mount-table")).select("id", F.col("path").alias("mount")).filter("mount != ''").distinct()
    ways = cut(ways, "mount-ways")
    near = lines.select(F.col("path").alias("file_path"), "language", "line", "text").join(
        ways.select(_file_of(F.col("id")).alias("file_path")).distinct(), "file_path", "left_semi")
    router = F.regexp_extract("text", ROUTER, 1)
    django = F.col("text").rlike(r"\b(?:re_)?(?:path|url)\(\s*r?['\"]")
    near = near.withColumn("router", router).filter((F.col("router") != "") | ((F.col("language") == "python") & django))
    near = cut(near.select("file_path", "language", "line", "router"), "routers").join(_go_scope(near, nodes), ["file_path", "line"], "left")
    own = _unit(F.concat("file_path", F.coalesce("scope", F.lit(""))), F.col("router"))
    hit = near.withColumn("id", own).join(ways, "id", "left")
    # A router nobody mounts is reached through its file.
    rest = hit.filter("mount is null").drop("mount").withColumn("id", _unit(F.col("file_path"), F.lit(""))).join(ways, "id")
    keep = ["file_path", "line", "mount"]
    return hit.filter("mount is not null").select(*keep).unionByName(rest.select(*keep)).distinct()


def resource_sites(lines: DataFrame) -> DataFrame:
    """Routes of Rails `resources :name` and `resource :name`, one per action that `only` and `except` leave."""
    pattern = r"\b(resources?)\s+:(\w+)"
    listed = {w: F.regexp_extract("text", rf"\b{w}:\s*\[([^\]]*)\]", 1) for w in ("only", "except")}
    actions = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(row, ("verb", "after", "action"))]) for row in RESTFUL])
    name, plural = F.regexp_extract("text", pattern, 2), F.regexp_extract("text", pattern, 1) == "resources"
    rows = lines.filter((F.col("language") == "ruby") & F.col("text").rlike(pattern)).select(
        "path", "language", "line", name.alias("name"), plural.alias("plural"), F.explode(actions).alias("a"),
        *[F.regexp_extract_all(v, F.lit(r"(\w+)"), 1).alias(k) for k, v in listed.items()])
    rows = rows.filter((F.col("plural") | (F.col("a.action") != "index")) & ((F.size("only") == 0) | F.array_contains("only", F.col("a.action")))
                       & ((F.size("only") > 0) | ~F.array_contains("except", F.col("a.action"))))
    many = F.when(F.col("plural"), F.col("name")).when(F.col("name").rlike("[^aeiou]y$"), F.regexp_replace("name", "y$", "ies")).when(
        F.col("name").rlike("(s|x|z|ch|sh)$"), F.concat("name", F.lit("es"))).otherwise(F.concat("name", F.lit("s")))
    return rows.select(F.col("path").alias("file_path"), "language", "line", F.col("a.verb").alias("verb"), F.concat("name", "a.after").alias("route"),
                       F.concat(many, F.lit("#"), "a.action").alias("handler"), F.lit("rails").alias("framework"), F.lit("references").alias("ref_kind"))


def module_prefixes(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """(owner, module_prefix): path a RouterModule gives to the module that lists a controller class."""
    ts = files.filter(F.col("language").isin(JS) & F.col("content").isNotNull()).select("path", "content")
    given = matches(ts.filter(F.col("content").contains("RouterModule")), "content", r"path:\s*['\"`]([^'\"`]*)['\"`]\s*,\s*module:\s*(\w+)", 2).select(
        F.col("g1").alias("module_prefix"), F.col("g2").alias("module"))
    held = matches(ts, "content", r"(?s)@Module\(\s*\{((?:(?!@Module\().)*?)\}\s*\)\s*(?:export\s+)?(?:default\s+)?class\s+(\w+)", 2)
    held = held.select(F.col("g2").alias("module"), F.explode(F.regexp_extract_all(
        F.regexp_extract("g1", r"controllers:\s*\[([^\]]*)\]", 1), F.lit(r"(\w+)"), 1)).alias("name"))
    classes = nodes.filter("kind = 'class'").select("name", F.col("id").alias("owner"))
    return given.filter("trim(both '/' from module_prefix) != ''").join(held, "module").join(classes, "name").groupBy("owner").agg(
        F.min("module_prefix").alias("module_prefix"))


def resolve_includes(nodes: DataFrame, files: DataFrame, refs: DataFrame, aliases: dict[str, str] | None = None,
                     roots: DataFrame | None = None) -> DataFrame:
    """Routes that include a module lead to its file."""
    asked = refs.filter("reference_kind = 'imports'").withColumn("source", F.col("reference_name"))
    paths = imports.import_targets(asked.select("file_path", "language", "source"), files, aliases, roots)
    file_id = nodes.filter("kind = 'file'").select(F.col("file_path").alias("target_path"), F.col("id").alias("target"))
    return asked.join(paths, ["file_path", "source"]).join(file_id, "target_path").select(
        "ref_id", "target", F.lit(0.92).alias("confidence"), F.lit("import").alias("resolved_by"))


def routes(lines: DataFrame, nodes: DataFrame, frameworks: list[str], mounted: DataFrame | None = None,
           modules: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Route nodes and their references to handlers.

    `mounted`(file_path, line, mount) and `modules`(owner, module_prefix) put prefixes before routes.
    """
    sites = []
    for rule in ROUTES:
        if rule.framework not in frameworks:
            continue
        got = {g: F.regexp_extract("text", rule.pattern, i) for i, g in enumerate(rule.groups, 1)}
        sites.append(lines.filter(F.col("language").isin(list(rule.languages)) & F.col("text").rlike(rule.pattern)).select(
            F.col("path").alias("file_path"), "language", "line", F.upper(F.coalesce(F.nullif(got.get("verb", F.lit("")), F.lit("")), F.lit(rule.verb))).alias("verb"),
            got["path"].alias("route"), got.get("handler", F.lit("")).alias("handler"), F.lit(rule.framework).alias("framework"),
            F.lit(rule.ref_kind).alias("ref_kind")))
    if "rails" in frameworks:
        sites.append(resource_sites(lines))
    if not sites:
        return nodes.limit(0), with_ref_id(as_refs(lines.limit(0).selectExpr("path as from_node_id")))
    found = cut(union_all(sites), "routes")
    prefix = class_prefixes(lines, nodes)
    spans = nodes.filter("kind in ('class', 'interface')").select("id", "file_path", "start_line", "end_line")
    around = enclosing(found, spans).withColumnRenamed("id", "owner")
    found = found.join(around, ["file_path", "line"], "left").join(prefix, "owner", "left")
    found = found.join(_next_function(found, nodes), ["file_path", "line"], "left")
    if modules is not None:
        found = found.join(modules, "owner", "left").withColumn("prefix", F.concat_ws("/", "module_prefix", "prefix"))
    if mounted is not None:
        found = found.join(mounted, ["file_path", "line"], "left").withColumn("prefix", F.concat_ws("/", "mount", "prefix"))
    handler = F.coalesce(F.nullif("handler", F.lit("")), F.col("below"))
    # Parts name the handler, but a module stays whole; a class view stands for itself.
    handler = F.when(F.col("ref_kind") == "imports", handler).otherwise(
        F.element_at(F.split(F.regexp_replace(handler, r"\.as_view$", ""), r"[#@.:]+"), -1))
    name = F.concat_ws(" ", F.regexp_replace("verb", "^REQUEST$|^HANDLE(FUNC)?$|^ALL$", "ANY"),
                       _clean(F.concat_ws("/", F.coalesce("prefix", F.lit("")), "route")))
    name = F.when(F.col("verb") == "RESOURCE", F.concat(F.lit("resource:"), "route")).otherwise(name)
    found = cut(found.select("file_path", "language", "line", name.alias("name"), handler.alias("handler"), "framework", "ref_kind",
                             node_id(F.lit("route"), F.col("file_path"), name, F.col("line")).alias("id")), "routes")
    route_nodes = as_nodes(found.selectExpr("id", "'route' as kind", "name", "concat(file_path, '::', name) as qualified_name",
                                            "file_path", "language", "line as start_line", "line as end_line", "framework as docstring"))
    refs = found.filter("handler is not null and handler != ''").selectExpr(
        "id as from_node_id", "handler as reference_name", "ref_kind as reference_kind", "line", "0 as col", "file_path", "language")
    return route_nodes, with_ref_id(as_refs(refs))


def class_prefixes(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """(owner, prefix): path a controller class puts before its routes."""
    pattern = r"^\s*[@\[](?:Controller|RequestMapping|Route)\(\s*(?:path\s*[:=]\s*|value\s*=\s*)?['\"`]([^'\"`]*)['\"`]"
    marks = lines.filter(F.col("text").rlike(pattern)).select(
        F.col("path").alias("file_path"), "line", F.regexp_extract("text", pattern, 1).alias("prefix"))
    classes = nodes.filter("kind = 'class'").selectExpr("file_path", "start_line as at", "id")
    near = marks.withColumn("at", F.explode(F.sequence(F.col("line"), F.col("line") + 5))).join(classes, ["file_path", "at"])
    return near.groupBy("file_path", "line").agg(F.min_by("id", F.struct("at", "id")).alias("owner"), F.min("prefix").alias("prefix")).groupBy(
        "owner").agg(F.min("prefix").alias("prefix"))


def with_module_prefixes(route_nodes: DataFrame, lines: DataFrame, prefix_pattern: str = r"setGlobalPrefix\(\s*['\"`]([^'\"`]+)['\"`]") -> DataFrame:
    """Routes renamed by the prefix the application sets elsewhere; a second run changes nothing."""
    row = lines.filter(F.col("text").rlike(prefix_pattern)).agg(F.min(F.regexp_extract("text", prefix_pattern, 1)).alias("p")).first()
    if row is None or not row["p"]:
        return route_nodes
    prefix = "/" + row["p"].strip("/")
    verb, path = F.split("name", " ")[0], F.element_at(F.split("name", " "), -1)
    return route_nodes.withColumn("name", F.when(path.startswith(prefix), F.col("name")).otherwise(
        F.concat(verb, F.lit(" " + prefix), path)))


def file_routes(files: DataFrame) -> DataFrame:
    """Routes that exist by the place of their file."""
    out = []
    for pattern, framework in FILE_ROUTES:
        path = F.regexp_replace(F.regexp_extract("path", pattern, 1), r"\[\.{3}(\w+)\]", "*")
        path = _clean(F.regexp_replace(F.regexp_replace(path, r"\([^)]*\)/?", ""), r"\[(\w+)\]", ":$1"))
        out.append(files.filter(F.col("path").rlike(pattern)).select(
            "path", "language", path.alias("name"), F.lit(framework).alias("framework")))
    rows = union_all(out).withColumn("name", F.when(F.col("name") == "/", "/").otherwise(F.regexp_replace("name", "/$", "")))
    return as_nodes(rows.select(
        node_id(F.lit("route"), F.col("path"), F.col("name"), F.lit(1)).alias("id"), F.lit("route").alias("kind"), "name",
        F.concat_ws("::", "path", "name").alias("qualified_name"), F.col("path").alias("file_path"), "language",
        F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.col("framework").alias("docstring")))


def expo_modules(lines: DataFrame) -> DataFrame:
    """(path, module): name an Expo module file gives itself, else the name of its class."""
    native = lines.filter(F.col("language").isin("kotlin", "swift"))
    given, cls = r"\bName\s*\(\s*[\"'](\w+)[\"']", r"\bclass\s+(\w+)\s*:\s*Module\b"
    marks = native.filter(F.col("text").rlike(f"{given}|{cls}"))
    first = [F.min_by(F.regexp_extract("text", p, 1), F.when(F.col("text").rlike(p), F.col("line"))) for p in (given, cls)]
    return marks.groupBy("path").agg(F.coalesce(*first).alias("module"))


def bridge_nodes(lines: DataFrame) -> DataFrame:
    """Components and native bridge methods, with the id prefixes the inference rules look for.

    Methods of an Expo module are qualified by its name, all others by their folder.
    """
    out = []
    for prefix, kind, languages, pattern in BRIDGES:
        name = F.regexp_extract("text", pattern, 1)
        hit = lines.filter(F.col("language").isin(list(languages)) & F.col("text").rlike(pattern))
        out.append(hit.select(
            F.concat(F.lit(f"{prefix}:"), F.substring(F.sha2(F.concat_ws(":", "path", name, "line"), 256), 1, 32)).alias("id"),
            F.lit(kind).alias("kind"), name.alias("name"), F.lit(prefix).alias("bridge"),
            F.col("path").alias("file_path"), "language", F.col("line").alias("start_line"), F.col("line").alias("end_line")))
    module = expo_modules(lines).withColumnRenamed("path", "file_path").withColumn("bridge", F.lit("expo-module"))
    rows = union_all(out).join(module, ["file_path", "bridge"], "left")
    return as_nodes(rows.withColumn("qualified_name", F.concat_ws("::", F.coalesce("module", dirname("file_path")), "name")))


def resolve_handlers(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """Handlers of routes: in the same file at 0.9, elsewhere at 0.8 if in a usual folder, else 0.6."""
    cand = nodes.filter("kind in ('function', 'method', 'class', 'component')").select(
        "id", F.col("name").alias("reference_name"), "file_path", "language")
    same = cand.groupBy("reference_name", "file_path").agg(F.min("id").alias("own"))
    usual = F.col("file_path").rlike(r"(?i)(^|/)(controllers?|handlers?|views?|routes?|api|pages)(/|\.|_)")
    far = cand.groupBy("reference_name", "language").agg(
        F.min(F.struct(F.when(usual, 0).otherwise(1).alias("o"), F.col("id"))).alias("b"))
    out = refs.join(same, ["reference_name", "file_path"], "left").join(far, ["reference_name", "language"], "left")
    target = F.coalesce("own", "b.id")
    confidence = F.when(F.col("own").isNotNull(), 0.9).when(F.col("b.o") == 0, 0.8).otherwise(0.6)
    return out.select("ref_id", target.alias("target"), confidence.alias("confidence"), F.lit("framework").alias("resolved_by")).filter("target is not null")
