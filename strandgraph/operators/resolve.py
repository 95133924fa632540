"""Reference resolution as set-based joins.

References carry (ref_id, from_node_id, reference_name, reference_kind, line, file_path,
language). A strategy returns (ref_id, target, confidence, resolved_by), at most one row per
reference; with `keep` it brings further columns of the reference along, which saves a join by ref_id.

A frequent name may have millions of references and millions of definitions, so no strategy
pairs the two. References shrink to the distinct values a decision depends on, definitions
shrink to one row per (name, directory prefix, language, kind, exported); both meet there.
Where the rules say "first match", the smallest node id wins.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.langs import gate, same_family
from ..functions.paths import basename, dir_parts, dir_prefixes, dirname
from ..graph import Graph
from ..lineage import cut, union_all, unsent

OUT = ["ref_id", "target", "confidence", "resolved_by"]
EDGE_OF = ["from_node_id", "reference_kind", "line", "col"]  # what an edge takes from its reference
TYPE_KINDS = ["class", "struct", "interface"]
CALLABLE = ["function", "method"]
REF_ID = ["from_node_id", "reference_kind", "reference_name", "line", "col"]  # what a ref_id is made of
CLASS = ["reference_name", "reference_kind", "language", "file_path"]  # what decides a reference by name besides its line
NEAR = 200  # lines beyond which two positions in one file are equally far


def with_ref_id(refs: DataFrame) -> DataFrame:
    """Identity of a reference: where it stands and what it names."""
    return refs.withColumn("ref_id", F.concat_ws(
        "|", "from_node_id", "reference_kind", "reference_name",
        F.coalesce("line", F.lit(0)).cast("string"), F.coalesce("col", F.lit(0)).cast("string")))


def _answer(df: DataFrame, confidence: Column | float, by: str, keep: Sequence[str] = ()) -> DataFrame:
    conf = F.lit(float(confidence)) if isinstance(confidence, (int, float)) else confidence
    return df.select("ref_id", "target", conf.cast("double").alias("confidence"), F.lit(by).alias("resolved_by"), *keep)


def _kind_bias(ref_kind: Column, kind: Column) -> Column:
    return (
        F.when(ref_kind.isin("calls", "decorates") & kind.isin(CALLABLE), 25)
        .when((ref_kind == "instantiates") & kind.isin(TYPE_KINDS), 25)
        .when((ref_kind == "decorates") & kind.isin("class", "interface"), 15)
        .otherwise(0)
    )


def _static_score(ref_kind: Column, ref_lang: Column, cand: Column | None = None) -> Column:
    lang, kind, exported = (F.col(c) if cand is None else cand[c] for c in ("cand_lang", "cand_kind", "exported"))
    return (F.when(lang == ref_lang, 50).otherwise(-80) + _kind_bias(ref_kind, kind)
            + F.when(exported, 10).otherwise(0))


# -- by name --------------------------------------------------------------------

def prefix_groups(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Definitions by key and directory prefix: count and smallest id per group."""
    spread = candidates.select(*keys, "id", F.explode(dir_prefixes("file_path")).alias("d"))
    return spread.select(*keys, "d.level", "d.prefix", "id").groupBy(*keys, "level", "prefix").agg(
        F.count("*").alias("n"), F.min("id").alias("first"))


def _named(nodes: DataFrame, refs: DataFrame, ref_col: str = "reference_name") -> DataFrame:
    """Definitions some reference names, in the form the name strategies use."""
    wanted = refs.select(F.col(ref_col).alias("name")).distinct()
    return nodes.select(
        "id", "name", "file_path", F.col("language").alias("cand_lang"), F.col("kind").alias("cand_kind"),
        F.col("is_exported").alias("exported"), F.col("start_line").alias("cand_line"),
    ).join(wanted, "name", "left_semi")


def _by_class(cand: DataFrame, classes: DataFrame) -> DataFrame:
    """What the class of a reference settles without its line: number of candidates, best one, best one in the own file."""
    groups = cut(prefix_groups(cand, ["name", "cand_lang", "cand_kind", "exported"]), "groups")
    levels = classes.select(*CLASS, F.explode(dir_prefixes("file_path")).alias("d")).select(
        *CLASS, F.col("reference_name").alias("name"), "d.level", "d.prefix")
    open_gate = gate(F.col("reference_kind"), F.col("cand_lang"), F.col("language"))
    met = levels.join(groups, ["name", "level", "prefix"]).filter(open_gate)
    proximity = F.least(F.col("level") * 15, F.lit(80))
    score = (proximity + _static_score(F.col("reference_kind"), F.col("language"))).cast("double")
    # Level 0 holds every candidate, so its counts tell how many there are in all.
    best = met.groupBy(*CLASS).agg(
        F.sum(F.when(F.col("level") == 0, F.col("n")).otherwise(0)).alias("n"),
        F.min(F.struct((-score).alias("neg"), F.col("first").alias("target"), proximity.alias("near"),
                       F.col("cand_lang"))).alias("best"))
    everywhere = cand.groupBy("name", "file_path", "cand_lang", "cand_kind", "exported").agg(F.min("id").alias("target"))
    far = classes.withColumn("name", F.col("reference_name")).join(everywhere, ["name", "file_path"]).filter(open_gate)
    far = far.groupBy(*CLASS).agg(F.min(_here(F.lit(0.0))).alias("far"))
    return best.join(far, CLASS, "left")


def _here(closeness: Column, cand: Column | None = None) -> Column:
    """A candidate in the reference's own file, in the order the best one comes first."""
    depth = F.least(F.size(dir_parts("file_path")) * 15, F.lit(80))
    score = 100 + depth + closeness + _static_score(F.col("reference_kind"), F.col("language"), cand)
    target, lang = (F.col(c) if cand is None else cand[c] for c in ("target", "cand_lang"))
    return F.struct((-score).cast("double").alias("neg"), target.alias("target"), depth.alias("near"), lang.alias("cand_lang"))


def _exact(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """Stored references with the number of their candidates `n`, the `best` by class and the winner `win`, null without any."""
    classes = cut(refs.select(*CLASS).distinct(), "classes")
    cand = _named(nodes, classes)
    by_class = cut(_by_class(cand, classes), "best")

    # Definitions in the same file also score by distance in lines. They lie in bins as wide as the reach and in
    # both neighbours, so a reference looks into its own bin only, which holds few of them.
    local = cand.filter("cand_line > 0").join(
        classes.select(F.col("reference_name").alias("name"), "file_path").distinct(), ["name", "file_path"], "left_semi")
    by_line = local.groupBy("name", "file_path", "cand_lang", "cand_kind", "exported", "cand_line").agg(F.min("id").alias("target"))
    around = by_line.withColumn("bin", F.explode(F.array(*[F.floor(F.col("cand_line") / NEAR) + d for d in (-1, 0, 1)]))).groupBy(
        F.col("name").alias("reference_name"), "file_path", "bin").agg(
        F.collect_list(F.struct("cand_line", "cand_lang", "cand_kind", "exported", "target")).alias("around"))
    # What the class settles comes in behind, so that references travel to their bins without it.
    out = refs.withColumn("bin", F.floor(F.col("line") / NEAR)).join(unsent(around), ["reference_name", "file_path", "bin"], "left")

    def apart(c: Column) -> Column:
        return F.abs(c["cand_line"] - F.col("line"))

    close = F.filter("around", lambda c: (apart(c) < NEAR) & gate(F.col("reference_kind"), c["cand_lang"], F.col("language")))
    near = F.array_min(F.transform(close, lambda c: _here(F.greatest(F.lit(0.0), 20 - apart(c) / 10), c)))
    out = out.withColumn("close", near).drop("bin", "around").join(by_class, CLASS, "left")
    far = F.when(F.col("line").isNotNull(), F.col("far"))
    return out.withColumn("win", F.least("best", far, "close")).drop("close", "far")


def exact_name(nodes: DataFrame, refs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """By exact name: a sole candidate, else the best by file, directory, language, kind, export."""
    return _exact_answers(_exact(nodes, refs), keep)


def _answered() -> Column:
    return F.coalesce((F.col("n") == 1) | (F.col("win.neg") < 1), F.lit(False))


def _exact_answers(scored: DataFrame, keep: Sequence[str]) -> DataFrame:
    confidence = F.when(
        F.col("n") == 1, F.when(F.col("best.cand_lang") == F.col("language"), 0.9).otherwise(0.5)
    ).when(F.col("win.near") >= 30, 0.7).otherwise(0.4)
    out = scored.filter(_answered()).withColumn("target", F.col("win.target"))
    return _answer(out, confidence, "exact-match", keep)


def _qualified(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """(reference_name, target, c) for every qualified name some reference uses."""
    refs = refs.filter(F.col("reference_name").contains("::") | F.col("reference_name").contains("."))
    wanted = refs.select("reference_name").distinct()
    exact = nodes.groupBy(F.col("qualified_name").alias("reference_name")).agg(
        F.count("*").alias("n"), F.min("id").alias("one"))
    segments = F.split("qualified_name", "::")
    # Suffixes at segment borders turn "ends with" into an equality.
    suffix = nodes.select("id", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(segments)), lambda i: F.array_join(F.slice(segments, i, F.size(segments)), "::"),
    )).alias("reference_name")).groupBy("reference_name").agg(F.min("id").alias("first"))
    return wanted.join(exact, "reference_name", "left").join(suffix, "reference_name", "left").select(
        "reference_name", F.when(F.col("n") == 1, F.col("one")).otherwise(F.col("first")).alias("target"),
        F.when(F.col("n") == 1, 0.95).otherwise(0.85).alias("c")).filter("target is not null")


def qualified_name(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """By qualified name: a sole exact match, else the first whose qualified name ends with it."""
    return _answer(refs.join(_qualified(nodes, refs), "reference_name"), F.col("c"), "qualified-name")


def file_path(nodes: DataFrame, refs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Path-like names against file nodes: exact, then closest by suffix, then sole base name."""
    refs = refs.filter(F.col("reference_name").contains("/")
                       | F.col("reference_name").rlike(r"\.[A-Za-z][A-Za-z0-9]{0,3}$"))
    files = nodes.filter("kind = 'file'").select("id", "name", "file_path", F.col("language").alias("cand_lang"))
    exact = files.groupBy(F.col("file_path").alias("reference_name")).agg(F.min("id").alias("exact"))
    segments = F.split("file_path", "/")
    suffixed = files.select("id", "file_path", "cand_lang", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(segments)), lambda i: F.array_join(F.slice(segments, i, F.size(segments)), "/"),
    )).alias("reference_name")).join(refs.select("reference_name").distinct(), "reference_name", "left_semi")
    groups = prefix_groups(suffixed, ["reference_name", "cand_lang"])
    in_dir = suffixed.groupBy("reference_name", "cand_lang", dirname("file_path").alias("dir")).agg(
        F.min("id").alias("first"))
    cls = ["reference_name", "file_path", "language"]
    classes = refs.select(*cls).distinct()
    bonus = F.when(same_family(F.col("cand_lang"), F.col("language")), 5).otherwise(0)
    depth = F.least(F.size(dir_parts("file_path")) * 15, F.lit(80))
    here = classes.withColumn("dir", dirname("file_path")).join(in_dir, ["reference_name", "dir"]).select(
        *cls, (1000 + depth + bonus).alias("score"), "first")
    levels = classes.select(*cls, F.explode(dir_prefixes("file_path")).alias("d")).select(*cls, "d.level", "d.prefix")
    there = levels.join(groups, ["reference_name", "level", "prefix"]).select(
        *cls, (F.least(F.col("level") * 15, F.lit(80)) + bonus).alias("score"), "first")
    closest = here.unionByName(there).groupBy(*cls).agg(
        F.min(F.struct((-F.col("score")).alias("neg"), F.col("first"))).alias("b")).select(
        *cls, F.col("b.first").alias("closest"))
    sole = files.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("sole")).filter("n = 1")
    out = (
        refs.join(exact, "reference_name", "left").join(closest, cls, "left")
        .withColumn("name", basename("reference_name")).join(sole.select("name", "sole"), "name", "left")
        .withColumn("target", F.coalesce("exact", "closest", "sole")).filter("target is not null")
    )
    confidence = F.when(F.col("exact").isNotNull(), 0.95).when(F.col("closest").isNotNull(), 0.85).otherwise(0.7)
    return _answer(out, confidence, "file-path", keep)


def fuzzy(nodes: DataFrame, refs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Case-folded name of a sole callable, in the own language if that has any."""
    cand = nodes.filter(F.col("kind").isin("function", "method", "class")).groupBy(
        F.lower("name").alias("lower"), F.col("language").alias("cand_lang")).agg(
        F.count("*").alias("n"), F.min("id").alias("one"))
    cls = ["lower", "reference_kind", "language"]
    refs = refs.withColumn("lower", F.lower("reference_name"))
    met = refs.select(*cls).distinct().join(cand, "lower").filter(
        gate(F.col("reference_kind"), F.col("cand_lang"), F.col("language")))
    own = F.col("cand_lang") == F.col("language")
    found = met.groupBy(*cls).agg(
        F.sum(F.when(own, F.col("n")).otherwise(0)).alias("own_n"), F.min(F.when(own, F.col("one"))).alias("own"),
        F.sum("n").alias("all_n"), F.min("one").alias("one"))
    found = found.filter("own_n = 1 or (own_n = 0 and all_n = 1)").select(
        *cls, F.coalesce("own", "one").alias("target"), F.when(F.col("own_n") == 1, 0.5).otherwise(0.3).alias("c"))
    return _answer(refs.join(found, cls), F.col("c"), "fuzzy", keep)


# -- methods --------------------------------------------------------------------

def _camel_words(col: Column) -> Column:
    spaced = F.regexp_replace(F.regexp_replace(col, "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    words = F.split(spaced, r"[\s._:/\\]+")
    return F.array_sort(F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) > 1), F.lower)))


def method_call(nodes: DataFrame, refs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """`receiver.method` and `Type::method`: by class name, capitalised receiver, sole method, shared words."""
    pattern = r"^([\w.]+)\.(\w+:?(?:\w+:)*)$|^(\w+)::(\w+)$"
    parsed = refs.filter(F.col("reference_name").rlike(pattern)).select(
        *dict.fromkeys(["ref_id", "language", *keep]), F.coalesce(F.nullif(F.regexp_extract("reference_name", pattern, 1), F.lit("")),
                        F.regexp_extract("reference_name", pattern, 3)).alias("receiver"),
        F.coalesce(F.nullif(F.regexp_extract("reference_name", pattern, 2), F.lit("")),
                   F.regexp_extract("reference_name", pattern, 4)).alias("method"))
    parsed = cut(parsed, "parsed")
    calls = cut(parsed.select("receiver", "method", "language").distinct(), "calls")
    methods = nodes.filter("kind = 'method'").select(
        F.col("id").alias("m"), F.col("name").alias("method"), "file_path", "qualified_name", "language")
    methods = cut(methods.join(calls.select("method").distinct(), "method", "left_semi"), "methods")
    classes = nodes.filter(F.col("kind").isin(TYPE_KINDS)).select(
        F.col("id").alias("c"), F.col("name").alias("receiver"), "file_path", F.col("language").alias("class_lang"))
    owned = methods.select("m", "method", "file_path", F.explode(
        F.array_distinct(F.split("qualified_name", "::"))).alias("receiver"))
    of_class = owned.join(classes, ["file_path", "receiver"]).groupBy(
        "receiver", "method", F.col("class_lang").alias("language")).agg(
        F.min(F.struct("c", "m")).alias("b")).select("receiver", "method", "language", F.col("b.m").alias("hit"))
    of_class = cut(of_class, "of-class")

    named = calls.join(of_class, ["receiver", "method", "language"])
    named = named.select("receiver", "method", "language", F.lit(1).alias("stage"), F.col("hit").alias("target"))
    upper = F.concat(F.upper(F.substring("receiver", 1, 1)), F.expr("substring(receiver, 2)"))
    capital = calls.withColumn("upper", upper).filter("upper != receiver").join(
        of_class.withColumnRenamed("receiver", "upper"), ["upper", "method", "language"])
    capital = capital.select("receiver", "method", "language", F.lit(2).alias("stage"), F.col("hit").alias("target"))
    by_lang = methods.groupBy("method", F.col("language").alias("cand_lang")).agg(
        F.count("*").alias("n"), F.min("m").alias("one"))
    counted = calls.join(by_lang, "method").groupBy("receiver", "method", "language").agg(
        F.sum(F.when(F.col("cand_lang") == F.col("language"), F.col("n")).otherwise(0)).alias("own_n"),
        F.sum("n").alias("all_n"), F.min(F.when(F.col("cand_lang") == F.col("language"), F.col("one"))).alias("one"))
    counted = cut(counted, "counted")
    sole = counted.filter("own_n = 1").select(
        "receiver", "method", "language", F.lit(3).alias("stage"), F.col("one").alias("target"))

    # Word overlap meets on distinct word sets of both sides, one word at a time.
    sets = methods.groupBy("method", F.col("language").alias("cand_lang"),
                           _camel_words(F.col("qualified_name")).alias("words")).agg(F.min("m").alias("m"))
    open_calls = counted.filter("own_n > 1 or (own_n = 0 and all_n > 1)").select(
        "receiver", "method", "language", "own_n", F.explode(_camel_words(F.col("receiver"))).alias("word"))
    pairs = open_calls.join(sets.select("method", "cand_lang", "m", F.explode("words").alias("word")), ["method", "word"])
    pairs = pairs.filter("own_n = 0 or cand_lang = language").groupBy("receiver", "method", "language", "cand_lang", "m").agg(
        F.count("*").alias("overlap"))
    score = F.col("overlap") + (F.col("cand_lang") == F.col("language")).cast("int")
    overlap = pairs.withColumn("score", score).filter("score >= 2").groupBy("receiver", "method", "language").agg(
        F.min(F.struct((-F.col("score")).alias("neg"), F.col("m"))).alias("b"))
    overlap = overlap.select("receiver", "method", "language", F.lit(4).alias("stage"), F.col("b.m").alias("target"))
    best = union_all([named, capital, sole, overlap]).groupBy("receiver", "method", "language").agg(
        F.min(F.struct("stage", "target")).alias("b")).select(
        "receiver", "method", "language", "b.stage", "b.target")
    out = parsed.join(best, ["receiver", "method", "language"])
    stage = F.col("stage")
    confidence = F.when(stage == 1, 0.85).when(stage == 2, 0.8).when(stage == 3, 0.7).otherwise(0.65)
    by = F.when(stage == 1, "qualified-name").otherwise("instance-method")
    return out.select("ref_id", "target", confidence.alias("confidence"), by.alias("resolved_by"), *keep)


def supertypes(g: Graph) -> DataFrame:
    """(type_name, language, super_name): direct supertypes by simple name over same-named types."""
    edges = g.edges.filter(F.col("kind").isin("extends", "implements")).select("source", "target")
    sub = g.nodes.select(F.col("id").alias("source"), F.col("name").alias("type_name"), "language")
    sup = g.nodes.select(F.col("id").alias("target"), F.col("name").alias("super_name"))
    return edges.join(sub, "source").join(sup, "target").select("type_name", "language", "super_name").distinct()


def method_on_type(g: Graph, calls: DataFrame) -> DataFrame:
    """Method of a named type or its nearest supertype, however far up: calls(type_name, method, language) -> target."""
    parts = F.split("qualified_name", "::")
    table = cut(g.nodes.filter("kind = 'method'").filter(F.size(parts) >= 2).groupBy(
        F.element_at(parts, -2).alias("at"), F.col("name").alias("method"), "language").agg(
        F.min("id").alias("target")), "methods")
    up = cut(supertypes(g).withColumnRenamed("type_name", "at"), "supertypes")
    key = ["type_name", "method", "language"]
    open_ = cut(calls.select(*key).distinct().withColumn("at", F.col("type_name")), "open")
    seen, found = [open_], []
    while True:  # ends, since a type is looked at once per call
        hit = cut(open_.join(table, ["at", "method", "language"]).groupBy(*key).agg(F.min("target").alias("target")), "hit")
        found.append(hit)
        nxt = open_.join(hit, key, "left_anti").join(up, ["at", "language"]).select(
            *key, F.col("super_name").alias("at")).distinct()
        open_ = cut(nxt.join(union_all(seen), [*key, "at"], "left_anti"), "open")
        if open_.isEmpty():
            break
        seen.append(open_)
    return union_all(found)


def call_chain(g: Graph, refs: DataFrame) -> DataFrame:
    """`A.f().m`, `A::f().m` and `f().m`: the method lies on the type the inner call returns."""
    pattern = r"^(?:(.+?)(?:\.|::))?(\w+)\(\)\.(\w+)$"
    parsed = refs.filter(F.col("reference_name").rlike(pattern)).select(
        "ref_id", "language", *[F.regexp_extract("reference_name", pattern, i).alias(n)
                                for i, n in ((1, "owner"), (2, "fn"), (3, "method"))])
    parts = F.split("qualified_name", "::")
    returns = g.nodes.filter(F.col("return_type").isNotNull()).select(
        F.when(F.size(parts) >= 2, F.element_at(parts, -2)).otherwise("").alias("owner"),
        F.col("name").alias("fn"), "language", "id",
        F.regexp_extract("return_type", r"(\w+)\W*$", 1).alias("type_name"))
    returns = returns.groupBy("owner", "fn", "language").agg(F.min_by("type_name", "id").alias("type_name"))
    last = F.element_at(F.split("owner", r"::|\."), -1)
    typed = parsed.withColumn("owner", F.when(F.col("owner") == "", "").otherwise(last)).join(
        returns, ["owner", "fn", "language"], "left")
    # A capitalised bare callee without a known return type is a constructor.
    typed = typed.withColumn("type_name", F.coalesce("type_name", F.when(
        (F.col("owner") == "") & F.col("fn").rlike("^[A-Z]"), F.col("fn")))).filter("type_name is not null")
    hits = method_on_type(g, typed)
    return _answer(typed.join(hits, ["type_name", "method", "language"]), 0.85, "call-chain")


# -- function values ------------------------------------------------------------

# Languages where a bare name can only be a function value, never a method.
BARE_FUNCTION = ["typescript", "tsx", "javascript", "jsx", "cpp", "python", "php"]


def _two_smallest(cand: DataFrame, keys: list[str]) -> DataFrame:
    """Count, first and second candidate per group by (start_line, id)."""
    order = F.struct("cand_line", "id")
    first = cut(cand.groupBy(*keys).agg(F.count("*").alias("n"), F.min(order).alias("first")), "first")
    second = cand.join(first.select(*keys, "first"), keys).filter(F.col("id") != F.col("first.id")).groupBy(
        *keys).agg(F.min(order).alias("second"))
    return first.join(second, keys, "left")


def function_value(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """A function named as a value: same file first, else a sole match in the family, never itself."""
    refs = refs.filter((F.col("reference_kind") == "function_ref") & ~F.col("reference_name").startswith("this."))
    refs = refs.withColumn("name", F.element_at(F.split("reference_name", "::"), -1)).withColumn(
        "scope", F.expr("if(contains(reference_name, '::'), reference_name, '')"))
    cand = nodes.filter(F.col("kind").isin(CALLABLE)).select(
        "id", "name", "file_path", "qualified_name", F.col("language").alias("cand_lang"),
        F.col("kind").alias("cand_kind"), F.col("start_line").alias("cand_line"))
    segments = F.split("qualified_name", "::")
    scopes = F.concat(F.array(F.lit("")), F.when(F.size(segments) > 1, F.transform(
        F.sequence(F.lit(1), F.size(segments) - 1),
        lambda i: F.array_join(F.slice(segments, i, F.size(segments)), "::"))).otherwise(F.array().cast("array<string>")))
    cand = cand.withColumn("scope", F.explode(scopes)).join(refs.select("name", "scope").distinct(), ["name", "scope"], "left_semi")
    cand = cut(cand, "fn-values")
    me = nodes.select(
        F.col("id").alias("from_node_id"), F.col("name").alias("my_name"), F.col("kind").alias("my_kind"),
        F.col("language").alias("my_lang"), F.col("file_path").alias("my_file"), F.col("qualified_name").alias("my_qn"))
    asks = refs.join(me, "from_node_id", "left")

    def pick(keys: list[str], limit_one: bool) -> DataFrame:
        stats = _two_smallest(cand, ["name", "scope", "cand_lang", "cand_kind", *keys])
        rows = asks.join(stats, ["name", "scope", *keys]).filter(
            same_family(F.col("cand_lang"), F.col("language"))
            & ((F.col("cand_kind") == "function") | (F.col("scope") != "") | ~F.col("language").isin(BARE_FUNCTION)))
        # The asking function may be one of the candidates; it does not count.
        inside = (F.col("my_name") == F.col("name")) & (F.col("my_kind") == F.col("cand_kind")) & (
            F.col("my_lang") == F.col("cand_lang"))
        inside = inside & ((F.col("scope") == "") | F.concat(F.lit("::"), F.col("my_qn")).endswith(
            F.concat(F.lit("::"), F.col("scope"))))
        if keys:
            inside = inside & (F.col("my_file") == F.col("file_path"))
        mine = F.coalesce(inside, F.lit(False)).cast("long")
        best = F.when(F.col("first.id") == F.col("from_node_id"), F.col("second")).otherwise(F.col("first"))
        rows = rows.select("ref_id", "scope", best.alias("best"), (F.col("n") - mine).alias("n")).groupBy(
            "ref_id", "scope").agg(F.sum("n").alias("n"), F.min("best").alias("best")).filter("best is not null")
        return rows.filter("n = 1") if limit_one else rows

    own = pick(["file_path"], False).select(
        "ref_id", F.col("best.id").alias("target"),
        F.when(F.col("scope") != "", 0.9).when(F.col("n") == 1, 0.95).otherwise(0.9).alias("confidence"))
    wide = pick([], True).select("ref_id", F.col("best.id").alias("target"),
                                 F.when(F.col("scope") != "", 0.9).otherwise(0.8).alias("confidence"))
    out = own.unionByName(wide.join(own, "ref_id", "left_anti"))
    return _answer(out, F.col("confidence"), "function-ref")


def this_member(g: Graph, refs: DataFrame) -> DataFrame:
    """`this.member` as a value: a member of the own class (0.95), else of a supertype (0.85)."""
    refs = refs.filter(F.col("reference_name").rlike(r"^this\.\w+$")).withColumn(
        "method", F.expr("substring(reference_name, 6)"))
    parts = F.split("qualified_name", "::")
    owner = g.nodes.select(F.col("id").alias("from_node_id"), F.when(
        F.col("kind").isin(TYPE_KINDS), F.col("name")).when(F.size(parts) >= 2, F.element_at(parts, -2)).alias("type_name"))
    typed = refs.join(owner, "from_node_id").filter("type_name is not null")
    members = g.nodes.filter(F.col("kind").isin(CALLABLE) & (F.size(parts) >= 2)).groupBy(
        F.element_at(parts, -2).alias("type_name"), F.col("name").alias("method"), "file_path").agg(F.min("id").alias("own"))
    typed = typed.join(members, ["type_name", "method", "file_path"], "left")
    inherited = method_on_type(g, typed.filter("own is null"))
    out = typed.join(inherited, ["type_name", "method", "language"], "left").withColumn(
        "target", F.coalesce("own", "target")).filter("target is not null")
    return _answer(out, F.when(F.col("own").isNotNull(), 0.95).otherwise(0.85), "function-ref")


# -- the whole pass ---------------------------------------------------------------

def existing(nodes: DataFrame, refs: DataFrame, mappings: DataFrame | None = None) -> DataFrame:
    """References some part of which names a definition or an imported name."""
    name = F.col("reference_name")
    first = F.split(name, r"::|\.")[0]
    keys = F.array_distinct(F.array_compact(F.array(
        name, F.element_at(F.split(name, r"::|\."), -1), first,
        F.concat(F.upper(F.substring(first, 1, 1)), F.substring(first, 2, 2**31 - 1)), basename(name),
        F.regexp_replace(F.element_at(F.split(name, r"::|\."), -1), r"\(\)", ""))))
    wanted = nodes.select(F.col("name").alias("key"))
    if mappings is not None:
        wanted = wanted.unionByName(mappings.select(F.col("local_name").alias("key")))
    variants = refs.select("reference_name").distinct().withColumn("key", F.explode(keys))
    known = variants.join(wanted.distinct(), "key", "left_semi").select("reference_name").distinct()
    return refs.join(known, "reference_name", "left_semi")


def drop_external(refs: DataFrame, stop_names: DataFrame, nodes: DataFrame) -> DataFrame:
    """Remove references to built-in names: stop_names(language, reference_name, yields).

    Entries with `yields` give way when the project itself defines the name.
    """
    defined = nodes.select(F.col("name").alias("reference_name")).distinct()
    hard = stop_names.filter("not yields").select("language", "reference_name")
    soft = stop_names.filter("yields").join(defined, "reference_name", "left_anti").select("language", "reference_name")
    return refs.join(hard.unionByName(soft), ["language", "reference_name"], "left_anti")


def best_of(*answers: DataFrame) -> DataFrame:
    """Highest confidence per reference; on ties the earlier list wins."""
    ranked = union_all([a.select(*OUT, F.lit(i).alias("ord")) for i, a in enumerate(answers)])
    pick = F.min(F.struct((-F.col("confidence")).alias("neg"), F.col("ord"), F.col("target"), F.col("resolved_by")))
    return ranked.groupBy("ref_id").agg(pick.alias("b")).select(
        "ref_id", "b.target", (-F.col("b.neg")).alias("confidence"), "b.resolved_by")


def with_columns_of(answers: DataFrame, refs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Answers with further columns of their references."""
    return answers.join(refs.select("ref_id", *keep), "ref_id").select(*answers.columns, *keep) if keep else answers


def by_name(g: Graph, refs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """File path, qualified name, call chain, method call, exact name, fuzzy; the first that answers."""
    return _by_name(g, cut(refs.filter("reference_kind != 'function_ref'"), "refs"), keep)


def _by_name(g: Graph, left: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Each stage sees only what earlier ones left over of the stored references `left`.

    Names settled by the qualified name and references scored by the exact one leave by what settled them;
    only the rare answers of the other stages are taken out by ref_id.
    """
    def rest(left: DataFrame, answer: DataFrame) -> DataFrame:
        return left.join(answer.select("ref_id"), "ref_id", "left_anti")

    paths = cut(file_path(g.nodes, left, keep), "answer")
    left = rest(left, paths)
    names = cut(_qualified(g.nodes, left), "qualified")
    qualified = _answer(left.join(names, "reference_name"), F.col("c"), "qualified-name", keep)
    left = left.join(names.select("reference_name"), "reference_name", "left_anti")
    chains = cut(call_chain(g, left), "answer")
    chains = with_columns_of(chains, left, keep)
    left = rest(left, chains)
    methods = cut(method_call(g.nodes, left, keep), "answer")
    left = rest(left, methods)
    columns = list(dict.fromkeys([*CLASS, "ref_id", *keep]))
    scored = cut(_exact(g.nodes, left).select(*columns, "n", "best", "win"), "scored")
    unsure = scored.filter(~_answered()).select(*columns)
    return union_all([paths, qualified, chains, methods, _exact_answers(scored, keep), fuzzy(g.nodes, unsure, keep)])


def resolve(g: Graph, refs: DataFrame, via_import: DataFrame | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Resolve all references: function values apart, imports at 0.9 first, then the best answer."""
    refs = cut(existing(g.nodes, refs), "refs")
    functions = refs.filter("reference_kind = 'function_ref'")
    values = with_columns_of(union_all([function_value(g.nodes, refs), this_member(g, refs)]), functions, keep)
    rest = refs.filter("reference_kind != 'function_ref'")
    if via_import is None:
        return union_all([values, _by_name(g, rest, keep)])
    strong = via_import.filter("confidence >= 0.9").select(*OUT)
    named = by_name(g, rest.join(strong, "ref_id", "left_anti"))
    best = union_all([strong, best_of(via_import.filter("confidence < 0.9"), named)])
    return union_all([values, with_columns_of(best, refs, keep)])


def edges_from(g: Graph, refs: DataFrame, answers: DataFrame) -> DataFrame:
    """Edges of resolved references with the promotions their ends imply.

    Answers that carry the columns `EDGE_OF` are not joined with their references again.
    """
    target = g.nodes.select(F.col("id").alias("target"), F.col("kind").alias("target_kind"))
    rows = answers if set(EDGE_OF) <= set(answers.columns) else refs.join(answers, "ref_id")
    rows = rows.join(unsent(target), "target")
    source = g.nodes.select(F.col("id").alias("from_node_id"), F.col("kind").alias("source_kind"))
    rows = rows.join(unsent(source), "from_node_id", "left")
    contract = ["interface", "protocol"]
    kind = (
        F.when(F.col("reference_kind") == "function_ref", "references")
        .when((F.col("reference_kind") == "extends") & F.col("target_kind").isin(contract)
              & ~F.coalesce(F.col("source_kind").isin(contract), F.lit(False)), "implements")
        .when((F.col("reference_kind") == "calls") & F.col("target_kind").isin("class", "struct"), "instantiates")
        .otherwise(F.col("reference_kind"))
    )
    note = F.map_concat(
        F.create_map(F.lit("confidence"), F.col("confidence").cast("string"), F.lit("resolvedBy"), F.col("resolved_by")),
        F.when(F.col("reference_kind") == "function_ref", F.create_map(F.lit("fnRef"), F.lit("true"))).otherwise(
            F.create_map().cast("map<string,string>")))
    return rows.select(
        F.col("from_node_id").alias("source"), "target", kind.alias("kind"), "line",
        (F.col("col") if "col" in rows.columns else F.lit(None).cast("int")).alias("col"),
        note.alias("metadata"), F.lit(None).cast("string").alias("provenance"))


def summary(answers: DataFrame) -> DataFrame:
    return answers.groupBy("resolved_by").agg(F.count("*").alias("n"))


def first_wins(edges: DataFrame, rank: str) -> DataFrame:
    """One edge per (source, target): the one of the lowest rank."""
    order = Window.partitionBy("source", "target").orderBy(rank)
    return edges.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")
