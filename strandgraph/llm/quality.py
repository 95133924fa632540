"""Quality rules by cross-document line frequency, in DataFrame functions only.

Base measures of each whole text are column expressions. A line's normal form (lower case, digits as
0, other runs of non-letters as one space) is hashed; per host the distinct documents holding it are
counted, copies of one text counting once. A line in more than `share` of its host's documents, and in
more than `least_docs`, is the host's boilerplate and is removed; a document that keeps fewer than
`min_words` words, or less than `min_left` of its own, is depleted and rejected.

Only hashes and counts are shuffled: (host, line, text) rows are made distinct on the map side first,
and a frequent line is a count, not a list.

Edge cases: a null text has no words; a null host is the host named ''; empty and short texts fail the
base rules (under 20 words); repeated rows each get the same verdict; an empty table gives no rows;
any other column is passed over.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from .lines import hide, without

_SPACE = " \t\n\x0b\f\r"
_SPACES = "[ \\t\\n\\x0B\\f\\r]+"
_SYMBOLS = "#*$%&|<>"
_WINDOW = 8


def text_words(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space."""
    return F.array_remove(F.split(text, _SPACES), "")


def normal_line(line: Column) -> Column:
    digits = F.regexp_replace(F.lower(line), "[0-9]+", "0")
    return F.trim(F.regexp_replace(digits, "[^\\p{L}0-9]+", " "))


def _windows(hashes: Column) -> Column:
    """Hash of each run of eight words."""
    last = F.size(hashes) - _WINDOW
    each = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[hashes[i + k] for k in range(_WINDOW)]))
    return F.when(last >= 0, each).otherwise(F.array().cast("array<bigint>"))


def base_measures(docs: DataFrame) -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    blank = lambda c: F.translate(c, _SPACE, "")
    out = docs.withColumn("_text", text)
    out = out.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda line: F.length(blank(line)) > 0))
    out = out.withColumn("_hashes", F.transform(text_words(F.col("_text")), lambda w: F.xxhash64(w)))
    out = out.withColumn("_runs", _windows(F.col("_hashes")))
    repeated = F.size(F.array_distinct("_runs")) < F.size("_runs")
    placed = F.array_sort(F.transform("_runs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("_sorted", F.when(repeated, placed))
    same = lambda e, at: F.coalesce(F.try_element_at(F.col("_sorted"), at)["h"] == e["h"], F.lit(False))
    twice = F.filter("_sorted", lambda e, i: ((i > 0) & same(e, F.greatest(i, F.lit(1)))) | same(e, i + 2))
    out = out.withColumn("_at", F.array_sort(F.transform(twice, lambda e: e["i"])))
    steps = F.transform("_at", lambda p, i: F.least(F.coalesce(F.try_element_at(F.col("_at"), i + 2) - p, F.lit(_WINDOW)), F.lit(_WINDOW)))
    out = out.withColumn("n_repeat_words", F.coalesce(F.aggregate(steps, F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long"))
    out = out.withColumn("n_words", F.size("_hashes").cast("long")).withColumn("word_chars", F.length(blank(F.col("_text"))).cast("long"))
    out = out.withColumn("n_symbols", (F.length("_text") - F.length(F.translate("_text", _SYMBOLS, ""))).cast("long"))
    out = out.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    return out.withColumn("base_failed", failed).drop("_text", "_lines", "_hashes", "_runs", "_sorted", "_at")


def _keyed(docs: DataFrame, host: str) -> DataFrame:
    """Adds the host and the identity of the text; a document is its text on its host."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"_host": F.coalesce(F.col(host), F.lit("")), "_k1": F.xxhash64(text), "_k2": F.hash(text)})


def host_lines(docs: DataFrame, host: str = "source") -> DataFrame:
    """Lines with words of each distinct text of a host: (_host, _k1, _k2, number, line hash, words)."""
    lines = _keyed(docs.select("text", host), host).select(
        "_host", "_k1", "_k2", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("number", "line"))
    lines = lines.select("_host", "_k1", "_k2", "number", F.xxhash64(normal_line(F.col("line"))).alias("line"), F.size(text_words(F.col("line"))).alias("words"))
    return lines.filter("words > 0").groupBy("_host", "_k1", "_k2", "number").agg(F.first("line").alias("line"), F.first("words").alias("words"))


def boilerplate(lines: DataFrame, share: float, least_docs: int) -> DataFrame:
    """(_host, line, n_docs): lines in more of a host's documents than the limits allow."""
    per_line = lines.select("_host", "line", "_k1", "_k2").distinct().groupBy("_host", "line").agg(F.count(F.lit(1)).alias("n_docs"))
    hosts = lines.select("_host", "_k1", "_k2").distinct().groupBy("_host").agg(F.count(F.lit(1)).alias("host_docs"))
    frequent = per_line.filter(F.col("n_docs") > least_docs).join(hosts, "_host")
    return frequent.filter(F.col("n_docs") > share * F.col("host_docs")).select("_host", "line", "n_docs")


def score(
    docs: DataFrame, host: str = "source", share: float = 0.05, least_docs: int = 10, min_words: int = 20, min_left: float = 0.5
) -> DataFrame:
    """`docs` without text, with the base measures, `n_removed_words` and `kept`; these replace columns of their names."""
    docs, (host,), back = hide(docs, host)
    lines = cut(host_lines(docs, host), "lines")
    removed = lines.join(boilerplate(lines, share, least_docs), ["_host", "line"]).groupBy("_host", "_k1", "_k2").agg(
        F.sum("words").alias("_removed"))
    measured = base_measures(_keyed(docs, host)).drop("text")
    out = measured.join(removed, ["_host", "_k1", "_k2"], "left").withColumn("n_removed_words", F.coalesce("_removed", F.lit(0)).cast("long"))
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (F.col("n_removed_words") > 0) & ((left < min_words) | (left < min_left * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted).drop("_host", "_k1", "_k2", "_removed").withColumnsRenamed(back)


def keep(
    docs: DataFrame, host: str = "source", share: float = 0.05, least_docs: int = 10, min_words: int = 20, min_left: float = 0.5
) -> DataFrame:
    """The documents that pass, whole rows; their boilerplate lines are removed from the text.

    Verdicts are written first, one row per text and host, so that no filter reaches into the measures.
    """
    docs, (host,), back = hide(docs, host)
    keys = ["_host", "_k1", "_k2"]
    lines = cut(host_lines(docs, host), "lines")
    gone = lines.join(boilerplate(lines, share, least_docs), ["_host", "line"]).groupBy(*keys).agg(
        F.sum("words").alias("_removed"), F.array_sort(F.collect_list("number")).alias("_gone"))
    measured = base_measures(_keyed(docs.select("text", host), host)).groupBy(*keys).agg(
        F.first("n_words").alias("_words"), F.first("base_failed").alias("_failed"))
    verdicts = cut(measured.join(gone, keys, "left"), "verdicts")
    left = F.col("_words") - F.col("_removed")
    depleted = F.coalesce((left < min_words) | (left < min_left * F.col("_words")), F.lit(False))
    out = _keyed(docs, host).join(verdicts.filter(~F.col("_failed") & ~depleted), keys)
    out = out.withColumn("_lines", F.when(F.col("_gone").isNotNull(), F.split("text", "\n")))
    text = F.array_join(without(F.col("_lines"), F.col("_gone")), "\n")
    return out.withColumn("text", F.when(F.col("_gone").isNotNull(), text).otherwise(F.col("text"))).select(docs.columns).withColumnsRenamed(back)
