"""Search over nodes: full text, substring, edit distance and the cascade.

A query is a handful of words, so matching is a filter over one scan with no shuffle except
the top-k at the end. Word statistics come from one aggregation that yields a single row.
For repeated queries, `SearchIndex` holds postings sorted by term, of which a query reads
only the row groups around its words; `segments.SegmentedIndex` keeps one in shared storage.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.paths import is_generated_file
from ..graph import Graph
from ..lineage import cut, cut_measured, union_all
from ..schema import any_kind

# Full-text columns with their weights, and the BM25 constants.
COLUMNS = [("id", 0.0), ("name", 20.0), ("qualified_name", 5.0), ("docstring", 1.0), ("signature", 2.0)]
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
_SLICE = 1 << 20  # words grouped at a time


def _kept(kinds, languages) -> Column:
    return any_kind("kind", kinds) & any_kind("language", languages)


def _idf(total: int, hits: int) -> float:
    import math
    value = math.log((total - hits + 0.5) / (hits + 0.5))
    return value if value > 0 else LEAST_IDF


def _bm25(tf: Column, length: Column, average: float, idf: float) -> Column:
    return F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(average)))


def fts(nodes: DataFrame, text: str, kinds=None, languages=None, ids_only: bool = False) -> DataFrame:
    """BM25 full-text matches with prefix terms: node columns plus `score`.

    One scan reads the texts: it counts tokens and words over all rows and writes the counts of
    the matching ones. Every match is scored; the caller ranks them.
    """
    phrases = T.fts_phrases(text)
    empty = nodes.withColumn("score", F.lit(0.0)).limit(0)
    empty = empty.select("id", "score") if ids_only else empty
    if not phrases:
        return empty
    # One projection folds each column once; the second reads it for every phrase.
    folded = nodes.select("id", "kind", "language", *[T.fold(c).alias(f"_f_{c}") for c, _ in COLUMNS])
    length = sum((T.token_count(F.col(f"_f_{c}")) for c, _ in COLUMNS), F.lit(0))
    each = range(len(phrases))
    counts = folded.select(
        "id", "kind", "language", length.alias("_len"),
        *[F.array(*[T.phrase_hits(F.col(f"_f_{c}"), p) for c, _ in COLUMNS]).alias(f"_h{i}") for i, p in enumerate(phrases)])
    weights = F.array(*[F.lit(w) for _, w in COLUMNS])

    def total(arr: Column, zero: Column) -> Column:
        return F.aggregate(arr, zero, lambda a, x: a + x)

    feats = counts.select(
        "id", "kind", "language", "_len",
        *[total(F.zip_with(f"_h{i}", weights, lambda h, w: h * w), F.lit(0.0)).alias(f"_tf{i}") for i in each],
        *[total(F.col(f"_h{i}"), F.lit(0)).alias(f"_any{i}") for i in each])
    matched = F.lit(False)
    for i in each:
        matched = matched | (F.col(f"_any{i}") > 0)
    measures = {"n": F.count(F.lit(1)), "len": F.sum("_len"),
                **{f"h{i}": F.sum((F.col(f"_any{i}") > 0).cast("long")) for i in each}}
    hits, stat = cut_measured(feats, measures, matched, "fts")
    if not stat["n"]:
        return empty
    average = stat["len"] / stat["n"]
    score = sum((_bm25(F.col(f"_tf{i}"), F.col("_len"), average, _idf(stat["n"], stat[f"h{i}"])) for i in each), F.lit(0.0))
    ranked = hits.filter(_kept(kinds, languages)).select("id", score.alias("score"))
    return ranked if ids_only else nodes.join(ranked, "id").select(*nodes.columns, "score")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of rows (id, len, col, own): each word of a row once, with its places, `_SLICE` words at a time."""
    for batch in batches:
        ends, start = np.cumsum(pc.list_value_length(batch.column("own")).to_numpy(zero_copy_only=False)), 0
        while start < len(ends):
            done = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + _SLICE, "right")))
            part, start = batch.slice(start, stop - start), stop
            count = pc.list_value_length(part.column("own")).to_numpy(zero_copy_only=False)
            spelled = pc.list_flatten(part.column("own")).dictionary_encode()
            codes, row = spelled.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(count)), count)
            place = np.arange(len(codes)) - np.repeat(np.cumsum(count) - count, count)
            key = row * max(len(spelled.dictionary), 1) + codes
            order = np.argsort(key, kind="stable")  # places stay in order
            first = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])[: len(order)])
            at = pa.array(row[order][first])
            pos = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), pa.array(place[order], pa.int32()))
            term = spelled.dictionary.take(pa.array(codes[order][first]))
            yield pa.RecordBatch.from_arrays([term, part.column("id").take(at), part.column("col").take(at), part.column("len").take(at), pos],
                                             ["term", "id", "col", "len", "pos"])


@dataclass
class SearchIndex:
    """Postings (term, id, col, len, pos), where len is the node's token count, and the totals of the corpus.
    A query reads the postings of its words and nothing else."""

    postings: DataFrame
    total: int
    length: int

    @staticmethod
    def words(nodes: DataFrame) -> DataFrame:
        """(id, len, words): the words of each column, and the number of all of them."""
        none = F.array().cast("array<string>")
        each = F.array(*[F.coalesce(F.regexp_extract_all(T.fold(c), F.lit(f"({T.TOKEN}+)"), 1), none) for c, _ in COLUMNS])
        count = F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.size(w))
        return nodes.select("id", each.alias("words")).select("id", count.alias("len"), "words")

    @staticmethod
    def sorted_postings(words: DataFrame) -> DataFrame:
        """Positions are grouped within each row before anything moves, then dealt by ranges of (term, id) and sorted."""
        columns = words.select("id", "len", F.posexplode("words").alias("col", "own")).filter(F.size("own") > 0)
        return columns.mapInArrow(_grouped, "term string, id string, col int, len long, pos array<int>").repartitionByRange(
            "term", "id").sortWithinPartitions("term")

    @classmethod
    def build(cls, nodes: DataFrame) -> "SearchIndex":
        words = cut(cls.words(nodes), "tokens")
        size = words.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("len")).first()
        return cls(cut(cls.sorted_postings(words), "postings"), size.n, size.len)

    def _term(self, token: str, prefix: bool) -> DataFrame:
        term = F.col("term")
        if prefix:  # a range on the sorted column, so row-group statistics skip the rest
            return self.postings.filter((term >= token) & (term < token + "\U0010ffff"))
        return self.postings.filter(term == token)

    def _phrase(self, tokens: list[str]) -> DataFrame:
        """(id, col, len, hits) of one phrase; consecutive words are joined on their position."""
        last = len(tokens) - 1
        at = None
        for i, token in enumerate(tokens):
            here = self._term(token, i == last).select("id", "col", "len", F.explode("pos").alias("p"))
            here = here.select("id", "col", "len", (F.col("p") - i).alias("p"))
            at = here if at is None else at.join(here.drop("len"), ["id", "col", "p"])
        return at.groupBy("id", "col", "len").agg(F.count("*").alias("hits"))

    def search(self, text: str) -> DataFrame:
        """(id, score) of all matches."""
        phrases = T.fts_phrases(text)
        if not phrases or not self.total:
            return self.postings.select("id", F.lit(0.0).alias("score")).limit(0)
        weight = F.element_at(F.array(*[F.lit(w) for _, w in COLUMNS]), F.col("col") + 1)
        parts = []
        for phrase in phrases:
            tf = cut(self._phrase(phrase).groupBy("id", "len").agg(F.sum(weight * F.col("hits")).alias("tf")), "tf")
            idf = _idf(self.total, tf.count())
            parts.append(tf.select("id", _bm25(F.col("tf"), F.col("len"), self.length / self.total, idf).alias("s")))
        return union_all(parts).groupBy("id").agg(F.sum("s").alias("score"))


def like(nodes: DataFrame, text: str, kinds=None, languages=None, limit: int | None = 100, offset: int = 0) -> DataFrame:
    """Substring matches; `%` and `_` in the text act as wildcards."""
    pattern = text.replace("\\", "\\\\")
    name, qn = F.col("name"), F.col("qualified_name")
    inside = f"%{pattern}%"
    score = (F.when(name == text, 1.0).when(name.ilike(f"{pattern}%"), 0.9).when(name.ilike(inside), 0.8)
             .when(qn.ilike(inside), 0.7).otherwise(0.5))
    hits = nodes.filter((name.ilike(inside) | qn.ilike(inside)) & _kept(kinds, languages))
    hits = hits.withColumn("score", score)
    return hits if limit is None else hits.orderBy(F.desc("score"), F.length("name"), "id").offset(offset).limit(limit)


def fuzzy(nodes: DataFrame, text: str, kinds=None, languages=None, limit: int | None = 100) -> DataFrame:
    """Nodes with names within edit distance 1 (up to four letters) or 2, nearest first."""
    query = text.lower()
    reach = 1 if len(query) <= 4 else 2
    dist = F.levenshtein(F.lower("name"), F.lit(query), reach)
    near = nodes.filter((F.abs(F.length("name") - len(query)) <= reach) & _kept(kinds, languages)).withColumn("_d", dist).filter("_d >= 0")
    near = near.select(*nodes.columns, (1 / (1 + F.col("_d"))).alias("score"))
    return near if limit is None else near.orderBy(F.desc("score"), "name", "id").limit(limit)


def by_filters(nodes: DataFrame, kinds=None, languages=None, limit: int | None = 500) -> DataFrame:
    found = nodes.filter(_kept(kinds, languages)).withColumn("score", F.lit(1.0))
    return found if limit is None else found.orderBy("name", "id").limit(limit)


def rescored(results: DataFrame, query: str, project: set[str] = frozenset()) -> DataFrame:
    bonus = T.kind_bonus() + T.path_relevance("file_path", query, project) + T.name_bonus("name", query)
    return results.withColumn("score", F.col("score") + bonus)


_SLIM = ["id", "kind", "language", "name", "file_path"]


def _candidates(nodes: DataFrame, text: str, kinds, languages, index: "SearchIndex | None" = None) -> DataFrame:
    """All matches of the first of the three searches that has any: what ranking reads of a node, and `score`.
    With an index only the postings of the query's words are read for the first."""
    slim = nodes.select(_SLIM)
    if not text:
        return by_filters(slim, kinds, languages, None)
    if index is None:
        found = slim.join(fts(nodes, text, kinds, languages, ids_only=True), "id")
    else:
        found = slim.filter(_kept(kinds, languages)).join(index.search(text), "id")
    found = cut(found.select(*_SLIM, "score"), "fts")
    if found.isEmpty() and len(text) >= 2:
        found = cut(like(nodes.select(*_SLIM, "qualified_name"), text, kinds, languages, None).select(*_SLIM, "score"), "like")
    if found.isEmpty() and len(text) >= 3:
        found = cut(fuzzy(slim, text, kinds, languages, None), "fuzzy")
    return found


def search(g: Graph, query: str, kinds=None, languages=None, limit: int = 100, offset: int = 0,
           project: set[str] = frozenset(), strict_filters: bool = False, index: "SearchIndex | None" = None) -> DataFrame:
    """The search cascade: full text, then substring, then fuzzy; every match is rescored, and the top `limit`
    (behind `offset`) are fetched whole.

    Kinds and languages named in the query add to those in the arguments. `path:` and `name:`
    filters act on the ranked rows, after the limit; `strict_filters` applies them first. `index` answers the
    full-text search from its postings instead of a scan; it must cover the graph's nodes.
    """
    parsed = T.parse_query(query)
    kinds = list(dict.fromkeys((kinds or []) + parsed.kinds)) if parsed.kinds else kinds
    languages = list(dict.fromkeys((languages or []) + parsed.languages)) if parsed.languages else languages

    def hard(df: DataFrame) -> DataFrame:
        for column, wanted in (("file_path", parsed.paths), ("name", parsed.names)):
            if wanted:
                df = df.filter(T._has_any(F.lower(column), [w.lower() for w in wanted]))
        return df

    nodes = hard(g.nodes) if strict_filters else g.nodes
    found = _candidates(nodes, parsed.text, kinds, languages, index)
    words = list(dict.fromkeys(w.lower() for w in query.split() if len(w) >= 2))
    if words:
        # Exact names always compete, with the best score, if the search itself did not find them.
        exact = nodes.filter(F.lower("name").isin(words) & _kept(kinds, languages)).select(*_SLIM, F.lit(None).cast("double").alias("score"))
        best = F.broadcast(found.agg(F.max("score").alias("_best")).filter("_best is not null"))  # one row or none
        extra = exact.join(found.select("id"), "id", "left_anti").crossJoin(best)
        found = found.unionByName(extra.select(*_SLIM, F.col("_best").cast("double").alias("score")))
    top = rescored(found, parsed.text or query, project).orderBy(F.desc("score"), "id").offset(offset).limit(limit).select("id", "score")
    whole = nodes.join(F.broadcast(top), "id").select(*nodes.columns, "score")  # `limit` rows
    return hard(whole).orderBy(F.desc("score"), "id")


def exact_names(nodes: DataFrame, names: list[str], kinds=None, languages=None, limit: int | None = 50) -> DataFrame:
    """Exact (case-folded) names; those in files of rarely used names among them score 20 more. Of a name
    all rows are scored; with a limit its best ones stay, a like number for each name."""
    lowered = list(dict.fromkeys(n.lower() for n in names))
    hits = nodes.filter(F.lower("name").isin(lowered)).withColumn("_n", F.lower("name"))
    of_kind = hits.filter(any_kind("kind", kinds))
    files = of_kind.select("_n", "file_path").distinct()
    rare = files.groupBy("_n").agg(F.count("*").alias("k")).filter("k < 10").select("_n")
    near = files.join(rare, "_n", "left_semi").select("file_path").distinct().withColumn("_near", F.lit(20.0))
    rows = of_kind.filter(any_kind("language", languages)).join(near, "file_path", "left")
    rows = rows.withColumn("score", 1.0 + F.coalesce("_near", F.lit(0.0)))
    if limit is None:
        return rows.select(*nodes.columns, "score")
    per_name = max(8, -(-limit // len(names)))
    best = Window.partitionBy("_n").orderBy(F.desc("score"), "id")
    rows = rows.withColumn("_rn", F.row_number().over(best)).filter(F.col("_rn") <= per_name)
    return rows.select(*nodes.columns, "score").orderBy(F.desc("score"), "id").limit(limit)


def name_substring(nodes: DataFrame, part: str, kinds=None, languages=None, limit: int | None = 30,
                   exclude_prefix: bool = False) -> DataFrame:
    """Names containing a part, shortest first."""
    pattern = part.replace("\\", "\\\\")
    hits = nodes.filter(F.col("name").ilike(f"%{pattern}%") & _kept(kinds, languages))
    if exclude_prefix:
        hits = hits.filter(~F.col("name").ilike(f"{pattern}%"))
    hits = hits.withColumn("score", F.lit(1.0))
    return hits if limit is None else hits.orderBy(F.length("name"), "id").limit(limit)


def symbol_matches(g: Graph, symbol: str, index: SearchIndex | None = None) -> DataFrame:
    """All definitions a symbol may mean, generated files last."""
    qualified = re.search(r"[./]|::", symbol)
    if not qualified:
        exact = cut(g.nodes.filter(F.col("name") == symbol), "symbol")
        if not exact.isEmpty():
            return exact.orderBy(is_generated_file("file_path"), "id")
        return search(g, symbol, limit=10, index=index).orderBy(F.desc("score"), "id").limit(1).drop("score")
    found = cut(search(g, symbol, limit=50, index=index), "symbol")
    if found.isEmpty():
        tail = [p for p in re.split(r"::|[./]", symbol) if p][-1:]
        if tail and tail[0] != symbol:
            found = cut(search(g, tail[0], limit=50, index=index), "symbol")
    return found.filter(T.matches_symbol(symbol)).orderBy(
        is_generated_file("file_path"), F.desc("score"), "id").drop("score")


def definitions(nodes: DataFrame, file: str | None = None) -> DataFrame:
    """Same-named nodes with the key of the definition they belong to; `file` narrows if it can."""
    if file:
        wanted = file.removeprefix("./")
        narrowed = cut(nodes.filter((F.col("file_path") == wanted) | F.col("file_path").endswith(f"/{wanted.removeprefix('/')}")), "narrowed")
        if not narrowed.isEmpty():
            nodes = narrowed
    return nodes.withColumn("definition", F.concat_ws("|", "file_path", "qualified_name"))
