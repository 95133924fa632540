"""Ranked lexical search by NRA: sequential reads of impact-sorted lists, no random access.

1. One pass over the texts keeps, for each document, its number of terms and the counts of those terms that
   some query asks for; it is written once. Corpus figures (documents, terms, documents per term) cover all rows.
2. A run of documents (at most `SHARD_DOCS`, and about `SHARD_POSTINGS` postings) is a shard. Its lists are
   sorted by impact, the part of a score that one occurrence of the query term adds.
3. For a query, the lists of its terms are read from the top, all to the same depth, which doubles. A document
   seen has a lower score (impacts read) and an upper one (plus, for each list it was not met in, the impact
   next in that list); an unseen one has the sum of these next impacts as upper score. Reading goes on until
   no unseen document can reach the k-th lower score and every document that can, ties included, has equal
   bounds. Once no new document can enter, lists that no such document still needs are read no further.
4. Shards of one task share the k-th score found so far; k rows a query leave a task, and one window that keeps
   k rows before its shuffle merges them.

Terms are maximal runs of ASCII letters and digits and characters beyond ASCII, A-Z in lower case. Weights:
floor(1000 ln((2N + 2) / (2 df + 1))), in doubles; the rest is integer. Queries are split into blocks of about
`BLOCK_TERMS` terms, each a search of its own, so what travels with the tasks is bounded.

Edge cases: a null text has no terms, and a document without terms counts nowhere; a query without terms, or
whose terms are nowhere, has no rows; equal rows of the queries are one query; repeated documents are ranked
one by one; equal scores go by ascending key, null keys last; an empty table gives no rows. Only keys and texts
are read.
"""

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..lineage import cut, union_all

SHARD_DOCS, SHARD_POSTINGS = 16_384, 1_000_000
BLOCK_TERMS = 200_000
FIRST_DEPTH = 64
_SPACED = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SPAN = 1 << 20


def term_counts(text: bytes) -> tuple[int, Counter]:
    """Number of terms and count of each, in spans of 1 MB, so that a long text is never one long list."""
    total, counts, start = 0, Counter(), 0
    spaced = text.translate(_SPACED)
    while start < len(spaced):
        stop = spaced.find(b" ", start + _SPAN) if start + _SPAN < len(spaced) else -1
        stop = len(spaced) if stop < 0 else stop
        words = spaced[start:stop].split()
        total += len(words)
        counts.update(words)
        start = stop
    return total, counts


def _raw(texts: pa.Array) -> Iterator[bytes]:
    for value in pc.fill_null(texts, "").cast(pa.large_binary()):
        yield value.as_py()


def postings(docs: DataFrame, vocabulary: dict[bytes, int], key: str) -> DataFrame:
    """(`key`, `n`, `terms`, `counts`) of documents with a term: n counts all terms, the lists those asked for."""
    wanted = vocabulary.keys()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, n, terms, counts = [], [], [], []
            for i, text in enumerate(_raw(batch.column(1))):
                total, own = term_counts(text)
                if total:
                    some = own.keys() & wanted
                    rows.append(i)
                    n.append(total)
                    terms.append([vocabulary[t] for t in some])
                    counts.append([own[t] for t in some])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))],
                [key, "n", "terms", "counts"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(counted, f"`{key}` {kind}, n long, terms array<int>, counts array<long>")


class Shard:
    """Impact-sorted lists of one run of documents."""

    def __init__(self, n: np.ndarray, owner: np.ndarray, terms: np.ndarray, counts: np.ndarray, weights: np.ndarray, documents: int, length: int):
        m = 25 + (75 * n * documents) // length
        impact = weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 8 * m[owner]))
        order = np.lexsort((owner, -impact, terms))
        self.size, self.docs, self.impacts = len(n), owner[order], impact[order]
        self.starts = np.searchsorted(terms[order], np.arange(len(weights) + 1))

    def search(self, query: list[tuple[int, int]], k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) that may be among the `k` best with a score of `floor` or more, fully resolved."""
        lists = [(self.starts[t], self.starts[t + 1], times) for t, times in query if self.starts[t] < self.starts[t + 1]]
        lower, read, depth = np.zeros(self.size, np.int64), [a for a, _, _ in lists], FIRST_DEPTH
        needed, closed = np.ones(len(lists), bool), False
        while True:
            for j, (start, stop, times) in enumerate(lists):
                until = min(stop, start + depth)
                if needed[j] and read[j] < until:
                    lower[self.docs[read[j] : until]] += self.impacts[read[j] : until] * times
                    read[j] = until
            ahead = np.array([self.impacts[r] * times if r < stop else 0 for r, (_, stop, times) in zip(read, lists)], np.int64)
            unseen = int(ahead.sum())
            kth = int(np.partition(lower, self.size - k)[self.size - k]) if self.size >= k else 0
            least = max(kth, floor, 1)
            met = np.zeros(self.size, np.int64)
            for (start, _, _), r, f in zip(lists, read, ahead.tolist()):
                if f:
                    met[self.docs[start:r]] += f
            closed = closed or unseen < least
            open_ = (lower + (unseen - met) >= least) & ((lower > 0) | (not closed))
            if closed:
                unresolved = open_ & (met < unseen)
                if not unresolved.any():
                    found = np.flatnonzero(open_ & (lower >= least))
                    return found, lower[found]
                needed = np.array([f > 0 and self._lacks(unresolved, start, r) for (start, _, _), r, f in zip(lists, read, ahead.tolist())])
            depth *= 2

    def _lacks(self, wanted: np.ndarray, start: int, read: int) -> bool:
        """Whether some wanted document was not met in the part of the list read so far."""
        return int(wanted[self.docs[start:read]].sum()) < int(wanted.sum())


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of documents: keys, lengths, and for each posting its document in the run, its term and count."""
    held, size, entries = [], 0, 0
    for batch in batches:
        for part in (batch.slice(i, 1_024) for i in range(0, batch.num_rows, 1_024)):
            held.append(part)
            size, entries = size + part.num_rows, entries + len(part.column(2).flatten())
            if size >= SHARD_DOCS or entries >= SHARD_POSTINGS:
                yield _run(held)
                held, size, entries = [], 0, 0
    if held:
        yield _run(held)


def _run(parts: list[pa.RecordBatch]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    table = pa.Table.from_batches(parts).combine_chunks()
    column = lambda i: table.column(i).combine_chunks()
    lists, counts = column(2), column(3)
    owner = np.repeat(np.arange(table.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    return column(0), column(1).to_numpy(), owner, lists.flatten().to_numpy(), counts.flatten().to_numpy()


def _search_block(docs: DataFrame, queries: list[tuple[object, Counter]], k: int, key: str, item: str, item_kind: str) -> DataFrame:
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, own in queries for t in own}))}
    table = cut(postings(docs, vocabulary, key), "postings")
    size = table.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    weights = np.zeros(len(vocabulary), np.int64)
    for r in table.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most the terms of a block
        weights[r.t] = math.floor(1000 * math.log((2 * size.docs + 2) / (2 * r["count"] + 1)))
    asked = [sorted((vocabulary[t], times) for t, times in own.items() if weights[vocabulary[t]] > 0) for _, own in queries]
    documents, length = int(size.docs), int(size.terms)
    kind = docs.schema[key].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in asked]  # (-score, key is null, key)
        for keys, n, owner, terms, counts in _shards(batches):
            shard = Shard(n, owner, terms, counts, weights, documents, length)
            for own, query in zip(best, asked):
                found, scores = shard.search(query, k, -own[k - 1][0] if len(own) == k else 0)
                if len(found):
                    names = keys.take(pa.array(found)).to_pylist()
                    merged = own + [(-s, x is None, 0 if x is None else x) for s, x in zip(scores.tolist(), names)]
                    own[:] = sorted(merged)[:k]
        rows = [(q, None if none else x, -s) for q, own in enumerate(best) for s, none, x in own]
        cols = list(zip(*rows)) if rows else [()] * 3
        yield pa.RecordBatch.from_pydict(
            {"query": pa.array(cols[0], pa.int32()), key: pa.array(cols[1], types[key]), "score": pa.array(cols[2], pa.int64())})

    types = {key: to_arrow_type(docs.schema[key].dataType)}
    found = table.mapInArrow(search, f"query int, `{key}` {kind}, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col(key).isNull(), key)
    top = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = docs.sparkSession.createDataFrame([(i, x) for i, (x, _) in enumerate(queries)], f"query int, `{item}` {item_kind}")
    return top.join(F.broadcast(names), "query").select(item, "rank", key, "score")  # names: the queries of a block


def search(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """(`item`, `rank`, `key`, `score`): the `k` best documents for the text of each row of `items`."""
    asked = cut(items.filter(F.length("text") > 0).select(item, "text").distinct(), "queries")
    terms = int(asked.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]) // 4
    blocks = terms // BLOCK_TERMS + 1
    numbered = asked.withColumn("block", F.pmod(F.xxhash64(item, "text"), F.lit(blocks)))
    found, kind = [], items.schema[item].dataType.simpleString()
    for block in range(blocks):
        rows = numbered.filter(F.col("block") == block).collect()  # bounded by the size of a block
        queries = [(r[item], own) for r in rows for own in [term_counts(r.text.encode())[1]] if own]
        if queries:
            found.append(_search_block(docs, queries, k, key, item, kind))
    if not found:
        return docs.select(key).limit(0).select(
            F.lit(None).cast(kind).alias(item), F.lit(0).alias("rank"), key, F.lit(0).cast("long").alias("score"))
    return union_all(found)
