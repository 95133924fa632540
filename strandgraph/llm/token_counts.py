"""Token counts from an exact length histogram.

Documents shrink to their encoded length where they are read; only (length, count) pairs are
shuffled. Suffix sums over the histogram then answer, for every context limit at once, how many
documents are longer, how many tokens a cut at the limit keeps, and any quantile of the lengths.

Edge cases: a null or empty text has length 0 and counts as a document; repeated rows count as
often as they occur; an empty table gives an empty histogram. Other columns are never read.
"""

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut

_ENCODINGS: dict[str, object] = {}
_SPAN = 1024


def _encoding(path: str, pattern: str):
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        _ENCODINGS[path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def encoded_lengths(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """One row (`length`) per document: the number of its ids under a byte-pair rank file."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(ranks_path, pattern)
        for batch in batches:
            counts = [len(encoding.encode_ordinary(t.as_py())) if t.is_valid else 0 for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(counts, pa.int64())], ["length"])

    return docs.select("text").mapInArrow(lengths, "length long")


def histogram(lengths: DataFrame) -> DataFrame:
    """(`length`, `n_docs`): counted on the map side first and written, so that texts are encoded once."""
    return cut(lengths.groupBy("length").agg(F.count(F.lit(1)).alias("n_docs")), "lengths")


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length that occurs: what is longer, and what a cut at that length keeps.

    The sums run within spans of 1,024 lengths; a table of span totals, whose size depends on the
    longest document only, carries them over. For a limit c between two rows, take the row with
    the largest length at most c: kept(c) = tokens_kept + (c - length) * docs_longer.
    """
    spans = hist.withColumn("span", F.floor(F.col("length") / _SPAN))
    totals = spans.groupBy("span").agg(
        F.sum("n_docs").alias("span_docs"), F.sum(F.col("n_docs") * F.col("length")).alias("span_tokens"))
    everything, above = Window.partitionBy(F.lit(0)), Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        "span", F.coalesce(F.sum("span_docs").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("span_tokens").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("span_docs").over(everything).alias("total_docs"), F.sum("span_tokens").over(everything).alias("total_tokens"))
    within = Window.partitionBy("span").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    longer = F.col("docs_above") + F.coalesce(F.sum("n_docs").over(within), F.lit(0))
    tokens = F.col("tokens_above") + F.coalesce(F.sum(F.col("n_docs") * F.col("length")).over(within), F.lit(0))
    return spans.join(carried, "span").select(
        "length", "n_docs", longer.alias("docs_longer"), tokens.alias("tokens_longer"), "total_docs", "total_tokens"
    ).withColumn("tokens_kept", F.col("total_tokens") - F.col("tokens_longer") + F.col("docs_longer") * F.col("length"))


def kept_at(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(`context`, `docs_cut`, `tokens_kept`) for context limits given by the caller."""
    rows = sums.sparkSession.createDataFrame([(c,) for c in limits], "context long")
    at = F.max_by(F.struct("length", "docs_longer", "tokens_kept"), F.col("length"))
    best = sums.join(F.broadcast(rows), F.col("length") <= F.col("context")).groupBy("context").agg(at.alias("at"))
    docs = F.broadcast(sums.agg(F.coalesce(F.max("total_docs"), F.lit(0)).alias("docs")))
    return rows.join(F.broadcast(best), "context", "left").join(docs, F.lit(True)).select(
        "context", F.coalesce("at.docs_longer", "docs").alias("docs_cut"),
        F.coalesce(F.col("at.tokens_kept") + (F.col("context") - F.col("at.length")) * F.col("at.docs_longer"),
                   F.col("context") * F.col("docs")).alias("tokens_kept"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(`share`, `length`): the least length that at least this share of the documents do not exceed."""
    rows = sums.sparkSession.createDataFrame([(float(s),) for s in shares], "share double")
    enough = (F.col("total_docs") - F.col("docs_longer")) >= F.ceil(F.col("share") * F.col("total_docs"))
    return sums.join(F.broadcast(rows), enough).groupBy("share").agg(F.min("length").alias("length"))
