"""Toxicity by multiple-instance learning: a document is a bag of sentences.

A sentence's score is a logistic function of its features; a document's is the noisy-or of its sentences,
p = 1 - prod(1 - p_s), so document labels teach which sentences offend. The model is fitted on about
`max_docs` labelled documents at most, picked by a hash of the key: the documented bound on what is
broadcast and reaches the driver. Features are lower-case words and their first five letters; those worth
weighing are chosen by counts of documents holding them, per label, and weighed by gradient steps.
Scoring streams every whole text through the workers.

Edge cases: a null or empty text has no sentences, hence score 0; labels that are null or whose document
is missing teach nothing, a repeated label row teaches once; without both labels the model has no features
and every score is 0; an empty table gives no rows. Only `text` (and the label) is ever a model input.
"""

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from .word_bpe import slices

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_STEM = 5
_SLICE = 8 << 20


def sentences(text: str) -> Iterator[tuple[int, int, set[str]]]:
    """Spans of the sentences with a word, and their features."""
    for found in _SENTENCE.finditer(text):
        words = set(_WORD.findall(found[0].lower()))
        if words:
            yield *found.span(), words | {w[:_STEM] + "*" for w in words if len(w) > _STEM}


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", max_docs: int = 20_000) -> DataFrame:
    """(text, label) of about `max_docs` labelled documents at most, none of them held out (crc32 of the key as
    text mod 5 is not 0). Labels are picked by a hash of the key, so the side that is broadcast is bounded."""
    usable = labels.filter(F.col(label).isNotNull() & (F.pmod(F.crc32(F.col(key).cast("string")), F.lit(5)) != 0))
    known = usable.groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("int").alias("_label"))
    share = min(1.0, max_docs / max(known.count(), 1))
    picked = known.filter(F.pmod(F.xxhash64("_key"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = docs.select(F.col(key).alias("_key"), "text").join(F.broadcast(picked), "_key")
    return cut(rows.select(F.coalesce("text", F.lit("")).alias("text"), F.col("_label").alias("label")), "labelled")


def feature_counts(rows: DataFrame) -> DataFrame:
    """(feature, pos, neg): documents of each label that hold the feature, over all rows."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for f in set().union(*(own for _, _, own in sentences(text))):
                    counts.setdefault(f, [0, 0])[label == 1] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(counts, pa.string()), pa.array([c[1] for c in counts.values()], pa.int64()),
                 pa.array([c[0] for c in counts.values()], pa.int64())], ["feature", "pos", "neg"])

    return rows.mapInArrow(held, "feature string, pos long, neg long").groupBy("feature").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def choose_features(rows: DataFrame, max_features: int) -> list[str]:
    """The features that tell the labels apart best, by log-likelihood ratio."""
    totals = rows.agg(F.coalesce(F.sum("label"), F.lit(0)).alias("pos"), F.count(F.lit(1)).alias("n")).first()
    pos, neg = float(totals.pos), float(totals.n - totals.pos)
    if not pos or not neg:
        return []
    seen, share = F.col("pos") + F.col("neg"), pos / (pos + neg)
    part = lambda x, m: F.when(x > 0, x * F.log(x / m)).otherwise(0.0)
    gain = part(F.col("pos"), seen * share) + part(F.col("neg"), seen * (1 - share))
    best = feature_counts(rows).filter(F.col("pos") + F.col("neg") >= 2).withColumn("gain", gain).filter("gain > 5")
    chosen = best.orderBy(F.desc("gain"), "feature").limit(max_features).select("feature")
    return [r.feature for r in chosen.collect()]


class Model:
    """Weights of the chosen features and the bias of a sentence."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias, self.names = weights, bias, weights.keys()

    def sentence_scores(self, text: str) -> Iterator[tuple[int, int, float]]:
        for a, b, own in sentences(text):
            z = self.bias + sum(self.weights[f] for f in own & self.names)
            yield a, b, 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def score(self, text: str) -> float:
        none = 1.0
        for _, _, p in self.sentence_scores(text) if self.weights else ():
            none *= 1 - p
        return 1 - none


def _bags(rows: DataFrame, names: list[str]) -> list:
    """Label, number of sentences without a chosen feature, and (sentence, feature) pairs of the others."""
    index = {n: i for i, n in enumerate(names)}

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = [[index[f] for f in found if f in index] for _, _, found in sentences(text)]
                full = [x for x in own if x]
                pairs = [(i, f) for i, x in enumerate(full) for f in x]
                out.append((label, len(own) - len(full), len(full), np.array(pairs, np.int32).tobytes()))
            cols = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c, pa.int32()) for c in cols[:3]], pa.array(cols[3], pa.binary())], ["label", "plain", "full", "pairs"])

    return rows.mapInArrow(shrink, "label int, plain int, full int, pairs binary").collect()


def fit(rows: DataFrame, max_features: int = 5_000, steps: int = 300, rate: float = 0.3, decay: float = 1e-4) -> Model:
    """Noisy-or weights by full-batch gradient ascent (Adam) on `training_rows`."""
    names = choose_features(rows, max_features)
    bags = _bags(rows, names) if names else []
    if not bags:
        return Model({}, 0.0)
    y, plain = np.array([r.label == 1 for r in bags], float), np.array([r.plain for r in bags], float)
    full = np.array([r.full for r in bags], np.int64)
    pairs = np.concatenate([np.frombuffer(r.pairs, np.int32).reshape(-1, 2) + [base, 0] for r, base in zip(bags, np.cumsum(full) - full)])
    sent, feat, doc_of, total = pairs[:, 0], pairs[:, 1], np.repeat(np.arange(len(bags)), full), int(full.sum())
    w = np.append(np.zeros(len(names)), -6.0)
    m, v = np.zeros_like(w), np.zeros_like(w)
    balance = np.where(y == 1, len(y) / (2 * max(y.sum(), 1)), len(y) / (2 * max((1 - y).sum(), 1)))
    logistic = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, steps + 1):
        p, p0 = logistic(np.bincount(sent, w[feat], total) + w[-1]), logistic(w[-1])
        none = np.exp(np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-12)), len(bags)) + plain * np.log1p(-p0))
        # d log-likelihood / d z_s = p_s * none / (1 - none) for a positive document, -p_s for a negative one
        per_doc = balance * np.where(y == 1, none / np.maximum(1 - none, 1e-12), -1.0)
        g = per_doc[doc_of] * p
        grad = np.append(np.bincount(feat, g[sent], len(names)), g.sum() + (per_doc * plain).sum() * p0) / len(y)
        grad[:-1] -= decay * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(dict(zip(names, w[:-1].tolist())), float(w[-1]))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with `score`; a column of that name is replaced."""
    kept = [c for c in docs.columns if c != "score"]
    at = kept.index("text")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                scores = [model.score(t.as_py() or "") for t in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], [*kept, "score"])

    schema = docs.select(kept).schema.add("score", "double")
    return docs.select(kept).mapInArrow(scored, schema)


def offending_sentences(docs: DataFrame, model: Model, key: str = "doc_id", least: float = 0.5) -> DataFrame:
    """(key, start, stop, score, sentence): code-point spans of sentences whose own score is `least` or more."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(k, a, b, s, t[a:b]) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t
                   for a, b, s in (model.sentence_scores(t) if model.weights else ()) if s >= least]
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], batch.column(0).type), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                 pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.string())], [key, "start", "stop", "score", "sentence"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(found, f"`{key}` {kind}, start long, stop long, score double, sentence string")
