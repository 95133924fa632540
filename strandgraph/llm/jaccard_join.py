"""Jaccard join on word n-grams with Bayesian pruning of candidates.

1. Every text becomes a MinHash signature of its five-word shingles (hashes of 64 bits, signature values of
   16). Texts with the same words are one class, so copies never meet.
2. Classes that agree in a band of the signature are candidates (28 bands of 5: a pair at the threshold is
   missed with probability 2e-5). A bucket is cut into blocks of at most some 256 and its pairs of blocks are the
   units of work, so that no bucket is one group. A pair counts in the first band it agrees in only.
3. The signature values of a pair are compared 20 at a time. After each step the posterior probability
   that its similarity reaches the threshold, under a uniform prior, is P(Binomial(n + 1, t) <= m) for m
   agreements of n; below `tolerance` the pair is dropped.
4. Survivors are verified exactly. They are grouped by connected component, again in blocks, where shingle
   sets meet once per pair of blocks and the links of one text to a block are counted in one sweep.

Links are summed per text inside the tasks, weighted by copies, and tasks report spanning trees. The surviving
candidates, however, leave their task as lists of partners and are written twice before they are verified: a
group of n different near copies has n(n-1)/2 entries there, so one very large group does not finish. Results: a row per document with its class (documents
linked by chains of links) and its exact number of links.

Edge cases: words are runs of characters other than ASCII white space; a text of one to four words is one
shingle; a text without words (null, empty, blank) is alone and has no links; repeated rows and repeated ids
count as documents; a null id is allowed and never a class id unless a class has no other; an empty table
gives no rows. Only the id and the text are read.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from .components import components
from .hashing import mix, run_hashes
from .lines import hide
from .word_bpe import slices

SHINGLE = 5
BANDS, ROWS = 28, 5
STEP = 20
BLOCK = 256
_SALT = np.uint64(0x9E3779B97F4A7C15)
_TEXT_SLICE = 1 << 20


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in order, where each text's begin (and the last ends), and a hash of each
    text's sequence of words (0 without words)."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    ink = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(ink & (edge[:-1] | np.concatenate([[True], ~ink[:-1]])[: len(ink)]))
    stops = np.flatnonzero(ink & (edge[1:] | np.concatenate([~ink[1:], [True]])[: len(ink)])) + 1
    words = run_hashes(data, starts, stops)
    first = np.searchsorted(starts, offsets)
    count = np.diff(first)
    doc = np.repeat(np.arange(len(texts)), count)
    place = np.arange(len(words)) - first[doc] if len(words) else np.zeros(0, np.int64)
    left = count[doc] - place if len(words) else place
    keep = (left >= SHINGLE) | (place == 0)
    at = np.flatnonzero(keep)
    padded = np.concatenate([words, np.zeros(SHINGLE, np.uint64)])
    h = np.zeros(len(at), np.uint64)
    for k in range(SHINGLE):
        h = h * _SALT + np.where(left[at] > k, padded[at + k], np.uint64(0))
    bounds = np.searchsorted(at, first)
    whole = np.zeros(len(texts), np.uint64)
    some = count > 0
    if some.any():
        spread = mix(words + mix(place.astype(np.uint64) * _SALT + np.uint64(1)))
        whole[some] = mix(np.add.reduceat(spread, first[:-1][some]) + count[some].astype(np.uint64))
    return mix(h), bounds, whole


def _factors() -> np.ndarray:
    return np.random.default_rng(20_240_601).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """MinHash values, 16 bits each, one row per text with shingles."""
    filled = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(filled), BANDS * ROWS), np.uint16)
    if len(filled):
        for j, factor in enumerate(_factors()):
            # the least product's high half, folded: equal minima stay equal
            low = np.minimum.reduceat((hashes * factor) >> np.uint64(20), bounds[:-1][filled])
            out[:, j] = mix(low).astype(np.uint16)
    return out


def _small(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for part in slices(batch, "text", _TEXT_SLICE):
        yield part


def sketch(docs: DataFrame, key: str) -> DataFrame:
    """(`key`, `text_hash`, `class`, `signature`) of every document; class 0 and no signature without words."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _small(batch):
                hashes, bounds, whole = shingles(part.column("text"))
                found, sig = np.flatnonzero(np.diff(bounds)), signatures(hashes, bounds)
                rows = np.full(part.num_rows, -1)
                rows[found] = np.arange(len(found))
                sigs = [sig[r].tobytes() if r >= 0 else None for r in rows.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(whole.view(np.int64)), pa.array(sigs, pa.binary())],
                    [key, "text_hash", "class", "signature"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        sketched, f"`{key}` {kind}, text_hash long, class long, signature binary")


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """After 20, 40, ... compared values: the fewest agreements at which a pair is still likely enough."""
    least = []
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance and m < n:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        least.append(m)
    return least


def groups(batches: Iterator[pa.RecordBatch], keys: list[str], at_least: int) -> Iterator[tuple[dict, np.ndarray]]:
    """Columns of runs of whole groups (consecutive rows with equal keys) and where each group starts."""
    held = None
    for batch in batches:
        held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if held.num_rows < at_least:
            continue
        marks = _starts(held, keys)
        if marks[-1] > 0:
            yield held.slice(0, marks[-1]), marks[:-1]
            held = held.slice(marks[-1])
    if held is not None and held.num_rows:
        yield held, _starts(held, keys)


def _starts(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for k in keys:
        v = batch.column(k).to_numpy(zero_copy_only=False)
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def _forest(a: np.ndarray, b: np.ndarray) -> dict[int, int]:
    """Root of every id in the pairs."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = root(x), root(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    return {x: root(x) for x in up}


def _pairs(side: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    if lo == hi:
        return np.triu_indices(len(side), 1)
    a, b = np.flatnonzero(side == lo), np.flatnonzero(side == hi)
    return np.repeat(a, len(b)), np.tile(b, len(a))


def _blocks(size: Column) -> Column:
    """A power of two, so that the blocks of a larger group lie within those of a smaller one and a list
    of partners from one unit of a bucket falls into few blocks of its component."""
    return F.pow(F.lit(2), F.greatest(F.ceil(F.log2(size / BLOCK)), F.lit(0))).cast("int")


def _block(key: Column, blocks: Column) -> Column:
    return F.pmod(F.hash(key), blocks)


def candidates(classes: DataFrame, threshold: float, tolerance: float, lists: bool = True) -> DataFrame:
    """(`id`, `root`, `partners`): classes with surviving candidates, larger id's list of them in one unit of
    work (null without `lists`), and a spanning tree of the unit's pairs. `classes` has `id` and `signature`."""
    least = least_matches(threshold, tolerance)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in groups(batches, ["bucket", "lo", "hi"], 4096):
            ids, side = rows.column("id").to_numpy(), rows.column("side").to_numpy()
            lo, hi, band = (rows.column(c).to_numpy() for c in ("lo", "hi", "band"))
            sig = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint16).reshape(len(ids), -1)
            stops = np.append(starts[1:], len(ids))
            todo, size = [], 0
            for s, e in [*zip(starts.tolist(), stops.tolist()), (0, 0)]:
                if e > s:
                    a, b = _pairs(side[s:e], lo[s], hi[s])
                    todo.append((a + s, b + s))
                    size += len(a)
                if todo and (size > 30_000 or e == 0):
                    a, b = (np.concatenate(x) for x in zip(*todo))
                    todo, size = [], 0
                    keep = ids[a] != ids[b]
                    a, b = a[keep], b[keep]
                    matches = np.zeros(len(a), np.int64)
                    for k, need in enumerate(least):
                        same = sig[a, k * STEP : (k + 1) * STEP] == sig[b, k * STEP : (k + 1) * STEP]
                        matches += same.sum(axis=1)
                        agreed = same.reshape(len(a), STEP // ROWS, ROWS).all(axis=2)
                        earlier = agreed & (np.arange(agreed.shape[1]) + k * STEP // ROWS < band[a][:, None])
                        live = (matches >= need) & ~earlier.any(axis=1)
                        a, b, matches = a[live], b[live], matches[live]
                    if len(a):
                        yield _lists(np.maximum(ids[a], ids[b]), np.minimum(ids[a], ids[b]), lists)

    bands = classes.select("id", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring("signature", b * 2 * ROWS + 1, F.lit(2 * ROWS))))).alias("band", "bucket"))
    shared = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = bands.join(shared, "bucket").withColumn("blocks", _blocks(F.col("n"))).withColumn("side", _block(F.col("id"), F.col("blocks")))
    work = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "id", "bucket", "band", "side", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"))
    signed = work.join(classes.select("id", "signature"), "id").repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    return signed.mapInArrow(compare, "id long, root long, partners array<long>")


def _lists(a: np.ndarray, b: np.ndarray, partners: bool) -> pa.RecordBatch:
    """One row per id: its root in the spanning forest and its list of partners."""
    roots, lists = _forest(a, b), {}
    if partners:
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        heads, first = np.unique(a, return_index=True)
        lists = dict(zip(heads.tolist(), np.split(b, first[1:])))
    return pa.RecordBatch.from_arrays(
        [pa.array(list(roots), pa.int64()), pa.array(list(roots.values()), pa.int64()),
         pa.array([lists.get(x) for x in roots], pa.list_(pa.int64()))], ["id", "root", "partners"])


def _shingle_sets(texts: DataFrame) -> DataFrame:
    """(`id`, `shingles`): sorted distinct hashes, from (`id`, `text`)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _small(batch):
                hashes, bounds, _ = shingles(part.column("text"))
                out = [np.unique(hashes[s:e]).tobytes() for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(out, pa.binary())], ["id", "shingles"])

    return texts.select("id", "text").mapInArrow(sets, "id long, shingles binary")


def _verify(threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in groups(batches, ["comp", "lo", "hi"], 1024):
            columns = [rows.column(c).to_pylist() for c in ("id", "copies", "shingles", "partners")]
            stops = np.append(starts[1:], rows.num_rows)
            for s, e in zip(starts.tolist(), stops.tolist()):
                held, asked = {}, []
                for i, n, own, partners in zip(*[c[s:e] for c in columns]):
                    if own is not None:
                        held[i] = (n, np.frombuffer(own, np.uint64))
                    else:
                        asked.append((i, partners))
                if asked:
                    found = _linked(held, asked, threshold)
                    if found.num_rows:
                        yield found

    return verify


def _linked(held: dict, asked: list, threshold: float) -> pa.RecordBatch:
    """Verified links of one unit: per id the copies it is linked to and its root in the spanning forest."""
    names = list(held)
    at = {x: k for k, x in enumerate(names)}
    sizes = np.array([len(held[x][1]) for x in names])
    values, dense = np.unique(np.concatenate([held[x][1] for x in names]), return_inverse=True)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    copies = np.array([held[x][0] for x in names])
    mark, links, ends = np.zeros(len(values), bool), np.zeros(len(names), np.int64), []
    wanted: dict[int, set] = {}
    for i, partners in asked:
        wanted.setdefault(i, set()).update(partners)
    for i, partners in wanted.items():
        k, others = at[i], np.array([at[p] for p in partners])
        own = dense[bounds[k] : bounds[k + 1]]
        mark[own] = True
        index = np.concatenate([dense[bounds[o] : bounds[o + 1]] for o in others])
        common = np.add.reduceat(mark[index].astype(np.int64), np.cumsum(sizes[others]) - sizes[others])
        mark[own] = False
        linked = others[common >= threshold * (sizes[k] + sizes[others] - common) - 1e-9]
        links[k] += copies[linked].sum()
        np.add.at(links, linked, copies[k])
        ends += [(k, o) for o in linked.tolist()]
    pairs = np.array(ends, np.int64).reshape(-1, 2)
    ids = np.array(names, np.int64)
    roots = _forest(ids[pairs[:, 0]], ids[pairs[:, 1]])
    keep = [x for x in names if x in roots]
    return pa.RecordBatch.from_arrays(
        [pa.array(keep, pa.int64()), pa.array([int(links[at[x]]) for x in keep], pa.int64()),
         pa.array([roots[x] for x in keep], pa.int64())], ["id", "links", "root"])


def _verified(docs: DataFrame, key: str, classes: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """(`id`, `links`, `root`) of classes with links, from surviving candidates."""
    comp = cut(components(pairs.select(F.col("id").alias("u"), F.col("root").alias("v"))).withColumnRenamed("label", "comp"), "comp")
    sizes = comp.groupBy("comp").agg(_blocks(F.count(F.lit(1))).alias("blocks"))
    placed = comp.join(sizes, "comp").withColumn("block", _block(F.col("id"), F.col("blocks")))
    members = cut(placed.join(classes.select("id", "copies", "rep"), "id"), "members")
    asked = pairs.filter("partners is not null").join(members.select("id", "comp", "blocks", "block"), "id")
    others = F.transform("partners", lambda p: F.struct(_block(p, F.col("blocks")).alias("b"), p.alias("p")))
    asked = asked.withColumn("others", others).withColumn("other", F.explode(F.array_distinct(F.col("others.b"))))
    asked = asked.select("comp", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "id", F.transform(
        F.filter("others", lambda o: o["b"] == F.col("other")), lambda o: o["p"]).alias("partners"))
    asked = cut(asked, "asked")
    units = asked.select("comp", "lo", "hi").distinct().withColumn("block", F.explode(F.array_distinct(F.array("lo", "hi"))))
    reps = members.select("id", F.col("rep.key").alias("_key"), F.col("rep.text_hash").alias("_hash"))
    # the same plan at every size: texts move once to meet their keys
    texts = docs.select(F.col(key).alias("_own"), "text").join(
        reps.hint("merge"), (F.xxhash64("text") == F.col("_hash")) & F.col("_own").eqNullSafe(F.col("_key")))
    sets = cut(_shingle_sets(texts), "sets")
    rows = members.join(units, ["comp", "block"]).join(sets, "id").select(
        "comp", "lo", "hi", "id", "copies", "shingles", F.lit(None).cast("array<long>").alias("partners"))
    rows = rows.unionByName(asked.select(
        "comp", "lo", "hi", "id", F.lit(None).cast("long").alias("copies"), F.lit(None).cast("binary").alias("shingles"), "partners"))
    spread = rows.repartition("comp", "lo", "hi").sortWithinPartitions("comp", "lo", "hi")
    return spread.mapInArrow(_verify(threshold), "id long, links long, root long")


def likely_classes(sketches: DataFrame, key: str, threshold: float = 0.8, tolerance: float = 1e-5) -> DataFrame:
    """(`key`, `label`) of sketched texts with words: texts linked by chains of surviving candidates share a label.

    No text is read and nothing is verified: a pair is linked if its signatures agree in a band and, value by
    value, never so seldom that reaching `threshold` is less likely than `tolerance`.
    """
    filled = sketches.filter("signature is not null")
    classes = cut(filled.groupBy(F.col("class").alias("id")).agg(F.first("signature").alias("signature")), "classes")
    pairs = candidates(classes, threshold, tolerance, lists=False).select(F.col("id").alias("u"), F.col("root").alias("v"))
    labels = components(pairs)
    return filled.select(key, F.col("class").alias("id")).join(labels, "id", "left").select(key, F.coalesce("label", "id").alias("label"))


def similar_documents(docs: DataFrame, key: str = "doc_id", threshold: float = 0.8, tolerance: float = 1e-5) -> DataFrame:
    """A row per document: `key`, `text_hash`, `class_id` (least key of its class), `n_links` (other documents
    with similarity `threshold` or more), `rep_text_hash` (text hash of the class's document with that key)."""
    sketches = cut(sketch(docs, key), "sketches")
    rep = F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), "text_hash")).alias("rep")
    filled = sketches.filter("signature is not null")
    classes = cut(filled.groupBy(F.col("class").alias("id")).agg(
        F.count(F.lit(1)).alias("copies"), rep, F.first("signature").alias("signature")), "classes")
    pairs = cut(candidates(classes, threshold, tolerance), "pairs")
    verified = cut(_verified(docs, key, classes, pairs, threshold), "links")
    links = verified.groupBy("id").agg(F.sum("links").alias("links"))
    labels = components(verified.select(F.col("id").alias("u"), F.col("root").alias("v")))
    known = classes.select("id", "copies", "rep").join(links, "id", "left").join(labels, "id", "left").withColumn(
        "label", F.coalesce("label", "id"))
    heads = known.groupBy("label").agg(F.min("rep").alias("head"))
    table = known.join(heads, "label").select(
        F.col("id").alias("class"), F.col("head.key").alias("class_id"), F.col("head.text_hash").alias("rep_text_hash"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    named = filled.drop("signature").join(table, "class").drop("class")
    alone = sketches.filter("signature is null").select(
        key, "text_hash", F.col(key).alias("class_id"), F.col("text_hash").alias("rep_text_hash"), F.lit(0).cast("long").alias("n_links"))
    return named.unionByName(alone)


def keep_one(docs: DataFrame, key: str = "doc_id", threshold: float = 0.8) -> DataFrame:
    """One document of each class, the one with the least key; texts without words all stay, once a key and text."""
    own, (key,), back = hide(docs, key)
    found = similar_documents(own, key, threshold)
    heads = found.select(F.col("class_id").alias("_key"), F.col("rep_text_hash").alias("_hash")).distinct()
    hashed = own.withColumn("_own", F.xxhash64("text"))
    kept = hashed.join(heads, (F.col("_own") == F.col("_hash")) & F.col(key).eqNullSafe(F.col("_key")), "left_semi")
    return kept.dropDuplicates([key, "_own"]).drop("_own").withColumnsRenamed(back)
