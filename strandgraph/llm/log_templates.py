"""Line dedup with a log-template tree of fixed depth.

A line in lower case, tokens with a digit replaced by <*>, goes down the tree by its token count and its
first `depth` tokens. Within a leaf, lines are merged by similarity, from two variants on: a group of lines of
which at least `min_constant` of the tokens after the leading ones, and at least `min_evidence` tokens, are
the same in all is one template, and its other places are fields; a group that is not is split by the tokens
at the place with the fewest different ones. No rule looks at how many lines a leaf or a group has. A line
without a group is its own template. A template found in `min_docs` or more distinct texts is recurring, and
its lines are dropped from every document. With `long_line` fewer texts do for longer templates.
With `near` near copies count as one text, so that they do not make each other's prose recurring; their
signatures decide which texts are near copies (jaccard_join.likely_classes), so no text moves for it.

Lines are hashes of their tokens (64 bits to tell lines apart, 32 bits a token within a leaf). A first reading
of the texts finds the leaves with several variants; a second one sends out the tokens of their lines, kept
apart by a bitmap of leaves of fixed size (what it lets through by chance, a join removes). A leaf of up to
`LEAF_LINES` variants is worked out by one task; a larger one by aggregates on its exploded tokens, level by
level, so that no leaf is ever one group. Texts move once, to meet their flags.

Edge cases: a null text stays null; lines without tokens are kept; a text that loses every line is empty
but its row stays; equal texts count as one document and lose the same lines; repeated rows stay; an empty
table stays empty. Other columns are passed through, whatever their names.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut, union_all
from . import jaccard_join
from .hashing import mix, run_hashes
from .jaccard_join import groups
from .lines import hide, without
from .memo import gather
from .word_bpe import slices

#: How the query and the pipeline drop lines.
RULE = {"long_line": 20, "near": 0.8}
LEAF_LINES = 20_000
LEAF_BITS = 1 << 26
_WILD = 0  # a token with a digit
_SLICE = 2 << 20
_SALT = np.uint64(0x9E3779B97F4A7C15)


def line_tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines with tokens: text, number within it, and first token; and the hashes of all tokens, `_WILD`
    for those with a digit. Tokens stand between ASCII white space, in lower case."""
    texts = pc.utf8_lower(texts.fill_null("").cast(pa.large_string()))
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    ink = np.append((data != 32) & ((data < 9) | (data > 13)), False)
    fresh = np.ones(len(data) + 1, bool)
    fresh[1:] = ~ink[:-1]
    fresh[offsets] = True
    starts = np.flatnonzero(ink & fresh)
    ends = np.ones(len(data) + 1, bool)
    ends[:-1] = ~ink[1:]
    ends[offsets[1:] - 1] = True
    stops = np.flatnonzero(ink & ends) + 1
    hashes = run_hashes(data, starts, stops)
    digits = np.zeros(len(data) + 1, np.int32)  # a slice of texts is far below 2 GB
    np.cumsum((data >= 48) & (data <= 57), out=digits[1:])
    hashes = np.where(digits[stops] > digits[starts], np.uint64(_WILD), np.maximum(hashes, np.uint64(1)))
    feeds = np.flatnonzero(data == 10) + 1
    # The first token behind a border of lines or texts; borders are fewer than tokens, so they look for them.
    first = np.unique(np.searchsorted(starts, np.concatenate([offsets[:-1], feeds])))
    first = first[first < len(starts)]
    line = np.searchsorted(feeds, starts[first], "right")  # over all texts; a text's first line has the number of feeds before it
    text = np.searchsorted(offsets, starts[first], "right") - 1
    number = line - np.searchsorted(feeds, offsets[:-1], "right")[text]
    return text, number, first, hashes


def _keys(first: np.ndarray, hashes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lines: number of tokens, tree leaf, hash of all tokens, number of tokens without a digit."""
    count = np.diff(np.append(first, len(hashes)))
    padded, leaf = np.append(hashes, np.zeros(depth, np.uint64)), count.astype(np.uint64)
    for k in range(depth):
        leaf = leaf * _SALT + np.where(count > k, padded[first + k], np.uint64(0))
    if not len(first):
        return count, leaf, leaf, count
    place = np.arange(len(hashes)) - np.repeat(first, count)
    exact = np.add.reduceat(mix(hashes + mix(place.astype(np.uint64) * _SALT + np.uint64(1))), first)
    return count, mix(leaf), mix(exact + count.astype(np.uint64)), np.add.reduceat((hashes != _WILD).astype(np.int64), first)


def _lines(docs: DataFrame, depth: int, least: int) -> DataFrame:
    """Every line with tokens: text keys, number, leaf, hash of the masked line, constant tokens, and whether it
    has at least `least` tokens."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                text, number, first, hashes = line_tokens(part.column("text"))
                count, leaf, exact, size = _keys(first, hashes, depth)
                rows = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(rows), part.column(1).take(rows), pa.array(number, pa.int32()), pa.array(leaf.view(np.int64)),
                     pa.array(exact.view(np.int64)), pa.array(size, pa.int32()), pa.array(count >= least)],
                    ["k1", "k2", "number", "leaf", "exact", "size", "long"])

    keyed = docs.filter("text is not null").select(F.xxhash64("text").alias("k1"), F.hash("text").alias("k2"), "text")
    return keyed.mapInArrow(parsed, "k1 long, k2 int, number int, leaf long, exact long, size int, long boolean")


def _bitmap(leaves: DataFrame) -> bytes:
    """One bit for each of `LEAF_BITS` residues of the leaves: at most 8 MB, however many leaves there are."""
    place = F.pmod("leaf", F.lit(LEAF_BITS)) + 1
    parts = leaves.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    bits = bytearray(LEAF_BITS // 8)
    for r in parts:
        bits[(r.bucket - 1) * 4096 : r.bucket * 4096] = r.bits
    return bytes(bits)


def _spelled(docs: DataFrame, leaves: DataFrame, depth: int, least: int) -> DataFrame:
    """(leaf, exact, n, tokens) of the distinct lines of `leaves` (leaf, n), tokens in 32 bits each."""
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(leaves))

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                _, _, first, hashes = line_tokens(part.column("text"))
                count, leaf, exact, _ = _keys(first, hashes, depth)
                leaf, exact = leaf.view(np.int64), exact.view(np.int64)
                place = leaf % LEAF_BITS
                lines = np.flatnonzero((count >= least) & ((marked[place >> 3] >> (place & 7)) & 1 == 1))
                lines = lines[np.unique(exact[lines], return_index=True)[1]]
                short = np.where(hashes == _WILD, 0, np.maximum(hashes >> np.uint64(32), np.uint64(1))).astype("<u4")
                own = gather(short, first[lines], count[lines])
                offsets = np.concatenate([[0], np.cumsum(count[lines])]).astype(np.int32) * 4
                tokens = pa.Array.from_buffers(pa.binary(), len(lines), [None, pa.py_buffer(offsets), pa.py_buffer(own)])
                yield pa.RecordBatch.from_arrays([pa.array(leaf[lines]), pa.array(exact[lines]), tokens], ["leaf", "exact", "tokens"])

    found = docs.filter("text is not null").select("text").mapInArrow(spelled, "leaf long, exact long, tokens binary")
    return found.join(leaves, "leaf").groupBy("leaf", "exact", "n").agg(F.first("tokens").alias("tokens"))


def merge_leaf(tokens: np.ndarray, key: int, depth: int, min_constant: float, min_evidence: int) -> Iterator[tuple[np.ndarray, int, int]]:
    """(lines, template, constant tokens) of the groups of a leaf's lines (rows of tokens) that are one template.

    A group is one template if enough of its tokens after the leading ones are the same in all of its lines. If
    not, it is split by the tokens at the place with the fewest different ones, and so on.
    """
    waiting, width = [(np.arange(len(tokens)), key)], tokens.shape[1]
    while waiting:
        rows, name = waiting.pop()
        own = np.sort(tokens[rows, depth:], axis=0)
        kinds = 1 + (own[1:] != own[:-1]).sum(axis=0)
        same = int(((kinds == 1) & (own[0] != _WILD)).sum())
        if same >= min_evidence and same >= min_constant * (width - depth):
            yield rows, name, same + int((tokens[rows[0], :depth] != _WILD).sum())
            continue
        at = int(np.argmin(np.where(kinds > 1, kinds, len(rows) + 1))) + depth
        order = np.argsort(tokens[rows, at], kind="stable")
        rows, values = rows[order], tokens[rows[order], at]
        borders = np.flatnonzero(values[1:] != values[:-1]) + 1
        for part in np.split(rows, borders):
            if len(part) > 1:
                base = np.array([(name * 31 + at) & 0xFFFFFFFFFFFFFFFF], np.uint64)
                waiting.append((part, int(mix(base + mix(np.array([tokens[part[0], at]], np.uint64) + np.uint64(1)))[0])))


def _small_leaves(spelled: DataFrame, depth: int, min_constant: float, min_evidence: int) -> DataFrame:
    """(leaf, exact, general, fixed) of the lines of whole leaves that share a template with another one."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in groups(batches, ["leaf"], 1_024):
            leaf, exact, tokens = rows.column("leaf").to_numpy(), rows.column("exact").to_numpy(), rows.column("tokens").to_pylist()
            at, general, fixed = [], [], []
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(leaf)]):
                table = np.frombuffer(b"".join(tokens[s:e]), "<u4").reshape(e - s, -1)
                for lines, name, size in merge_leaf(table, int(leaf[s]) & 0xFFFFFFFFFFFFFFFF, depth, min_constant, min_evidence):
                    at.append(lines + s)
                    general.append(np.full(len(lines), name, np.uint64))
                    fixed.append(np.full(len(lines), size))
            if at:
                places = np.concatenate(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf[places]), pa.array(exact[places]), pa.array(np.concatenate(general).view(np.int64)), pa.array(np.concatenate(fixed), pa.int32())],
                    ["leaf", "exact", "general", "fixed"])

    return spelled.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(merged, "leaf long, exact long, general long, fixed int")


def _large_leaves(spelled: DataFrame, depth: int, min_constant: float, min_evidence: int) -> DataFrame:
    """The same for leaves of any size, by aggregates on their tokens, one level of splits a turn."""
    words = F.expr("transform(sequence(1, length(tokens), 4), i -> conv(hex(substring(tokens, i, 4)), 16, 10))")
    done, turn = [], cut(spelled.select("leaf", "exact", words.alias("tokens"), F.col("leaf").alias("general")), "large")
    while not turn.isEmpty():
        places = turn.select("general", F.size("tokens").alias("n"), F.posexplode("tokens").alias("at", "token")).filter(F.col("at") >= depth)
        spread = places.groupBy("general", "n", "at", "token").agg(F.first(F.col("token") == "0").alias("wild"))
        kinds = spread.groupBy("general", "n", "at").agg(F.count(F.lit(1)).alias("kinds"), F.max("wild").alias("wild"))
        same, varied = (F.col("kinds") == 1) & ~F.col("wild"), F.col("kinds") > 1
        found = kinds.groupBy("general", "n").agg(
            F.count(F.when(same, 1)).alias("same"), F.min(F.when(varied, F.struct("kinds", "at"))).alias("split"),
            F.collect_set(F.when(varied, F.col("at"))).alias("fields"))  # at most one entry a token of the line
        one = (F.col("same") >= min_evidence) & (F.col("same") >= min_constant * (F.col("n") - depth))
        met = cut(turn.join(found.withColumn("one", one).drop("n"), "general"), "groups")
        fixed = F.filter("tokens", lambda t, i: (t != "0") & ~F.array_contains("fields", i))
        done.append(met.filter("one").select("leaf", "exact", "general", F.size(fixed).alias("fixed")))
        token = F.element_at("tokens", F.col("split.at") + 1)
        parts = met.filter("not one").select("leaf", "exact", "tokens", F.xxhash64("general", "split.at", token).alias("general"))
        several = parts.groupBy("general").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("general")
        turn = cut(parts.join(several, "general"), "turn")
    none = spelled.limit(0).select("leaf", "exact", F.col("leaf").alias("general"), F.lit(0).alias("fixed"))
    return union_all([none, *done])


def line_templates(docs: DataFrame, depth: int = 3, min_constant: float = 0.5, min_evidence: int = 3, leaf_lines: int = LEAF_LINES) -> DataFrame:
    """(k1, k2, number, template, size) of the lines of all texts, as a written table; size counts the constant
    tokens of the template. Equal texts have the same rows, once each."""
    texts, least = docs.select("text"), depth + min_evidence + 1
    lines = cut(_lines(texts, depth, least), "lines")
    leaves = lines.filter("long").select("leaf", "exact").distinct().groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    spelled = cut(_spelled(texts, cut(leaves, "leaves"), depth, least), "spelled")
    rule = depth, min_constant, min_evidence
    small = _small_leaves(spelled.filter(F.col("n") <= leaf_lines).drop("n"), *rule)
    large = _large_leaves(spelled.filter(F.col("n") > leaf_lines).drop("n"), *rule)
    merged = cut(small.unionByName(large), "merged")
    return cut(lines.join(merged, ["leaf", "exact"], "left").select(
        "k1", "k2", "number", F.coalesce("general", "exact").alias("template"), F.coalesce("fixed", "size").alias("size")), "templates")


def recurring(templates: DataFrame, min_docs: int = 6, long_line: int | None = None, of: tuple[str, ...] = ("k1", "k2")) -> DataFrame:
    """(template, n_docs) of templates in at least `min_docs` distinct texts (or other values of the columns `of`).
    With `long_line` that number falls with the constant tokens of the template, down to two at `long_line`."""
    least = F.lit(min_docs)
    if long_line is not None:
        least = F.greatest(F.lit(2), F.lit(min_docs) - F.floor(F.col("size") * (min_docs - 2) / long_line))
    return templates.select("template", "size", *of).distinct().groupBy("template", "size").agg(
        F.count(F.lit(1)).alias("n_docs")).filter(F.col("n_docs") >= least).drop("size")


def _near_classes(docs: DataFrame, holders: DataFrame, near: float) -> DataFrame:
    """(k1, class) of the texts in `holders`."""
    texts = docs.filter("text is not null").select(F.xxhash64("text").alias("k1"), "text")
    held = jaccard_join.sketch(texts, "k1").drop("text_hash").join(holders.select("k1").distinct(), "k1", "left_semi")
    return jaccard_join.likely_classes(cut(held, "holders"), "k1", near).withColumnRenamed("label", "class").distinct()


def drop_recurring(docs: DataFrame, min_docs: int = 6, long_line: int | None = None, near: float | None = None, **tree) -> DataFrame:
    """`docs` with the recurring lines taken out of `text`; adds `n_dropped_lines` if no column has that name."""
    own, _, back = hide(docs)
    templates = line_templates(own, **tree)
    gone = templates.join(recurring(templates, min_docs, long_line).select("template"), "template", "left_semi")
    if near is not None:
        # only a template that recurs in distinct texts can recur in classes of them
        gone = cut(gone, "held")
        classed = gone.join(_near_classes(own, gone, near), "k1")
        gone = gone.join(recurring(classed, min_docs, long_line, ("class",)).select("template"), "template", "left_semi")
    flags = gone.groupBy(F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).agg(F.array_sort(F.collect_set("number")).alias("_gone"))
    keyed = own.withColumns({"_k1": F.xxhash64("text"), "_k2": F.hash("text")})
    out = keyed.join(flags, ["_k1", "_k2"], "left")
    out = out.withColumn("_lines", F.when(F.col("_gone").isNotNull(), F.split("text", "\n")))
    kept = F.array_join(without(F.col("_lines"), F.col("_gone")), "\n")
    columns = [F.when(F.col("_gone").isNotNull(), kept).otherwise(F.col("text")).alias(c) if c == "text" else F.col(c) for c in own.columns]
    if "n_dropped_lines" not in own.columns:
        columns.append(F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped_lines"))
    return out.select(columns).withColumnsRenamed(back)
