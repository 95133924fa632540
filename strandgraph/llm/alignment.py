"""Alignment of the tokens of two tokenizers, in windows between white-space anchors.

1. Both tokenizers encode every whole text. A text is cut before each space between two other characters, where
   neither tokenizer's tokens reach across; a worker asks the libraries once per unit and remembers the ids.
2. An anchor is a byte offset where tokens of both sides end and the next tokens of both sides begin with a
   space. Shared ends are verified by offset, never assumed. Anchors split a document into windows, pairs of
   runs of ids; how a window falls into groups depends on its ids alone and is remembered under them.
3. Groups end where tokens of both sides end. All pairs of an A and a B token of a group are links. A document
   leaves its task with its distinct id pairs and how often it links them, never with the links one by one.
4. A pair's count is the number of documents with it. Pairs held by more than one `HOT_PAIRS`-th of all
   (document, pair) rows, of which there are at most `HOT_PAIRS`, travel with the tasks; the others, no key of
   which has more rows than that, are joined by shuffle.

Edge cases: texts that are null or empty, or whose joined A or B bytes differ from a space and the text, have no
tokens (zeros, and an empty digest); runs of blanks, very long units and bytes without characters are aligned
like all else; repeated rows count as documents; an empty table gives no rows. Only the key and text are read.
"""

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from .memo import Memo, gather
from .word_bpe import slices

HOT_PAIRS = 250_000
_SLICE = 1 << 20
_KEEP = 16 << 20
_LARGE = 1_024
_STOP = 0xFFFF
_ALIGNERS: dict[tuple[str, str], "Aligner"] = {}


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 characters stand for
    themselves, the other bytes for characters from U+0100 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Spelling:
    """The bytes of every id: one flat array, with places and lengths."""

    def __init__(self, tokens: list[bytes]):
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.spaced = np.array([t[:1] == b" " for t in tokens])

    def spell(self, ids: np.ndarray) -> np.ndarray:
        return gather(self.flat, self.starts[ids], self.lengths[ids])


class _ByteLevel(Memo):
    """Ids of units under a byte-level vocabulary file; special tokens are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        letters, names = byte_letters(), self.tokenizer.get_vocab()
        tokens = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            tokens[i] = bytes(letters[c] for c in name) if all(c in letters for c in name) else name.encode()
        self.spelling = Spelling(tokens)
        super().__init__(np.dtype(np.int32), _KEEP)

    def fresh(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(strings.to_pylist(), add_special_tokens=False)]
        return _joined(found)


class _Pieces(Memo):
    """Ids of units under a piece model, which puts the leading space itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.spelling = Spelling([
            bytes([int(name[3:5], 16)]) if self.model.IsByte(i) else name.replace("▁", " ").encode()
            for i in range(self.model.vocab_size()) for name in [self.model.id_to_piece(i)]])
        super().__init__(np.dtype(np.int32), _KEEP)

    def fresh(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return _joined(self.model.encode([s[1:] for s in strings.to_pylist()], num_threads=1))


def _joined(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(ids) for ids in found], np.int64)
    return np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum())), sizes


def unit_starts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where units start: at the texts' beginnings, and at each space between two characters that are no white
    space. Characters whose UTF-8 form might be white space, or U+2581, count as such."""
    padded = np.concatenate([np.full(3, 32, np.uint8), data, np.full(1, 32, np.uint8)])
    third, second, before, after = padded[:-4], padded[1:-3], padded[2:-2], padded[4:]
    blank = lambda b: (b <= 32) | (b == 127)
    odd_before = ((second == 0xC2) & (before >= 0x80)) | ((third >= 0xE1) & (third <= 0xE3))
    odd_after = (after == 0xC2) | ((after >= 0xE1) & (after <= 0xE3))
    cut_here = (data == 32) & ~blank(before) & ~odd_before & ~blank(after) & ~odd_after
    cut_here[begins] = True
    return np.flatnonzero(cut_here)


class Windows:
    """Alignments of windows: groups' texts, numbers of groups and links, and runs of id pairs with their links."""

    def __init__(self):
        self.texts = pa.array([], pa.large_string())
        self.groups = self.links = self.sizes = np.zeros(0, np.int64)
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.groups)

    @property
    def nbytes(self) -> int:
        return self.texts.nbytes + 24 * len(self) + self.pairs.nbytes + self.times.nbytes

    def append(self, other: "Windows") -> None:
        self.texts = pa.concat_arrays([self.texts, other.texts])
        for name in ("groups", "links", "sizes", "pairs", "times"):
            setattr(self, name, np.concatenate([getattr(self, name), getattr(other, name)]))


def _join_runs(parts: pa.Array, bounds: np.ndarray, mark: str) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), parts), pa.scalar(mark, pa.large_string()))


def align_windows(a: np.ndarray, a_stops: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_stops: np.ndarray, b_sizes: np.ndarray) -> Windows:
    """All windows at once: `a` and `b` are their ids one after the other, `a_stops` and `b_stops` where each window
    ends (both sides have the same bytes), and the sizes are the bytes of each token."""
    a_ends, b_ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
    at = np.searchsorted(b_ends, a_ends)
    last = np.flatnonzero(b_ends[at] == a_ends)  # the A tokens that end a group
    a_bounds, b_bounds = np.append(0, last + 1), np.append(0, at[last] + 1)
    n_a, n_b = np.diff(a_bounds), np.diff(b_bounds)
    owner = np.searchsorted(a_stops, last, "right")
    per_window = np.bincount(owner, minlength=len(a_stops))
    out, spelled = Windows(), []
    for ids, bounds in ((a, a_bounds), (b, b_bounds)):
        names = pa.array(ids.astype(np.int64)).dictionary_encode()
        spelled.append(_join_runs(names.dictionary.cast(pa.large_string()).take(names.indices), bounds, ","))
    groups = pc.binary_join_element_wise(*spelled, pa.scalar("|", pa.large_string()))
    out.texts = _join_runs(groups, np.concatenate([[0], np.cumsum(per_window)]), ";")
    out.groups, many = per_window, n_a * n_b
    out.links = np.bincount(owner, many, len(a_stops)).astype(np.int64)
    small = np.where(many <= _LARGE, many, 0)
    g = np.repeat(np.arange(len(many)), small)
    place = np.arange(len(g)) - np.repeat(np.cumsum(small) - small, small)
    pairs = a[a_bounds[g] + place // n_b[g]].astype(np.int64) << 32 | b[b_bounds[g] + place % n_b[g]].astype(np.int64)
    times, whose = np.ones(len(pairs), np.int64), owner[g]
    for i in np.flatnonzero(many > _LARGE).tolist():  # a long group: its distinct ids and how often they occur
        x, n = np.unique(a[a_bounds[i] : a_bounds[i + 1]].astype(np.int64), return_counts=True)
        y, m = np.unique(b[b_bounds[i] : b_bounds[i + 1]].astype(np.int64), return_counts=True)
        more = ((x << 32)[:, None] | y[None]).ravel()
        pairs, times = np.concatenate([pairs, more]), np.concatenate([times, (n[:, None] * m[None]).ravel()])
        whose = np.concatenate([whose, np.full(len(more), owner[i])])
    order = np.argsort(whose, kind="stable")
    out.pairs, out.times, out.sizes = pairs[order], times[order], np.bincount(whose, minlength=len(a_stops))
    return out


class Aligner:
    """Both tokenizers of a worker and the windows it has met, remembered under their ids up to `keep` bytes."""

    def __init__(self, first: str, second: str, keep: int = _KEEP):
        self.a, self.b, self.keep = _ByteLevel(first), _Pieces(second), keep
        self.known, self.windows, self.held, self.asked, self.solved = {}, Windows(), 0, 0, 0
        self.kind = np.uint16 if max(len(self.a.spelling.lengths), len(self.b.spelling.lengths)) < _STOP else np.uint32

    def tokens(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """For both sides: ids of all texts, and where each text's begin (and the last end). Texts that do not
        come back from their tokens have none."""
        spaced = pc.binary_join_element_wise("", pc.fill_null(texts, ""), " ").cast(pa.large_string())
        offsets = np.frombuffer(spaced.buffers()[1], np.int64)[spaced.offset : spaced.offset + len(spaced) + 1]
        data = np.frombuffer(spaced.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        starts = unit_starts(data, offsets[:-1])
        places = np.append(starts, len(data))
        units = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(data))])
        coded, bounds = units.dictionary_encode(), np.searchsorted(starts, offsets)
        index, good, out = coded.indices.to_numpy(), np.diff(offsets) > 1, []
        for side in (self.a, self.b):
            entry = side.entries(coded.dictionary)[index]
            sizes = side.sizes[entry].astype(np.int64)
            ids, ends = gather(side.flat, side.starts[entry], sizes), np.concatenate([[0], np.cumsum(sizes)])[bounds]
            good &= self._whole(side.spelling, ids, ends, data, offsets)
            out.append((ids, ends))
        return [self._only(ids, ends, good) for ids, ends in out]

    @staticmethod
    def _whole(spelling: Spelling, ids: np.ndarray, ends: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether the joined bytes of a text's tokens are the text."""
        joined = spelling.spell(ids)
        places = np.concatenate([[0], np.cumsum(spelling.lengths[ids])])[ends]
        if len(joined) == len(data) and (places == offsets).all() and (joined == data).all():
            return np.ones(len(offsets) - 1, bool)
        return np.array([
            np.array_equal(joined[p:q], data[r:s])
            for p, q, r, s in zip(places[:-1].tolist(), places[1:].tolist(), offsets[:-1].tolist(), offsets[1:].tolist())], bool)

    @staticmethod
    def _only(ids: np.ndarray, ends: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = np.diff(ends)
        return ids[np.repeat(good, counts)], np.concatenate([[0], np.cumsum(counts * good)])

    def anchored(self, a: np.ndarray, a_bounds: np.ndarray, b: np.ndarray, b_bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where windows end on both sides (counts of tokens before): at texts' ends, and at shared ends before
        tokens that begin with a space on both sides."""
        a_ends, b_ends = np.cumsum(self.a.spelling.lengths[a]), np.cumsum(self.b.spelling.lengths[b])
        at = np.searchsorted(b_ends, a_ends)
        shared = b_ends[np.minimum(at, len(b_ends) - 1)] == a_ends
        marked = shared.copy()
        marked[:-1] &= self.a.spelling.spaced[a[1:]]
        inner = np.flatnonzero(marked[:-1])
        inner = inner[self.b.spelling.spaced[b[at[inner] + 1]]]
        stops = np.zeros(len(a) + 1, bool)
        stops[inner + 1] = stops[a_bounds[1:][np.diff(a_bounds) > 0]] = True
        places = np.flatnonzero(stops)
        return places, at[places - 1] + 1

    def _numbers(self, keys: list[bytes]) -> np.ndarray:
        """Places of windows among the remembered ones; those not met before are aligned together."""
        fresh = [k for k in keys if k not in self.known]
        if fresh:
            ids = np.frombuffer(b"".join(fresh), self.kind)
            ends = np.cumsum([len(k) // ids.itemsize for k in fresh])
            marks = np.flatnonzero(ids == np.iinfo(self.kind).max)
            of_a, of_b = marks - np.append(0, ends[:-1]), ends - marks - 1
            side = np.repeat(np.tile([0, 2, 1], len(fresh)), np.stack([of_a, np.ones(len(fresh), np.int64), of_b], axis=1).ravel())
            a, b = ids[side == 0], ids[side == 1]
            found = align_windows(a, np.cumsum(of_a), self.a.spelling.lengths[a], b, np.cumsum(of_b), self.b.spelling.lengths[b])
            self.known.update(zip(fresh, range(len(self.windows), len(self.windows) + len(fresh))))
            self.windows.append(found)
            self.held += ids.nbytes + 120 * len(fresh)
            self.solved += len(fresh)
        return np.fromiter((self.known[k] for k in keys), np.int64, len(keys))

    def align(self, texts: pa.Array) -> dict[str, pa.Array]:
        """Per text: n_a, n_b, n_groups, n_links, groups_sha256, distinct `pairs` (A id << 32 | B id) and `times`."""
        if self.held + self.windows.nbytes > self.keep:
            self.known, self.windows, self.held = {}, Windows(), 0
        (a, a_bounds), (b, b_bounds) = self.tokens(texts)
        n_a, n_b, n = np.diff(a_bounds), np.diff(b_bounds), len(texts)
        if not len(a):
            zeros, none = pa.array(np.zeros(n, np.int64)), pa.array([[]] * n, pa.list_(pa.int64()))
            return {"n_a": zeros, "n_b": zeros, "n_groups": zeros, "n_links": zeros, "groups_sha256": pa.array([""] * n), "pairs": none, "times": none}
        a_stops, b_stops = self.anchored(a, a_bounds, b, b_bounds)
        a_sizes, b_sizes = np.diff(a_stops, prepend=0), np.diff(b_stops, prepend=0)
        flat = np.concatenate([a.astype(self.kind), b.astype(self.kind), np.array([np.iinfo(self.kind).max], self.kind)])
        ones = np.ones(len(a_stops), np.int64)
        runs = np.stack([a_stops - a_sizes, len(flat) - ones, len(a) + b_stops - b_sizes], axis=1).ravel()
        sizes = np.stack([a_sizes, ones, b_sizes], axis=1)
        keys = gather(flat, runs, sizes.ravel())
        ends = np.concatenate([[0], np.cumsum(sizes.sum(axis=1))]) * flat.itemsize
        coded = pa.Array.from_buffers(pa.large_binary(), len(a_stops), [None, pa.py_buffer(ends), pa.py_buffer(keys)]).dictionary_encode()
        index = self._numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        self.asked += len(index)
        bounds, known = np.searchsorted(a_stops, a_bounds, "right"), self.windows
        per = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[bounds])
        texts_of = _join_runs(known.texts.take(pa.array(index)), bounds, ";").cast(pa.large_binary())
        digests = [hashlib.sha256(t.as_py()).hexdigest() if k else "" for t, k in zip(texts_of, n_a.tolist())]
        pair_sizes = known.sizes[index]
        first = (np.cumsum(known.sizes) - known.sizes)[index]
        own, times = gather(known.pairs, first, pair_sizes), gather(known.times, first, pair_sizes)
        owner = np.repeat(np.repeat(np.arange(n), np.diff(bounds)), pair_sizes)
        order = np.lexsort((own, owner)) if len(self.b.spelling.lengths) > _STOP or n > 1 << 15 else np.argsort(
            owner << 48 | (own >> 32) << 16 | own & _STOP, kind="stable")
        own, owner, times = own[order], owner[order], times[order]
        new = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (owner[1:] != owner[:-1])))
        lists = pa.array(np.searchsorted(owner[new], np.arange(n + 1)), pa.int32())
        return {
            "n_a": pa.array(n_a), "n_b": pa.array(n_b), "n_groups": pa.array(per(known.groups[index])), "n_links": pa.array(per(known.links[index])), "groups_sha256": pa.array(digests),
            "pairs": pa.ListArray.from_arrays(lists, pa.array(own[new])), "times": pa.ListArray.from_arrays(lists, pa.array(np.add.reduceat(times, new)))}


def aligner(first: str, second: str) -> Aligner:
    """One aligner per worker process and pair of files."""
    if (first, second) not in _ALIGNERS:
        _ALIGNERS[first, second] = Aligner(first, second)
    return _ALIGNERS[first, second]


_COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
_TYPES = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def aligned_documents(docs: DataFrame, first: str, second: str, key: str = "doc_id") -> DataFrame:
    """(`row`, `key`, counts, `groups_sha256`, `pairs`, `times`) of every document; `row` numbers the rows of this run."""

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, row = aligner(first, second), TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                found = both.align(part.column("text"))
                numbers = pa.array(np.arange(row, row + part.num_rows))
                row += part.num_rows
                yield pa.RecordBatch.from_arrays([numbers, part.column(0), *found.values()], ["row", key, *found])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(aligned, f"row long, `{key}` {kind}, {_TYPES}, pairs array<long>, times array<long>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(`pair`, `n_docs`, `best`): documents with each pair, and whether no pair of its A id has more."""
    counts = cut(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n_docs")), "pairs")
    first = F.shiftright("pair", 32)
    most = counts.groupBy(first.alias("a")).agg(F.max("n_docs").alias("most"))
    return counts.join(most, first == F.col("a")).select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def align(docs: DataFrame, first: str, second: str, key: str = "doc_id", hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """`key`, `n_a`, `n_b`, `n_groups`, `n_links`, `n_best`, `count_sum` and `groups_sha256` of every document."""
    table = cut(aligned_documents(docs, first, second, key), "aligned")
    counts = cut(pair_counts(table), "counts")
    rows = counts.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
    hot = counts.filter(F.col("n_docs") > rows // hot_pairs).orderBy("pair").collect()  # fewer than `hot_pairs` rows
    names = np.array([r.pair for r in hot], np.int64)
    worth, best = np.array([r.n_docs for r in hot], np.int64), np.array([r.best for r in hot], bool)
    kind = docs.schema[key].dataType.simpleString()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, times, n = batch.column("pairs"), batch.column("times").flatten().to_numpy(), batch.num_rows
            own, owner = pairs.flatten().to_numpy(), np.repeat(np.arange(n), pc.list_value_length(pairs).to_numpy())
            at = np.minimum(np.searchsorted(names, own), max(len(names) - 1, 0))
            known = names[at] == own if len(names) else np.zeros(len(own), bool)
            links = times * known
            sums, tops = np.zeros(n, np.int64), np.zeros(n, np.int64)
            if len(names):
                np.add.at(sums, owner, links * worth[at])
                np.add.at(tops, owner, links * best[at])
            bounds = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner[~known], minlength=n))]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("row", key, *_COLUMNS)] + [pa.array(tops), pa.array(sums), *(
                    pa.ListArray.from_arrays(bounds, pa.array(v[~known])) for v in (own, times))],
                ["row", key, *_COLUMNS, "n_best", "count_sum", "pairs", "times"])

    partly = cut(table.mapInArrow(summed, f"row long, `{key}` {kind}, {_TYPES}, n_best long, count_sum long, pairs array<long>, times array<long>"), "partly")
    rest = partly.filter(F.size("pairs") > 0).select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), "x.times")
    others = rest.join(counts.filter(F.col("n_docs") <= rows // hot_pairs), "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n_docs")).alias("more_sum"))
    out = partly.join(others, "row", "left")
    total = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).cast("long").alias(a)
    return out.select(key, "n_a", "n_b", "n_groups", "n_links", total("n_best", "more_best"), total("count_sum", "more_sum"), "groups_sha256")
