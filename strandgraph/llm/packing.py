"""Best-fit packing by exact complements.

Texts are encoded once into pieces no longer than a sequence; only (length, count) pairs decide the
packing. The plan is made on that histogram, whose size is bounded by the sequence length: for each
length, largest first, an index of single, pair and triple length sums is asked for a combination
that fills the gap exactly, and as many sequences are filled with it as the counts allow. What finds
no exact filling is packed by best fit, decreasing. The plan is a list of runs "the pieces of length
L ranked r..r+n stand at offset o of sequences s..s+n"; each piece finds its run by its rank among the
pieces of its length, counted per bucket so that a frequent length is never one group.

Edge cases: a null or empty text is the end id alone (one piece of length 1); a text longer than a
sequence is cut, only its last piece being shorter; repeated rows and repeated or null ids are packed
as separate pieces; an empty table gives no rows. Other columns are never read.
"""

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut
from .word_bpe import encoder, slices

_BUCKET_ROWS = 2_000
_RANKS = 1 << 44


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0) -> DataFrame:
    """(`doc_id`, `piece`, `start`, `length`, `ids_crc32`): each text's ids and the end id, cut at `capacity`."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for part in slices(batch):
                ids, bounds = enc.encode(part.column("text"))
                out = []
                for doc, a, b in zip(part.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                    own = np.append(ids[a:b], end_id).astype("<u4")
                    for k, start in enumerate(range(0, len(own), capacity)):
                        piece = own[start : start + capacity]
                        out.append((doc, k, start, len(piece), zlib.crc32(piece.tobytes())))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), types)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut_up, "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Runs:
    """Runs of sequences written so far: (length, first rank, count, first sequence, offset)."""

    def __init__(self, counts: np.ndarray):
        self.left, self.used, self.rows, self.sequences = counts.copy(), np.zeros_like(counts), [], 0

    def place(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.rows.append((length, int(self.used[length]), count, sequence, offset))
        self.used[length] += count
        self.left[length] -= count

    def open(self, lengths: list[int], count: int) -> int:
        first, offset = self.sequences, 0
        for length in lengths:
            self.place(length, count, first, offset)
            offset += length
        self.sequences += count
        return first


def _fill(left: np.ndarray, length: int, gap: int) -> list[int] | None:
    """Up to three available lengths that with one more of `length` sum to `gap` exactly, few and long first."""
    have = left.copy()
    have[length] -= 1
    lengths = np.arange(len(have))
    mask = have > 0
    if mask[gap]:
        return [gap]
    half = np.arange(gap // 2 + gap % 2, gap)
    pairs = half[mask[half] & mask[gap - half] & ((half * 2 != gap) | (have[half] > 1))]
    if len(pairs):
        return [int(pairs[-1]), gap - int(pairs[-1])]
    sums = np.convolve(mask[: gap + 1].astype(np.float32), mask[: gap + 1].astype(np.float32))[: gap + 1] > 0.5
    longest = lengths[1:gap][mask[1:gap]]
    for a in longest[::-1]:
        rest = gap - int(a)
        if a * 3 < gap:
            break
        if not sums[rest]:
            continue
        b = lengths[(rest + 1) // 2 : min(int(a), rest - 1) + 1]
        need_a, need_b = 1 + (b == a), 1 + (rest - b == b) + (b == a)
        ok = mask[b] & mask[rest - b] & (have[b] >= need_b) & (have[a] >= need_a + (rest - b == a))
        if ok.any():
            best = int(b[ok][-1])
            return [int(a), best, rest - best]
    return None


def plan(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, count, first sequence, offset) and the number of sequences.
    `counts[n]` is the number of pieces of length n."""
    runs = _Runs(counts)
    for length in range(capacity, 0, -1):
        while runs.left[length] > 0:
            if length == capacity:
                runs.open([length], int(runs.left[length]))
                continue
            filling = _fill(runs.left, length, capacity - length)
            if filling is None:
                break
            bins = min(int(runs.left[n]) // k for n, k in Counter([length, *filling]).items())
            runs.open([length, *filling], bins)
    open_bins: dict[int, list[tuple[int, int]]] = {}  # free space: (first sequence, count)
    for length in range(capacity - 1, 0, -1):
        while runs.left[length] > 0:
            space = min((s for s in open_bins if s >= length), default=None)
            if space is None:
                per = capacity // length
                bins = max(1, int(runs.left[length]) // per)
                each = min(per, int(runs.left[length]))
                first = runs.open([length] * each, bins)
                space_left, fresh = capacity - each * length, (first, bins)
            else:
                first, have = open_bins[space].pop()
                bins = min(have, int(runs.left[length]))
                runs.place(length, bins, first, capacity - space)
                if have > bins:
                    open_bins[space].append((first + bins, have - bins))
                if not open_bins[space]:
                    del open_bins[space]
                space_left, fresh = space - length, (first, bins)
            if space_left:
                open_bins.setdefault(space_left, []).append(fresh)
    return np.array(runs.rows, dtype=np.int64).reshape(-1, 5), runs.sequences


def pack(items: DataFrame, capacity: int) -> DataFrame:
    """`items` (written table with `length`, 1 to `capacity`) with `sequence_id` and `offset`."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in items.groupBy("length").count().collect():  # at most `capacity` rows
        counts[length] = n
    runs, _ = plan(counts, capacity)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    keys = runs[:, 0] * _RANKS + runs[:, 1]
    buckets = int(counts.sum()) // _BUCKET_ROWS + 1
    group = [F.col("length"), F.col("bucket")]
    spread = items.withColumn("bucket", F.pmod(F.xxhash64(*items.columns), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = spread.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).select(
        *group, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = [F.col(c) for c in items.columns if c != "length"]
    ranked = spread.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1)
    placed = ranked.join(bases, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("base")).drop("bucket", "base")

    names = items.columns

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            run = np.searchsorted(keys, length * _RANKS + rank, "right") - 1
            found = {"sequence_id": runs[run, 3] + rank - runs[run, 1], "offset": runs[run, 4]}
            columns = [batch.column(c) for c in names] + [pa.array(v) for v in found.values()]
            yield pa.RecordBatch.from_arrays(columns, [*names, *found])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    return placed.mapInArrow(find, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of all documents with their places; `pieces` are written once, so texts are encoded once."""
    return pack(cut(pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)
