"""A file format for token ids: blocks of fixed size, cut into bit or byte planes.

A block of ids is written as 32 unsigned bits each, transposed so that plane k holds bit (or byte) k
of every id, and each plane is compressed with zstandard; high planes nearly vanish. Files are
Parquet containers with one row per block: the planes and, as the chunk index, which documents
start in the block, where, and how long they are. The index is read without the planes. Rows go to
range partitions by document id, one shard a partition, so ids stand in ascending order of doc_id
and a lost task is simply written again.

Edge cases: a null or empty text holds the end id alone; a null doc_id sorts first; documents with
one doc_id, even equal rows, follow each other in any order, each with its own ids; an empty table
gives an empty store. A document may span any number of blocks. Other columns are never read.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .word_bpe import encoder, slices

BLOCK_SCHEMA = (
    "shard int, block long, n_ids int, planes array<binary>, first_ordinal long, head int, "
    "doc_ids array<long>, doc_starts array<long>, doc_tokens array<long>"
)
_PART_SCHEMA = "shard int, ordinal long, place long, doc_id long, local_start long, n_tokens long, crc long, part binary"


def to_planes(ids: np.ndarray, mode: str = "byte", level: int = 3) -> list[bytes]:
    """Compressed planes of a block: 4 byte planes or 32 bit planes, lowest first."""
    import zstandard

    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if mode == "bit":
        planes = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1)
    else:
        planes = np.ascontiguousarray(raw.T)
    press = zstandard.ZstdCompressor(level=level)
    return [press.compress(p.tobytes()) for p in planes]


def from_planes(planes: list[bytes], n_ids: int) -> np.ndarray:
    """The ids of a block; the number of planes tells the mode."""
    import zstandard

    if not n_ids:
        return np.zeros(0, "<u4")
    press = zstandard.ZstdDecompressor()
    raw = np.stack([np.frombuffer(press.decompress(p), np.uint8) for p in planes])
    if len(planes) == 32:
        bits = np.unpackbits(raw, axis=1)[:, :n_ids]
        raw = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").T
    return np.ascontiguousarray(raw.T).view("<u4").ravel()


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, block: int = 1 << 16, mode: str = "byte") -> None:
    """Encode documents and write their ids below `path`."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = encoder(tokenizer), TaskContext.get().partitionId()
        schema = pa.schema([
            ("shard", pa.int32()), ("block", pa.int64()), ("n_ids", pa.int32()), ("planes", pa.list_(pa.binary())),
            ("first_ordinal", pa.int64()), ("head", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
            ("doc_starts", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64()))])
        held, docs_held, done, number, ordinal = np.zeros(0, np.uint32), [], 0, 0, 0

        def row(ids: np.ndarray, own: list, first: int) -> pa.RecordBatch:
            head = (own[0][1] - number * block) if own else len(ids)
            return pa.RecordBatch.from_pylist([{
                "shard": shard, "block": number, "n_ids": len(ids), "planes": to_planes(ids, mode), "first_ordinal": first,
                "head": head, "doc_ids": [d[0] for d in own], "doc_starts": [d[1] for d in own],
                "doc_tokens": [d[2] for d in own]}], schema)

        for batch in batches:
            for part in slices(batch):
                ids, bounds = enc.encode(part.column("text"))
                counts = np.diff(bounds) + 1
                full = np.full(len(ids) + part.num_rows, end_id, np.uint32)
                keep = np.ones(len(full), bool)
                keep[np.cumsum(counts) - 1] = False
                full[keep] = ids
                starts = done + len(held) + np.cumsum(counts) - counts
                docs_held += list(zip(part.column("doc_id").to_pylist(), starts.tolist(), counts.tolist()))
                held = np.concatenate([held, full])
                while len(held) >= block:
                    own = [d for d in docs_held if d[1] < done + block]
                    yield row(held[:block], own, ordinal)
                    docs_held, ordinal = docs_held[len(own) :], ordinal + len(own)
                    held, done, number = held[block:], done + block, number + 1
        if len(held):
            yield row(held, docs_held, ordinal)

    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.monotonically_increasing_id()]
    ordered = docs.select("doc_id", "text").repartitionByRange(*keys).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    ordered.mapInArrow(blocks, BLOCK_SCHEMA).write.option("compression", "uncompressed").parquet(path)


def _offsets(store: DataFrame) -> DataFrame:
    """Ids before each shard: one row a shard."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return store.groupBy("shard").agg(F.sum("n_ids").alias("n")).select(
        "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))


def index(spark: SparkSession, path: str) -> DataFrame:
    """(`doc_id`, `start`, `n_tokens`) from the chunk index alone."""
    store = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    rows = store.select("shard", F.explode(F.arrays_zip("doc_ids", "doc_starts", "doc_tokens")).alias("d"))
    return rows.join(_offsets(store), "shard").select(
        F.col("d.doc_ids").alias("doc_id"), (F.col("shard_start") + F.col("d.doc_starts")).alias("start"),
        F.col("d.doc_tokens").alias("n_tokens"))


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decoded blocks, cut at document borders. A document inside one block is summed up at once;
    the pieces of the others carry their ids."""
    for batch in batches:
        for b in batch.to_pylist():
            raw = memoryview(from_planes(b["planes"], b["n_ids"]).tobytes())
            out = []
            if b["head"]:
                out.append((b["first_ordinal"] - 1, b["block"], None, None, None, None, bytes(raw[: 4 * b["head"]])))
            at = b["head"]
            for i, (doc, start, n) in enumerate(zip(b["doc_ids"], b["doc_starts"], b["doc_tokens"])):
                piece = raw[4 * at : 4 * (at + n)]
                whole = at + n <= b["n_ids"]
                out.append((b["first_ordinal"] + i, b["block"], doc, start, n, zlib.crc32(piece) if whole else None, None if whole else bytes(piece)))
                at += n
            cols = list(zip(*out)) if out else [()] * 7
            types = [pa.int64()] * 6 + [pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([b["shard"]] * len(out), pa.int32()), *[pa.array(c, t) for c, t in zip(cols, types)]],
                ["shard", "ordinal", "place", "doc_id", "local_start", "n_tokens", "crc", "part"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document; checksums of documents cut by block borders run over their pieces in order."""
    names = ["shard", "doc_id", "local_start", "n_tokens", "ids_crc32"]
    schema = pa.schema([("shard", pa.int32()), *[(n, pa.int64()) for n in names[1:]]])
    last, held = None, None
    for batch in batches:
        done = []
        for shard, ordinal, _, doc, start, n, crc, part in zip(*[c.to_pylist() for c in batch.columns]):
            if (shard, ordinal) != last:
                done += [held] if held else []
                last, held = (shard, ordinal), [shard, doc, start, n, crc or 0]
            if crc is None:
                held[4] = zlib.crc32(part, held[4])
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], f.type) for i, f in enumerate(schema)], schema=schema)
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(names, held))], schema)


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(`doc_id`, `start`, `n_tokens`, `ids_crc32`) of every document, from the decoded blocks."""
    store = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    pieces = store.mapInArrow(_fragments, _PART_SCHEMA).repartition("shard", "ordinal")
    rows = pieces.sortWithinPartitions("shard", "ordinal", "place").mapInArrow(
        _joined, "shard int, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    return rows.join(_offsets(store), "shard").select(
        "doc_id", (F.col("shard_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
