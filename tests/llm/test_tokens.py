"""Packing, token counts and the plane store against plain recomputation."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from cases import SF, TRICKY, rows
from strandgraph.llm import packing, plane_store, queries, token_counts


def ids_of(tokenizer, text, end):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.fixture(scope="module")
def tokenizer(vocabulary):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


@pytest.fixture(scope="module")
def tricky(spark):
    return spark.createDataFrame([(d, t, "x") for d, t in TRICKY], "doc_id long, text string, length string")


def check_packing(out, texts, tokenizer, capacity):
    want = sorted(
        (doc if doc is not None else -1, k, s, len(ids[s : s + capacity]), crc(ids[s : s + capacity]))
        for doc, text in texts for ids in [ids_of(tokenizer, text, 0)] for k, s in enumerate(range(0, len(ids), capacity)))
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out)
    assert got == want
    places = defaultdict(list)
    for r in out:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in places.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= capacity
    return len(places), -(-sum(w[3] for w in want) // capacity)


def test_packing_tricky(spark, tricky, vocabulary, tokenizer):
    check_packing(rows(packing.pack_documents(tricky, vocabulary, 64)), TRICKY, tokenizer, 64)
    assert packing.pack_documents(tricky.limit(0), vocabulary, 64).count() == 0


def test_packing_table(spark, tokenizer):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    used, least = check_packing(rows(queries.op3_best_fit_packing(spark, SF)), texts, tokenizer, 2048)
    assert used <= least * 1.02 + 1


def test_plan_fills_exactly():
    counts = np.zeros(11, np.int64)
    counts[[7, 3, 5, 2, 1]] = [4, 4, 2, 3, 4]  # 7+3, 5+5, 2+2+... leaves 10 tokens: one sequence
    runs, sequences = packing.plan(counts, 10)
    assert sequences == 6 and sum(r[2] for r in runs) == counts.sum()


@pytest.mark.parametrize("mode", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 65536])
def test_planes_round_trip(mode, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint64).astype("<u4")
    assert (plane_store.from_planes(plane_store.to_planes(ids, mode), n) == ids).all()


@pytest.mark.parametrize("mode,block", [("byte", 64), ("bit", 1000)])
def test_store_tricky(spark, tricky, vocabulary, tokenizer, folder, mode, block):
    plane_store.write(tricky, folder, vocabulary, block=block, mode=mode)
    out = sorted(rows(plane_store.read_checksums(spark, folder)), key=lambda r: r["start"])
    start = 0
    assert [r["doc_id"] for r in out] == [None, 1, 2, 3, 4, 5, 5, 6, 7, 8, 9]
    texts = {d: t for d, t in TRICKY}
    for r in out:
        ids = ids_of(tokenizer, texts[r["doc_id"]], 2)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), crc(ids))
        start += len(ids)
    assert sorted(map(str, rows(plane_store.index(spark, folder)))) == sorted(
        str({k: r[k] for k in ("doc_id", "start", "n_tokens")}) for r in out)


def test_store_empty(spark, tricky, vocabulary, folder):
    plane_store.write(tricky.limit(0), folder, vocabulary)
    assert plane_store.read_checksums(spark, folder).count() == 0


def test_store_table(spark, tokenizer):
    start = 0
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op9_plane_store(spark, SF).orderBy("doc_id").collect():
        ids = ids_of(tokenizer, texts[r.doc_id], 2)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)


def test_counts(spark, tricky):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoding = token_counts._encoding(path, public_tokenizers.PATTERN)
    for docs in (tricky, spark.read.parquet(f"{SF}/documents.parquet"), tricky.limit(0)):
        own = sorted(len(encoding.encode_ordinary(r.text or "")) for r in docs.collect())
        sums = token_counts.suffix_sums(token_counts.histogram(token_counts.encoded_lengths(docs, path, public_tokenizers.PATTERN)))
        got = {r.length: r for r in sums.collect()}
        assert sorted(got) == sorted(set(own))
        for length, r in got.items():
            assert r.n_docs == own.count(length) and r.total_tokens == sum(own) and r.total_docs == len(own)
            assert r.docs_longer == sum(n > length for n in own) and r.tokens_longer == sum(n for n in own if n > length)
            assert r.tokens_kept == sum(min(n, length) for n in own)
        limits = [0, 1, 5, 100, 2048, 10**6]
        kept = {r.context: r for r in token_counts.kept_at(sums, limits).collect()}
        for c in limits:
            assert (kept[c].docs_cut, kept[c].tokens_kept) == (sum(n > c for n in own), sum(min(n, c) for n in own))
        for r in token_counts.quantiles(sums, [0.5, 0.9, 1.0]).collect():
            assert r.length == own[-(-int(r.share * 1000) * len(own) // 1000) - 1]
