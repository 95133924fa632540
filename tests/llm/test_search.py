"""Piece encoding against the library, metric-tree search against brute force, revisits against a plain version."""

import datetime
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cases import SF, TRICKY, rows
from strandgraph.llm import metric_tree, queries, suffix_pieces, warc_revisits


@pytest.fixture(scope="module")
def model():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def test_pieces_equal_library(spark, model):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model)
    rnd = random.Random(1)
    texts = [t for _, t in TRICKY] + [" ", "   a  b ", "▁", "a▁ b", "日本 😀 x", "aaab" * 700, "<s></s><unk><0x41>", "=" * 400, " \n \n  ", "\xa0\x01"]
    texts += ["".join(rnd.choice("abcde ▁é\n日😀12") for _ in range(rnd.randrange(80))) for _ in range(400)]
    df = spark.createDataFrame([(i, t, [i]) for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>")
    encoded = suffix_pieces.encode_documents(df, model)
    got = {r["doc_id"]: r["ids"] for r in rows(encoded)}
    assert got == {i: library.encode(t or "") for i, t in enumerate(texts)}
    decoded = {r["doc_id"]: r["text"] for r in rows(suffix_pieces.decode_documents(encoded, model))}
    assert decoded == {i: library.decode(library.encode(t or "")) for i, t in enumerate(texts)}
    assert suffix_pieces.decode_documents(suffix_pieces.encode_documents(df.limit(0), model), model).count() == 0


def test_pieces_table(spark, model):
    import hashlib

    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op4_suffix_pieces(spark, SF).collect():
        assert r.n_ids == len(library.encode(texts[r.doc_id]))
        assert r.decoded_md5 == hashlib.md5(texts[r.doc_id].encode()).hexdigest()


def test_unigram_relaxation():
    """Best scores equal those of a plain Viterbi over all segmentations."""
    rnd = random.Random(2)
    words = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randrange(2, 5))) for _ in range(14)})
    pieces = ["<unk>", "a", "b", "▁", "▁a", *words]
    scores = [0.0, *[-rnd.random() * 9 for _ in pieces[1:]]]
    enc = suffix_pieces.PieceEncoder(pieces, scores, [2] + [1] * (len(pieces) - 1), True, False)
    value = dict(zip(pieces[1:], scores[1:]))
    texts = ["".join(rnd.choice("aabbc ") for _ in range(rnd.randrange(1, 30))) for _ in range(200)]
    ids, bounds = enc.encode(pa.array(texts))
    for i, t in enumerate(texts):
        s = "▁" + t.replace(" ", "▁")
        best = [0.0] + [-np.inf] * len(s)
        for e in range(1, len(s) + 1):
            best[e] = best[e - 1] + min(scores[1:]) - 10
            for b in range(max(0, e - 4), e):
                if s[b:e] in value:
                    best[e] = max(best[e], best[b] + value[s[b:e]])
        own = ids[bounds[i] : bounds[i + 1]].tolist()
        assert "".join("?" if x == 0 else pieces[x] for x in own) == s.replace("c", "?")
        assert abs(sum(scores[x] if x else min(scores[1:]) - 10 for x in own) - best[-1]) < 1e-6


def test_suffix_array():
    codes = np.random.default_rng(3).integers(0, 3, 200)
    order = suffix_pieces.suffix_array(codes, 8).tolist()
    assert [codes[i : i + 8].tolist() for i in order] == sorted(codes[i : i + 8].tolist() for i in range(200))


def brute_top(vectors, k):
    out = []
    for q, v in vectors:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, x)), i) for i, x in vectors if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard", [30, 20_000])
def test_metric_tree(spark, monkeypatch, shard):
    monkeypatch.setattr(metric_tree, "SHARD_ROWS", shard)
    monkeypatch.setattr(metric_tree, "ROWS_PER_PIVOT", 90)
    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(5, 6)) * 3
    data = [(i, [float(x) for x in centres[i % 5] + rnd.normal(size=6) * (0.1 if i % 3 else 2)]) for i in range(400)]
    data += [(1000 + i, [0.5, -0.25, 1.0, 0.0, 0.0, 0.1]) for i in range(200)]  # one very common vector
    data += [(2000, [1.0, 2.0]), (2050, []), (2100, [0.0] * 6)]
    odd = [(3000, None), (3050, [1.0, None]), (3100, [float("nan")] * 6), (None, [1.0] * 6), (3150, [float("inf")] * 6)]
    table = spark.createDataFrame([(i, v, 1, "p") for i, v in data + odd], "vec_id long, embedding array<double>, id int, pivot string")
    vectors = metric_tree.integer_vectors(table, "vec_id", "embedding")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows(metric_tree.top_inner_products(vectors, F.col("id") % 50 == 0, 5)))
    assert got == brute_top([(i, [int(np.floor(256 * x)) for x in v]) for i, v in data], 5)
    few = metric_tree.top_inner_products(vectors.filter("id in (2000, 2050)"), F.col("id") % 50 == 0, 5)
    assert sorted(r["rank"] for r in rows(few)) == [1, 1]
    assert metric_tree.top_inner_products(vectors.limit(0), F.col("id") % 50 == 0, 5).count() == 0


def test_tree_skips_distances():
    rnd = np.random.default_rng(5)
    points = np.concatenate([rnd.normal(c, 3, (500, 2)) for c in ((0, 900), (900, 0), (-900, 0), (0, -900))]).astype(np.int64)
    most = int((points * points).sum(axis=1).max())
    tree, query = metric_tree.MTree(points, most), np.array([[0, 900]])
    worst, best = np.array([np.inf]), []

    def answer(asked, found, apart):
        best.extend(zip((points[found] @ query[0]).tolist(), found.tolist()))
        best.sort(reverse=True)
        del best[5:]
        worst[0] = np.sqrt(max(900 * 900 + most - 2 * best[-1][0], 0)) if len(best) == 5 else np.inf

    tree.search(query, worst, answer)
    assert [s for s, _ in best] == sorted((points @ query[0]).tolist(), reverse=True)[:5]
    assert tree.computed < 1000


def when(second):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=second)


def test_revisits(spark):
    page = lambda i, uri, s, tags, body="b": (i, "response", uri, when(s), 200, tags, body)
    back = lambda i, uri, s, tags: (i, "revisit", uri, None if s is None else when(s), 304, tags, None)
    a = "http://www.A.example:80/x/?b=2&a=1&utm_source=q#top"
    records = [
        page("1", a, 10, [("ETag", '"one"'), ("Content-Type", "t"), ("Vary", "v")]), page("2", "https://a.example/x?a=1&b=2", 20, [("etag", 'W/"two"'), ("Expires", "e")]),
        page("2b", "https://a.example/x?a=1&b=2", 20, [("etag", '"low"')], "c"), (None, "response", a, when(25), 404, [], "gone"), page("3", a, 30, None, None),
        back("4", a, 20, [("Etag", '"one"'), ("content-length", "0"), ("VARY", "w")]), back("5", "HTTP://a.example/x/?a=1&b=2", 40, [("ETAG", '"low"'), (None, "x"), ("Date", "d")]),
        back("6", a, 40, [("ETag", '"else"')]), back("7", a, 40, [("Last-Modified", "m")]), back("8", a, 5, [("ETag", '"one"')]), back("9", None, 5, None), back("10", a, None, None),
        back("11", "not a url", 50, []), back("11", "not a url", 50, []),
        page("12", "http://b.example", 1, [("last-modified", "m")]), back("13", "http://b.example/", 2, [("Last-Modified", "m"), ("X", "y")]),
    ]
    hot = [page("h", "http://c.example/", 100, [("ETag", "t")])] + [back(f"h{i}", "http://c.example/", 100 + i, [("ETag", "t")]) for i in range(1, 300)]
    schema = ("record_id string, warc_type string, target_uri string, warc_date timestamp, status int, headers array<struct<name:string,value:string>>, "
              "payload string, url int, range string")
    df = spark.createDataFrame([(*r, 1, "x") for r in records + hot], schema)
    resolved = warc_revisits.resolve(df)
    got = {}
    for r in rows(resolved):
        got.setdefault(r["record_id"], []).append((r["resolution"], r["response_id"], [(h["name"], h["value"]) for h in r["headers"] or []]))
    assert got["4"] == [("resolved", "1", [("content-type", "t"), ("etag", '"one"'), ("vary", "w")])]
    assert got["5"] == [("resolved", "2b", [("etag", '"low"'), ("date", "d")])]
    assert got["6"] == [("validator_mismatch", None, [])] and got["7"] == [("no_validator", None, [])]
    assert all(got[i] == [("no_response", None, [])] for i in ("8", "9", "10")) and len(got["11"]) == 2
    assert got["13"] == [("resolved", "12", [("last-modified", "m")])]
    assert all(got[f"h{i}"][0][:2] == ("resolved", "h") for i in range(1, 300)) and len(got) == 9 + 299
    bodies = {r["record_id"]: r["payload"] for r in rows(warc_revisits.with_payload(resolved, df))}
    assert bodies["5"] == "c" and bodies["4"] == bodies["h7"] == "b" and len(bodies) == 302
    assert warc_revisits.resolve(df.limit(0)).count() == 0
