"""Impact lists, URL vocabulary and token alignment against plain recomputation."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from cases import SF, TRICKY, rows
from strandgraph.llm import alignment, lexical_search, queries, url_filters

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_ranks(docs, items, k=10):
    held = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    total, length, df = len(held), sum(sum(c.values()) for _, c in held), Counter(t for _, c in held for t in c)
    weight = {t: math.floor(1000 * math.log((2 * total + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in sorted(set(items), key=str):
        scores = []
        for d, c in held:
            m = 100 - 75 + (75 * sum(c.values()) * total) // length
            s = sum(weight[t] * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in TERM.findall((text or "").translate(LOWER)) if t in c)
            if s > 0:
                scores.append((-s, d is None, d if d is not None else 0))
        out += [(item, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:k])]
    return out


def ranked(found):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found), key=str)


def test_lexical_search(spark, monkeypatch):
    rnd = random.Random(5)
    words = [f"w{int(rnd.paretovariate(0.6)) % 300}" for _ in range(4000)] + ["Ünï", "X9", "x9"]
    docs = TRICKY + [(100 + i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 60)))) for i in range(700)]
    docs += [(900, docs[20][1]), (901, docs[20][1]), (902, "W1-w2,w3\nÜnï x9"), (None, "w1 w2")]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 40)))) for i in range(30)]
    items += [(50, "w1 w1 w1 repeat REPEAT"), (51, ""), (52, None), (53, "nowhere"), (54, docs[20][1]), (54, docs[20][1]), (None, "w7 word"), (55, "... !"), (56, "w5 " * 5000)]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, score int, rank string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(plain_ranks(docs, items), key=str)
    assert ranked(rows(lexical_search.search(df, asked))) == want
    # small shards, deep reads and several blocks of queries give the same ranks
    monkeypatch.setattr(lexical_search, "SHARD_DOCS", 64)
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", 1_000)
    monkeypatch.setattr(lexical_search, "FIRST_DEPTH", 2)
    assert ranked(rows(lexical_search.search(df, asked))) == want
    assert lexical_search.search(df.limit(0), asked).count() == 0 and lexical_search.search(df, asked.limit(0)).count() == 0


def test_lists_are_read_only_as_far_as_needed():
    import numpy as np

    n, owner = np.full(10_000, 100), np.arange(10_000)
    counts = np.ones(10_000, np.int64)
    counts[:10] = np.arange(40, 50)
    shard = lexical_search.Shard(n, owner, np.zeros(10_000, np.int64), counts, np.array([1000]), 10_000, 1_000_000)
    read = []
    whole = shard.impacts

    class Watched:
        def __getitem__(self, at):
            read.append(at.stop if isinstance(at, slice) else int(at) + 1)
            return whole[at]

    shard.impacts = Watched()
    found, scores = shard.search([(0, 1)], 10, 0)
    assert sorted(found.tolist()) == list(range(10)) and max(read) <= 65 and (scores == whole[:10][np.argsort(shard.docs[:10])]).all()


def test_lexical_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert ranked(rows(queries.op11_impact_lists(spark, SF))) == sorted(plain_ranks(docs, items), key=str)


def test_url_vocabulary(spark):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("a.b", "", "block")]
    want = {
        "http://x.org/porn": ("x.org", "/porn", "org/", "allow", 1, 0), "HTTP://Example.ORG/es/a?q": ("example.org", "/es/a", "example.org/es/", "block", 0, 0),
        "http://www.example.org/en/12#x": ("www.example.org", "/en/12", "example.org/en/1", "block", 0, 0), "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow", 0, 0),
        "http://example.org": ("example.org", "", None, "allow", 0, 0), "http://a.com/fr/sex-poker": ("a.com", "/fr/sex-poker", "com/fr/", "allow", 0, 2),
        "http://a.com/FR/x": ("a.com", "/FR/x", None, "allow", 0, 0), "x.net/xxx": ("", "", None, "block", 1, 0), None: ("", "", None, "allow", 0, 0), "": ("", "", None, "allow", 0, 0),
        "http://essex.net/bethany/hotel": ("essex.net", "/bethany/hotel", None, "allow", 0, 0), "http://h.net?a=hot/b": ("h.net", "", None, "allow", 0, 1),
        "http://h.net/hot/hot-HOT": ("h.net", "/hot/hot-HOT", None, "allow", 0, 1), "http://h.net/18hot_teen3": ("h.net", "/18hot_teen3", None, "block", 0, 2),
        "http://h.net/éhot/teen": ("h.net", "/éhot/teen", None, "allow", 0, 1), "a://b://c/d": ("b:", "//c/d", None, "allow", 0, 0), "s://q.a.b": ("q.a.b", "", "a.b", "block", 0, 0),
        "http://h.net/" + "xy/" * 50_000 + "porn": ("h.net", "/" + "xy/" * 50_000 + "porn", None, "block", 1, 0),
    }
    data = [(i, u, "old", 5) for i, u in enumerate(want)] * 2
    df = spark.createDataFrame(data, "page_id long, url string, host string, n_soft int")
    got = rows(url_filters.judge(df, rules))
    assert len(got) == 2 * len(want)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"], r["n_strict"], r["n_soft"]) == want[r["url"]], r["url"][:80]
    assert url_filters.judge(df.limit(0)).count() == 0
    assert {r["verdict"] for r in rows(url_filters.judge(df.filter("url like '%xxx'"), [], [], []))} == {"allow"}


def plain_tokens(tokenizer, model, text):
    """(id, bytes) of both sides from whole texts, or nothing."""
    if not text:
        return [], []
    letters = alignment.byte_letters()
    a = [(i, bytes(letters[c] for c in tokenizer.id_to_token(i))) for i in tokenizer.encode(" " + text, add_special_tokens=False).ids]
    piece = lambda p: bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()
    b = [(i, piece(model.id_to_piece(i))) for i in model.encode(text)]
    whole = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])


def plain_alignment(docs, tokenizer, model):
    out, held = [], defaultdict(int)
    for d, text in docs:
        a, b = plain_tokens(tokenizer, model, text)
        ends = [[sum(len(x) for _, x in side[: i + 1]) for i in range(len(side))] if len(side) < 2000 else running(side) for side in (a, b)]
        shared = sorted(set(ends[0]) & set(ends[1]))
        groups, i, j = [], 0, 0
        for e in shared:
            p, q = ends[0].index(e, i) + 1, ends[1].index(e, j) + 1
            groups.append(([x for x, _ in a[i:p]], [x for x, _ in b[j:q]]))
            i, j = p, q
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        for pair in links:
            held[pair] += 1
        out.append((d, len(a), len(b), groups, links))
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    sha = lambda g: hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g).encode()).hexdigest() if g else ""
    return sorted((str(d), n, m, len(g), sum(c.values()), sum(t for p, t in c.items() if held[p] == most[p[0]]), sum(t * held[p] for p, t in c.items()), sha(g))
                  for d, n, m, g, c in out)


def running(side):
    total, out = 0, []
    for _, x in side:
        total += len(x)
        out.append(total)
    return out


@pytest.fixture(scope="module")
def both():
    import public_tokenizers as P
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path(queries.BYTES))
    tokenizer.encode_special_tokens = True
    return tokenizer, SentencePieceProcessor(model_file=P.path(queries.PIECES))


def aligned(found):
    return sorted((str(r["doc_id"]), r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in found)


ODD = ["it's we'll don't", " lead", "  two  blanks ", "trail ", "tab\there \n new\n\n line", "a\u00a0b c\u2003d e\u3000f\u2028g", "汉字 漢字 テスト 한국어", "emoji 😀😀 👩‍👩‍👧 x", "▁ under▁score ▁", "é è “q” – dash", "\x00 nul \x7f x",
       "<s> </s> <unk> <0x41> <|endoftext|>", "x" * 3000, "ab " * 3000, " " * 700, "don't' 's 're", "1234567890 12 3.14", "\r\n a\r\n", "a\x85b \x85 c", "क़. שׁ!", "A\u1680B \u1680 C", "q\u200b w \ufeff e"]


def test_token_alignment(spark, both):
    import public_tokenizers as P

    rnd = random.Random(12)
    docs = TRICKY + [(100 + i, t) for i, t in enumerate(ODD)]
    docs += [(300 + i, "".join(rnd.choice("ab é\n.'😀x  汉") for _ in range(rnd.randrange(80)))) for i in range(120)]
    df = spark.createDataFrame([(d, t, 3, [1]) for d, t in docs], "doc_id long, text string, row int, pairs array<int>").repartition(3)
    paths = P.path(queries.BYTES), P.path(queries.PIECES)
    want = plain_alignment(docs, *both)
    assert aligned(rows(alignment.align(df, *paths))) == want
    assert aligned(rows(alignment.align(df, *paths, hot_pairs=5))) == want  # nearly all pairs by shuffle
    assert alignment.align(df.limit(0), *paths).count() == 0
    blank = alignment.align(df.filter("doc_id in (2, 3)"), *paths)
    assert [r[1:] for r in aligned(rows(blank))] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_token_alignment_table(spark, both):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert aligned(rows(queries.op12_token_alignment(spark, SF))) == plain_alignment(docs, *both)


def test_windows_are_remembered(both):
    import public_tokenizers as P
    import pyarrow as pa

    own = alignment.Aligner(P.path(queries.BYTES), P.path(queries.PIECES))
    own.align(pa.array(["one two three one two three"] * 3))
    assert own.asked == 18 and own.solved == 3
    own.keep = 0
    assert own.align(pa.array(["one two"]))["n_groups"].to_pylist() == [2] and own.solved == 5
