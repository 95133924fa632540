"""Jaccard join against all pairs, and components against union-find."""

import random
import re
from collections import defaultdict

import pytest

from cases import SF, rows
from strandgraph.llm import jaccard_join
from strandgraph.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingle_set(text):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs, threshold=0.8):
    """n_links and class id of every document, in order."""
    sets = [shingle_set(t) for _, t in docs]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    common = defaultdict(int)
    for ids in holders.values():
        for k, i in enumerate(ids):
            for j in ids[:k]:
                common[i, j] += 1
    links, up = [0] * len(docs), list(range(len(docs)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (i, j), n in common.items():
        if n >= threshold * (len(sets[i]) + len(sets[j]) - n):
            links[i] += 1
            links[j] += 1
            up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        r = root(i)
        least[r] = min(least.get(r, (True, None)), (d is None, d), key=lambda x: (x[0], x[1] or 0))
    return [(str(docs[i][0]), str(least[root(i)][1]), links[i]) for i in range(len(docs))]


def check(spark, docs):
    df = spark.createDataFrame([(d, t, "z", 1) for d, t in docs], "doc_id long, text string, class string, id int")
    got = sorted((str(r["doc_id"]), str(r["class_id"]), r["n_links"]) for r in rows(jaccard_join.similar_documents(df)))
    want = brute(docs)
    assert got == sorted(want)
    kept = rows(jaccard_join.keep_one(df))
    spoken = [r for r in kept if shingle_set(r["text"])]
    assert sorted(str(r["doc_id"]) for r in spoken) == sorted({c for (_, c, _), (_, t) in zip(want, docs) if shingle_set(t)})
    return kept


def test_tricky(spark):
    docs = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "one two"), (6, "one  two\n"), (7, "one two three"), (None, "a b c d e f g"),
            (8, "a b c d e f g"), (9, "x " * 4000), (10, "x " * 4001), (11, "r s t u v w"), (11, "r s t u v w")]
    kept = check(spark, docs)
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "11", "2", "3", "4", "7", "8", "9"]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.similar_documents(empty).count() == 0 and jaccard_join.keep_one(empty).count() == 0


def test_groups_in_blocks(spark, monkeypatch):
    """One large group of near copies, many small ones, cut into blocks of 8."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    docs = []
    for size, n in ((60, 1), (4, 10), (1, 30)):
        for _ in range(n):
            base = [rnd.choice(words) for _ in range(120)]
            for _ in range(size):
                own = list(base)
                for _ in range(rnd.randrange(5)):
                    own[rnd.randrange(120)] = rnd.choice(words)
                docs += [(len(docs), " ".join(own))] * rnd.choice([1, 1, 1, 2])
    check(spark, docs)


def test_table(spark):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(-300, 300), rnd.randrange(-300, 300)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5000)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    got = {r.id: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in list(up)}


def test_pruning_table():
    """A pair is dropped only while fewer agreements than these are left probable."""
    least = jaccard_join.least_matches(0.8, 1e-5)
    assert least == sorted(least) and len(least) == 7 and 80 < least[-1] < 112
