"""The pipeline against plain versions of its stages, and its stages on awkward rows."""

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
from cases import SF, TRICKY, rows
from strandgraph.llm import log_templates, toxicity
from test_filters import base, plain_drop
from test_jaccard import brute, shingle_set
from test_tokens import check_packing


def plain_quality(docs):
    normal = lambda line: re.sub(r"[^\w]+|_", " ", re.sub("[0-9]+", "0", line.lower())).strip()
    words = lambda text: re.findall("[^\x20\x09-\x0d]+", text)
    holders, hosts = defaultdict(set), defaultdict(set)
    for _, text, source in docs:
        for line in (text or "").split("\n"):
            if words(line):
                holders[source, " ".join(normal(line).split())].add(text)
                hosts[source].add(text)
    bad = {k for k, texts in holders.items() if len(texts) > 10 and len(texts) > 0.05 * len(hosts[k[0]])}
    out = []
    for d, text, source in docs:
        lines = (text or "").split("\n")
        gone = [x for x in lines if words(x) and (source, " ".join(normal(x).split())) in bad]
        n, removed = len(words(text or "")), sum(len(words(x)) for x in gone)
        if not base(text)[5] and not (removed and (n - removed < 20 or n - removed < 0.5 * n)):
            out.append((d, "\n".join(x for x in lines if x not in gone) if gone else text, source))
    return out


def test_run_equals_plain_stages(spark, vocabulary):
    from tokenizers import Tokenizer

    table = spark.read.parquet(f"{SF}/documents.parquet")
    docs = plain_quality([(r.doc_id, r.text, r.source) for r in table.collect()])
    assert len(docs) < table.count()
    kept = corpus_pipeline.quality_stage(spark, table, SF)
    assert kept.columns == table.columns and sorted((r.doc_id, r.text) for r in kept.collect()) == sorted(d[:2] for d in docs)
    model = toxicity.fit(toxicity.training_rows(kept, spark.read.parquet(f"{SF}/labels.parquet")))
    docs = plain_drop([(d, t) for d, t, _ in docs if model.score(t) < 0.5], **log_templates.RULE)
    docs = [(d, t) for d, t, _ in docs]
    heads = {c for (_, c, _), (_, t) in zip(brute(docs), docs) if shingle_set(t)}
    docs = [(d, t) for d, t in docs if str(d) in heads or not shingle_set(t)]
    used, least = check_packing(rows(corpus_pipeline.run(spark, SF)), docs, Tokenizer.from_file(vocabulary), 2048)
    assert used <= least * 1.05 + 1


def test_stages_on_awkward_rows(spark):
    data = [(d, t, None, "h", None) for d, t in TRICKY] + [(50 + i, " ".join(f"w{i}x{j}" for j in range(40)), "en", None, 3) for i in range(3)]
    docs = spark.createDataFrame(data + data[-1:], "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, SF)
            if name == "best-fit packing":
                assert {r.doc_id for r in out.collect()} == {r.doc_id for r in frame.collect()}
            else:
                assert out.columns == corpus_pipeline.COLUMNS
                seen = Counter(r.doc_id for r in out.collect())
                assert set(seen) <= {r.doc_id for r in frame.collect()}
                if frame is docs:
                    assert seen[50] == 1 and seen[51] == 1  # clean documents stay


def test_large_group_of_near_copies_becomes_one_whole_document(spark):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(7))
    page = lambda: [[word() for _ in range(40)] for _ in range(7)]
    shared, passage = "all rights reserved by the owners of this site", " ".join(word() for _ in range(60))
    first, texts = page(), []
    for _ in range(20):
        lines = [list(x) for x in first]
        for _ in range(3):
            lines[rnd.randrange(7)][rnd.randrange(40)] = word()
        texts.append("\n".join(" ".join(x) for x in lines))
    texts += ["\n".join(" ".join(x) for x in page()) for _ in range(10)]
    whole = [f"{t}\n{shared}" + (f"\n{passage}" if i in (25, 26) else "") for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, "en", "h", len(t)) for i, t in enumerate(whole)], "doc_id long, text string, lang string, source string, n_chars long")
    lines = corpus_pipeline.line_stage(spark, docs, SF)
    assert {r.doc_id: r.text for r in lines.collect()} == dict(enumerate(texts))
    kept = corpus_pipeline.near_duplicate_stage(spark, lines, SF)
    assert {r.doc_id: r.text for r in kept.collect()} == {i: t for i, t in enumerate(texts) if i == 0 or i >= 20}
