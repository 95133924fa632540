"""Quality rules, toxicity and line templates against plain recomputation."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from cases import SF, TRICKY, rows
from strandgraph.llm import jaccard_join, log_templates, quality, queries, toxicity

WORD = re.compile("[^\x20\x09-\x0d]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    runs = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often, covered = Counter(runs), set()
    for i, r in enumerate(runs):
        if often[r] > 1:
            covered.update(range(i, i + 8))
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_base_measures(spark):
    rnd = random.Random(3)
    texts = TRICKY + [(100 + i, " ".join(rnd.choice("ab") for _ in range(rnd.randrange(60)))) for i in range(60)]
    texts += [(200, "l one\nl one\n l one\n\n"), (201, "$5 <b>|x|</b> 100% ä😀 *&#\x0b\x0c\r y"), (202, ("q w e r t y u i " * 3 + "\n") * 5)]
    df = spark.createDataFrame([(d, t, "h", 1) for d, t in texts], "doc_id long, text string, source string, _lines int")
    got = {(r["doc_id"], tuple(r[m] for m in MEASURES)) for r in rows(quality.score(df))}
    assert got == {(d, base(t)) for d, t in texts}
    assert quality.score(df.limit(0)).count() == 0 and quality.keep(df.limit(0)).count() == 0


def test_line_frequency(spark):
    rnd = random.Random(4)
    prose = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    menu = "Home | About us 2024 | all the many links of a menu with some more words in it"
    docs = [(i, f"{menu.replace('2024', str(i))}\n{prose(60)}", "a") for i in range(30)]
    docs += [(100 + i, f"{menu}\n{prose(3)}", "a") for i in range(12)]
    docs += [(200 + i, f"{menu}\n{prose(60)}", "b") for i in range(10)] + [(300 + i, docs[0][1], "b") for i in range(40)]
    docs += [(400, None, None), (401, "", "c"), (402, prose(50), None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in rows(quality.score(df))}
    assert all(got[i]["kept"] and got[i]["n_removed_words"] == len(menu.split()) for i in range(30))
    assert not any(got[100 + i]["kept"] for i in range(12)) and not got[105]["base_failed"] * (got[105]["n_words"] >= 20)
    assert all(got[i]["kept"] and got[i]["n_removed_words"] in (0, len(menu.split())) for i in [*range(200, 210), *range(300, 340)])
    assert not got[400]["kept"] and not got[401]["kept"] and got[402]["kept"]
    kept = {r["doc_id"]: r["text"] for r in rows(quality.keep(df))}
    assert set(kept) == {d for d, r in got.items() if r["kept"]}
    assert kept[3] == docs[3][1].split("\n")[1] and kept[402] == docs[-1][1]


def test_toxicity_learns_and_locates(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    bad, docs, labels = ["zorkish", "blarg"], [], []
    for i in range(400):
        sents = [" ".join(word() for _ in range(8)).capitalize() + "." for _ in range(rnd.randrange(1, 9))]
        toxic = i % 4 == 0
        if toxic:
            k = rnd.randrange(len(sents))
            sents[k] = sents[k].replace(" ", f" {rnd.choice(bad)} ", 1)
        docs.append((i, " ".join(sents), "en", 9.0))
        labels += [(i, int(toxic))] * (1 + (i == 5))
    docs += [(900, None, "en", None), (901, "", None, None), (None, "Only words.", None, None)]
    labels += [(900, None), (5000, 1), (None, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, score double")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(toxicity.training_rows(df, lab))
    got = {r["doc_id"]: r["score"] for r in rows(toxicity.score_documents(df, model))}
    assert all((got[i] >= 0.5) == (i % 4 == 0) for i in range(400)) and got[900] == got[901] == 0.0
    texts = {d: t for d, t, *_ in docs}
    found = rows(toxicity.offending_sentences(df, model))
    assert {r["doc_id"] for r in found} == set(range(0, 400, 4))
    assert all(any(b in r["sentence"] for b in bad) and texts[r["doc_id"]][r["start"] : r["stop"]] == r["sentence"] for r in found)
    nothing = toxicity.fit(toxicity.training_rows(df, lab.filter("toxic = 0")))
    assert {r["score"] for r in rows(toxicity.score_documents(df, nothing))} == {0.0}
    assert toxicity.score_documents(df.limit(0), model).count() == 0


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    scores = queries.op6_noisy_or_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    pos, neg = [r.score for r in scores if r.toxic], [r.score for r in scores if not r.toxic]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    right = sum(r.predicted == r.toxic for r in scores) / len(scores)
    assert wins > 0.97 and right > 0.97


def plain_merge(own, depth=3, min_constant=0.5, min_evidence=3):
    """Template and size of each line of a leaf that shares one with another line."""
    found, waiting = {}, [sorted(own)]
    while waiting:
        group = waiting.pop()
        if len(group) < 2:
            continue
        kinds = [len(set(column)) for column in zip(*group)]
        same = [n == 1 and x != "<*>" for n, x in zip(kinds, group[0])]
        if sum(same[depth:]) >= max(min_evidence, min_constant * (len(same) - depth)):
            found |= {t: (("field", *group), sum(same)) for t in group}
            continue
        at = min((n, i) for i, n in enumerate(kinds) if n > 1)[1]
        parts = defaultdict(list)
        for t in group:
            parts[t[at]].append(t)
        waiting += parts.values()
    return found


def plain_lines(docs):
    lines = {}
    for _, text in docs:
        if text is not None:
            for n, line in enumerate(text.split("\n")):
                words = [w for w in re.split("[ \t\x0b\f\r]+", line.lower()) if w]
                tokens = tuple("<*>" if re.search("[0-9]", w) else w for w in words)
                if tokens:
                    lines[text, n] = tokens
    return lines


def plain_classes(texts, near):
    hashes, bounds, whole = jaccard_join.shingles(pa.array(texts))
    sig, up, names = jaccard_join.signatures(hashes, bounds), list(range(len(texts))), {}
    assert len(sig) == len(texts)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    least, step = jaccard_join.least_matches(near, 1e-5), jaccard_join.STEP
    for i in range(len(texts)):
        same = sig[:i] == sig[i]
        enough = np.all([same[:, : (k + 1) * step].sum(axis=1) >= m for k, m in enumerate(least)], axis=0)
        band = same.reshape(i, jaccard_join.BANDS, jaccard_join.ROWS).all(axis=2).any(axis=1)
        for j in [*np.flatnonzero(enough & band).tolist(), names.setdefault(whole[i], i)]:
            up[root(i)] = root(j)
    return [root(i) for i in range(len(texts))]


def plain_drop(docs, min_docs=6, depth=3, long_line=None, near=None):
    """The rule of log_templates, recomputed; near copies by comparing all pairs of signatures."""
    lines, leaves, merged = plain_lines(docs), defaultdict(set), {}
    for t in lines.values():
        leaves[len(t), t[:depth]].add(t)
    for own in leaves.values():
        merged |= plain_merge(own) if len(next(iter(own))) > depth + 3 else {}
    template = {t: merged.get(t, (t, sum(x != "<*>" for x in t))) for t in lines.values()}

    def dropped(keys, of):
        held = defaultdict(set)
        for text, n in keys:
            held[template[lines[text, n]]].add(of[text])
        least = lambda size: min_docs if long_line is None else max(2, min_docs - size * (min_docs - 2) // long_line)
        return {k for k in keys if len(held[template[lines[k]]]) >= least(template[lines[k]][1])}

    gone = dropped(set(lines), {text: text for text, _ in lines})
    if near is not None:
        texts = sorted({text for text, _ in gone})
        gone = dropped(gone, {text: c for text, c in zip(texts, plain_classes(texts, near))})
    return [(d, t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (t, n) not in gone),
             0 if t is None else sum((t, n) in gone for n in range(len(t.split("\n"))))) for d, t in docs]


def as_text(found):
    return sorted(map(str, found))


def test_line_templates(spark):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(7))
    docs = [(i, f"door opened by {word()} in room {rnd.random():.3f} today for a visit\n{word()} {word()} {word()} {word()}\n\n All rights  reserved ") for i in range(150)]
    docs += [(200, None), (201, ""), (202, "\n \n"), (203, "All rights reserved"), (203, "All rights reserved"), (204, "alone here\nuser x logged out")]
    docs += [(300 + i, "same text twice over\nand over") for i in range(20)] + [(400 + i, f"shared passage of words\nid {i} {word()}") for i in range(5)]
    df = spark.createDataFrame([(d, t, i, "l") for i, (d, t) in enumerate(docs)], "doc_id long, text string, tokens int, template string")
    got = as_text((r["doc_id"], r["text"], r["n_dropped_lines"]) for r in rows(log_templates.drop_recurring(df)))
    assert got == as_text(plain_drop(docs))
    kept = dict(plain_drop(docs)[i][:2] for i in (0, 160, 175))
    assert "door opened" not in kept[0] and kept[304] == "same text twice over\nand over"
    assert log_templates.drop_recurring(df.limit(0)).count() == 0


def test_line_templates_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for leaf_lines in (log_templates.LEAF_LINES, 1):  # by tasks, and by aggregates
        out = log_templates.drop_recurring(table, leaf_lines=leaf_lines)
        assert as_text((r["doc_id"], r["text"], r["n_dropped_lines"]) for r in rows(out)) == as_text(plain_drop(docs))


def test_registered_rule(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = plain_drop(docs, **log_templates.RULE)
    got = log_templates.drop_recurring(spark.read.parquet(f"{SF}/documents.parquet"), **log_templates.RULE)
    assert as_text((r["doc_id"], r["text"], r["n_dropped_lines"]) for r in rows(got)) == as_text(want)
    assert any(n for _, _, n in want)


def test_clashing_columns(spark):
    names = ["_lines", "_gone", "_k1", "_k2", "_host", "_removed", "_key", "_hash", "_own", "own_gone"]
    texts = [f"one line that all of them share, word for word\nown " + " ".join(chr(97 + i) * (j + 1) for j in range(30)) for i in range(12)] + [None, ""]
    df = spark.createDataFrame([(i, t, "h", *range(i, i + len(names))) for i, t in enumerate(texts)], ["doc_id", "text", "source", *names])
    for out in (quality.keep(df), quality.score(df), log_templates.drop_recurring(df), jaccard_join.keep_one(df, "_key")):
        found = rows(out)
        assert [c for c in out.columns if c in df.columns] == [c for c in df.columns if c in out.columns] and set(names) <= set(out.columns)
        assert all(r[n] == r["doc_id"] + i for r in found for i, n in enumerate(names)) and len(found) >= 12


def dropped(spark, texts, **rule):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["n_dropped_lines"] for r in rows(log_templates.drop_recurring(df, **rule))}


def test_fields_of_few_values_and_short_clean_lines(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(7))
    prose = lambda n: " ".join(word() for _ in range(n))
    texts = []
    for opening, n in (("sent from my", 6), ("brought to you", 40), ("this page was", 100)):
        texts += [f"{opening} new phone by {word()} with best regards to all\n{prose(30)}" for _ in range(n)]
    texts += [f"sent from my {prose(8)}\n{prose(30)}" for _ in range(20)]  # clean lines in a leaf with a template
    texts += [f"one of the {prose(n)}\n{prose(30)}" for n in (1, 2, 3) for _ in range(150)]
    got = dropped(spark, texts)
    assert [got[i] for i in range(len(texts))] == [int(i < 146) for i in range(len(texts))]


def test_long_lines_need_fewer_texts(spark):
    rnd = random.Random(9)
    prose = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(7)) for _ in range(n))
    for words, least in ((60, 2), (20, 2), (15, 3), (10, 4), (5, 5), (3, 6)):
        few, enough = prose(words), prose(words)
        texts = [f"{prose(40)}\n{few}"] * 2 + [f"{prose(40)}\n{few}" for _ in range(least - 2)] + [f"{enough}\n{prose(40)}" for _ in range(least)]
        got = dropped(spark, texts, **log_templates.RULE)
        assert [got[i] for i in range(len(texts))] == [0] * least + [1] * least
