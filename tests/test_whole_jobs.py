"""Queries that take whole texts and whole methods, against brute force on small fixtures."""

import datetime
import os
import re
import string
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import scoring, similarity
from tidemark.plans import catalog, event_queries, model_queries, text_queries


@pytest.fixture()
def tables(spark, tmp_path):
    """Writes a table of a fixture's folder and gives the folder."""

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


BODY = "The committee will keep its policy steady over the coming year. Prices rose in most of the regions that were surveyed."
TEXTS = [
    (1, f"An opening of its own. {BODY} Short one."),
    (2, f"Another start altogether! {BODY}"),
    (3, "Nothing alike here. In short, the committee will keep its policy steady over the coming year and beyond."),
    (4, "Alone in every respect; nobody else says this. Alone in every respect!"),
    (5, None),
    (6, ""),
    (7, "Loose ends are tied at last. Prices rose in most of the regions that were surveyed, x."),
    (8, "Short one."),
    (9, "Short on."),
]


def sentences(text):
    return [p for p in (x.strip() for x in re.sub(r"([.!?;]) *", "\\1\1", re.sub(r"\s+", " ", text or "")).split("\1")) if len(p) >= 4]


def brute_pairs(texts):
    ids = [((d, k), re.sub(rf"[\s{re.escape(string.punctuation)}]+", "", s.lower())) for d, t in texts for k, s in enumerate(sentences(t))]
    first, out = {}, set()
    for i, t in ids:
        if t in first:
            out.add((first[t], i))
        first.setdefault(t, i)
    grams = lambda t: {t[k : k + 3] for k in range(len(t) - 2)} or {t}
    for s, i in first.items():
        for t, j in first.items():
            a, b = grams(s), grams(t)
            if i < j and (min(len(s), len(t)) >= 20 and (s in t or t in s) or 100 * len(a & b) >= 92 * len(a | b)):
                out.add((i, j))
    return ids, out


def test_all_sentences_are_compared(spark, tables):
    d = tables("documents", TEXTS, "doc_id long, text string")
    ids, want = brute_pairs(TEXTS)
    got = {((r.a_doc_id, r.a_sentence_no), (r.b_doc_id, r.b_sentence_no)) for r in catalog.queries()["near_duplicate_sentences"](spark, d).collect()}
    assert got == want and ((1, 1), (2, 1)) in got and ((1, 1), (3, 1)) in got and ((4, 0), (4, 2)) in got

    root = {i: i for i, _ in ids}
    edges = want | {((i[0], 0), i) for i, _ in ids}
    for _ in ids:
        for a, b in edges:
            low = min(root[a], root[b])
            root[a] = root[b] = low
    groups = {(r.doc_id, r.sentence_no): ((r.root_doc_id, r.root_sentence_no), r.group_label) for r in catalog.queries()["duplicate_report_groups"](spark, d).collect()}
    assert {i: r for i, (r, _) in groups.items()} == root
    assert {root[i] for i in root} == {(1, 0), (4, 0), (9, 0)}
    assert len({g for _, g in groups.values()}) == 3


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the tables are not here")
def test_volatility_queries_run_their_whole_methods(spark):
    d = "/root/testdata/sf0.001"
    fit = catalog.queries()["egarch_fit"](spark, d).collect()
    assert 15 < fit[0].steps < 120
    assert catalog.queries()["egarch_permutation"](spark, d).count() == 99
    lr = {r.model: r.lr for r in catalog.queries()["egarch_conditional"](spark, d).collect()}
    assert lr["D0_D1"] >= max(lr["D0"], lr["D1"]) - 1e-6


def test_text_queries_take_whole_documents(spark, tables):
    long = "and that tion was not the rate " * 400
    texts = {3: "abcd efg", 10: "abcd efh", 11: long, 20: ""}
    d = tables("documents", list(texts.items()), "doc_id long, text string")
    run = lambda name: {r[0]: r[1:] for r in catalog.queries()[name](spark, d).collect()}
    grams = lambda t, n: [t[k : k + n] for k in range(len(t) - n + 1)] if len(t) > n else [t] * bool(t)
    a, b = (set(grams(texts[k], 3)) for k in (3, 10))
    got = run("ngram_jaccard_documents")
    assert set(got) == {3, 10, 11} and got[3][0] == pytest.approx(len(a & b) / len(a | b), abs=1e-6) and got[11][0] == 0
    f = {k: Counter(g for n in (2, 3, 4) for g in grams(re.sub(r"\s\s+", " ", t).lower(), n)) for k, t in texts.items()}
    df = Counter(g for c in f.values() for g in c)
    w = {k: {g: n * (np.log(5 / (1 + df[g])) + 1) for g, n in c.items()} for k, c in f.items()}
    norm = lambda k: np.sqrt(sum(x * x for x in w[k].values()))
    got = run("fullsample_similarity_char_documents")
    for p, k in ((3, 10), (10, 11)):
        assert got[k][0] == pytest.approx(sum(x * w[p].get(g, 0) for g, x in w[k].items()) / (norm(p) * norm(k)), abs=2e-6)
    assert got[3][0] is None and got[20][0] == 0
    assert run("tokenized_text_documents")[11][0].split() == long.split() and run("sentence_bare_documents")[11][0] == long.replace(" ", "")
    words, lex = long.split(), text_queries.LEX

    def weight(before):
        out = np.prod([v for x, v in lex.degree.items() if x in before] or [1.0])
        return out * (-1.0 if any(x in before for x in lex.negations) else 1.0) * (1.15 if any(x in before for x in lex.turning) else 1.0)

    want = sum(weight("".join(words[max(0, i - 3) : i])) for i, x in enumerate(words) if x in lex.positive)
    assert run("token_score_documents")[11][0] == pytest.approx(want, abs=1e-4)
    got, same = run("phrase_score_documents"), spark.createDataFrame([(long,)], "text string").select(scoring.phrase_score(F.col("text"), lex.dovish, lex)).collect()[0][0]
    assert got[11][0] == pytest.approx(same, abs=1e-4) and got[11][0] != 0 and got[20] == (0.0, 0.0)


def test_actions_on_days_without_a_curve(spark, tables):
    """The first orders are not shipped on their day, so the curve's calendar begins later; an action there counts at its first day."""
    day = lambda k: datetime.datetime(1995, 1, 1) + datetime.timedelta(days=k)
    tables("lineitem", [(day(k), flag, 1000.0 + 37 * (k % 11) + 5 * n) for k in range(1, 900) if k != 40 for n, flag in enumerate("ANR")], "l_shipdate timestamp, l_returnflag string, l_extendedprice double")
    d = tables("orders", [(day(k), "1-URGENT", 460000.0) for k in (0, 40, 500)], "o_orderdate timestamp, o_orderpriority string, o_totalprice double")
    rows = model_queries._yield_panel(spark, d).select("event_id", "action_nearby").collect()
    assert {r.event_id: r.action_nearby for r in rows} == {f"{y}Q{q}": int((y, q) == (1995, 1)) for y in (1995, 1996) for q in (1, 2, 3, 4)} | {"1997Q1": 0, "1997Q2": 0}
    assert catalog.queries()["yield_models_grouped"](spark, d).count() == 12
    cal = event_queries.curve(spark, d)
    assert sorted(r.pos for r in event_queries.actions(spark, d, cal).collect()) == [0, 39, 498]


def test_phrase_score_of_a_long_text_is_linear(spark):
    """A hit looks at the characters before it only; joining all parts before each of 30,000 hits took minutes."""
    text, lex = "not station, the and tion " * 15_000, text_queries.LEX
    began = time.monotonic()
    got = spark.createDataFrame([(text,)], "text string").select(scoring.phrase_score(F.col("text"), ("tion",), lex)).collect()[0][0]
    before = [text[max(0, m.start() - 8) : m.start()] for m in re.finditer("tion", text)]
    want = sum(np.prod([v for x, v in lex.degree.items() if x in b] or [1.0]) * (-1.0 if any(x in b for x in lex.negations) else 1.0) * (1.15 if any(x in b for x in lex.turning) else 1.0) for b in before)
    assert got == pytest.approx(want) and time.monotonic() - began < 30


def test_neighbours_cross_blocks_and_many_terms(spark, monkeypatch):
    """Blocks of three positions, frequencies joined by block and sent to all, against one block; no row a document and term is shuffled."""
    r = np.random.default_rng(4)
    texts = [" ".join(r.choice(["ab", "bcd", "cd", "ef", "géh"], r.integers(0, 9))) for _ in range(20)] + [None, "", "ab", "ab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "idx long, text string").repartition(3)
    run = lambda df: {x[0]: x[1] and round(x[1], 9) for x in df.collect()}
    words = T.words(F.col("text"))
    counts = [Counter(w for w in (t or "").split()) for t in texts]

    def cosine(k, df, n):
        w = [{x: c * (np.log((1 + n) / (1 + df[x])) + 1) for x, c in counts[i].items()} for i in (k - 1, k)]
        size = np.sqrt(sum(x * x for x in w[0].values()) * sum(x * x for x in w[1].values()))
        return round(sum(x * w[0].get(t, 0) for t, x in w[1].items()) / size, 9) if size else None

    full = Counter(x for c in counts for x in c)
    want = {0: None} | {k: cosine(k, full, len(texts)) or 0.0 for k in range(1, len(texts))}
    assert run(similarity.adjacent_similarity(docs, words, block=3)) == want
    plan = similarity.adjacent_similarity(docs, words, block=3)._jdf.queryExecution().toString()
    assert "xxhash64" in plan and "explode(terms" not in plan
    monkeypatch.setattr(similarity, "TERMS", 2)
    assert run(similarity.adjacent_similarity(docs, words, block=3)) == want
    so_far = {k: Counter(x for c in counts[: k + 1] for x in c) for k in range(len(texts))}
    assert run(similarity.expanding_similarity(docs, words, block=3)) == {0: None} | {k: cosine(k, so_far[k], k + 1) for k in range(1, len(texts))}
    grams = lambda t: {t[k : k + 3] for k in range(len(t) - 2)} or ({t} if t else set())
    pairs = [(grams(a), grams(b)) if a is not None and b is not None else None for a, b in zip(texts, texts[1:])]
    assert run(similarity.adjacent_jaccard(docs, F.col("text"), block=3)) == {k: round(len(p[0] & p[1]) / len(p[0] | p[1]), 9) if p and p[0] | p[1] else None for k, p in enumerate(pairs)}
