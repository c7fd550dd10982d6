"""Passage search against a plain scan of all texts for all passages."""

import random
import re

import pytest

from tidemark.operators import search


def found(docs, needles):
    """(item, level, doc) by looking for each passage in each text."""
    bare, one = (lambda t: re.sub("[ \t\n\f\r]+", "", t)), (lambda t: re.sub("[ \t\n\f\r]+", " ", t).strip(" "))
    best = {}
    for item, needle in needles:
        for doc, t in docs:
            if item is None or doc is None or not needle or not bare(needle) or t is None:
                continue
            level = 1 if needle in t else 2 if one(needle) in one(t) else 3 if bare(needle) in bare(t) else 9
            if level < 9:
                best[item] = min(best.get(item, (9, 0)), (level, doc))
    return {(i, *m) for i, m in best.items()}


def tables(seed, n_docs=60, n_needles=150):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé漢") for _ in range(r.randint(1, 6)))
    docs = [(i, r.choice([" ", "  ", "\n"]).join(word() for _ in range(r.randint(0, 90)))) for i in range(n_docs)]
    docs += [(100 + i, docs[3][1]) for i in range(5)] + [(200, None), (None, "abc"), (7, "another text of row seven")]
    needles = []
    for i in range(n_needles):
        t = r.choice(docs[:n_docs])[1]
        a = r.randint(0, max(0, len(t) - 1))
        part = t[a : a + r.choice([1, 2, 3, 5, 7, 9, 15, 19, 20, 25, 60, 500])]
        part = part if r.random() < 0.5 else re.sub(r"\s+", r.choice(["", " ", " \n "]), part)
        needles.append((i, part if r.random() < 0.8 else part + word()))
    # repeated items, repeated passages, one that starts as a text does and goes on otherwise
    needles += [(5, needles[9][1]), (900, needles[9][1]), (901, None), (None, "abc"), (902, " \n "), (903, docs[4][1][:30] + "zzz"), (904, docs[4][1])]
    return docs, needles


@pytest.mark.parametrize("anchors", [500_000, 1])
def test_equal_to_a_plain_scan(spark, monkeypatch, anchors):
    monkeypatch.setattr(search, "ANCHORS", anchors)
    monkeypatch.setattr(search, "TOGETHER", 4)
    docs, needles = tables(3)
    got = search.layered_search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(needles, "item_id long, text string"))
    want = found(docs, needles)
    assert {tuple(x) for x in got.collect()} == want and len(want) > 80
    assert {x[1] for x in want} == {1, 2, 3}


def test_needles_as_large_as_the_texts(spark):
    docs, _ = tables(8)
    needles = [(i, t) for i, t in docs if i is not None]
    got = search.layered_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(needles, "item_id long, text string"))
    assert {tuple(x) for x in got.collect()} == found(docs, needles)


def test_very_long_text(spark):
    r = random.Random(1)
    long = " ".join(str(r.randint(0, 10**6)) for _ in range(400_000))
    docs, needles = [(1, "short"), (2, long)], [(1, long[1_900_000:2_100_000]), (2, long[-60:].replace(" ", "\n")), (3, "hor")]
    got = search.layered_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(needles, "item_id long, text string"))
    assert {tuple(x) for x in got.collect()} == {(1, 1, 2), (2, 2, 2), (3, 1, 1)}
