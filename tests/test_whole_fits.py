"""Classifiers are fitted on all rows of their training sets, in tasks or by passes over blocks; n-grams and folds as by one row after the other."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import char_grams, classify


def test_cells_equal_counts_of_each_text():
    r = random.Random(0)
    texts = ["", "a", "ab", "abc", "abcd", "abcde", None, "aaaaaa", "ÄÖ\U0001f600x\U0001f600xß 漢字", "a\0b"]
    texts += ["".join(r.choice("abc é\U0001f600") for _ in range(r.randrange(12))) for _ in range(300)]
    texts.append("".join(map(chr, range(0x3000, 0x3000 + 40_000))))  # more characters than 64 bits hold four of
    for own in (texts, texts[:9], [None, ""], []):
        terms, term, text, n = char_grams.cells(own)
        got: list[dict] = [{} for _ in own]
        for t, k, v in zip(term, text, n):
            got[k][terms[t]] = v
        assert got == [dict(char_grams.gram_counts(t)) for t in own]
    sizes, code, n = char_grams.Terms(["bc", "ab", "zz"]).rows(["abab", None, "xbc"])
    assert sizes.tolist() == [1, 0, 1] and code.tolist() == [1, 0] and n.tolist() == [2, 1]


def test_a_fit_learns_from_all_rows(spark):
    """21,000 rows: the gradient over all of them is nothing at the model; one of 20,000 of them would leave a twentieth of it."""
    words = ["up", "un", "of", "it"]
    rows = [(k, f"{words[k % 4]} {words[k // 4 % 4]}", "good" if k % 3 else "bad", k % 21 and 1) for k in range(22_050)]
    texts, roles = spark.createDataFrame([x[:2] for x in rows], "_row long, _t string"), spark.createDataFrame([("a", k, lab, f) for k, _, lab, f in rows], "assignment string, _row long, label string, fold int")
    models = classify.FoldModels().fit(texts, roles, [("a", 0)])
    features, w, b, _ = models.models["a", 0]
    own = [(t, 1.0 if lab == "good" else -1.0) for _, t, lab, f in rows if f]
    share = sum(y > 0 for _, y in own) / len(own)
    distinct = {t: features.weights_of(classify.gram_counts(t)) for t in {t for t, _ in own}}

    def gradient(w, b):
        g = np.append(w, b)
        for t, y in own:
            at, v = distinct[t]
            d = -2 * (0.5 / share if y > 0 else 0.5 / (1 - share)) * y * max(0.0, 1 - y * (v @ w[at] + b))
            np.add.at(g, at, d * v)
            g[-1] += d
        return np.abs(g).max()

    assert len(own) == 21_000 and gradient(w[:, 0], b[0]) < 1e-3 * gradient(np.zeros(len(w)), 0.0)


@pytest.mark.parametrize("filled", [0, 10**9])
def test_passes_over_blocks_give_the_fits_of_one_task(spark, monkeypatch, filled):
    """Fits of several tasks, folds and labels, by full and by sparse blocks."""
    r = random.Random(3)
    rows = []
    for k in range(300):
        lab = r.choice("xyz")
        rows.append((k, " ".join(r.choice({"x": ["rise", "grow"], "y": ["fall", "drop"], "z": ["hold", "keep"]}[lab if r.random() < 0.8 else "z"]) for _ in range(r.randrange(6))), lab, k % 3))
    texts = spark.createDataFrame([x[:2] for x in rows], "_row long, _t string")
    roles = spark.createDataFrame([("all", k, lab, f) for k, _, lab, f in rows] + [("two", k, lab, 2 - f) for k, _, lab, f in rows if lab != "z"], "assignment string, _row long, label string, fold int")
    fits = [("all", 0), ("all", 2), ("two", 1)]
    one = classify.FoldModels().fit(texts, roles, fits)
    monkeypatch.setattr(classify, "TASK_CELLS", 0)
    monkeypatch.setattr(classify, "FILLED", filled)
    monkeypatch.setattr(classify, "COLLECTED", 0 if filled else 10**9)
    monkeypatch.setattr(char_grams, "CHARACTERS", 500)
    two = classify.FoldModels().fit(texts, roles, fits)
    assert set(one.models) == set(two.models) == set(fits)
    for f in fits:
        assert one.models[f][0].index == two.models[f][0].index and one.models[f][3] == two.models[f][3]
        assert np.allclose(one.models[f][1], two.models[f][1], atol=5e-3) and np.allclose(one.models[f][2], two.models[f][2], atol=5e-3)
    rows = texts.join(roles, "_row").where("fold = 1")
    got = {r._t: r for r in two.predict(rows.withColumn("fold", F.lit(0)).where("assignment = 'all'")).collect()}
    features, w, b, labels = two.models["all", 0]
    for t, r in got.items():
        at, v = features.weights_of(classify.gram_counts(t))
        s = v @ w[at] + b
        assert [r.scores[x] for x in labels] == pytest.approx(s.tolist()) and r.pred == labels[int(s.argmax())]


def dealt(rows, k, order):
    """Groups one after the other, each to the fold with the fewest rows of its labels."""
    sizes, loads, out = {}, [{} for _ in range(k)], {}
    for g, lab in rows:
        own = sizes.setdefault(g, {})
        own[lab] = own.get(lab, 0) + 1
    for g, labels in sorted(sizes.items(), key=lambda x: (-sum(x[1].values()), order(x[0]))):
        best = min(range(k), key=lambda f: (sum((loads[f].get(x, 0) + n) ** 2 - loads[f].get(x, 0) ** 2 for x, n in labels.items()), sum(loads[f].values()), f))
        for x, n in labels.items():
            loads[best][x] = loads[best].get(x, 0) + n
        out[g] = best
    return out


def test_folds_are_dealt_as_one_group_after_the_other(spark):
    r = random.Random(5)
    rows = [(f"g{r.randrange(90)}", r.choice(["a", "a", "b"])) for _ in range(400)]
    df = spark.createDataFrame(rows, "group string, label string")
    assert {x.group: x.fold for x in classify.group_folds(df, "group", "label", 4).collect()} == dealt(rows, 4, str)
    hashes = {x.group: x.h for x in df.select("group", F.xxhash64("group", F.lit(7)).alias("h")).collect()}
    assert {x.group: x.fold for x in classify.group_folds(df, "group", "label", 4, 7).collect()} == dealt(rows, 4, lambda g: (hashes[g], g))


def test_folds_of_any_number_of_groups(spark):
    """More groups than the 200,000 that were refused before."""
    df = spark.range(210_000).select(F.col("id").alias("group"), (F.col("id") % 3).alias("label"))
    sizes = {r.fold: r["n"] for r in classify.group_folds(df, "group", "label").groupBy("fold").agg(F.count("*").alias("n")).collect()}
    assert sizes == {f: 42_000 for f in range(5)}


def test_learning_curve_takes_groups_until_there_are_two_labels(spark):
    rows = [(k, "rise and gain" if k % 20 else "fall and drop", "good" if k % 20 else "bad", k) for k in range(200)]
    df = spark.createDataFrame(rows, "report long, text string, label string, group long")
    folds = {r.group: r.fold for r in classify.group_folds(df, "group", "label", 3).collect()}
    hashes = sorted((r.h, r.group) for r in df.select("group", F.xxhash64(F.col("group").cast("string")).alias("h")).collect() if folds[r.group])
    bad = [i for i, (_, g) in enumerate(hashes) if g % 20 == 0]
    good = [i for i, (_, g) in enumerate(hashes) if g % 20]
    want = [max(math.ceil(x * len(hashes)), bad[0] + 1, good[0] + 1) for x in (0.001, 0.5, 1.0)]
    curve = classify.learning_curve(df, "text", "label", "group", (0.001, 0.5, 1.0), k=3).collect()
    assert [c.n_train for c in curve] == want and all(c.hits == c.n_test for c in curve)
