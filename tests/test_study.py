"""Readers, sinks, tables, classifiers and volatility fits of the study on small fixtures."""

import json
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import classify, metrics, regression, search, tables, volatility
from tidemark.sources import config, sinks
from tidemark.sources import tables as sources


def test_readers(spark, tmp_path):
    (tmp_path / "s.csv").write_text("report_id,report_period,section,found,char_count,word_count_proxy,local_path\nr1,2001Q1,guidance,true,3,1,a\\\\b.txt\n")
    (tmp_path / "fixed.csv").write_text("report_id,report_period,section,found,char_count,word_count_proxy,local_path\nr1,2001Q1,guidance,true,9,1,c.txt\n")
    first = sources.section_index(spark, f"{tmp_path}/s.csv", f"{tmp_path}/none.csv").collect()
    assert "\\" not in first[0].local_path and first[0].local_path.startswith("a/")
    assert sources.section_index(spark, f"{tmp_path}/s.csv", f"{tmp_path}/fixed.csv").collect()[0].local_path == "c.txt"
    (tmp_path / "ev.csv").write_text("event_id,report_period,publication_datetime,bond_event_date,equity_event_date,bond_window_complete_m3_p3,equity_window_complete_m3_p3,action_nearby\ne2,p,2002-02-01 10:00:00,2002-02-02,2002-02-01,true,true,1\ne1,p,2001-02-01 10:00:00,2001-02-02,2001-02-01,true,false,0\n")
    ev = sources.event_calendar(spark, f"{tmp_path}/ev.csv").collect()
    assert [e.event_id for e in ev] == ["e1", "e2"] and ev[0].bond_event_date.year == 2001 and ev[1].action_nearby == 1
    (tmp_path / "pos.csv").write_text("word\ngood\n\nfine\n")
    (tmp_path / "neg.csv").write_text("bad\nworse\n")
    words = sources.lexicon_sheets(spark, {"positive": (f"{tmp_path}/pos.csv", True), "negative": (f"{tmp_path}/neg.csv", False)}).collect()
    assert sorted((w.category, w.word) for w in words) == [("negative", "bad"), ("negative", "worse"), ("positive", "fine"), ("positive", "good")]
    (tmp_path / "r.json").write_text(json.dumps({"a": {"b": 1.5}}))
    assert sources.json_results(spark, f"{tmp_path}/r.json").collect()[0].a.b == 1.5
    (tmp_path / "r.md").write_text("# R\nbeta = -0.25, n: 79\n")
    assert {r.item: r.value for r in sources.scraped_numbers(spark, f"{tmp_path}/r.md", {"beta": r"beta = (-?[0-9.]+)", "n": r"n: (\d+)", "no": "zz(1)"}).collect()} == {"beta": -0.25, "n": 79.0, "no": None}


def test_settings(tmp_path):
    rules = config.load_rules(f"{tmp_path}/x/rules.json", {"a": 1})
    assert rules == {"a": 1} and config.load_rules(f"{tmp_path}/x/rules.json", {"a": 2, "b": 3}) == {"a": 1, "b": 3}
    assert config.sample_bounds({"sample": {"first": "1995Q1"}}) == ("1995Q1", "1999Q2", "1998Q1")


def test_sinks(spark, tmp_path):
    judged = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", None)], "t string, p string")
    back = sinks.validation_bundle(judged, "t", "p", ["a", "b"], f"{tmp_path}/v")
    assert back["disagreements"].count() == 2 and back["confusion"].count() == 4
    assert "| a | 2 | 1.0000 | 0.5000 |" in spark.read.text(f"{tmp_path}/v/summary_md", wholetext=True).collect()[0].value
    sinks.write_crossfit(spark.createDataFrame([(1, 0, 0.5)], "r long, fold int, s double"), judged, f"{tmp_path}/c")
    assert spark.read.parquet(f"{tmp_path}/c/sentence_scores").count() == 1
    sinks.write_power(spark.createDataFrame([(20, 0.5), (10, 0.2)], "size int, power double"), f"{tmp_path}/p")
    assert [r[0] for r in spark.read.csv(f"{tmp_path}/p/power_curve", header=True).collect()] == ["10", "20"]
    audit = sinks.number_audit({"t1": (spark.createDataFrame([("x", "1.50", "—", "text")], "k string, a string, b string, c string"), "k")}).collect()
    assert [tuple(r) for r in audit] == [("x / a", 1.5, "t1")]
    cited = sinks.citation_audit(spark.createDataFrame([("see [A1] and [B2], [A1]",)], "t string"), "t", r"\[(\w+)\]", spark.createDataFrame([("A1",), ("C3",)], "key string"))
    assert sorted(map(tuple, cited.collect())) == [("A1", 2, True), ("B2", 1, False), ("C3", 0, True)]
    snap = sinks.lexicon_snapshot(spark.createDataFrame([("p", "x"), ("p", "x "), ("n", "y")], "category string, word string"), 2, "note")
    assert snap.count() == 2
    new = spark.createDataFrame([("p", "z"), ("n", "y")], "category string, word string")
    assert sorted((r.word, r.change) for r in sinks.lexicon_changes(snap, new).collect()) == [("x", "removed"), ("z", "added")]
    sinks.write_json(spark, {"a": [1, None]}, f"{tmp_path}/j")
    assert json.loads(spark.read.text(f"{tmp_path}/j").collect()[0].value) == {"a": [1, None]}
    (tmp_path / "inv").mkdir()
    (tmp_path / "inv" / "a.csv").write_text("1")
    (tmp_path / "inv" / "b.txt").write_text("22")
    assert [(r.path, r.bytes, r.reason) for r in sinks.inventory(spark, f"{tmp_path}/inv", {r"csv$": "data"}).collect()] == [("a.csv", 1, "data"), ("b.txt", 2, "unlisted")]


def test_tables(spark):
    fits = spark.createDataFrame([("m", "x", 1.0, 0.25, 4.0, 30), ("m", "y", None, None, None, 30), ("k", "x", -0.5, 0.3, -1.7, 12)], "model string, term string, beta double, se double, z double, n long")
    got = [tuple(r) for r in tables.coefficient_table(fits, {"x": "X", "y": "Y"}, ["m", "k"], 2).orderBy("place").collect()]
    assert got == [(0, "X", "1.00*** (0.25)", "-0.50* (0.30)"), (1, "Y", "—", "—"), (2, "n", "30", "12")]
    cond = spark.createDataFrame([("D0", 0.5, None, 1.0, 0.2), ("D0_D1", 0.5, 0.25, 2.0, 0.1)], "model string, first double, second double, lr double, p double")
    assert [r.coefficient for r in tables.conditional_table(cond).orderBy("model").collect()] == [0.5, 0.75]
    assert tables.without_empty_columns(spark.createDataFrame([("k", "—", None, "1")], "a string, b string, c string, d string"), ["a"]).columns == ["a", "d"]


def test_segments(spark):
    rows = [("The interestrate stays",), ("abcrate 12 x rates",), (None,), ("",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(T.segment(F.col("t"), ["rate", "interest"], ["the"])).collect()]
    assert got == [["interest", "rate", "stays"], ["abc", "rate", "rate"], [], []]


def test_disagreements_and_labels(spark):
    df = spark.createDataFrame([("a", "a", 1, 1), ("a", "b", 1, 1), ("a", None, 2, 3), (None, None, 1, 1)], "t string, p string, x int, y int")
    rows = metrics.disagreements(df, {"label": ("t", "p"), "size": ("x", "y")}).collect()
    assert [(r.label_differs, r.size_differs) for r in rows] == [(True, False), (True, True)]
    assert sorted(r.label for r in metrics.labels_of(df, ["t", "p"]).collect()) == ["a", "b"]


def test_search_for_whole_passages(spark):
    r = random.Random(4)
    docs = [(k, "".join(r.choice("ab \n") for _ in range(60))) for k in range(80)] + [(100, None), (101, "")]
    items = [(k, "".join(r.choice("ab \n") for _ in range(r.randrange(1, 7)))) for k in range(40)] + [(90, None), (91, " "), (92, "a b"), (92, "a b")]
    flat, bare = (lambda t: re.sub(r"[ \n]+", " ", t).strip(" ")), (lambda t: re.sub(r"[ \n]", "", t))
    want = {}
    for i, n in items:
        for d, t in docs:
            if n and bare(n) and t is not None and bare(n) in bare(t):
                at = (1 if n in t else 2 if flat(n) in flat(t) else 3, d)
                want[i] = min(want.get(i, at), at)
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {x.item_id: (x.level, x.doc_id) for x in search.layered_search(a, b).collect()} == want
    assert search.layered_search(a.limit(0), b).count() == 0 and search.layered_search(a, b.limit(0)).count() == 0


def test_squared_hinge_reaches_the_least_loss():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 5))
    y = np.where(x[:, 0] + 0.3 * rng.standard_normal(60) > 0.2, 1.0, -1.0)
    row, col = np.repeat(np.arange(60), 5), np.tile(np.arange(5), 60)
    loss = lambda w, b: 0.5 * (w @ w + b * b) + (np.maximum(0, 1 - y * (x @ w + b)) ** 2).sum()
    w, b = classify.squared_hinge(row, col, x.ravel(), y, np.ones(60), 5)
    best = loss(w, b)
    assert all(best <= loss(w + 1e-3 * d[:5], b + 1e-3 * d[5]) + 1e-9 for d in rng.standard_normal((200, 6)))


def labelled(spark):
    r = random.Random(1)
    rows = []
    for k in range(60):
        good = k % 3 > 0
        rows.append((k, 0, " ".join(r.choice(["rise", "grow", "gain"] if good else ["fall", "drop", "loss"]) for _ in range(8)), "good" if good else "bad", f"g{k // 2}"))
    return spark.createDataFrame(rows, "report long, sentence_id int, text string, label string, group string")


def test_classifiers(spark):
    rows = labelled(spark)
    out = classify.cross_validate(rows, "text", "label", "group", 3).collect()
    assert len(out) == 60 and sum(r.pred == r.label for r in out) >= 58
    folds = {}
    for r in out:
        folds.setdefault(r.group, set()).add(r.fold)
    assert all(len(f) == 1 for f in folds.values())
    curve = classify.learning_curve(rows, "text", "label", "group", (0.01, 0.5, 1.0), k=3).collect()
    assert [c.n_train for c in curve] == sorted(c.n_train for c in curve) and curve[0].n_train >= 3
    parts = rows.select("report", F.explode(F.array(F.struct(F.lit(0).alias("sentence_id"), "text"), F.struct(F.lit(1).alias("sentence_id"), F.lit("rise and gain").alias("text")))).alias("x")).select("report", "x.*")
    scored = classify.crossfit_tone(parts, rows, "text", "label", "report", "sentence_id", "good", "bad", k=3)
    got = scored.collect()
    assert len(got) == 120 and {r.manual for r in got if r.sentence_id == 1} == {""} and all(r.plus_score == -r.minus_score for r in got)
    assert all(r.pred == "good" for r in got if r.sentence_id == 1)
    tone = classify.report_tone(scored, "report", "pred", "plus_score", "minus_score", {"all": []}).collect()
    assert len(tone) == 60 and all((t.all_mean > 0) == (t.report % 3 > 0) or t.report % 3 == 0 for t in tone)
    assert classify.predicted_counts(scored, "report", ["good", "bad"]).count() == 60
    tasks = {r.task: r for r in classify.evaluate_tasks(rows, {"all": ("label", None), "few": ("label", "report < 3")}, "text", "group", k=3).collect()}
    assert tasks["all"].accuracy > 0.9 and tasks["few"].accuracy is None and "fewer" in tasks["few"].error
    seeds = spark.createDataFrame([("m", 1.0), ("m", -1.0), ("m", 3.0)], "model string, beta double")
    s = classify.seed_summary(seeds, ["model"], "beta").collect()[0]
    assert (s.n_seeds, s["mean"], s.least, s.largest) == (3, 1.0, -1.0, 3.0) and s.share_positive == pytest.approx(2 / 3)


def test_fold_models_equal_fits_from_scratch(spark):
    """Counts that are the total less the fold's, and fits that share their work, against one fit of each training set by itself."""
    rows = [(k, r.text, r.label, k * 7 // 5 % 3) for k, r in enumerate(labelled(spark).collect())]
    texts = spark.createDataFrame([(k, t) for k, t, *_ in rows], "_row long, _t string")
    roles = [(name, k, lab, fold) for name in ("a", "b") for k, _, lab, fold in rows if name == "a" or k % 4]
    models = classify.FoldModels().fit(texts, spark.createDataFrame(roles, "assignment string, _row long, label string, fold int"), [("a", 0), ("a", 2), ("b", 1), ("b", 9), ("none", 0)])
    assert models.errors == {("none", 0): "no rows"} and set(models.models) == {("a", 0), ("a", 2), ("b", 1), ("b", 9)}
    text = {k: t for k, t, *_ in rows}
    for (name, held), (features, w, b, labels) in models.models.items():
        own = [(classify.gram_counts(text[k]), lab) for n, k, lab, fold in roles if n == name and fold != held]
        df = {}
        for c, _ in own:
            for g in c:
                df[g] = df.get(g, 0) + 1
        assert set(features.index) == set(df) and labels == ["bad", "good"]
        assert all(features.idf[i] == pytest.approx(math.log((1 + len(own)) / (1 + df[g])) + 1) for g, i in features.index.items())
        vectors = [features.weights_of(c) for c, _ in own]
        y = np.array([1.0 if lab == "good" else -1.0 for _, lab in own])
        share = (y > 0).mean()
        row, col, value = np.repeat(np.arange(len(own)), [len(a) for a, _ in vectors]), np.concatenate([a for a, _ in vectors]), np.concatenate([v for _, v in vectors])
        alone, c = classify.squared_hinge(row, col, value, y, np.where(y > 0, 0.5 / share, 0.5 / (1 - share)), len(df))
        assert np.allclose(alone, w[:, 0], atol=5e-3) and c == pytest.approx(b[0], abs=5e-3)
        again = classify.RowSpace(row, col, value, len(own), len(df)).squared_hinge(y, np.where(y > 0, 0.5 / share, 0.5 / (1 - share)))
        assert np.allclose(alone, again[0], atol=5e-3) and c == pytest.approx(again[1], abs=5e-3)
    assert classify.gram_counts("abc") == {"ab": 1, "bc": 1, "abc": 2} and not classify.gram_counts("") and not classify.gram_counts(None)


def test_folds_take_many_labels_a_group(spark):
    wide = spark.createDataFrame([(f"g{k}", f"l{j}") for k in range(8) for j in range(9)], "group string, label string")
    folds = classify.group_folds(wide, "group", "label", 4).collect()
    assert len(folds) == 8 and sorted(f.fold for f in folds) == [0, 0, 1, 1, 2, 2, 3, 3]


def test_sublinear_weights(spark):
    df = spark.createDataFrame([(["a", "a", "b"],), (["a", "c"],), ([],)], "g array<string>")
    f = classify.SublinearTfidf().fit(df, "g")
    at, w = f.weights(["a", "a", "b", "zz"])
    idf = {"a": math.log(4 / 3) + 1, "b": math.log(4 / 2) + 1}
    raw = {"a": (1 + math.log(2)) * idf["a"], "b": idf["b"]}
    norm = math.sqrt(sum(v * v for v in raw.values()))
    assert {k: pytest.approx(v / norm) for k, v in raw.items()} == {t: w[list(at).index(f.index[t])] for t in raw}


def daily(spark, n=260):
    rng = np.random.default_rng(3)
    event = (np.arange(n) % 20 == 5).astype(float)
    z = event * rng.standard_normal(n)
    r = rng.standard_t(6, n) * 0.01 * np.exp(0.4 * z)
    return spark.createDataFrame([(k, float(r[k]), float(event[k]), float(z[k])) for k in range(n)], "d int, ret double, event_day double, z double")


def test_joint_fit_and_what_follows_from_it(spark):
    df, xs = daily(spark), ["event_day", "z"]
    base = volatility.baseline_fit(df, "d", "ret", 30)
    joint = volatility.joint_fit(df, "d", "ret", xs, "z", base, 30)
    rows = {r.term: r for r in joint.collect()}
    one = rows["z"]
    assert one.loglik >= one.restricted_loglik - 1e-6 and one.loglik >= base["loglik"] - 1e-3 and one.lr == pytest.approx(max(0, 2 * (one.loglik - one.restricted_loglik)))
    assert one.volatility_percent == pytest.approx((math.exp(one.value / 2) - 1) * 100) and rows["mu"].volatility_percent is None
    theta = volatility.theta_of(joint, xs)
    cond = {r.model: r for r in volatility.conditional_fits(df, "d", "ret", xs, "z", theta).collect()}
    assert cond["D0_D1"].loglik >= cond["D0"].loglik - 1e-6 and cond["D0"].lr >= 0
    assert volatility.compare_fits(one.value, cond["D0"].first)["relative_difference"] < 0.5
    again = volatility.permuted_joint(df, "d", "ret", xs, "event_day", "z", theta, n=3, rounds=5).collect()
    assert len(again) == 3
    moved = volatility.date_sensitivity(df, "d", "ret", xs, xs, theta, rounds=5).collect()
    assert {m.shift for m in moved} == {-1, 0, 1} and len(moved) == 27
    assert volatility.joint_fit(df.limit(10), "d", "ret", xs, "z").count() == 0
    z, e = np.linspace(-3, 3, 7), np.zeros(7)
    assert volatility.normal_loglik(z, e) == pytest.approx(sum(-0.5 * math.log(2 * math.pi) - 0.5 * v * v for v in z))


def test_fits_of_several_specifications(spark):
    rng = np.random.default_rng(5)
    rows = [(k, float(a), float(b), float(1 + 2 * a - b + rng.standard_normal()), "s" if k < 6 else "t") for k, (a, b) in enumerate(rng.standard_normal((80, 2)))]
    df = spark.createDataFrame(rows, "k long, a double, b double, y double, part string")
    fits = regression.gated_fits(df, "y", ["a", "b"], "part").collect()
    assert all((f.beta is None) == (f.model == "s") for f in fits)
    specs = regression.specification_fits(df, "y", {"one": ["a"], "two": ["a", "b"]}).collect()
    assert {(f.model, f.term) for f in specs} == {("one", "const"), ("one", "a"), ("two", "const"), ("two", "a"), ("two", "b")}
    t = regression.totals(df, "y", ["a", "b"], "a", "b", "k").collect()[0]
    by = {f.term: f.beta for f in specs if f.model == "two"}
    assert t.beta == pytest.approx(by["a"] + by["b"]) and t.lo < t.beta < t.hi
    assert regression.totals(df.limit(5), "y", ["a", "b"], "a", "b", "k").collect()[0].beta is None


def test_a_weigher_looks_terms_up_once_for_all_fits():
    from tidemark.operators import classify

    features = {("a", 0): classify.SublinearTfidf.of(["xy", "b", "zz"], [3, 1, 2], 5), ("a", 1): classify.SublinearTfidf.of(["b", "q"], [2, 2], 4), ("c", 0): classify.SublinearTfidf.of([], [], 0)}
    counts = {"q": 2, "unknown": 4, "zz": 1, "b": 3}
    own = classify.Weigher(features).weights(list(counts), list(counts.values()), list(features))
    for (at, w), f in zip(own, features.values()):
        want_at, want = f.weights_of(counts)
        assert at.tolist() == want_at.tolist() and w == pytest.approx(want)


def test_sparse_and_dense_fits_are_the_same(monkeypatch):
    from tidemark.operators import classify

    r = np.random.default_rng(2)
    row, col = np.repeat(np.arange(50), 4), np.concatenate([r.choice(12, 4, False) for _ in range(50)])
    args = row, col, r.random(200), np.where(r.random(50) < 0.4, 1.0, -1.0), np.ones(50), 14
    one = classify.squared_hinge(*args)
    monkeypatch.setattr(classify, "DENSE_CELLS", 0)
    two = classify.squared_hinge(*args)
    assert one[0] == pytest.approx(two[0], abs=1e-6) and one[1] == pytest.approx(two[1], abs=1e-6)
