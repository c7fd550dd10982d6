"""Literal cases of the study's operators, and properties that hold on any series."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import duplicates, events, metrics, order, regression, sampling, scoring, similarity, volatility
from tidemark.sources import sinks, tables


def cal_of(spark, values, col="close"):
    rows = [(f"2020-01-{i + 1:02d}", float(v) if v is not None else None) for i, v in enumerate(values)]
    return events.calendar(spark.createDataFrame(rows, f"d string, {col} double").withColumn("d", F.to_date("d")))


def one(df, col):
    return df.collect()[0][col]


@pytest.fixture()
def event(spark):
    return lambda pos: spark.createDataFrame([("e", pos)], "event_id string, pos int")


def test_window_returns(spark, event):
    cal = cal_of(spark, [90, 100, 110, 120, 150])
    assert one(events.window_return(event(1), cal, "close", 0, 3, "r"), "r") == pytest.approx(0.5)
    assert one(events.window_return(event(1), cal, "close", -1, 1, "r"), "r") == pytest.approx(110 / 90 - 1)
    assert one(events.window_return(event(0), cal, "close", -1, 1, "r"), "r") is None
    assert one(events.window_return(event(3), cal, "close", 0, 3, "r"), "r") is None


def test_realized_volatility(spark, event):
    r = [0, 0.01, -0.01, 0.02, 0]
    cal = cal_of(spark, r, "ret")
    assert one(events.realized_volatility(event(1), cal, "ret", 0, 3, "rv"), "rv") == pytest.approx(np.std(r[1:5], ddof=1) * math.sqrt(252))
    assert one(events.realized_volatility(event(2), cal, "ret", 0, 3, "rv"), "rv") is None
    gap = cal_of(spark, [0, 0.01, None, 0.02, 0], "ret")
    assert one(events.realized_volatility(event(1), gap, "ret", 0, 3, "rv"), "rv") == pytest.approx(np.std([0.01, 0.02, 0], ddof=1) * math.sqrt(252))


def test_yield_change_and_curve(spark, event):
    cal = cal_of(spark, [1.0, 1.1, 1.2], "y")
    assert one(events.yield_change_bp(event(0), cal, "y", 0, 2, "b"), "b") == pytest.approx(20.0)
    f = events.curve_factors(F.lit(1.0), F.lit(2.0), F.lit(4.0))
    r = spark.range(1).select(*[c.alias(n) for n, c in f.items()]).collect()[0]
    assert r.level == pytest.approx(7 / 3) and r.slope == pytest.approx(3) and r.curvature == pytest.approx(-1)


def test_calendar_checks(spark):
    twice = spark.createDataFrame([("2020-01-01",), ("2020-01-01",)], "d string").withColumn("d", F.to_date("d"))
    with pytest.raises(Exception, match="occurs twice"):
        events.calendar(twice).collect()
    cal = cal_of(spark, [1, 2, 3])
    bad = spark.createDataFrame([("2021-05-05",)], "day string").withColumn("day", F.to_date("day"))
    with pytest.raises(Exception, match="not a calendar day"):
        events.on_calendar(bad, cal, "day").collect()


def test_next_calendar_day_crosses_months_and_drops_late_dates(spark):
    days = spark.createDataFrame([("2020-01-02",), ("2020-01-30",), ("2020-04-01",)], "d string").withColumn("d", F.to_date("d"))
    ask = spark.createDataFrame([("2020-01-01",), ("2020-01-02",), ("2020-01-31",), ("2020-02-15",), ("2020-04-02",)], "q string").withColumn("q", F.to_date("q"))
    got = {str(r.q): str(r.cal_d) for r in events.next_calendar_day(ask, days, "q").collect()}
    assert got == {"2020-01-01": "2020-01-02", "2020-01-02": "2020-01-02", "2020-01-31": "2020-04-01", "2020-02-15": "2020-04-01"}


def test_forecast_ignores_the_future(spark):
    def last(v):
        rows = spark.createDataFrame([(i, float(x)) for i, x in enumerate([1, 2, 3, 4, v])], "i int, v double")
        return {r.i: r for r in events.expanding_forecast(rows, "v", "i", 3).collect()}

    a, b = last(99), last(-99)
    assert a[3].forecast == b[3].forecast == pytest.approx(4.0) and a[4].forecast == b[4].forecast
    assert a[0].method == "insufficient_history" and a[1].method == "last_available" and a[1].forecast == 1.0


def test_terciles_and_bins_on_ties(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 1, 2, 2, 2, 3)], "v double")
    r = events.terciles(df, "v").select("v", events.high_low(F.col("v"), F.col("q1"), F.col("q2")).alias("g"), events.right_closed_bin(F.col("v"), F.col("q1"), F.col("q2")).alias("b")).distinct().collect()
    assert {x.v: x.g for x in r} == {1.0: "low", 2.0: "high", 3.0: "high"} and {x.v: x.b for x in r} == {1.0: 0, 2.0: 1, 3.0: 2}


def test_sentences_of_another_script(spark):
    r = spark.createDataFrame([("第一句话完。第二句话完；第三句话完！",)], "t string").select(T.sentences(F.col("t"), "。！？；").alias("s")).collect()[0].s
    assert len(r) == 3 and r[0].endswith("。")


def test_adjacent_and_expanding_similarity(spark):
    rows = [(0, "alpha beta gamma"), (1, "alpha beta gamma"), (2, "delta beta omega"), (3, None), (4, "delta")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = order.with_index(docs, ["doc_id"])
    a = {r.idx: r.similarity for r in similarity.adjacent_similarity(docs, T.words(F.col("text"))).collect()}
    assert a[0] is None and a[1] == pytest.approx(1.0) and a[1] > a[2] and a[3] == 0.0
    e = {r.idx: r.similarity for r in similarity.expanding_similarity(docs, T.words(F.col("text"))).collect()}
    assert e[0] is None and e[1] == pytest.approx(1.0) and e[3] is None and e[4] is None
    fewer = order.with_index(docs.where("idx < 3").drop("idx"), ["doc_id"])
    assert {r.idx: r.similarity for r in similarity.expanding_similarity(fewer, T.words(F.col("text"))).collect()}[2] == pytest.approx(e[2])


def test_running_count_over_blocks(spark):
    df = spark.createDataFrame([("a", i) for i in range(0, 50, 2)] + [("b", i) for i in range(50)], "g string, i long")
    got = {(r.g, r.i): r.n for r in order.running_count(df, "g", "i", block=7).collect()}
    assert all(got["a", i] == i // 2 + 1 for i in range(0, 50, 2)) and all(got["b", i] == i + 1 for i in range(50))


def test_scores(spark):
    lex = scoring.Lexicon(positive=("good",), negative=("bad",), dovish=("ease",), hawkish=("hike",), negations=("not",), turning=("but",), degree={"very": 1.5}, topics={"t": ("ea",)})
    df = spark.createDataFrame([(1, "very good. not ease but"), (2, None), (3, "")], "doc_id long, text string")
    r = {x.doc_id: x for x in scoring.text_scores(df, lex).collect()}
    assert r[1].sentiment == pytest.approx(1.5 * 1000 / 23) and r[1].stance == pytest.approx(-1000 / 23) and r[1].attention_t == pytest.approx(1000 / 23)
    assert r[2].sentiment is None and r[3].sentiment == 0.0


def test_near_pairs_routes(spark):
    long = "the committee will keep policy steady over the coming year"
    rows = [(1, long), (2, long + "!"), (3, "x" + long + " and more words follow here"), (4, ""), (5, None), (6, "short one"), (7, "short on")]
    got = {(r.a, r.b) for r in duplicates.near_pairs(spark.createDataFrame(rows, "id long, s string"), "id", "s").collect()}
    assert got == {(1, 2), (1, 3)}
    roots = {r.id: r.root for r in duplicates.duplicate_groups(spark.createDataFrame(rows, "id long, s string"), "id", "s").collect()}
    assert roots[3] == 1 and roots[6] == 6 and roots[4] == 4


def test_hc3_equals_dense(spark):
    rng = np.random.default_rng(1)
    x, e = rng.normal(size=(60, 2)), rng.normal(size=60)
    y = 1 + x @ [2.0, -1.0] + e
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)] + [(None, 1.0, 1.0)], "a double, b double, y double")
    beta, cov = regression.hc3_arrays(x, y)
    got = {r.term: r for r in regression.ols_hc3(df, "y", ["a", "b"]).collect()}
    for k, t in enumerate(["const", "a", "b"]):
        assert got[t].beta == pytest.approx(beta[k], rel=1e-9) and got[t].se == pytest.approx(math.sqrt(cov[k, k]), rel=1e-9) and got[t].n == 60
    assert regression.ols_hc3(df.limit(2), "y", ["a", "b"]).collect()[0].beta is None


def test_resampling_gates_and_seeds(spark):
    df = spark.createDataFrame([(i, float(i), float(i % 5)) for i in range(30)], "i int, y double, x double")
    a, b = (regression.bootstrap_ci(df, "y", ["x"], "x", "i", 50).collect()[0] for _ in range(2))
    assert (a.lo, a.hi) == (b.lo, b.hi) and a.lo < a.hi
    assert regression.bootstrap_ci(df.limit(5), "y", ["x"], "x", "i", 50).collect()[0].lo is None
    assert 0 < regression.permutation_p(df, "y", ["x"], "x", "i", 50).collect()[0].p <= 1


def test_conditional_fit():
    r = np.cos(np.arange(100) / 3) * 2
    theta = np.array([0, 0, -0.2, 0.08, -0.02, 0.92, 8.0, 0.0])
    fit = volatility.conditional_fit(r, np.zeros((100, 1)), theta, [0])
    assert fit["lr"] >= 0
    rng = np.random.default_rng(3)
    x = (np.arange(400) % 10 == 0).astype(float)[:, None]
    h = volatility.log_variance(np.zeros(400), 0.02, 0.0, 0.0, 0.5, 8.0, x[:, 0], 1.0)
    fit = volatility.conditional_fit(rng.standard_normal(400) * np.exp(h / 2), x, np.array([0, 0, 0.02, 0, 0, 0.5, 8.0, 0.0]), [0])
    assert 0.3 < fit["values"][0] < 1.8 and fit["lr"] > 3
    assert volatility.compare_fits(1.0, 1.1)["accepted"] and not volatility.compare_fits(1.0, -1.0)["accepted"]


def test_metrics_with_a_missing_class(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "t string, p string")
    m = {r.label: r for r in metrics.label_metrics(df, "t", "p", ["a", "b", "c"]).collect()}
    assert m["c"].f1 == 0.0 and m["a"].recall == 0.5 and m["b"].precision == 0.5
    assert metrics.confusion(df, "t", "p", ["a", "b", "c"]).count() == 9


def test_even_positions_round_half_even(spark):
    df = spark.range(10).select(F.lit(1).alias("g"), "id")
    got = sorted(r.id for r in sampling.even_sample(df, ["g"], ["id"], F.lit(4)).collect())
    assert got == sorted({int(np.round(i * 9 / 3)) for i in range(4)})


def test_holm(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", None), ("d", 0.02)], "model string, p double")
    got = {r.model: r.p_holm for r in events.holm(df).collect()}
    assert got == {"a": pytest.approx(0.04), "d": pytest.approx(0.06), "b": pytest.approx(0.08), "c": 1.0}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts" / "a.txt").write_text("one\ntwo")
    index = spark.createDataFrame([(1, "a.txt"), (2, "none.txt")], "id int, local_path string")
    got = {r.id: r.text for r in tables.side_texts(spark, index, "local_path", f"{tmp_path}/texts").collect()}
    assert got == {1: "one\ntwo", 2: ""}
    prices = spark.createDataFrame([("2020-01-02", 1.5, 0.1, None)], "date string, close double, simple_return double, volatility_20d double")
    sinks.write_csv(prices, f"{tmp_path}/p", bom=True)
    assert tables.csv(spark, f"{tmp_path}/p", "stock_prices", ["date"]).collect()[0].close == 1.5
    m = sinks.manifest(spark, f"{tmp_path}/texts").collect()
    assert [(r.path, r.bytes) for r in m] == [("a.txt", 7)]
