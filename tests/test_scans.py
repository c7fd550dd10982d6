"""Running values, lags, forecasts, samples and quantiles over blocks and ranges, against plain Python on whole groups."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import events, metrics, quantiles, sampling, scans


def groups_of(n=700, seed=5):
    r = random.Random(seed)
    # one group holds most rows, one has a null name, one a single row
    rows = [(i, r.choice(["hot"] * 6 + ["b", None]), r.choice([None, float("nan"), *range(9), r.gauss(0, 1)])) for i in range(n)]
    rows.append((n, "one", 3.0))
    r.shuffle(rows)
    return [(i, g, float(v) if v is not None else None) for i, g, v in rows]


def by_group(rows):
    out = {}
    for i, g, v in sorted(rows, key=lambda x: x[0]):
        out.setdefault(g, []).append((i, v))
    return out


@pytest.mark.parametrize("block", [3, 50, 100_000])
def test_lag_and_running_cross_blocks(spark, block):
    rows = groups_of()
    df = spark.createDataFrame(rows, "i int, g string, v double")
    b = scans.running(scans.lag(scans.blocked(df, ["g"], ["i"], block), "i", "before"), {"n": ("sum", F.lit(1)), "top": ("max", F.when(~F.isnan("v"), F.col("v")))}, whole={"size": F.lit(1)})
    b = scans.running(b, {"past": ("sum", F.col("i")), "least": ("min", F.when(~F.isnan("v"), F.col("v")))}, past=True)
    got = {r.i: (r.before, r.n, r.top, r.size, r.past, r.least) for r in b.collect()}
    want = {}
    for members in by_group(rows).values():
        seen = []
        for k, (i, v) in enumerate(members):
            least = min(seen, default=None)
            seen += [v] if v is not None and v == v else []
            want[i] = (members[k - 1][0] if k else None, k + 1, max(seen, default=None), len(members), sum(x for x, _ in members[:k]), least)
    assert got == want
    assert set(scans.unblocked(b).columns) == {"i", "g", "v", "before", "n", "top", "size", "past", "least"}


def test_no_groups_and_no_rows(spark):
    df = spark.range(40).withColumn("v", F.col("id") * 2)
    got = events.first_difference(df, "v", "id", "d", block=7)
    assert sorted((r.id, r.d) for r in got.collect()) == [(i, 2 if i else None) for i in range(40)]
    none = events.first_difference(df.limit(0), "v", "id", "d")
    assert none.count() == 0 and none.columns == ["id", "v", "d"]
    assert events.holm(spark.createDataFrame([], "model int, p double")).count() == 0
    assert events.expanding_forecast(spark.createDataFrame([], "i int, v double"), "v", "i").count() == 0
    assert sampling.even_sample(spark.createDataFrame([], "i int, g string"), ["g"], ["i"], F.lit(3)).count() == 0


def test_holm_over_blocks(spark):
    r = random.Random(2)
    rows = [(g, i, r.choice([None, r.random() / 50, 0.01])) for g in ("a", None) for i in range(60)]
    got = {(x.g, x.model): x.p_holm for x in events.holm(spark.createDataFrame(rows, "g string, model int, p double"), by=["g"], block=7).collect()}
    for g in ("a", None):
        own, top = sorted((1.0 if p is None else p, i) for h, i, p in rows if h == g), 0.0
        for k, (p, i) in enumerate(own):
            top = max(top, (len(own) - k) * p)
            assert got[g, i] == pytest.approx(min(1.0, top))


@pytest.mark.parametrize("block", [4, 100_000])
def test_expanding_forecast_over_blocks(spark, block):
    r = random.Random(4)
    rows = [(g, i, None if r.random() < 0.1 else 7.0 if g == "flat" else 150_000 + r.gauss(0, 900)) for g in ("a", None, "flat") for i in range(45)]
    df = spark.createDataFrame(rows, "g string, i int, v double")
    got = {(x.g, x.i): (x.method, x.forecast) for x in events.expanding_forecast(df, "v", "i", 5, ["g"], block).collect()}
    assert len(got) == len(rows)
    for g in ("a", None, "flat"):
        seen = []
        for h, i, v in rows:
            if h != g:
                continue
            method, forecast = got[g, i]
            if v is None:
                assert (method, forecast) == ("missing_actual", None)
                continue
            if not seen:
                assert (method, forecast) == ("insufficient_history", None)
            elif len(seen) < 5:
                assert method == "last_available" and forecast == pytest.approx(seen[-1])
            elif g == "flat":
                assert method == "historical_mean_constant" and forecast == pytest.approx(7.0)
            else:
                slope, icept = np.polyfit(np.array(seen[:-1]) - 150_000, np.array(seen[1:]) - 150_000, 1)
                assert method == "expanding_ar1" and forecast == pytest.approx(150_000 + icept + slope * (seen[-1] - 150_000), rel=1e-9)
            seen.append(v)


@pytest.mark.parametrize("accuracy", [10, 10_000])
def test_quantiles_are_exact(spark, accuracy):
    rows = groups_of(900, 8) + [(5000, "empty", None), (5001, "empty", float("nan"))] + [(6000 + i, "big", float(i * i % 997)) for i in range(3000)]
    df = spark.createDataFrame(rows, "i int, g string, v double")
    probs = [0.0, 0.25, 1 / 3, 0.5, 0.999, 1.0]
    got = {r.g: r.q for r in quantiles.quantiles(df, ["g"], "v", probs, accuracy=accuracy).collect()}
    own = by_group(rows)
    assert set(got) == set(own) and got["empty"] is None
    for g, members in own.items():
        v = [x for _, x in members if x is not None and x == x]
        if v:
            assert got[g] == pytest.approx(list(np.quantile(v, probs)), rel=1e-12, abs=1e-12)
    (alone,) = quantiles.quantiles(df, [], "v", [0.5]).collect()
    assert alone.q[0] == pytest.approx(np.median([v for _, _, v in rows if v is not None and v == v]))
    assert quantiles.quantiles(df.limit(0), ["g"], "v", [0.5]).count() == 0


def test_brackets_that_miss_are_opened(spark, monkeypatch):
    """With a sketch that is wrong on both sides the ranks are still found."""
    monkeypatch.setattr(quantiles.F, "percentile_approx", lambda v, probs, accuracy: F.array(*[F.lit(90.0 if k % 2 else 5.0) for k in range(len(probs))]))
    df = spark.range(101).select(F.col("id").cast("double").alias("v"))
    (r,) = quantiles.quantiles(df, [], "v", [0.5, 0.25]).collect()
    assert r.q == [50.0, 25.0]


def test_even_sample_takes_settings(spark):
    rows = [(i, g, q) for g, q, n in (("a", 3, 11), (None, 2, 9), ("c", 50, 4)) for i in range(n)]
    got = sampling.even_sample(spark.createDataFrame(rows, "i int, g string, q int"), ["g"], ["i"], F.col("q"), ["q"]).collect()
    assert sorted((str(r.g), r.i) for r in got) == [("None", 0), ("None", 8), ("a", 0), ("a", 5), ("a", 10), *[("c", i) for i in range(4)]]


def test_describe(spark):
    r = random.Random(1)
    v = [r.gauss(10, 3) for _ in range(500)]
    (x,) = metrics.describe(spark.createDataFrame([(a,) for a in v] + [(None,), (float("nan"),)], "v double"), ["v"]).collect()
    assert (x["count"], x["min"], x["max"]) == (500, min(v), max(v))
    assert [x.mean, x.std, x.p25, x.p50, x.p75] == pytest.approx([np.mean(v), np.std(v, ddof=1), *np.quantile(v, [0.25, 0.5, 0.75])])
