"""Least squares with HC3 errors from two aggregate passes, and what is built on it.

The first pass sums x_i x_j and x_i y, the driver solves a k x k system for each group, the second pass sums
(e / (1 - h))^2 x_i x_j. Only k x k numbers a group reach the driver, whatever the rows."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "model string, term string, beta double, se double, z double, p double, lo double, hi double, n long, r2 double, condition double"


def finite(c):
    """NaN and infinities as null."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which all columns are there and finite."""
    return df.withColumns({c: finite(F.col(c).cast("double")) for c in columns}).dropna(subset=columns)


def _p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2)) if math.isfinite(z) else float("nan")


def ols_hc3(df: DataFrame, y: str, xs: list[str], by: str | None = None) -> DataFrame:
    """A row for each group (column model) and term, const first: SCHEMA. A group with no more rows than terms has null estimates."""
    spark = df.sparkSession
    k = len(xs) + 1
    rows = complete(df, [y, *xs]).select((F.col(by).cast("string") if by else F.lit("all")).alias("model"), F.col(y).alias("_y"), *[F.col(x).alias(f"_x{i + 1}") for i, x in enumerate(xs)]).withColumn("_x0", F.lit(1.0))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    x = lambda i: F.col(f"_x{i}")
    first = rows.groupBy("model").agg(*[F.sum(x(i) * x(j)).alias(f"s{i}_{j}") for i, j in pairs], *[F.sum(x(i) * F.col("_y")).alias(f"t{i}") for i in range(k)], F.count("*").alias("n"), F.sum(F.col("_y") * F.col("_y")).alias("yy"))
    fits, out = {}, []
    for r in first.collect():
        a = np.zeros((k, k))
        for i, j in pairs:
            a[i, j] = a[j, i] = r[f"s{i}_{j}"]
        b = np.array([r[f"t{i}"] for i in range(k)])
        if r["n"] <= k or np.linalg.matrix_rank(a) < k:
            out += [(r["model"], t, *[None] * 6, r["n"], None, None) for t in ["const", *xs]]
            continue
        inv = np.linalg.inv(a)
        lam = np.linalg.eigvalsh(a)
        fits[r["model"]] = (inv, inv @ b, r["n"], r["yy"], b[0], float(math.sqrt(lam[-1] / lam[0])))
    if fits:
        table = spark.createDataFrame([(m, f[0].ravel().tolist(), f[1].tolist()) for m, f in fits.items()], "model string, inv array<double>, beta array<double>")
        e = F.col("_y") - sum((F.col("beta")[i] * x(i) for i in range(1, k)), F.col("beta")[0])
        h = sum((F.col("inv")[i * k + j] * x(i) * x(j) for i in range(k) for j in range(k)), F.lit(0.0))
        both = rows.join(F.broadcast(table), "model").withColumns({"_e": e, "_h": h}).withColumn("_w", F.try_divide(F.col("_e"), 1 - F.col("_h")))
        second = both.groupBy("model").agg(*[F.sum(F.col("_w") * F.col("_w") * x(i) * x(j)).alias(f"m{i}_{j}") for i, j in pairs], F.sum(F.col("_e") * F.col("_e")).alias("ee"))
        for r in second.collect():
            inv, beta, n, yy, sy, cond = fits[r["model"]]
            meat = np.zeros((k, k))
            for i, j in pairs:
                meat[i, j] = meat[j, i] = r[f"m{i}_{j}"] if r[f"m{i}_{j}"] is not None else np.nan
            se = np.sqrt(np.diag(inv @ meat @ inv))
            total = yy - sy * sy / n
            r2 = float(1 - r["ee"] / total) if total > 0 else None
            for i, t in enumerate(["const", *xs]):
                z = beta[i] / se[i] if se[i] > 0 else float("nan")
                out.append((r["model"], t, float(beta[i]), float(se[i]), float(z), _p(z), float(beta[i] - 1.959963984540054 * se[i]), float(beta[i] + 1.959963984540054 * se[i]), n, r2, cond))
    return spark.createDataFrame(out, SCHEMA)


def hc3_arrays(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimates and HC3 covariance of a small sample in memory; a constant is put first."""
    x = np.column_stack((np.ones(len(x)), x))
    inv = np.linalg.pinv(x.T @ x)
    beta = inv @ x.T @ y
    w = (y - x @ beta) / (1 - np.einsum("ij,jk,ik->i", x, inv, x))
    return beta, inv @ ((x * (w * w)[:, None]).T @ x) @ inv


def percent_effect(beta: float) -> float:
    return (math.exp(beta) - 1) * 100


def gated_fits(df: DataFrame, y: str, xs: list[str], by: str | None = None, least: int | None = None) -> DataFrame:
    """ols_hc3 with null estimates for models of fewer than `least` rows (terms + 5 unless given), and percent effects of the coefficients."""
    least = len(xs) + 6 if least is None else least
    fits = ols_hc3(df, y, xs, by)
    gone = F.col("n") < least
    numbers = [c for c, t in fits.dtypes if t == "double"]
    out = fits.withColumns({c: F.when(~gone, F.col(c)) for c in numbers})
    return out.withColumn("percent", (F.exp("beta") - 1) * 100)


def specification_fits(df: DataFrame, y: str, specs: dict[str, list[str]], least: int | None = None) -> DataFrame:
    """A model a specification (name -> regressors) of one outcome."""
    out = None
    for name, xs in specs.items():
        one = gated_fits(df, y, xs, least=least).withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def totals(df: DataFrame, y: str, xs: list[str], base: str, inter: str, order: str) -> DataFrame:
    """One row: the sum of two coefficients with its error, z test and interval; null under terms + 5 rows."""
    x, v = _panel(df, y, xs, order)
    schema = "beta double, se double, z double, p double, lo double, hi double, n long"
    if len(v) < len(xs) + 6:
        return df.sparkSession.createDataFrame([(*[None] * 6, len(v))], schema)
    beta, cov = hc3_arrays(x, v)
    t = total_effect(beta, cov, xs.index(base) + 1, xs.index(inter) + 1)
    return df.sparkSession.createDataFrame([(*(t[k] for k in ("beta", "se", "z", "p", "lo", "hi")), len(v))], schema)


def total_effect(beta: np.ndarray, cov: np.ndarray, i: int, j: int) -> dict[str, float]:
    """b_i + b_j with its error, z test and 95 % interval."""
    b, se = float(beta[i] + beta[j]), math.sqrt(max(0.0, float(cov[i, i] + cov[j, j] + 2 * cov[i, j])))
    z = b / se if se else float("nan")
    return {"beta": b, "se": se, "z": z, "p": _p(z), "lo": b - 1.96 * se, "hi": b + 1.96 * se}


def vif(df: DataFrame, columns: list[str]) -> DataFrame:
    """(term, vif) from the inverse correlation matrix, one aggregate pass."""
    rows = complete(df, columns)
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    r = rows.agg(*[F.corr(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs]).collect()[0] if pairs else {}
    c = np.eye(len(columns))
    for i, j in pairs:
        c[i, j] = c[j, i] = np.nan if r[f"c{i}_{j}"] is None else r[f"c{i}_{j}"]
    ok = np.isfinite(c).all() and np.linalg.matrix_rank(c) == len(columns)
    d = np.diag(np.linalg.inv(c)) if ok else np.full(len(columns), np.inf)
    return df.sparkSession.createDataFrame([(t, float(v)) for t, v in zip(columns, d)], "term string, vif double")


#: Panels that are resampled fit into a task; a larger one is refused rather than collected.
PANEL_ROWS = 100_000


def _panel(df: DataFrame, y: str, xs: list[str], order: str):
    rows = complete(df, [y, *xs]).select(order, y, *xs).orderBy(order).limit(PANEL_ROWS + 1).collect()
    if len(rows) > PANEL_ROWS:
        raise ValueError(f"resampling is for panels of at most {PANEL_ROWS} rows")
    a = np.array([r[1:] for r in rows], float).reshape(len(rows), len(xs) + 1)
    return a[:, 1:], a[:, 0]


def replicates(spark, one, n: int, seed: int, names: list[str]) -> DataFrame:
    """(replicate, names...) from one(rng) -> floats, replicates spread over tasks, each with a generator of its own."""

    def run(frames):
        for f in frames:
            rows = [(int(i), *map(float, one(np.random.default_rng([seed, int(i)])))) for i in f["id"]]
            yield pd.DataFrame(rows, columns=["replicate", *names])

    return spark.range(0, n, 1, max(1, min(64, n // 25))).mapInPandas(run, "replicate long, " + ", ".join(f"{c} double" for c in names))


def bootstrap_ci(df: DataFrame, y: str, xs: list[str], term: str, order: str, n: int = 200, seed: int = 2026, plus: str | None = None) -> DataFrame:
    """One row (term, n_rows, lo, hi, failed): 95 % percentile interval over resampled rows, of a term or of its sum with `plus`.

    Under 8 rows (with plus: under terms + 5) the interval is null. Failed replicates are counted."""
    x, v = _panel(df, y, xs, order)
    few = len(v) < (len(xs) + 6 if plus else 8)
    cols = [xs.index(term) + 1] + ([xs.index(plus) + 1] if plus else [])

    def one(rng):
        i = rng.integers(0, len(v), len(v))
        b = hc3_arrays(x[i], v[i])[0]
        return [float(b[cols].sum())]

    spark = df.sparkSession
    if few:
        return spark.createDataFrame([(term, len(v), None, None, 0)], "term string, n_rows long, lo double, hi double, failed long")
    q = replicates(spark, one, n, seed, ["b"]).withColumn("b", finite(F.col("b")))
    return q.agg(F.percentile("b", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.count_if(F.col("b").isNull()).alias("failed")).select(F.lit(term).alias("term"), F.lit(len(v)).cast("long").alias("n_rows"), F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), "failed")


def permutation_p(df: DataFrame, y: str, xs: list[str], term: str, order: str, n: int = 200, seed: int = 2026) -> DataFrame:
    """One row (term, n_rows, p): (count of |shuffled| >= |observed| + 1) / (n + 1), the term's column shuffled alone. Under 8 rows null."""
    x, v = _panel(df, y, xs, order)
    k = xs.index(term)
    spark = df.sparkSession
    if len(v) < 8:
        return spark.createDataFrame([(term, len(v), None)], "term string, n_rows long, p double")
    seen = abs(float(hc3_arrays(x, v)[0][k + 1]))

    def one(rng):
        s = x.copy()
        s[:, k] = rng.permutation(s[:, k])
        return [abs(float(hc3_arrays(s, v)[0][k + 1]))]

    hits = replicates(spark, one, n, seed, ["b"]).agg(F.count_if(F.col("b") >= seen).alias("c"))
    return hits.select(F.lit(term).alias("term"), F.lit(len(v)).cast("long").alias("n_rows"), ((F.col("c") + 1) / (n + 1)).alias("p"))


def power_curve(df: DataFrame, y: str, xs: list[str], term: str, order: str, sizes: tuple[int, ...] = (79, 100, 120, 160), n: int = 2000, seed: int = 2026) -> DataFrame:
    """(size, power, mde): share of wild-bootstrap samples of each size in which the term's |z| passes 1.96, and the least effect found with 80 % power.

    Rows are drawn unstratified. A size above three panels or under terms + 5 has nulls."""
    x, v = _panel(df, y, xs, order)
    k, spark = xs.index(term) + 1, df.sparkSession
    ok = len(v) >= len(xs) + 6
    beta, cov = hc3_arrays(x, v) if ok else (None, None)
    fitted = np.column_stack((np.ones(len(x)), x)) @ beta if ok else None
    parts = None
    for size in sizes:
        if not ok or size > 3 * len(v) or size < len(xs) + 6:
            part = spark.createDataFrame([(size, None, None)], "size int, power double, mde double")
        else:
            mde = math.sqrt(float(cov[k, k])) * math.sqrt(len(v) / size) * (NormalDist().inv_cdf(0.975) + NormalDist().inv_cdf(0.8))

            def one(rng, size=size):
                i = rng.integers(0, len(v), size)
                b, c = hc3_arrays(x[i], fitted[i] + (v - fitted)[i] * rng.choice([-1.0, 1.0], size))
                return [float(abs(b[k]) > 1.959963984540054 * math.sqrt(c[k, k])) if c[k, k] > 0 else 0.0]

            part = replicates(spark, one, n, seed + size, ["hit"]).agg(F.avg("hit").alias("power")).select(F.lit(size).alias("size"), "power", F.lit(mde).alias("mde"))
        parts = part if parts is None else parts.unionByName(part)
    return parts
