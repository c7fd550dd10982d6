"""Queries of statistical models: regressions, resampling, volatility, classifiers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import classify as C
from tidemark.operators import duplicates as D
from tidemark.operators import events as E
from tidemark.operators import regression as R
from tidemark.operators import volatility as V
from tidemark.operators.events import holm
from tidemark.operators import tables as J
from tidemark.sources.scratch import materialize
from tidemark.sources.tables import daily_prices, quarter_events, table

from .catalog import register
from .event_queries import _daily_model, actions, curve, panel

X = ["l_quantity", "l_discount", "l_tax"]
register("simple_ols", lambda s, d: table(s, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 4).alias("intercept"), F.round(F.corr("l_extendedprice", "l_quantity"), 6).alias("corr")), "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(corr(l_extendedprice, l_quantity), 6) AS corr FROM lineitem GROUP BY 1")
register("ols_two_groups", lambda s, d: R.ols_hc3(table(s, d, "lineitem"), "l_extendedprice", ["l_quantity"], "l_returnflag").select("model", "term", F.round("beta", 3).alias("beta"), F.round("se", 3).alias("se"), F.round("r2", 6).alias("r2"), "n"),
    """WITH b AS (SELECT l_returnflag AS model, regr_slope(l_extendedprice, l_quantity) AS b1, regr_intercept(l_extendedprice, l_quantity) AS b0, avg(l_quantity) AS mx, regr_sxx(l_extendedprice, l_quantity) AS sxx, count(*) AS n, regr_r2(l_extendedprice, l_quantity) AS r2 FROM lineitem GROUP BY 1),
w AS (SELECT model, b.*, l_quantity AS x, power((l_extendedprice - b0 - b1 * l_quantity) / (1 - (1.0 / n + power(l_quantity - mx, 2) / sxx)), 2) AS w FROM lineitem JOIN b ON l_returnflag = model),
v AS (SELECT model, any_value(b0) AS b0, any_value(b1) AS b1, any_value(n) AS n, any_value(r2) AS r2, sum(w * power((x - mx) / sxx, 2)) AS v1, sum(w * power(1.0 / n - mx * (x - mx) / sxx, 2)) AS v0 FROM w GROUP BY 1)
SELECT model, 'const' AS term, round(b0, 3) AS beta, round(sqrt(v0), 3) AS se, round(r2, 6) AS r2, n FROM v UNION ALL SELECT model, 'l_quantity', round(b1, 3), round(sqrt(v1), 3), round(r2, 6), n FROM v""")
register("ols_hc3", lambda s, d: R.ols_hc3(table(s, d, "lineitem"), "l_extendedprice", X))
register("vif", lambda s, d: R.vif(table(s, d, "lineitem"), ["l_quantity", "l_extendedprice"]).select("term", F.round("vif", 6).alias("vif")), "SELECT unnest(['l_quantity', 'l_extendedprice']) AS term, round(1 / (1 - power(corr(l_quantity, l_extendedprice), 2)), 6) AS vif FROM lineitem")
FULL = ["novelty_z", "pre_vol", "action_nearby", "late", "novelty_late"]
SUB = ["novelty_z", "pre_vol", "action_nearby", "trend"]


SAMPLES = {"full": None, "pre": "d < '1998-01-01'", "post": "d >= '1998-01-01'", "crisis": "d between '1997-07-01' and '1998-12-31'", "calm": "not d between '1997-07-01' and '1998-12-31'"}


def _volatility_models(spark, d):
    """Five samples: the full one with the regime interaction, the four others with a trend; one grouped fit for those."""
    p = panel(spark, d)
    tags = F.explode(F.filter(F.array(*[F.when(F.expr(c), F.lit(t)) for t, c in SAMPLES.items() if c]), lambda x: x.isNotNull())).alias("part")
    return R.gated_fits(p, "y", FULL).withColumn("model", F.lit("full")).unionByName(R.gated_fits(p.select("y", *SUB, tags), "y", SUB, "part"))


register("volatility_models", _volatility_models)
MEASURES = ["novelty_z", "novelty_change", "novelty_size", "novelty_gap", "novelty_rank"]


def _measured(spark, d):
    """The panel with five measures of novelty: the standardised level, its change, its size, its distance from the mean so far, and its rank."""
    by, so_far = Window.orderBy("d"), Window.orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    p = panel(spark, d)
    return p.withColumns({"novelty_change": F.col("novelty") - F.lag("novelty").over(by), "novelty_size": F.abs("novelty_z"), "novelty_gap": F.col("novelty") - F.avg("novelty").over(so_far), "novelty_rank": F.percent_rank().over(Window.orderBy("novelty"))})


def _robustness(spark, d):
    """One model a measure, each with its product with the late regime; Holm over the five measures' p-values."""
    p = _measured(spark, d).withColumns({f"{m}_late": F.col(m) * F.col("late") for m in MEASURES})
    fits = R.specification_fits(p, "y", {m: [m, "pre_vol", "action_nearby", "late", f"{m}_late"] for m in MEASURES})
    return holm(fits.where(F.col("term") == F.col("model")))


register("novelty_robustness", _robustness)
register("total_effect", lambda s, d: R.totals(panel(s, d), "y", FULL, "novelty_z", "novelty_late", "event_id"))
register("bootstrap_ci", lambda s, d: R.bootstrap_ci(panel(s, d), "y", ["novelty_z", "pre_vol"], "novelty_z", "event_id"))
register("bootstrap_total_ci", lambda s, d: R.bootstrap_ci(panel(s, d), "y", ["novelty_z", "late", "novelty_late"], "novelty_z", "event_id", plus="novelty_late"))
register("permutation_p", lambda s, d: R.permutation_p(panel(s, d), "y", ["novelty_z", "pre_vol"], "novelty_z", "event_id"))
register("permutation_interaction_p", lambda s, d: R.permutation_p(panel(s, d), "y", ["novelty_z", "late", "novelty_late"], "novelty_late", "event_id"))
register("power_curve", lambda s, d: R.power_curve(panel(s, d), "y", FULL, "novelty_z", "event_id", (20, 40, 60, 79, 100, 120, 160)))
EXTRA = ["event_day", "z", "action_day"]
register("egarch_fit", lambda s, d: V.fit_egarch(_daily_model(s, d), "d", "ret", EXTRA))




def _joint(spark, d):
    return V.joint_fit(_daily_model(spark, d), "d", "ret", EXTRA, "z")


def _frozen(spark, d):
    """The daily input, and the joint fit's parameters, which the conditional fits freeze."""
    return _daily_model(spark, d), V.theta_of(_joint(spark, d), EXTRA)


def _conditional(spark, d):
    rows, theta = _frozen(spark, d)
    return V.conditional_fits(rows, "d", "ret", EXTRA, "z", theta)


def _permutation(spark, d):
    rows, theta = _frozen(spark, d)
    return V.permuted_conditional(rows, "d", "ret", EXTRA, theta, "event_day", "z")


def _compared(spark, d):
    """The tested coefficient of the joint fit against that of the conditional one."""
    rows, theta = _frozen(spark, d)
    joint = float(theta[7 + EXTRA.index("z")])
    own = V.conditional_fits(rows, "d", "ret", EXTRA, "z", theta).where("model = 'D0'").collect()[0]["first"]
    c = V.compare_fits(joint, own)
    return spark.createDataFrame([(joint, own, c["relative_difference"], c["accepted"])], "joint double, conditional double, relative_difference double, accepted boolean")


def _baseline(spark, d):
    return spark.createDataFrame(sorted(V.baseline_fit(_daily_model(spark, d), "d", "ret").items()), "term string, value double")


def _permuted_joint(spark, d):
    rows, theta = _frozen(spark, d)
    return V.permuted_joint(rows, "d", "ret", EXTRA, "event_day", "z", theta)


def _shifted(spark, d):
    rows, theta = _frozen(spark, d)
    return V.date_sensitivity(rows, "d", "ret", EXTRA, ["event_day", "z"], theta)


def _arx(spark, d):
    """Mean equation: the return on its lag and the day's regressors."""
    rows = _daily_model(spark, d).withColumn("lag_ret", F.lag("ret").over(Window.orderBy("d")))
    return R.ols_hc3(rows, "ret", ["lag_ret", *EXTRA])


register("egarch_baseline", _baseline)
register("egarch_joint", _joint)
register("egarch_conditional", _conditional)
register("egarch_permutation", _permutation)
register("egarch_comparison", _compared)
register("egarch_joint_permutation", _permuted_joint)
register("egarch_date_sensitivity", _shifted)
register("arx_diagnostic", _arx)
register("collinearity", lambda s, d: V.d0_d1_diagnostics(table(s, d, "lineitem"), "l_discount", "l_tax").select(F.round("correlation", 6).alias("correlation"), F.round("condition", 6).alias("condition"), "warning"), "WITH c AS (SELECT corr(l_discount, l_tax) AS c FROM lineitem) SELECT round(c, 6) AS correlation, round(sqrt((1 + abs(c)) / (1 - abs(c))), 6) AS condition, sqrt((1 + abs(c)) / (1 - abs(c))) > 30 OR abs(c) > 0.9 AS warning FROM c")


def _labelled(spark, d):
    """Documents with labels; documents that are near-duplicates are one group."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", "text", "lang", "toxic", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("label"))
    rows = materialize(rows, "labelled")
    return materialize(rows.join(D.duplicate_groups(rows, "doc_id", "text").select(F.col("id").alias("doc_id"), F.col("group_label").alias("group")), "doc_id"), "grouped")


register("grouped_cv", lambda s, d: C.cross_validate(_labelled(s, d), "text", "label", "group").groupBy("fold", "label", "pred").agg(F.count("*").alias("n")))
register("learning_curve", lambda s, d: C.learning_curve(_labelled(s, d), "text", "label", "group"))
register("text_model_evaluation", lambda s, d: C.evaluate_tasks(_labelled(s, d), {"quality": ("label", None), "toxicity": ("toxic", None), "language": ("lang", None), "toxicity_of_good": ("toxic", "label = 'good'")}, "text", "group"))


def _crossfit(spark, d, seeds=(0,)):
    """Documents as reports: all sentences of labelled documents, scored by classifiers of the other documents' sentences, which have their document's label."""
    rows = _labelled(spark, d)
    parts = materialize(rows.select("doc_id", "label", "group", F.posexplode(T.sentences(F.col("text"))).alias("sentence_id", "text")), "sentences")
    return C.crossfit_tones(parts.select("doc_id", "sentence_id", "text"), parts, "text", "label", "doc_id", "sentence_id", "good", "bad", seeds=seeds)


TONES = {"all": [], "relevant": ["good", "bad"], "directional": ["good"]}


def _tones(spark, d):
    return C.report_tone(_crossfit(spark, d), "doc_id", "pred", "plus_score", "minus_score", TONES)


register("crossfit_tone", _tones)


def _bonds(spark, d, tones):
    """Curve reactions on the events' tone. An event's tone is the mean over its reports; reports are dealt to events in turn."""
    cal = curve(spark, d)
    ev = E.yield_change_bp(quarter_events(cal), cal, "slope", 0, 3, "slope").withColumn("k", F.row_number().over(Window.orderBy("d")) - 1)
    ev = E.action_nearby(ev, actions(spark, d, cal))
    n = ev.count()
    names = [f"{t}_mean" for t in TONES]
    mine = tones.groupBy(F.pmod("doc_id", F.lit(max(n, 1))).cast("int").alias("k")).agg(*[F.avg(c).alias(c) for c in names], *[F.sum(f"n_{t}").alias(f"n_{t}") for t in TONES])
    late = F.when(F.year("d") >= 1998, 1.0).otherwise(0.0)
    return ev.join(mine, "k", "left").withColumn("late", late).withColumns({f"{c}_late": F.col(c) * F.col("late") for c in names})


def _bond_models(spark, d):
    p = _bonds(spark, d, _tones(spark, d))
    return R.specification_fits(materialize(p, "bonds"), "slope", {t: [f"{t}_mean", "action_nearby", "late", f"{t}_mean_late"] for t in TONES}, 10)


register("crossfit_bond_models", _bond_models)


def _stability(spark, d, seeds=(1, 2, 3)):
    """The bond models' tone coefficient over several assignments of folds."""
    scored, out = materialize(_crossfit(spark, d, seeds), "scored"), None
    for seed in seeds:
        tones = C.report_tone(scored.where(F.col("seed") == seed), "doc_id", "pred", "plus_score", "minus_score", TONES)
        p = materialize(_bonds(spark, d, tones), "bonds")
        one = R.specification_fits(p, "slope", {t: [f"{t}_mean", "action_nearby"] for t in TONES}, 10).where(F.col("term").endswith("_mean")).select("model", "beta")
        out = one if out is None else out.unionByName(one)
    return C.seed_summary(out, ["model"], "beta")


register("crossfit_seed_stability", _stability)


def _return_models(spark, d):
    """Four event windows by four measures: one grouped fit a measure."""
    cal = E.simple_returns(E.calendar(daily_prices(spark, d)))
    p = panel(spark, d)
    windows = [(0, 1), (0, 3), (-1, 1), (-1, 3)]
    for a, b in windows:
        p = E.window_return(p, cal, "close", a, b, f"w_{'m' if a < 0 else ''}{abs(a)}_{b}")
    names = [c for c in p.columns if c.startswith("w_")]
    measures = MEASURES[:4]
    p = _measured(spark, d).select("event_id", *measures[1:]).join(p, "event_id")
    long = materialize(p.select(*measures, "action_nearby", F.explode(F.array(*[F.struct(F.lit(n).alias("spec"), F.col(n).alias("r")) for n in names])).alias("x")).select(*measures, "action_nearby", "x.*"), "windows")
    out = None
    for x in measures:
        one = R.gated_fits(long, "r", [x, "action_nearby"], "spec").withColumn("model", F.concat("model", F.lit(f" ~ {x}")))
        out = one if out is None else out.unionByName(one)
    return out


register("return_models", _return_models)


def _yield_panel(spark, d):
    cal = curve(spark, d)
    ev = quarter_events(cal)
    for f in ("slope", "level", "curvature"):
        ev = E.yield_change_bp(ev, cal, f, 0, 3, f)
    ev = E.expanding_forecast(ev.join(cal.select("pos", F.col("level").alias("tone")), "pos"), "tone", "event_id", 4)
    ev = E.action_nearby(ev, actions(spark, d, cal))
    late = F.when(F.year("d") >= 1998, 1.0).otherwise(0.0)
    return materialize(ev.withColumns({"late": late, "product": F.col("unexpected") * late}), "yields")


REACTION = ["unexpected", "action_nearby", "late", "product"]


def _yield_models(spark, d, locked=None):
    """Changes of level, slope and curvature after an event on the unexpected part of the level, nearby actions, the late regime and the product,
    with the bootstrap interval of the total effect and the product's permutation p-value. locked: a fit from elsewhere, as a further row."""
    ev, out = _yield_panel(spark, d), None
    for y in ("slope", "level", "curvature"):
        fits = R.gated_fits(ev, y, REACTION).withColumn("model", F.lit(y))
        ci = R.bootstrap_ci(ev, y, REACTION, "unexpected", "event_id", plus="product").select(F.col("lo").alias("total_lo"), F.col("hi").alias("total_hi"))
        perm = R.permutation_p(ev, y, REACTION, "product", "event_id").select(F.col("p").alias("permutation_p"))
        one = fits.crossJoin(ci).crossJoin(perm)  # one row each
        out = one if out is None else out.unionByName(one)
    return out.unionByName(locked, allowMissingColumns=True) if locked is not None else out


def _yield_long(spark, d):
    ev = _yield_panel(spark, d)
    long = ev.select("unexpected", "late", "product", F.explode(F.array(*[F.struct(F.lit(f).alias("spec"), F.col(f).alias("y")) for f in ("slope", "level", "curvature")])).alias("x")).select("unexpected", "late", "product", "x.*")
    return R.ols_hc3(long, "y", ["unexpected", "late", "product"], "spec")


register("yield_models", _yield_models)
register("yield_models_grouped", _yield_long)


def _effects(spark, d):
    """Percent effects of one unit in the variance equation on variance and volatility."""
    fit = V.fit_egarch(_daily_model(spark, d), "d", "ret", EXTRA).where(F.col("name").startswith("lambda_"))
    return fit.select("name", "value", ((F.exp("value") - 1) * 100).alias("variance_percent"), ((F.exp(F.col("value") / 2) - 1) * 100).alias("volatility_percent"))


register("egarch_effects", _effects)


def _journal(spark, d):
    """Coefficients of price on quantity by return flag, as a table of the report."""
    fits = R.ols_hc3(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"], "l_returnflag")
    return J.coefficient_table(fits, {"const": "Constant", "l_quantity": "Quantity"}, ["A", "N", "R"], 2).drop("place")


_hc3 = """WITH b AS (SELECT l_returnflag AS model, regr_slope(l_extendedprice, l_quantity) AS b1, regr_intercept(l_extendedprice, l_quantity) AS b0, avg(l_quantity) AS mx, regr_sxx(l_extendedprice, l_quantity) AS sxx, count(*) AS n FROM lineitem GROUP BY 1),
w AS (SELECT model, b.*, l_quantity AS x, power((l_extendedprice - b0 - b1 * l_quantity) / (1 - (1.0 / n + power(l_quantity - mx, 2) / sxx)), 2) AS w FROM lineitem JOIN b ON l_returnflag = model),
v AS (SELECT model, any_value(b0) AS b0, any_value(b1) AS b1, any_value(n) AS n, sum(w * power((x - mx) / sxx, 2)) AS v1, sum(w * power(1.0 / n - mx * (x - mx) / sxx, 2)) AS v0 FROM w GROUP BY 1),
l AS (SELECT 'Constant' AS variable, model, b0 AS b, sqrt(v0) AS se FROM v UNION ALL SELECT 'Quantity', model, b1, sqrt(v1) FROM v),
c AS (SELECT variable, model, printf('%.2f', b) || CASE WHEN abs(b / se) >= 2.5758293035489004 THEN '***' WHEN abs(b / se) >= 1.959963984540054 THEN '**' WHEN abs(b / se) >= 1.6448536269514722 THEN '*' ELSE '' END || printf(' (%.2f)', se) AS cell FROM l UNION ALL SELECT 'n', model, n::VARCHAR FROM v)"""
register("journal_coefficients", _journal, _hc3 + " SELECT variable, coalesce(max(cell) FILTER (model = 'A'), '—') AS \"A\", coalesce(max(cell) FILTER (model = 'N'), '—') AS \"N\", coalesce(max(cell) FILTER (model = 'R'), '—') AS \"R\" FROM c GROUP BY 1")
TERMS = {"novelty_z": "Novelty", "pre_vol": "Volatility before", "action_nearby": "Action nearby", "late": "Later regime", "novelty_late": "Novelty x later regime", "trend": "Trend"}
register("journal_volatility", lambda s, d: J.coefficient_table(_volatility_models(s, d), TERMS, list(SAMPLES)))
register("journal_robustness", lambda s, d: J.coefficient_table(_robustness(s, d), {m: m for m in MEASURES}, MEASURES))
register("journal_conditional", lambda s, d: J.conditional_table(_conditional(s, d)))
DICTIONARY = {"novelty_z": ("logarithm of the price, standardised over events", "prices"), "pre_vol": ("deviation of 20 returns before the event, a year's", "prices"), "action_nearby": ("an action within three days", "operations"), "late": ("event in or after 1998", "calendar"), "trend": ("place among the events", "calendar")}
register("variable_dictionary", lambda s, d: J.variable_dictionary(s, DICTIONARY), "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v[0].replace(chr(39), chr(39) * 2)}', '{v[1]}')" for k, v in DICTIONARY.items()) + ") t(variable, definition, source)")
