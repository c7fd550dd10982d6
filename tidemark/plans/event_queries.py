"""Queries on daily series and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import events as E
from tidemark.sources import tables as S

from .catalog import register

SER = """dp AS (SELECT CAST(o_orderdate AS DATE) AS d, avg(o_totalprice) AS close FROM orders GROUP BY 1),
ser AS (SELECT d, close, row_number() OVER (ORDER BY d) - 1 AS pos, close / lag(close) OVER (ORDER BY d) - 1 AS ret FROM dp),
ev AS (SELECT year(d) || 'Q' || quarter(d) AS event_id, min(d) AS d, min(pos) AS pos FROM ser GROUP BY 1)"""
CUR = """cu AS (SELECT CAST(l_shipdate AS DATE) AS d, avg(CASE WHEN l_returnflag = 'A' THEN l_extendedprice END) / 10000 AS y1, avg(CASE WHEN l_returnflag = 'N' THEN l_extendedprice END) / 10000 AS y5, avg(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END) / 10000 AS y10 FROM lineitem GROUP BY 1),
cv AS (SELECT d, y1, y5, y10, row_number() OVER (ORDER BY d) - 1 AS pos, (coalesce(y1, 0) + coalesce(y5, 0) + coalesce(y10, 0)) / nullif((y1 IS NOT NULL)::INT + (y5 IS NOT NULL)::INT + (y10 IS NOT NULL)::INT, 0) AS level, y10 - y1 AS slope, 2 * y5 - y1 - y10 AS curvature FROM cu),
ce AS (SELECT year(d) || 'Q' || quarter(d) AS event_id, min(d) AS d, min(pos) AS pos FROM cv GROUP BY 1)"""
OPS = "ops AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS op_date FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice >= 450000)"


def prices(spark, d):
    return E.simple_returns(E.calendar(S.daily_prices(spark, d)))


def curve(spark, d):
    cal = E.calendar(S.daily_curve(spark, d))
    return cal.withColumns(E.curve_factors(F.col("y1"), F.col("y5"), F.col("y10")))


def actions(spark, d, cal):
    """Action days by their position in a calendar that need not have all days of the orders: each at the first day at or after it, once."""
    days = E.next_calendar_day(S.action_days(spark, d), cal, "op_date").select(F.col("cal_d").alias("op_date")).distinct()
    return E.on_calendar(days, cal, "op_date")


def r6(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


register("daily_returns_vol20", lambda s, d: r6(E.rolling_volatility(prices(s, d)), "close", "ret", "vol20").select("d", F.col("pos").cast("long").alias("pos"), "close", "ret", "vol20"),
    f"WITH {SER} SELECT d, pos, round(close, 6) AS close, round(ret, 6) AS ret, round(CASE WHEN count(ret) OVER w = 20 THEN stddev_samp(ret) OVER w * sqrt(252) END, 6) AS vol20 FROM ser WINDOW w AS (ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")


def _returns(spark, d):
    cal = prices(spark, d)
    out = S.quarter_events(cal)
    for a, b in ((0, 1), (0, 3), (-1, 1), (-1, 3)):
        out = E.window_return(out, cal, "close", a, b, f"return_{'m1' if a < 0 else '0'}_p{b}")
    return r6(out, *[c for c in out.columns if c.startswith("return")]).drop("pos")


_ret = lambda a, b: f"round((SELECT close FROM ser x WHERE x.pos = ev.pos + {b}) / (SELECT close FROM ser x WHERE x.pos = ev.pos + ({a})) - 1, 6)"
register("event_window_returns", _returns, f"WITH {SER} SELECT event_id, d, " + ", ".join(f"{_ret(a, b)} AS return_{'m1' if a < 0 else '0'}_p{b}" for a, b in ((0, 1), (0, 3), (-1, 1), (-1, 3))) + " FROM ev")


def _vols(spark, d):
    cal = prices(spark, d)
    out = S.quarter_events(cal)
    for e in (3, 5, 10):
        out = E.realized_volatility(out, cal, "ret", 0, e, f"rv_0_{e}")
    out = out.withColumn("log_rv_0_5", F.when(F.col("rv_0_5") > 0, F.log("rv_0_5")))
    return r6(out, "rv_0_3", "rv_0_5", "rv_0_10", "log_rv_0_5").drop("pos")


_rv = lambda e: f"CASE WHEN count(*) OVER w{e} = {e + 1} AND count(ret) OVER w{e} >= 2 THEN stddev_samp(ret) OVER w{e} * sqrt(252) END"
register("realized_volatility", _vols, f"WITH {SER}, r AS (SELECT pos, " + ", ".join(f"{_rv(e)} AS rv_0_{e}" for e in (3, 5, 10)) + " FROM ser WINDOW " + ", ".join(f"w{e} AS (ORDER BY pos ROWS BETWEEN CURRENT ROW AND {e} FOLLOWING)" for e in (3, 5, 10)) + ") SELECT event_id, d, round(rv_0_3, 6) AS rv_0_3, round(rv_0_5, 6) AS rv_0_5, round(rv_0_10, 6) AS rv_0_10, round(CASE WHEN rv_0_5 > 0 THEN ln(rv_0_5) END, 6) AS log_rv_0_5 FROM ev LEFT JOIN r USING (pos)")

FACTORS = ["level", "slope", "curvature", "y1", "y5", "y10"]


def _curve_panel(spark, d):
    cal = curve(spark, d)
    out = S.quarter_events(cal)
    for f in FACTORS:
        for e in (1, 3, 5):
            out = E.yield_change_bp(out, cal, f, 0, e, f"delta_{f}_bp_0_{e}")
    return r6(out, *[c for c in out.columns if c.startswith("delta")], digits=8).drop("pos")


register("curve_factors", lambda s, d: r6(curve(s, d), "level", "slope", "curvature", digits=10).select("d", "level", "slope", "curvature"), f"WITH {CUR} SELECT d, round(level, 10) AS level, round(slope, 10) AS slope, round(curvature, 10) AS curvature FROM cv")
register("curve_event_panel", _curve_panel, f"WITH {CUR} SELECT event_id, ce.d, " + ", ".join(f"round((e{e}.{f} - cv.{f}) * 100, 8) AS delta_{f}_bp_0_{e}" for f in FACTORS for e in (1, 3, 5)) + " FROM ce JOIN cv ON cv.pos = ce.pos " + " ".join(f"LEFT JOIN cv e{e} ON e{e}.pos = ce.pos + {e}" for e in (1, 3, 5)))
register("yield_change", lambda s, d: r6(E.yield_change_bp(S.quarter_events(curve(s, d)), curve(s, d), "y1", -1, 3, "delta"), "delta", digits=8).select("event_id", "delta"),
    f"WITH {CUR} SELECT event_id, round((b.y1 - a.y1) * 100, 8) AS delta FROM ce LEFT JOIN cv a ON a.pos = ce.pos - 1 LEFT JOIN cv b ON b.pos = ce.pos + 3")
register("next_trading_day", lambda s, d: E.next_calendar_day(S.action_days(s, d).withColumn("op_date", F.date_add("op_date", 1)), prices(s, d), "op_date", out="trading_day"),
    f"WITH {SER}, {OPS}, o2 AS (SELECT CAST(op_date + INTERVAL 1 DAY AS DATE) AS op_date FROM ops) SELECT op_date, min(d) AS trading_day FROM o2 JOIN ser ON d >= op_date GROUP BY 1")
register("policy_days", lambda s, d: E.next_calendar_day(S.action_days(s, d), prices(s, d), "op_date", out="trading_day").select("trading_day").distinct(), f"WITH {SER}, {OPS} SELECT DISTINCT (SELECT min(d) FROM ser WHERE d >= op_date) AS trading_day FROM ops")


def _nearby(spark, d):
    cal = prices(spark, d)
    acts = E.on_calendar(S.action_days(spark, d), cal, "op_date")
    return E.action_nearby(S.quarter_events(cal), acts).select("event_id", F.col("action_nearby").cast("long").alias("action_nearby"))


register("action_nearby", _nearby, f"WITH {SER}, {OPS}, a AS (SELECT pos FROM ops JOIN ser ON d = op_date) SELECT event_id, (CASE WHEN EXISTS (SELECT 1 FROM a WHERE a.pos BETWEEN ev.pos - 3 AND ev.pos + 3) THEN 1 ELSE 0 END)::BIGINT AS action_nearby FROM ev")


def _paths(spark, d):
    cal = prices(spark, d)
    return E.paths(S.quarter_events(cal), cal, "ret")


register("volatility_paths", lambda s, d: r6(_paths(s, d), "abs_ret").select("event_id", F.col("rel").cast("long").alias("rel"), "abs_ret"), f"WITH {SER} SELECT event_id, rel, round(abs(ret), 6) AS abs_ret FROM (SELECT event_id, pos, unnest(range(0, 11)) AS rel FROM ev) e JOIN ser ON ser.pos = e.pos + rel")


def _grouped(spark, d):
    """Events with their pre-event volatility and its tercile group."""
    cal = E.rolling_volatility(prices(spark, d))
    pre = cal.select((F.col("pos") + 1).alias("pos"), F.col("vol20").alias("pre"))
    ev = S.quarter_events(cal).join(pre, "pos", "left")
    return E.terciles(ev, "pre").withColumn("grp", E.high_low(F.col("pre"), F.col("q1"), F.col("q2")))


TERC = f"""{SER}, v AS (SELECT pos + 1 AS pos, CASE WHEN count(ret) OVER w = 20 THEN stddev_samp(ret) OVER w * sqrt(252) END AS pre FROM ser WINDOW w AS (ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
ep AS (SELECT event_id, ev.d, ev.pos, pre FROM ev LEFT JOIN v USING (pos)), q AS (SELECT quantile_cont(pre, 1/3) AS q1, quantile_cont(pre, 2/3) AS q2 FROM ep),
eg AS (SELECT event_id, pos, pre, CASE WHEN pre >= q2 THEN 'high' WHEN pre <= q1 THEN 'low' WHEN pre IS NOT NULL THEN 'middle' END AS grp, CASE WHEN pre <= q1 THEN 0 WHEN pre <= q2 THEN 1 WHEN pre IS NOT NULL THEN 2 END AS bin FROM ep, q)"""
register("tercile_groups", lambda s, d: r6(_grouped(s, d), "pre").select("event_id", "pre", "grp"), f"WITH {TERC} SELECT event_id, round(pre, 6) AS pre, grp FROM eg")


def _path_means(spark, d):
    groups = _grouped(spark, d).where(F.col("grp").isin("high", "low")).select("event_id", "grp")
    return r6(_paths(spark, d).join(groups, "event_id").groupBy("grp", F.col("rel").cast("long").alias("rel")).agg(F.avg("abs_ret").alias("mean"), F.count("*").alias("n")), "mean")


register("path_means", _path_means, f"WITH {TERC} SELECT grp, rel, round(avg(abs(ret)), 6) AS mean, count(*) AS n FROM (SELECT grp, pos, unnest(range(0, 11)) AS rel FROM eg WHERE grp IN ('high', 'low')) e JOIN ser ON ser.pos = e.pos + rel GROUP BY 1, 2")


def _qcut(spark, d):
    g = _grouped(spark, d).withColumn("bin", E.right_closed_bin(F.col("pre"), F.col("q1"), F.col("q2")).cast("long"))
    out = E.window_return(g, prices(spark, d), "close", 0, 3, "r")
    return r6(out.where("bin is not null").groupBy("bin").agg(F.avg("r").alias("mean"), F.count("*").alias("n")), "mean")


register("qcut_reactions", _qcut, f"WITH {TERC} SELECT bin::BIGINT AS bin, round(avg(b.close / a.close - 1), 6) AS mean, count(*) AS n FROM eg JOIN ser a USING (pos) LEFT JOIN ser b ON b.pos = eg.pos + 3 WHERE bin IS NOT NULL GROUP BY 1")


def _ar1(spark, d):
    cal = prices(spark, d).withColumn("month", F.date_format("d", "yyyyMM"))
    monthly = cal.groupBy("month").agg(F.avg("close").alias("v")).withColumn("v", F.when(F.col("month").cast("int") % 7 != 0, F.col("v")))
    out = E.expanding_forecast(monthly, "v", "month")
    return out.select("month", F.round("forecast", 4).alias("forecast"), F.round("unexpected", 4).alias("unexpected"), "method")


register("expanding_ar1", _ar1, f"""WITH {SER}, m0 AS (SELECT strftime(d, '%Y%m') AS month, avg(close) AS v FROM ser GROUP BY 1), m AS (SELECT month, CASE WHEN month::INT % 7 <> 0 THEN v END AS v FROM m0),
l AS (SELECT month, v, lag(v) OVER (ORDER BY month) AS lg FROM m WHERE v IS NOT NULL), f AS (SELECT month, v, lg, count(v) OVER p AS n, regr_slope(v, lg) OVER p AS b, regr_intercept(v, lg) OVER p AS a, max(lg) OVER p = min(lg) OVER p AS flat, avg(v) OVER p AS m FROM l WINDOW p AS (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT month, v, CASE WHEN n = 0 THEN NULL WHEN n < 6 THEN lg WHEN flat THEN m ELSE a + b * lg END AS fc, CASE WHEN n = 0 THEN 'insufficient_history' WHEN n < 6 THEN 'last_available' WHEN flat THEN 'historical_mean_constant' ELSE 'expanding_ar1' END AS method FROM f)
SELECT month, round(fc, 4) AS forecast, round(v - fc, 4) AS unexpected, method FROM g UNION ALL SELECT month, NULL, NULL, 'missing_actual' FROM m WHERE v IS NULL""")
register("lag_fill_d1", lambda s, d: prices(s, d).select("d", F.round(F.coalesce(F.lag("ret").over(Window.orderBy("pos")), F.lit(0.0)), 6).alias("ret_d1")), f"WITH {SER} SELECT d, round(coalesce(lag(ret) OVER (ORDER BY pos), 0), 6) AS ret_d1 FROM ser")
register("trend_centred", lambda s, d: S.quarter_events(prices(s, d)).withColumn("trend", F.row_number().over(Window.orderBy("d")).cast("long")).select("event_id", "trend", F.round(F.col("trend") - F.avg("trend").over(Window.partitionBy()), 6).alias("centred")), f"WITH {SER}, t AS (SELECT event_id, row_number() OVER (ORDER BY d) AS trend FROM ev) SELECT event_id, trend, round(trend - avg(trend) OVER (), 6) AS centred FROM t")
register("every_kth", lambda s, d: prices(s, d).where("pos % 7 = 0").select("d", F.round("close", 6).alias("close")), f"WITH {SER} SELECT d, round(close, 6) AS close FROM ser WHERE pos % 7 = 0")
register("last_per_month", lambda s, d: prices(s, d).groupBy(F.date_format("d", "yyyyMM").alias("month")).agg(F.max_by("d", "d").alias("d"), F.round(F.max_by("close", "d"), 6).alias("close")), f"WITH {SER} SELECT strftime(d, '%Y%m') AS month, max(d) AS d, round(arg_max(close, d), 6) AS close FROM ser GROUP BY 1")


def _daily_model(spark, d):
    """Daily returns with event flag, standardised event value (over events, n - 1), action flag; everything missing counts 0."""
    cal = prices(spark, d)
    ev = S.quarter_events(cal).join(cal.select("pos", F.lag("close").over(Window.orderBy("pos")).alias("before")), "pos", "left").where("before is not null")
    ev = E.formal_zscore(ev.withColumn("raw", F.log("before")), "raw", F.lit(True), [], "z", ddof=1)
    acts = E.next_calendar_day(S.action_days(spark, d), cal, "op_date").select(F.col("cal_d").alias("d"), F.lit(1).alias("act")).distinct()
    one = cal.join(ev.select("pos", F.lit(1).alias("flag"), "raw", "z"), "pos", "left").join(acts, "d", "left").where("ret is not null")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return one.select("d", "ret", zero("flag").cast("long").alias("event_day"), zero("raw").alias("raw"), zero("z").alias("z"), zero("act").cast("long").alias("action_day"))


register("daily_model_input", lambda s, d: r6(_daily_model(s, d), "ret", "raw", "z"), f"""WITH {SER}, {OPS}, b AS (SELECT ev.pos, ln(ser.close) AS raw FROM ev JOIN ser ON ser.pos = ev.pos - 1), bz AS (SELECT pos, raw, (raw - avg(raw) OVER ()) / CASE WHEN stddev_samp(raw) OVER () = 0 THEN 1.0 ELSE stddev_samp(raw) OVER () END AS z FROM b),
a AS (SELECT DISTINCT (SELECT min(d) FROM ser WHERE d >= op_date) AS d FROM ops) SELECT ser.d, round(ret, 6) AS ret, (bz.pos IS NOT NULL)::BIGINT AS event_day, round(coalesce(raw, 0), 6) AS raw, round(coalesce(z, 0), 6) AS z, (a.d IS NOT NULL)::BIGINT AS action_day FROM ser LEFT JOIN bz USING (pos) LEFT JOIN a ON a.d = ser.d WHERE ret IS NOT NULL""")
register("contract_check", lambda s, d: prices(s, d).withColumn("step", F.datediff("d", F.lag("d").over(Window.orderBy("pos")))).agg(F.count("*").alias("n"), F.countDistinct("d").alias("n_days"), F.min("step").cast("long").alias("min_step"), F.count_if(F.col("close").isNull()).alias("missing")),
    f"WITH {SER}, t AS (SELECT d, close, d - lag(d) OVER (ORDER BY pos) AS step FROM ser) SELECT count(*) AS n, count(DISTINCT d) AS n_days, min(step)::BIGINT AS min_step, count_if(close IS NULL)::BIGINT AS missing FROM t")


def _period(spark, d):
    y, q = F.regexp_extract("period", r"^(\d{4})Q([1-4])$", 1), F.regexp_extract("period", r"^(\d{4})Q([1-4])$", 2)
    rows = S.table(spark, d, "orders").select("o_orderkey", F.concat(F.year("o_orderdate"), F.lit("Q"), F.quarter("o_orderdate")).alias("period")).withColumn("key", F.when(y == "", F.raise_error(F.lit("not a period"))).otherwise(y.cast("int") * 4 + q.cast("int")))
    inside = rows.where(F.col("key").between(1996 * 4 + 2, 1999 * 4 + 1))
    return inside.groupBy("period", F.when(F.col("key") >= 1998 * 4 + 1, 1).otherwise(0).cast("long").alias("late")).agg(F.count("*").alias("n"))


register("period_filter", _period, "SELECT year(o_orderdate) || 'Q' || quarter(o_orderdate) AS period, (CASE WHEN year(o_orderdate) >= 1998 THEN 1 ELSE 0 END)::BIGINT AS late, count(*) AS n FROM orders WHERE year(o_orderdate) * 4 + quarter(o_orderdate) BETWEEN 7986 AND 7997 GROUP BY 1, 2")


def _regimes(spark, d):
    day = F.to_date("o_orderdate")
    tags = {"full": F.lit(True), "pre": day < "1998-01-01", "post": day >= "1998-01-01", "crisis": day.between("1998-07-01", "1998-12-31"), "calm": ~day.between("1998-07-01", "1998-12-31")}
    kept = F.filter(F.array(*[F.when(c, F.lit(t)) for t, c in tags.items()]), lambda x: x.isNotNull())
    return S.table(spark, d, "orders").select(F.explode(kept).alias("sample"), "o_totalprice").groupBy("sample").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


register("regime_subsamples", _regimes, "WITH o AS (SELECT CAST(o_orderdate AS DATE) AS d, o_totalprice AS p FROM orders) " + " UNION ALL ".join(f"SELECT '{t}' AS sample, count(*) AS n, round(avg(p), 4) AS mean FROM o WHERE {c}" for t, c in (("full", "true"), ("pre", "d < DATE '1998-01-01'"), ("post", "d >= DATE '1998-01-01'"), ("crisis", "d BETWEEN DATE '1998-07-01' AND DATE '1998-12-31'"), ("calm", "NOT d BETWEEN DATE '1998-07-01' AND DATE '1998-12-31'"))))


def panel(spark, d):
    """One row an event: log volatility after it, pre-event volatility, nearby actions, trend, late regime and their product."""
    cal = E.rolling_volatility(prices(spark, d))
    ev = S.quarter_events(cal)
    ev = E.realized_volatility(ev, cal, "ret", 0, 5, "rv").withColumn("y", F.when(F.col("rv") > 0, F.log("rv")))
    ev = ev.join(cal.select((F.col("pos") + 1).alias("pos"), F.col("vol20").alias("pre_vol"), F.log("close").alias("novelty")), "pos", "left")
    ev = E.action_nearby(ev, E.on_calendar(S.action_days(spark, d), cal, "op_date"))
    ev = E.formal_zscore(ev, "novelty", F.lit(True), [], "novelty_z", ddof=1)
    late = F.when(F.year("d") >= 1998, 1.0).otherwise(0.0)
    return ev.withColumns({"late": late, "novelty_late": F.col("novelty_z") * late, "sample": F.when(F.year("d") < 1998, "pre").otherwise("post"), "trend": F.row_number().over(Window.orderBy("d")).cast("double")})
