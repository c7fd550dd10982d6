"""Event windows on a daily calendar: positions, as-of dates, window outcomes, paths, curve factors.

A calendar has one row a day (thousands of rows for any market), so windows over the whole of it are
single small tasks; events and their window rows are joined to it by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scans

TRADING_DAYS = 252.0


def calendar(daily: DataFrame, date: str = "d") -> DataFrame:
    """daily with pos 0, 1, 2, ... by date. A date that occurs twice raises an error."""
    w = Window.orderBy(date)
    twice = F.lag(date).over(w) == F.col(date)
    return daily.withColumn("pos", F.when(F.coalesce(twice, F.lit(False)), F.raise_error(F.lit("a date occurs twice in the calendar"))).otherwise(F.row_number().over(w) - 1).cast("int"))


def simple_returns(cal: DataFrame, price: str = "close", out: str = "ret") -> DataFrame:
    return cal.withColumn(out, F.try_divide(F.col(price), F.lag(price).over(Window.orderBy("pos"))) - 1)


def rolling_volatility(cal: DataFrame, ret: str = "ret", rows: int = 20, out: str = "vol20") -> DataFrame:
    """Standard deviation (n - 1) of the last `rows` returns, a year's; null until that many are there."""
    w = Window.orderBy("pos").rowsBetween(1 - rows, 0)
    return cal.withColumn(out, F.when(F.count(ret).over(w) == rows, F.stddev_samp(ret).over(w) * F.sqrt(F.lit(TRADING_DAYS))))


def on_calendar(events: DataFrame, cal: DataFrame, date: str, cal_date: str = "d") -> DataFrame:
    """events with the position of their exact date; a date that is no calendar day raises an error."""
    hit = events.join(cal.select(F.col(cal_date).alias("_d"), F.col("pos").alias("_pos")), events[date] == F.col("_d"), "left")
    return hit.withColumn("pos", F.when(F.col("_pos").isNull(), F.raise_error(F.concat(F.lit("not a calendar day: "), F.col(date).cast("string")))).otherwise(F.col("_pos"))).drop("_d", "_pos")


def next_calendar_day(dates: DataFrame, cal: DataFrame, date: str, cal_date: str = "d", out: str = "cal_d") -> DataFrame:
    """dates with the first calendar day at or after each; rows past the end are dropped.

    Dates and calendar are put into one order and each date takes the next calendar day after it. The order is kept
    within months of dates, and a month's first day at or after its end comes from the few months there are."""
    days = cal.select(F.col(cal_date).alias("_d"))
    month = lambda c: F.date_trunc("month", c).cast("date")
    firsts = days.groupBy(month(F.col("_d")).alias("_m")).agg(F.min("_d").alias("_first"))
    both = dates.withColumns({"_m": month(F.col(date)), "_k": F.col(date).cast("date"), "_day": F.lit(None).cast("date"), "_tag": F.lit(0)})
    marks = days.select(month(F.col("_d")).alias("_m"), F.col("_d").alias("_k"), F.col("_d").alias("_day"), F.lit(1).alias("_tag"))
    w = Window.partitionBy("_m").orderBy("_k", "_tag").rowsBetween(0, Window.unboundedFollowing)
    near = both.unionByName(marks, allowMissingColumns=True).withColumn("_near", F.first("_day", ignorenulls=True).over(w)).where("_tag = 0")
    months = near.select("_m").distinct().join(firsts.withColumnRenamed("_m", "_later"), F.col("_later") > F.col("_m")).groupBy("_m").agg(F.min("_first").alias("_next"))
    return near.join(months, "_m", "left").withColumn(out, F.coalesce("_near", "_next")).where(F.col(out).isNotNull()).drop("_m", "_k", "_day", "_tag", "_near", "_next")


def window_ends(events: DataFrame, cal: DataFrame, value: str, start: int, end: int) -> DataFrame:
    """events (with pos) with v_start and v_end; both null if either end lies outside the calendar."""
    a = cal.select((F.col("pos") - start).alias("pos"), F.col(value).alias("v_start"), F.lit(1).alias("_a"))
    b = cal.select((F.col("pos") - end).alias("pos"), F.col(value).alias("v_end"), F.lit(1).alias("_b"))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    joined = events.join(a, "pos", "left").join(b, "pos", "left")
    return joined.withColumns({"v_start": F.when(both, F.col("v_start")), "v_end": F.when(both, F.col("v_end"))}).drop("_a", "_b")


def window_return(events: DataFrame, cal: DataFrame, price: str, start: int, end: int, out: str) -> DataFrame:
    ends = window_ends(events, cal, price, start, end)
    return ends.withColumn(out, F.try_divide(F.col("v_end"), F.col("v_start")) - 1).drop("v_start", "v_end")


def yield_change_bp(events: DataFrame, cal: DataFrame, level: str, start: int, end: int, out: str) -> DataFrame:
    return window_ends(events, cal, level, start, end).withColumn(out, (F.col("v_end") - F.col("v_start")) * 100).drop("v_start", "v_end")


def realized_volatility(events: DataFrame, cal: DataFrame, ret: str, start: int, end: int, out: str) -> DataFrame:
    """Standard deviation (n - 1) of returns at pos+start .. pos+end, a year's. Null if the window leaves the calendar or has under two returns."""
    w = Window.orderBy("pos").rowsBetween(start, end)
    full = (F.count(F.lit(1)).over(w) == end - start + 1) & (F.count(ret).over(w) >= 2)
    rv = cal.select("pos", F.when(full, F.stddev_samp(ret).over(w) * F.sqrt(F.lit(TRADING_DAYS))).alias(out))
    return events.join(rv, "pos", "left")


def paths(events: DataFrame, cal: DataFrame, ret: str, last: int = 10) -> DataFrame:
    """One row for each event and relative day 0..last that is in the calendar: rel, abs_ret."""
    wide = events.withColumn("rel", F.explode(F.sequence(F.lit(0), F.lit(last)))).withColumn("_at", F.col("pos") + F.col("rel"))
    return wide.join(cal.select(F.col("pos").alias("_at"), F.abs(F.col(ret)).alias("abs_ret")), "_at").drop("_at")


def action_nearby(events: DataFrame, actions: DataFrame, days: int = 3, out: str = "action_nearby") -> DataFrame:
    """1 if any action lies within `days` positions of the event, else 0. Both have pos."""
    reach = actions.select(F.explode(F.sequence(F.col("pos") - days, F.col("pos") + days)).alias("pos")).distinct().withColumn("_hit", F.lit(1))
    return events.join(reach, "pos", "left").withColumn(out, F.coalesce("_hit", F.lit(0))).drop("_hit")


def curve_factors(y1: Column, y5: Column, y10: Column) -> dict[str, Column]:
    """level (mean of what is there), slope and curvature of three yields."""
    there = F.filter(F.array(y1, y5, y10), lambda x: x.isNotNull())
    return {"level": F.try_divide(F.aggregate(there, F.lit(0.0), lambda a, x: a + x), F.size(there).cast("double")), "slope": y10 - y1, "curvature": 2 * y5 - y1 - y10}


def terciles(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """df with q1 and q2, the exact 1/3 and 2/3 quantiles of non-missing values (of each group in `by`)."""
    q = df.groupBy(*(by or [])).agg(F.percentile(value, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("_q")).select(*(by or []), F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("q2"))
    return df.join(q, by) if by else df.crossJoin(F.broadcast(q))


def high_low(value: Column, q1: Column, q2: Column) -> Column:
    """high at or above q2 (tested first), low at or below q1, else middle."""
    return F.when(value >= q2, "high").when(value <= q1, "low").when(value.isNotNull(), "middle")


def right_closed_bin(value: Column, q1: Column, q2: Column) -> Column:
    return F.when(value <= q1, 0).when(value <= q2, 1).when(value.isNotNull(), 2)


def expanding_forecast(df: DataFrame, value: str, order: str, least: int = 6, by: list[str] | None = None, block: int = scans.BLOCK) -> DataFrame:
    """df with forecast, unexpected and method: one step ahead by a first-order autoregression fitted on earlier rows only.

    Under `least` earlier values: the last one (last_available), or nothing (insufficient_history). A constant history gives
    its mean. A missing value keeps its row with method missing_actual; rows are ranked over values that are there. The fit is in
    running sums of the values less their group's mean, carried over blocks, so a series of any length is many tasks."""
    there = df.where(F.col(value).isNotNull()).withColumn("_y", F.col(value).cast("double"))
    rows = scans.running(scans.blocked(there, by or [], [order], block), {"_n": ("sum", F.lit(1))}, True, {"_all": F.lit(1), "_total": F.col("_y")})
    rows = scans.lag(rows.withColumn("_y", F.col("_y") - F.col("_total") / F.col("_all")), "_y", "_x")
    x, y = F.col("_x"), F.when(F.col("_x").isNotNull(), F.col("_y"))
    sums = {"_m": ("sum", F.when(x.isNotNull(), 1).otherwise(0)), "_sx": ("sum", x), "_sy": ("sum", y), "_sxx": ("sum", x * x), "_sxy": ("sum", x * y), "_s": ("sum", F.col("_y")), "_hi": ("max", x), "_lo": ("min", x)}
    rows = scans.running(rows, sums, True)
    n, m, mean = F.col("_n"), F.col("_m"), F.col("_total") / F.col("_all")
    slope = F.try_divide(F.col("_sxy") - F.try_divide(F.col("_sx") * F.col("_sy"), m), F.col("_sxx") - F.try_divide(F.col("_sx") * F.col("_sx"), m))
    line = F.try_divide(F.col("_sy"), m) + slope * (x - F.try_divide(F.col("_sx"), m))
    flat = F.col("_hi") == F.col("_lo")
    fitted = F.when(n == 0, F.lit(None)).when(n < least, x).when(flat, F.try_divide(F.col("_s"), n)).otherwise(line)
    method = F.when(n == 0, "insufficient_history").when(n < least, "last_available").when(flat, "historical_mean_constant").otherwise("expanding_ar1")
    done = rows.withColumns({"forecast": fitted + mean, "method": method}).withColumn("unexpected", F.col(value) - F.col("forecast"))
    done = done.select(*df.columns, "forecast", "method", "unexpected")
    missing = df.where(F.col(value).isNull()).withColumns({"forecast": F.lit(None).cast("double"), "method": F.lit("missing_actual"), "unexpected": F.lit(None).cast("double")})
    return done.unionByName(missing)


def first_difference(df: DataFrame, value: str, order: str, out: str, by: list[str] | None = None, block: int = scans.BLOCK) -> DataFrame:
    """df with the value less that of the group's row before; what lies between blocks of rows is carried."""
    rows = scans.lag(scans.blocked(df, by or [], [order], block), value, "_prior")
    return scans.unblocked(rows.withColumn(out, F.col(value) - F.col("_prior"))).drop("_prior")


def holm(df: DataFrame, p: str = "p", key: str = "model", out: str = "p_holm", by: list[str] | None = None, block: int = scans.BLOCK) -> DataFrame:
    """Step-down adjusted p-values; a missing p counts as 1. Ranks and the running maximum are carried over blocks of rows."""
    rows = scans.blocked(df.withColumn("_p", F.coalesce(p, F.lit(1.0))), by or [], ["_p", key], block)
    rows = scans.running(rows, {"_k": ("sum", F.lit(1))}, whole={"_n": F.lit(1)}).withColumn("_x", (F.col("_n") - F.col("_k") + 1) * F.col("_p"))
    rows = scans.running(rows, {"_top": ("max", F.col("_x"))})
    return scans.unblocked(rows.withColumn(out, F.least(F.lit(1.0), "_top"))).drop("_p", "_x", "_k", "_n", "_top")


def formal_zscore(df: DataFrame, value: str, formal: Column, by: list[str], out: str, ddof: int = 0) -> DataFrame:
    """z-scores with mean and deviation of formal rows only, for all rows; an exact zero deviation counts as 1."""
    sd = F.stddev_pop if ddof == 0 else F.stddev_samp
    stats = df.where(formal).groupBy(*by).agg(F.avg(value).alias("_m"), sd(value).alias("_s"))
    joined = df.join(stats, by, "left") if by else df.crossJoin(F.broadcast(stats))
    return joined.withColumn(out, (F.col(value) - F.col("_m")) / F.when(F.col("_s") == 0, 1.0).otherwise(F.col("_s"))).drop("_m", "_s")
