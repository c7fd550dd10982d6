"""Exact quantiles of groups of any size: brackets from a sketch, counts below them, and a ranked look at the values between."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.scratch import materialize

from .scans import blocked, running

#: Ranks that the sketch gives are right to a share of 1 / ACCURACY of the group's rows.
ACCURACY = 10_000
#: Up to so many groups have their brackets broadcast (a few hundred bytes each); more are joined by a shuffle, whose skew AQE splits.
GROUPS = 50_000


def quantiles(df: DataFrame, by: list[str], value: str, probs: list[float], out: str = "q", accuracy: int = ACCURACY) -> DataFrame:
    """(by..., out): for each group the array of exact, linearly interpolated quantiles of value; nulls and NaN are left out, a group of nothing else has null.

    A first pass takes n and a sketch's bracket of each quantile, a second one counts the values below and up to the brackets. A bracket that
    misses its rank is opened to that side and counted again, so the result doesn't rest on the sketch. The values inside, about 4 / accuracy of
    the rows and one row each distinct value, are ranked by a running count over blocks. No task holds a group."""
    group = F.struct(*by) if by else F.lit(0)
    v = F.col(value).cast("double")
    rows = df.select(group.alias("_key"), F.when(~F.isnan(v), v).alias("_v"))
    there = rows.where("_v is not null")
    margin = 2.0 / accuracy
    near = F.percentile_approx("_v", [min(1.0, max(0.0, p + s)) for s in (-margin, margin) for p in probs], accuracy)
    k = range(len(probs))
    state = rows.groupBy("_key").agg(F.count("_v").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), near.alias("_a"))
    at = [F.lit(float(p)) * (F.col("_n") - 1) for p in probs]
    state = state.select("_key", "_n", "_min", "_max", F.slice("_a", 1, len(probs)).alias("_lo"), F.slice("_a", len(probs) + 1, len(probs)).alias("_hi"), F.array(*at).alias("_at"))
    state = materialize(state, "brackets")
    groups = state.count()
    small = (lambda x: F.broadcast(x)) if groups <= GROUPS else (lambda x: x)
    counted, open_ = None, state.where("_n > 0")
    while True:
        counts = there.join(small(open_.select("_key", "_lo", "_hi")), "_key").groupBy("_key").agg(
            F.array(*[F.count_if(F.col("_v") < F.col("_lo")[i]) for i in k]).alias("_below"), F.array(*[F.count_if(F.col("_v") <= F.col("_hi")[i]) for i in k]).alias("_upto"))
        counts = open_.join(counts, "_key")
        low, high = (lambda i: F.col("_below")[i] > F.floor(F.col("_at")[i])), (lambda i: F.col("_upto")[i] <= F.ceil(F.col("_at")[i]))
        wider = {"_lo": F.array(*[F.when(low(i), F.col("_min")).otherwise(F.col("_lo")[i]) for i in k]), "_hi": F.array(*[F.when(high(i), F.col("_max")).otherwise(F.col("_hi")[i]) for i in k])}
        missed = F.exists(F.array(*[low(i) | high(i) for i in k]), lambda x: x)
        counts = materialize(counts.withColumn("_missed", missed), "counted")
        good = counts.where("not _missed").drop("_missed", "_upto")
        counted = good if counted is None else counted.unionByName(good)
        open_ = counts.where("_missed").withColumns(wider).drop("_missed", "_below", "_upto")
        if not counts.where("_missed").limit(1).count():
            break
    targets = F.filter(F.array(*[F.struct(F.lit(i).alias("k"), F.col("_lo")[i].alias("lo"), F.col("_hi")[i].alias("hi"), F.col("_below")[i].alias("below"), F.col("_at")[i].alias("at")) for i in k]), lambda t: (F.col("_v") >= t["lo"]) & (F.col("_v") <= t["hi"]))
    inside = there.join(small(counted), "_key").select("_key", "_v", F.explode(targets).alias("t")).groupBy("_key", "t.k", "t.below", "t.at", "_v").agg(F.count("*").alias("_c"))
    ranked = running(blocked(inside, ["_key", "k"], ["_v"]), {"_upto": ("sum", F.col("_c"))})
    reach = F.col("below") + F.col("_upto")
    found = ranked.groupBy("_key", "k", "at").agg(F.min(F.when(reach > F.floor("at"), F.col("_v"))).alias("a"), F.min(F.when(reach > F.ceil("at"), F.col("_v"))).alias("b"))
    part = F.col("at") - F.floor("at")
    found = found.withColumn("x", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((1 - part) * F.col("a") + part * F.col("b")))
    whole = found.groupBy("_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias(out))
    return state.select("_key").join(whole, "_key", "left").select(*[F.col("_key")[c].alias(c) for c in by], out)
