"""Evenly spaced and quota samples, as joins on row ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import with_index


def even_positions(length: Column, target: Column) -> Column:
    """Distinct places rint(i * (length - 1) / (target - 1)) for i below target, half to even; all places if target is not below length."""
    some = F.transform(F.sequence(F.lit(0), F.greatest(target - 1, F.lit(0))), lambda i: F.rint(i * (length - 1) / F.greatest(target - 1, F.lit(1))).cast("int"))
    every = F.sequence(F.lit(0), F.greatest(length - 1, F.lit(0)))
    none = F.array().cast("array<int>")
    return F.when((target <= 0) | (length <= 0), none).when(target >= length, every).otherwise(F.array_distinct(some))


def even_sample(df: DataFrame, by: list[str], order: list[str], target: Column, settings: list[str] | None = None) -> DataFrame:
    """Rows of each group at even places of its order; target may use the group's size `n_rows` and the columns in settings, which are the same in all of a group.

    Rows are ranked over the whole table, and a group's places are ranks behind its first one: no window over a group, and one row
    for each row of the sample is joined. Ties in the order keep the order in which they were written."""
    ranked = with_index(df, [*by, *order], "_rank")
    groups = ranked.groupBy(*by).agg(F.min("_rank").alias("_first"), F.count("*").cast("int").alias("n_rows"), *[F.first(c).alias(c) for c in settings or []])
    wanted = groups.select(F.explode(F.transform(even_positions(F.col("n_rows"), target), lambda k: F.col("_first") + k)).alias("_rank"))
    return ranked.join(wanted, "_rank").drop("_rank")


def quotas(units: DataFrame, order: list[str], total: int, out: str = "quota") -> DataFrame:
    """units (a small table) with shares of total: equal, the first total mod n get one more."""
    n, rank = F.count("*").over(Window.partitionBy()), F.row_number().over(Window.orderBy(*order))
    return units.withColumn(out, (F.floor(F.lit(total) / n) + F.when(rank <= F.lit(total) % n, 1).otherwise(0)).cast("int"))


def settled_quotas(sizes: DataFrame, section: str, stratum: str, total: int, size: str = "n", out: str = "quota") -> DataFrame:
    """sizes (section, stratum, n) with quotas that sum up to `total` in each section, or to all its rows if it has fewer.

    Strata get equal shares; what short ones cannot fill flows to the others until it is settled: all have the same level or all their rows, and
    what is left over goes to the first ones, in their order, that have more. The level is searched by bits over a section's sizes."""
    at = lambda level: f"aggregate(_sizes, 0L, (s, x) -> s + least(x, {level}))"
    # the largest level whose sum is not above the total
    level = f"aggregate(sequence(62, 0, -1), 0L, (a, b) -> if({at('a + shiftleft(1L, b)')} <= {total}, a + shiftleft(1L, b), a))"
    bounded = f"aggregate(_sizes, 0L, (m, x) -> greatest(m, least(x, {total})))"
    sections = sizes.groupBy(F.col(section).alias("_section")).agg(F.collect_list(F.least(F.col(size).cast("long"), F.lit(total).cast("long"))).alias("_sizes"))
    sections = sections.withColumn("_level", F.least(F.expr(level.replace("sequence(62", f"sequence({max(1, total.bit_length())}")), F.expr(bounded)))
    sections = sections.select("_section", "_level", (F.lit(total) - F.expr(at("_level"))).alias("_rest"))
    joined = sizes.join(sections, sizes[section].eqNullSafe(sections["_section"]))
    more = F.col(size) > F.col("_level")
    rank = F.sum(more.cast("int")).over(Window.partitionBy(section).orderBy(stratum))
    quota = F.least(F.col(size), F.col("_level")) + F.when(more & (rank <= F.col("_rest")), 1).otherwise(0)
    return joined.withColumn(out, quota.cast("int")).drop("_section", "_level", "_rest")


def repaired_sample(df: DataFrame, section: str, stratum: str, order: list[str], total: int) -> DataFrame:
    """`total` rows of each section (all, if it has fewer), spread over its strata by settled_quotas, at even places of each stratum's order."""
    quotas_ = settled_quotas(df.groupBy(section, stratum).agg(F.count("*").cast("int").alias("n")), section, stratum, total)
    q = quotas_.select(F.col(section).alias("_s1"), F.col(stratum).alias("_s2"), "quota")
    joined = df.join(q, df[section].eqNullSafe(q["_s1"]) & df[stratum].eqNullSafe(q["_s2"])).drop("_s1", "_s2")
    return even_sample(joined, [section, stratum], order, F.col("quota"), ["quota"]).drop("quota")
