"""Classification metrics, confusion counts, completeness and disagreement of label columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import quantiles


def _grid(df: DataFrame, labels: list, cols: list[str]) -> DataFrame:
    kind = df.schema[cols[0]].dataType
    one = df.sparkSession.createDataFrame([(x,) for x in labels], "l string").select(F.col("l").cast(kind).alias("l"))
    out = one.withColumnRenamed("l", cols[0])
    return out.crossJoin(one.withColumnRenamed("l", cols[1])) if len(cols) > 1 else out


def confusion(df: DataFrame, true: str, pred: str, labels: list) -> DataFrame:
    """(true, pred, n) for every pair of labels, 0 where none."""
    counts = df.groupBy(true, pred).agg(F.count("*").alias("n"))
    return _grid(df, labels, [true, pred]).join(counts, [true, pred], "left").select(true, pred, F.coalesce("n", F.lit(0)).alias("n"))


def label_metrics(df: DataFrame, true: str, pred: str, labels: list) -> DataFrame:
    """(label, support, precision, recall, f1); a zero denominator gives 0."""
    c = confusion(df, true, pred, labels)
    zero = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    t = c.groupBy(F.col(true).alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(true) == F.col(pred), F.col("n")).otherwise(0)).alias("hit"))
    p = df.groupBy(F.col(pred).alias("label")).agg(F.count("*").alias("predicted"))
    both = t.join(p, "label", "left").withColumns({"precision": zero(F.col("hit"), F.coalesce("predicted", F.lit(0))), "recall": zero(F.col("hit"), F.col("support"))})
    return both.withColumn("f1", zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select("label", "support", "precision", "recall", "f1")


def overall_metrics(df: DataFrame, true: str, pred: str, labels: list) -> DataFrame:
    """One row: accuracy, macro and weighted precision, recall and F1 over the labels."""
    m = label_metrics(df, true, pred, labels)
    agg = [F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")] + [(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")]
    acc = df.agg(F.avg(F.when(F.col(true) == F.col(pred), 1.0).otherwise(0.0)).alias("accuracy"))
    return acc.crossJoin(F.broadcast(m.agg(*agg)))


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, nulls, empty, valid) of each column, in one pass."""
    sums = df.agg(*[F.struct(F.count_if(F.col(c).isNull()).alias("nulls"), F.count_if(F.trim(F.col(c).cast("string")) == "").alias("empty"), F.count_if(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")).alias("valid")).alias(c) for c in columns])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), f"{c}.nulls", f"{c}.empty", f"{c}.valid") for c in columns])).alias("x")).select("x.*")


def illegal_labels(df: DataFrame, column: str, allowed: list) -> DataFrame:
    return df.select(column).where(~F.col(column).isin(allowed)).distinct()


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """(variable, count, mean, std, min, p25, p50, p75, max) with exact, interpolated quantiles; missing values are left out."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*").where("v is not null and not isnan(v)")
    sums = long.groupBy("variable").agg(F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    q = quantiles(long, ["variable"], "v", [0.25, 0.5, 0.75])
    return sums.join(q, "variable").select("variable", "count", "mean", "std", "min", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "max")


def top_terms(df: DataFrame, terms: str, n: int) -> DataFrame:
    """(term, n): the n terms that occur most often in an array column, ties by the term."""
    return df.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(n)


def disagreements(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Rows in which any pair of columns differs (null differs from a value), with a flag for each pair."""
    flags = {f"{name}_differs": ~F.col(a).eqNullSafe(F.col(b)) for name, (a, b) in pairs.items()}
    any_ = F.lit(False)
    for name in flags:
        any_ = any_ | F.col(name)
    return df.withColumns(flags).where(any_)


def labels_of(df: DataFrame, columns: list[str]) -> DataFrame:
    """(label): the labels that occur in any of the columns, for a grid that leaves none out."""
    out = None
    for c in columns:
        one = df.select(F.col(c).cast("string").alias("label"))
        out = one if out is None else out.unionByName(one)
    return out.where("label is not null").distinct()
