"""Ranks over whole tables without a single sorting task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import materialize


def with_index(df: DataFrame, keys: list[str], out: str = "idx") -> DataFrame:
    """df with out: 0, 1, 2, ... in the order of keys. Rows are range-sorted and written once, so ranks do not change when
    an executor is lost; only one count a partition reaches the driver."""
    ranged = materialize(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_index_at", F.monotonically_increasing_id()), "ranged")
    counts = sorted((r[0], r[1]) for r in ranged.groupBy(F.shiftright("_index_at", 33).cast("int").alias("p")).count().collect())
    firsts, total = [], 0
    for p, n in counts:
        firsts.append((p, total))
        total += n
    if not firsts:
        return ranged.withColumn(out, F.lit(0).cast("long")).drop("_index_at")
    table = df.sparkSession.createDataFrame(firsts, "_index_p int, _index_first long")
    return ranged.join(F.broadcast(table), F.shiftright("_index_at", 33).cast("int") == F.col("_index_p")).withColumn(out, F.col("_index_first") + F.col("_index_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_index_at", "_index_p", "_index_first")


def running_count(df: DataFrame, group: str, position: str, block: int = 4096) -> DataFrame:
    """df with n: how many rows of the group lie at or before the row's position (positions differ within a group).

    Counted within blocks of positions, then the blocks' totals are summed up, so a group that holds
    most rows is many sort groups of at most `block` rows."""
    blocked = df.withColumn("_b", F.floor(F.col(position) / block))
    inner = blocked.withColumn("_n", F.row_number().over(Window.partitionBy(group, "_b").orderBy(position)))
    totals = blocked.groupBy(group, "_b").agg(F.count("*").alias("_c"))
    before = totals.withColumn("_before", F.sum("_c").over(Window.partitionBy(group).orderBy("_b")) - F.col("_c")).drop("_c")
    return inner.join(before, [group, "_b"]).withColumn("n", F.col("_n") + F.col("_before")).drop("_b", "_n", "_before")
