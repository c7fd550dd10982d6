"""Sessions of events: a long enough gap begins a new one. Found within time buckets and stitched at their ends, so that one key's
events, however many, are as many tasks as it has buckets; what is ordered over a whole key is one row a bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000


def sessions(df: DataFrame, key: str, micros: str, order: list[str], gap: int, bucket: int = DAY, out: str = "session") -> DataFrame:
    """df with out: 0, 1, 2, ... for each key by time. micros: the column of microseconds; rows at least `gap` apart are in different sessions.

    Rows with a null time are in their key's first session. Rows of the same time are ordered by `order`."""
    first = -(1 << 62)
    at, own = F.col(micros), Window.partitionBy(key, "_b").orderBy(micros, *order)
    rows = df.withColumn("_b", F.coalesce(F.floor(at / F.lit(bucket)), F.lit(first)))
    begins = F.coalesce((at - F.lag(at).over(own) >= gap).cast("int"), F.lit(0))
    rows = rows.withColumn("_g", begins).withColumn("_n", F.sum("_g").over(own)).drop("_g")
    parts = rows.groupBy(key, "_b").agg(F.min(at).alias("_first"), F.max(at).alias("_last"), F.max("_n").alias("_many"))
    by = Window.partitionBy(key).orderBy("_b")
    stitched = parts.withColumn("_new", F.coalesce((F.col("_first") - F.lag("_last").over(by) >= gap).cast("int"), F.lit(0)))
    before = stitched.select(F.col(key).alias("_key"), F.col("_b").alias("_b2"), (F.sum(F.col("_new") + F.col("_many")).over(by) - F.col("_many")).alias("_before"))
    joined = rows.join(before, rows[key].eqNullSafe(before["_key"]) & (rows["_b"] == before["_b2"]))
    return joined.withColumn(out, (F.col("_before") + F.col("_n")).cast("long")).drop("_b", "_b2", "_n", "_key", "_before")
