"""Lags, running sums and running extremes over groups of any size, a single group included.

Rows are range-sorted and written once (`order.with_index`) and cut into blocks of equal numbers of ranks. Windows run within blocks; what a block
passes on (its last row, its sums) is one row a block and group, so a source that is one group is as many sort groups as it has blocks.
Groups may be null. Rows with equal order keys keep the order in which they were written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import with_index

#: Ranks in a block.
BLOCK = 1 << 16
_COMBINE = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
}


def blocked(df: DataFrame, by: list[str], order: list[str], block: int = BLOCK) -> DataFrame:
    """df with _i (rank in the order of by and order), _b (its block), _last (the block's last rank?) and _g (the group)."""
    group = F.struct(*by) if by else F.lit(0)
    return with_index(df, [*by, *order], "_i").withColumns({"_g": group, "_b": F.floor(F.col("_i") / block), "_last": (F.col("_i") + 1) % block == 0})


def unblocked(df: DataFrame) -> DataFrame:
    return df.drop("_i", "_g", "_b", "_last")


def lag(rows: DataFrame, value: str, out: str) -> DataFrame:
    """rows (blocked) with the value of the group's row before, null for its first. A block's last row is carried to the next block."""
    here = F.struct("_g", F.col(value).alias("_v"))
    ends = rows.where("_last").select((F.col("_b") + 1).alias("_b"), here.alias("_end"))
    inner = rows.withColumn("_before", F.lag(here).over(Window.partitionBy("_b").orderBy("_i")))
    joined = inner.join(ends, "_b", "left").withColumn("_before", F.coalesce("_before", "_end"))
    return joined.withColumn(out, F.when(F.col("_before._g").eqNullSafe(F.col("_g")), F.col("_before._v"))).drop("_before", "_end")


def running(rows: DataFrame, values: dict[str, tuple[str, Column]], past: bool = False, whole: dict[str, Column] | None = None) -> DataFrame:
    """rows (blocked) with each of values, (sum, max or min, of what), from the group's first row to this one, or to the one before (past).

    Sums over nothing are 0, extremes null. Each of `whole` is a sum over all of the group. Carries are summed up over a group's blocks."""
    whole = whole or {}
    inside = Window.partitionBy("_g", "_b").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1 if past else 0)
    blocks = Window.partitionBy("_g")
    before = blocks.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_g", "_b").agg(*[_COMBINE[kind][0](v).alias(f"_t_{n}") for n, (kind, v) in values.items()], *[F.sum(v).alias(f"_w_{n}") for n, v in whole.items()])
    carry = totals.select("_g", "_b", *[_COMBINE[kind][0](f"_t_{n}").over(before).alias(f"_c_{n}") for n, (kind, _) in values.items()], *[F.sum(f"_w_{n}").over(blocks).alias(n) for n in whole])
    inner = rows.withColumns({n: _COMBINE[kind][0](v).over(inside) for n, (kind, v) in values.items()})
    joined = inner.join(carry, ["_g", "_b"])
    return joined.withColumns({n: _COMBINE[kind][1](F.col(f"_c_{n}"), F.col(n)) for n, (kind, _) in values.items()}).drop(*[f"_c_{n}" for n in values])
