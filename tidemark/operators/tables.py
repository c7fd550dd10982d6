"""Report-shaped tables: coefficients by model, relabelled and formatted, and the dictionary of variables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DASH = "—"


def stars(z: Column) -> Column:
    """Marks of two-sided significance at 1, 5 and 10 per cent, from the z value."""
    a = F.abs(z)
    return F.when(a >= 2.5758293035489004, "***").when(a >= 1.959963984540054, "**").when(a >= 1.6448536269514722, "*").otherwise("")


def coefficient_table(fits: DataFrame, labels: dict[str, str], models: list[str], digits: int = 3) -> DataFrame:
    """(place, variable, a column a model): "beta*** (se)" of the terms in `labels`, in their order, a dash where a model has none; then the rows.

    fits: model, term, beta, se, z, n. Estimates that are missing are dashes."""
    spark = fits.sparkSession
    names = spark.createDataFrame([(k, t, v) for k, (t, v) in enumerate(labels.items())], "place int, term string, variable string")
    cell = F.concat(F.format_string(f"%.{digits}f", "beta"), stars(F.col("z")), F.format_string(f" (%.{digits}f)", "se"))
    cells = fits.join(F.broadcast(names), "term").select("place", "variable", "model", F.when(F.col("beta").isNotNull() & F.col("se").isNotNull(), cell).alias("cell"))
    rows = fits.groupBy("model").agg(F.max("n").cast("string").alias("cell")).select(F.lit(len(labels)).alias("place"), F.lit("n").alias("variable"), "model", "cell")
    wide = cells.unionByName(rows).groupBy("place", "variable").pivot("model", models).agg(F.first("cell", ignorenulls=True))
    return wide.select("place", "variable", *[F.coalesce(F.col(f"`{m}`"), F.lit(DASH)).alias(m) for m in models])


def conditional_table(fits: DataFrame, digits: int = 3) -> DataFrame:
    """(model, coefficient, lr, p) of conditional fits; the coefficient of a fit of two is their sum."""
    total = F.col("first") + F.coalesce("second", F.lit(0.0))
    return fits.select("model", F.round(total, digits).alias("coefficient"), F.round("lr", digits).alias("lr"), F.round("p", digits).alias("p"))


def variable_dictionary(spark: SparkSession, entries: dict[str, tuple[str, str]]) -> DataFrame:
    """(variable, definition, source) from name -> (definition, source)."""
    return spark.createDataFrame([(k, *v) for k, v in entries.items()], "variable string, definition string, source string")


def without_empty_columns(df: DataFrame, keep: list[str], missing: str = DASH) -> DataFrame:
    """df without the columns that hold only dashes or nothing; those in keep stay. One aggregate pass."""
    rest = [c for c in df.columns if c not in keep]
    if not rest:
        return df
    full = df.agg(*[F.max(F.col(c).isNotNull() & ~F.trim(F.col(c).cast("string")).isin("", missing)).alias(c) for c in rest]).collect()[0]
    return df.select(*[c for c in df.columns if c in keep or full[c]])
