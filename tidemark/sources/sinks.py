"""Writers: CSV, named tables, nested JSON, versioned lexicons, file manifests and long value maps."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """One CSV with a header; bom puts a byte-order mark before the first column's name."""
    first = df.columns[0]
    out = df.withColumnRenamed(first, "﻿" + first) if bom else df
    out.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """A folder of named tables; names are cut to 31 characters, as in a workbook."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name[:31]}")


def write_json(spark: SparkSession, results: dict, path: str) -> None:
    """Small nested results as one JSON line."""
    spark.createDataFrame([(json.dumps(results, ensure_ascii=False, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def combined_lexicon(parts: dict[str, DataFrame]) -> DataFrame:
    """(word, source) of several word tables without repeated pairs."""
    out = None
    for source, df in parts.items():
        one = df.select(F.trim("word").alias("word"), F.lit(source).alias("source")).where("word <> '' and lower(word) <> 'nan'")
        out = one if out is None else out.unionByName(one)
    return out.dropDuplicates(["word", "source"])


def manifest(spark: SparkSession, folder: str, forbidden: str = r"(^|/)(\.git|__pycache__)(/|$)", own: str = "manifest.csv") -> DataFrame:
    """(path, bytes, sha256) of the files in a folder, without its own file; a forbidden name raises an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    path = F.regexp_replace(F.col("path"), "^.*?" + folder.rstrip("/").replace(".", "\\.") + "/", "")
    named = files.select(path.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).where(F.col("path") != own)
    return named.withColumn("path", F.when(F.col("path").rlike(forbidden), F.raise_error(F.concat(F.lit("forbidden name: "), F.col("path")))).otherwise(F.col("path")))


def value_map(df: DataFrame, key: str, columns: list[str], missing: str = "—") -> DataFrame:
    """(key, column, value, kind): the long form of cells that are there and no dash; kind is numeric or text."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")
    long = df.select(key, cells).select(key, "x.*").where(F.col("value").isNotNull() & (F.trim("value") != "") & (F.col("value") != missing))
    return long.withColumn("kind", F.when(F.col("value").rlike(r"^-?\d+(\.\d+)?$"), "numeric").otherwise("text"))


def hash_table_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(path, a_hash, b_hash, match) of two (path, hash) tables, full outer."""
    return a.select("path", F.col("hash").alias("a_hash")).join(b.select("path", F.col("hash").alias("b_hash")), "path", "full").withColumn("match", F.coalesce(F.col("a_hash") == F.col("b_hash"), F.lit(False)))


def lexicon_snapshot(words: DataFrame, version: int, note: str) -> DataFrame:
    """(category, word, version, revision_note) of a lexicon version, without repeated words."""
    return words.select("category", F.trim("word").alias("word")).where("word <> ''").distinct().withColumns({"version": F.lit(version), "revision_note": F.lit(note)})


def lexicon_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(category, word, change): added and removed words between two snapshots."""
    a, b = (x.select("category", "word").distinct() for x in (old, new))
    return b.exceptAll(a).withColumn("change", F.lit("added")).unionByName(a.exceptAll(b).withColumn("change", F.lit("removed")))


def inventory(spark: SparkSession, folder: str, rules: dict[str, str], other: str = "unlisted") -> DataFrame:
    """(path, bytes, sha256, reason) of a folder's files, sorted; reason is the first rule (pattern -> reason) that matches the path."""
    reason = F.lit(None).cast("string")
    for pattern, why in reversed(rules.items()):
        reason = F.when(F.col("path").rlike(pattern), why).otherwise(reason)
    return manifest(spark, folder).withColumn("reason", F.coalesce(reason, F.lit(other))).orderBy("path")


def validation_bundle(judged: DataFrame, true: str, pred: str, labels: list, folder: str) -> dict[str, DataFrame]:
    """Writes metrics by label, overall metrics, confusion counts and disagreements of one label column, and a Markdown summary; returns the tables."""
    from tidemark.operators import metrics as M

    tables = {"label_metrics": M.label_metrics(judged, true, pred, labels), "overall": M.overall_metrics(judged, true, pred, labels), "confusion": M.confusion(judged, true, pred, labels), "disagreements": M.disagreements(judged, {"label": (true, pred)})}
    write_tables(tables, folder)
    spark = judged.sparkSession
    back = {name: spark.read.parquet(f"{folder}/{name[:31]}") for name in tables}
    o, lines = back["overall"].collect()[0], ["# Validation", ""]
    lines += [f"- {c}: {'missing' if o[c] is None else format(o[c], '.4f')}" for c in back["overall"].columns]
    lines += ["", "| label | support | precision | recall | f1 |", "|---|---|---|---|---|"]
    lines += [f"| {r.label} | {r.support} | {r.precision:.4f} | {r.recall:.4f} | {r.f1:.4f} |" for r in back["label_metrics"].orderBy("label").collect()]
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/summary_md")
    return back


def write_crossfit(scored: DataFrame, tones: DataFrame, folder: str) -> None:
    """Sentence scores, partitioned by fold, and the reports' tones."""
    scored.write.mode("overwrite").partitionBy("fold").parquet(f"{folder}/sentence_scores")
    tones.write.mode("overwrite").parquet(f"{folder}/report_tones")


def write_power(power: DataFrame, folder: str) -> None:
    write_csv(power.orderBy("size"), f"{folder}/power_curve")


def number_audit(tables: dict[str, tuple[DataFrame, str]], missing: str = "—") -> DataFrame:
    """(item, value, source): every numeric cell of several tables (name -> (table, key column)); an item is the key and the column."""
    out = None
    for name, (df, key) in tables.items():
        one = value_map(df, key, [c for c in df.columns if c != key], missing).where("kind = 'numeric'")
        one = one.select(F.concat_ws(" / ", F.col(key).cast("string"), "column").alias("item"), F.col("value").cast("double").alias("value"), F.lit(name).alias("source"))
        out = one if out is None else out.unionByName(one)
    return out


def citation_audit(texts: DataFrame, text_col: str, pattern: str, known: DataFrame) -> DataFrame:
    """(key, cited, listed): keys that the pattern's first group finds in texts, and those of the list (key), full outer."""
    found = texts.select(F.explode(F.regexp_extract_all(text_col, F.lit(pattern), F.lit(1))).alias("key")).groupBy("key").agg(F.count("*").alias("cited"))
    both = found.join(known.select("key").distinct().withColumn("listed", F.lit(True)), "key", "full")
    return both.select("key", F.coalesce("cited", F.lit(0)).alias("cited"), F.coalesce("listed", F.lit(False)).alias("listed"))
