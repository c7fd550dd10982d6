"""Readers: Parquet tables, CSV with explicit schemas, side texts, JSON; and the daily series built from the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Schemas of the study's input files.
SCHEMAS = {
    "report_metadata": "report_id string, report_period string, publication_datetime timestamp",
    "report_sections": "report_id string, report_period string, section string, found boolean, char_count int, word_count_proxy int, local_path string",
    "stock_prices": "date date, close double, simple_return double, volatility_20d double",
    "bond_yields": "date date, yield_1y double, yield_5y double, yield_10y double",
    "policy_operations": "date date, effective_date date, operation_type string",
    "event_calendar": "event_id string, report_period string, publication_datetime timestamp, bond_event_date date, equity_event_date date, bond_window_complete_m3_p3 boolean, equity_window_complete_m3_p3 boolean, action_nearby int",
    "source_registry": "dataset_name string, source_organization string, coverage_start string, coverage_end string, license_or_terms string",
    "annotations": "annotation_id string, report_id string, report_period string, section string, sentence string, auto_sentiment_score double, auto_policy_stance_score double, manual_sentiment string, manual_stance string, manual_topic string, reviewer string, review_note string",
    "report_sentences": "report_id string, section string, sentence string, sentence_id string",
    "words": "word string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def csv(spark: SparkSession, path: str, kind: str, order: list[str] | None = None, header: bool = True) -> DataFrame:
    """A CSV file of a known kind; a byte-order mark is dropped with the header line. header=False for files whose first line is data."""
    df = spark.read.schema(SCHEMAS[kind]).option("header", header).option("enforceSchema", True).csv(path)
    return df.orderBy(*order) if order else df


def side_texts(spark: SparkSession, index: DataFrame, path_col: str, folder: str, out: str = "text") -> DataFrame:
    """index with the whole text of the file that path_col names under folder (\\ counts as /); a missing file gives ''."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(F.col("value").alias(out), F.element_at(F.split(F.input_file_name(), F.lit(folder.rstrip("/").split("/")[-1] + "/"), 2), -1).alias("_path"))
    keyed = index.withColumn("_path", F.regexp_replace(F.translate(path_col, "\\", "/"), "^\\./", ""))
    return keyed.join(files, "_path", "left").withColumn(out, F.coalesce(out, F.lit(""))).drop("_path")


def json_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def scraped_numbers(spark: SparkSession, path: str, patterns: dict[str, str]) -> DataFrame:
    """(item, value): the first match of each pattern's group in a text file."""
    lines = spark.read.text(path, wholetext=True)
    one = F.array(*[F.struct(F.lit(k).alias("item"), F.try_to_number(F.nullif(F.regexp_extract("value", p, 1), F.lit("")), F.lit("S999999999.999999999")).cast("double").alias("value")) for k, p in patterns.items()])
    return lines.select(F.explode(one).alias("x")).select("x.*")


def daily_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(d, close): the mean order value of each day."""
    return table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.avg("o_totalprice").alias("close"))


def daily_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(d, y1, y5, y10): the mean price of each day by return flag, as three points of a curve."""
    rows = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("d"), "l_returnflag", "l_extendedprice")
    wide = rows.groupBy("d").pivot("l_returnflag", ["A", "N", "R"]).agg(F.avg("l_extendedprice"))
    return wide.select("d", (F.col("A") / 10000).alias("y1"), (F.col("N") / 10000).alias("y5"), (F.col("R") / 10000).alias("y10"))


def quarter_events(cal: DataFrame) -> DataFrame:
    """(event_id, d, pos): the first calendar day of each quarter."""
    return cal.groupBy(F.concat(F.year("d"), F.lit("Q"), F.quarter("d")).alias("event_id")).agg(F.min("d").alias("d"), F.min("pos").alias("pos"))


def action_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(op_date): days with an urgent order of at least 450,000."""
    return table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_totalprice >= 450000").select(F.to_date("o_orderdate").alias("op_date")).distinct()


def _there(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def section_index(spark: SparkSession, path: str, repaired: str | None = None) -> DataFrame:
    """The section index, from the repaired file if there is one; \\ in paths becomes /."""
    df = csv(spark, repaired if repaired and _there(spark, repaired) else path, "report_sections")
    return df.withColumn("local_path", F.translate("local_path", "\\", "/"))


def event_calendar(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path, "event_calendar", ["publication_datetime", "event_id"])


def lexicon_sheets(spark: SparkSession, sheets: dict[str, tuple[str, bool]]) -> DataFrame:
    """(word, category) of a workbook's sheets, each exported as CSV: category -> (path, whether its first line is a header). The first
    column counts; blank words are left out."""
    out = None
    for category, (path, header) in sheets.items():
        one = csv(spark, path, "words", header=header).select(F.trim(F.regexp_replace("word", "^\ufeff", "")).alias("word"), F.lit(category).alias("category")).where("word <> ''")
        out = one if out is None else out.unionByName(one)
    return out
