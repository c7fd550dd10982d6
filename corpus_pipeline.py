"""The corpus pipeline: quality, near-duplicates, secrets, packing. Each stage is written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, materialize, short_batches, without
from tidemark.llm.near_dedup import near_duplicates
from tidemark.llm.packing import best_fit_pack, tokenized_pieces
from tidemark.llm.quality import keep_good
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.secret_scan import redact


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject, with all their columns."""
    short_batches(spark)
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), tuple(c for c in ("n_chars",) if c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, the one with the smallest doc_id; rows that repeat a doc_id stay or go together."""
    short_batches(spark)
    dropped = materialize(near_duplicates(docs).where("not kept").select("doc_id"), "dropped")
    return without(docs, dropped)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; spans that hold secrets are replaced by a mark, and n_chars follows the new text."""
    short_batches(spark)
    clean = redact(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in clean.columns else clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents' token pieces and their places in sequences of 4096."""
    short_batches(spark)
    return best_fit_pack(tokenized_pieces(docs, tokenizer_path("word_bpe_49k.json"), end_id=1))


STAGES = [("quality_classifier", quality_classifier), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("best_fit_packing", packing)]
ORACLE_SQL = None  # a fitted model, minima of hashes and packing rounds have no SQL; tests hold each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; every stage but the last is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
