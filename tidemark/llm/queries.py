"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, ogg
from .common import documents, materialize, short_batches
from .filter_audit import audit
from .html_text import extract
from .near_dedup import near_duplicates
from .packing import best_fit_pack, tokenized_pieces
from .piece_lattice import encode
from .quality import score, train
from .ranked_search import search
from .repair_store import read_token_files, write_token_files
from .secret_scan import scan
from .sql import filter_audit_sql, near_dedup_sql, ranked_search_sql, secret_scan_sql, warc_sql
from .warc import page_records, read_archives, write_archives
from .wordpiece import count_tokens


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary lies; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op2_wordpiece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = tokenized_pieces(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), end_id=1)
    return best_fit_pack(pieces)


def op4_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"), with_ids=False)


def op5_adaptive_scan_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda vec_id: vec_id % 20 == 0)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_token_files(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), end_id=0)
    return read_token_files(files, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    metadata = ("n_chars",)
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), metadata=metadata), metadata)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def op9_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    stored = materialize(ogg.store(documents(spark, sf_dir)), "media")
    return ogg.read(stored, with_payload=False).select(columns)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_batches(spark)
    archives = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return page_records(read_archives(spark, archives, with_payload=False))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_text": op1_html_text,
        "op2_wordpiece_counts": op2_wordpiece_counts,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op4_piece_lattice": op4_piece_lattice,
        "op5_adaptive_scan_ann": op5_adaptive_scan_ann,
        "op6_token_files": op6_token_files,
        "op7_quality_fm": op7_quality_fm,
        "op8_secret_scan": op8_secret_scan,
        "op9_ogg_media": op9_ogg_media,
        "op10_minhash_near_dedup": op10_minhash_near_dedup,
        "op11_filter_audit": op11_filter_audit,
        "op12_warc": op12_warc,
        "op13_ranked_search": op13_ranked_search,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_secret_scan": secret_scan_sql(), "op10_minhash_near_dedup": near_dedup_sql(), "op11_filter_audit": filter_audit_sql(), "op12_warc": warc_sql(), "op13_ranked_search": ranked_search_sql()}
