"""The registered queries of this subpackage; each derives its contract's columns from its operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import fresh_path, small_batches
from .decontaminate import contaminated
from .fingerprints import compare_with_edits
from .html_text import extract_main_text
from .licenses import scan_licenses
from .merkle import manifest
from .near_duplicates import near_duplicates
from .oracle import ORACLE_SQL  # noqa: F401  the entry point reads it here
from .packing import pack, token_pieces
from .pseudonyms import pseudonymise_documents
from .token_counts import count_tokens
from .token_files import read_token_index, write_token_files
from .toxicity import score_documents
from .url_filters import judge_urls
from .whitening import whiten


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pseudonym_key(spark: SparkSession) -> str:
    """The session's spark.quire.pseudonymKey; a new one for each session without it, whose pseudonyms nobody can turn back."""
    from secrets import token_hex

    key = spark.conf.get("spark.quire.pseudonymKey", None)
    if not key:
        key = token_hex(32)
        spark.conf.set("spark.quire.pseudonymKey", key)
    return key


def op1_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(table(spark, sf_dir, "documents"))


def op2_setsketch_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(small_batches(spark), sf_dir, "documents"), size=2)


def op3_zstd_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(small_batches(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_license_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op5_host_suffix_array_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op6_pigeonhole_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise_documents(table(spark, sf_dir, "documents"), pseudonym_key(spark)).select("doc_id", "text", "n_values")


def op8_grouping_ga_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_pieces(table(spark, sf_dir, "documents")))


def op9_elias_fano_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return read_token_index(spark, path)


def op10_viterbi_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return count_tokens(docs)


def op11_bitmap_rank_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


def op12_path_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op13_multiplicity_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_iblt_fingerprints": op1_iblt_fingerprints,
    "op2_setsketch_near_duplicates": op2_setsketch_near_duplicates,
    "op3_zstd_toxicity": op3_zstd_toxicity,
    "op4_license_set_join": op4_license_set_join,
    "op5_host_suffix_array_text": op5_host_suffix_array_text,
    "op6_pigeonhole_decontamination": op6_pigeonhole_decontamination,
    "op7_feistel_pseudonyms": op7_feistel_pseudonyms,
    "op8_grouping_ga_packing": op8_grouping_ga_packing,
    "op9_elias_fano_token_files": op9_elias_fano_token_files,
    "op10_viterbi_token_counts": op10_viterbi_token_counts,
    "op11_bitmap_rank_merkle": op11_bitmap_rank_merkle,
    "op12_path_template_tree": op12_path_template_tree,
    "op13_multiplicity_whitening": op13_multiplicity_whitening,
}
