"""A corpus pipeline: toxicity, near duplicates, benchmark decontamination, pseudonyms, packing.

Each stage takes what the one before kept and returns the columns of documents, the last the packed pieces. A row's doc_id may
be null or repeated: equal rows of one doc_id count once after the second stage, other texts under it are documents of their own; rows without a
doc_id are never duplicates. Columns that operators add have names of their own, so any extra columns of documents come along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import materialise, small_batches
from quire.llm.decontaminate import drop_contaminated
from quire.llm.near_duplicates import near_duplicates
from quire.llm.packing import pack, token_pieces
from quire.llm.pseudonyms import pseudonymise_documents
from quire.llm.queries import pseudonym_key
from quire.llm.toxicity import fit, score

TOXIC_FROM = 0.7

#: Chunks that a worker of the last stage keeps the ids of: executors come to it with a grown heap, so it keeps fewer than the operator alone.
CACHED_CHUNKS = 100_000


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose toxicity score is TOXIC_FROM or more."""
    small_batches(spark)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model, "_quire_toxicity").where(F.col("_quire_toxicity") < TOXIC_FROM).drop("_quire_toxicity")


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates (five words, a similarity of 0.8): the one with the smallest doc_id, of texts that share it the one with the least hash.

    Any one of rows equal in doc_id and text stays. The first text of a doc_id goes by that number, others by numbers beyond 2^62.
    """
    small_batches(spark)
    hashed = F.xxhash64("text")
    several = docs.groupBy(F.col("doc_id").alias("_quire_id")).agg(F.min(hashed).alias("_quire_first"), F.max(hashed).alias("_quire_last"))
    several = several.where("_quire_first <> _quire_last").drop("_quire_last")
    other = F.lit(1 << 62) + F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 61))
    keyed = docs.join(several, F.col("doc_id") == F.col("_quire_id"), "left")
    keyed = keyed.withColumn("_quire_key", F.when(F.col("_quire_first").isNull() | (F.col("_quire_first") == hashed), F.col("doc_id").cast("long")).when(F.col("doc_id").isNotNull(), other))
    kept = near_duplicates(keyed.select(F.col("_quire_key").alias("doc_id"), "text")).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_quire_key")).distinct()
    kept = materialise(kept, "kept")
    named = keyed.join(kept, "_quire_key").dropDuplicates(["_quire_key"]).select(*docs.columns)
    return named.unionByName(docs.where("doc_id IS NULL"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold an item of the benchmark."""
    small_batches(spark)
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal values by pseudonyms of the same format."""
    return pseudonymise_documents(docs, pseudonym_key(spark), count="_quire_values").drop("_quire_values").withColumn("n_chars", F.length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' token pieces into sequences."""
    small_batches(spark)
    return pack(token_pieces(docs, cache_entries=CACHED_CHUNKS, slice_bytes=1 << 20))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicate), ("decontamination", decontamination), ("personal_data", personal_data), ("packing", packing)]

#: SQL can express none of these stages but in part; tests/llm/test_pipeline.py has the brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
