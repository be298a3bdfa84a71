"""The corpus pipeline: quality rules, near duplicates, benchmark leaks, personal data, packing.

Each stage gets what its predecessor kept as ``docs`` and returns the columns of documents, but for the last, whose rows
are pieces of token sequences. Rows with a null doc_id or text are judged like all others: a null text fails the
quality rules, and a null id is never anyone's duplicate. Rows travel whole, packed, so columns of any name beside doc_id and
text come out as they went in (``n_chars`` follows the text where personal data is replaced); the last stage ignores them. Texts
of any length are judged whole, and an empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairlens.llm import decontamination, jaccard_join, packing, pii, quality_llr
from pairlens.llm.postings import small_batches
from pairlens.session import new_state_path


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the whole row in one column, so that no column's name can clash with an operator's."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.struct(*docs.columns).alias("packed_row"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the quality score go."""
    judged = quality_llr.judged(_packed(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.where("_quality.kept").select("packed_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates the rows with the smallest doc_id stay: of rows with that id, one of each set of
    shingles. Rows that share an id but not their words are thus different documents, and repeated rows one."""
    small_batches(spark)
    rows = _packed(docs).withColumn("text_key", F.xxhash64("text"))
    groups = jaccard_join.near_duplicates(rows.select("doc_id", "text", "text_key"), row_key=F.col("text_key"))
    stays = (groups.where("doc_id = component_id").groupBy("doc_id", "f1", "f2").agg(F.min("row_key").alias("text_key"))
             .select("doc_id", "text_key").distinct())
    same = Window.partitionBy("doc_id", "text_key").orderBy(F.xxhash64("packed_row"))
    first = rows.join(stays, ["doc_id", "text_key"]).withColumn("nth_copy", F.row_number().over(same)).where("nth_copy = 1")
    return first.select("packed_row.*").unionByName(docs.where("doc_id IS NULL"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    small_batches(spark)
    return decontamination.leak_free(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; n_chars follows."""
    small_batches(spark)
    return pii.redacted(docs).withColumn("n_chars", F.char_length("text").cast("bigint")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 1024 ids, as pieces of documents with their ids."""
    small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("personal data", personal_data),
    ("packing", pack),
]

# Hashes, trained models and tokenizers are outside SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again by the next."""
    folder = new_state_path(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
