"""Registered queries of the operators and, where SQL can say it, their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pairlens.llm import collocations, debruijn, decontamination, jaccard_join, licenses, packing, periodic_runs, pii, quality_llr, rans, sharding, token_rollup, toxicity
from pairlens.llm.postings import small_batches
from pairlens.session import new_state_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_spans(_table(spark, sf_dir, "documents"))


def op2_rare_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_table(spark, sf_dir, "documents")).drop("places")


def op3_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False).drop("ids")


def op4_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.without_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op5_rans_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.document_token_digest(
        _table(spark, sf_dir, "documents"), new_state_path(spark, "tokens"),
        public_tokenizers.path("word_bpe_49k.json"), byte_level=False, end_id=1)


def op6_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rollup.document_rollup(_table(spark, sf_dir, "documents"), new_state_path(spark, "rollup"))


def op8_vertical_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.document_shards(_table(spark, sf_dir, "documents"))


def op10_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_llr.quality_verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.planted(_table(spark, sf_dir, "documents"))
    return periodic_runs.run_digests(periodic_runs.collapse_runs(docs))


def op13_hat_trie_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_weak_supervision, op2_rare_token_index, op3_window_packing, op4_debruijn, op5_rans_files, op6_spaced_seeds, op7_token_rollup,
    op8_vertical_jaccard, op9_hypergeometric_shards, op10_quality_llr,
    op11_string_kernel_toxicity, op12_periodic_runs, op13_hat_trie_collocations)}
SQL = {"op7_token_rollup": token_rollup.ROLLUP_SQL, "op13_hat_trie_collocations": collocations.COLLOCATIONS_SQL}
