"""Uniform shuffle into shards of exact size through a hypergeometric communication matrix.

The rows are dealt to logical source partitions by a keyed hash of all their columns, so rows of one id part; rows that are
equal in everything stay together. How many rows of each
partition go to each shard is drawn exactly, partition by partition, from the multivariate
hypergeometric law: that is the count matrix of a uniformly random permutation cut into shards. Each
partition then permutes its rows by random keys, hands them out by its row of the matrix, and each shard
permutes what it got once more. Shard sizes differ by one row at most.

Only the matrix (at most ``MAX_PARTITIONS`` x shards numbers) passes the driver. Inside a shard, rows are
numbered in buckets of a random key, so no task ever holds a whole shard.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_PARTITION = 20_000
MAX_PARTITIONS = 4_096  # beyond, partitions grow; their sorts spill
NUMPY_TOTAL = 1_000_000_000
DEVIATIONS = 13


def shard_sizes(total: int, shards: int) -> np.ndarray:
    """Exact sizes: the first ``total % shards`` shards take one row more."""
    return total // shards + (np.arange(shards) < total % shards).astype(np.int64)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many of ``sample`` rows drawn without replacement are among ``good`` ones, for totals of any size.

    Numpy's sampler takes totals below ``NUMPY_TOTAL``. Beyond, the law is inverted around its mode: probabilities follow
    from their exact ratios within ``DEVIATIONS`` standard deviations, which leaves out less than 10^-30.
    """
    total = good + bad
    if total < NUMPY_TOTAL:
        return int(rng.hypergeometric(good, bad, sample))
    low, high = max(0, sample - bad), min(sample, good)
    share = good / total
    spread = (sample * share * (1 - share) * (total - sample) / max(1, total - 1)) ** 0.5
    mode = min(max(int((sample + 1) * (good + 1) / (total + 2)), low), high)
    reach = int(DEVIATIONS * spread) + 50
    x = np.arange(max(low, mode - reach), min(high, mode + reach) + 1, dtype=np.int64)
    y = x[:-1].astype(np.float64)
    ratio = np.log(good - y) + np.log(sample - y) - np.log(y + 1) - np.log(np.float64(bad - sample) + y + 1)
    logs = np.concatenate([[0.0], np.cumsum(ratio)])
    weight = np.cumsum(np.exp(logs - logs.max()))
    return int(x[np.searchsorted(weight, rng.random() * weight[-1], side="right")])


def communication_matrix(counts: list[int], sizes: np.ndarray, seed: int) -> np.ndarray:
    """Row p says how many rows of partition p each shard gets; rows sum to ``counts``, columns to ``sizes``."""
    rng = np.random.default_rng(seed)
    left = np.array(sizes, dtype=np.int64)
    drawn = np.zeros((len(counts), len(left)), dtype=np.int64)
    for p, count in enumerate(counts):
        if left.sum() < NUMPY_TOTAL:
            drawn[p] = rng.multivariate_hypergeometric(left, count, method="marginals")
        else:
            rest, need = int(left.sum()), count
            for shard, size in enumerate(left.tolist()):
                rest -= size
                drawn[p, shard] = hypergeometric(rng, size, rest, need) if need and size else 0
                need -= int(drawn[p, shard])
        left -= drawn[p]
    return drawn


def shuffle_into_shards(df: DataFrame, id_col: str, shards: int = 16, seed: int = 7,
                        rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """All rows and columns of ``df`` plus ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard).

    Null ids count as one id; rows of the same id are told apart by a hash of all their columns, and rows
    equal in everything are interchangeable. An empty table gives an empty result. Columns of ``df`` named
    ``shard`` or ``slot`` are replaced; internal columns start with ``_hs_``.
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    key = F.col(f"`{id_col}`")
    whole = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in df.columns])
    total = df.count()
    parts = int(min(MAX_PARTITIONS, max(1, -(-total // rows_per_partition))))
    buckets = int(max(1, -(-total // (shards * rows_per_partition))))

    def random(n: int):
        return F.xxhash64(F.lit(seed * 3 + n), key, F.col("_hs_tie"))

    placed = df.withColumn("_hs_tie", whole).withColumn(
        "_hs_part", F.pmod(F.xxhash64(F.lit(seed * 3), key, F.col("_hs_tie")), F.lit(parts)).cast("int"))
    counted = {r["_hs_part"]: r["count"] for r in placed.groupBy("_hs_part").count().collect()}
    counts = [counted.get(p, 0) for p in range(parts)]
    ends = np.cumsum(communication_matrix(counts, shard_sizes(total, shards), seed), axis=1)
    matrix = spark.createDataFrame(
        [(p, [int(x) for x in row]) for p, row in enumerate(ends)], "_hs_part int, _hs_ends array<bigint>")

    local = Window.partitionBy("_hs_part").orderBy(random(1), key, "_hs_tie")
    dealt = (placed.withColumn("_hs_rank", F.row_number().over(local))
             .join(F.broadcast(matrix), "_hs_part")
             .withColumn("shard", F.size(F.filter("_hs_ends", lambda e: e < F.col("_hs_rank"))))
             .withColumn("_hs_bucket", F.pmod(F.shiftright(random(2), 20), F.lit(buckets)).cast("int"))
             .drop("_hs_part", "_hs_ends", "_hs_rank"))
    before = (dealt.groupBy("shard", "_hs_bucket").count()
              .withColumn("_hs_before", F.sum("count").over(
                  Window.partitionBy("shard").orderBy("_hs_bucket").rowsBetween(Window.unboundedPreceding, 0))
                  - F.col("count")).drop("count"))
    again = Window.partitionBy("shard", "_hs_bucket").orderBy(random(3), key, "_hs_tie")
    return (dealt.withColumn("_hs_rank", F.row_number().over(again))
            .join(before, ["shard", "_hs_bucket"])
            .withColumn("slot", F.col("_hs_before") + F.col("_hs_rank") - 1)
            .select(*[F.col(f"`{c}`") for c in df.columns], "shard", "slot"))


def document_shards(docs: DataFrame, shards: int = 16, seed: int = 7) -> DataFrame:
    """Shuffle the documents themselves, then tell of each: doc_id, size (UTF-8 bytes plus 1; a null text has 1), text_crc32 (of a null text: 0), law ``rows``,
    shard, slot and grown_shard (null: this law moves rows when a shard is added)."""
    return shuffle_into_shards(docs, "doc_id", shards, seed).select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("bigint").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
