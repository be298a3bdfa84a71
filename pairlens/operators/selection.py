"""Row selection: samples, limits, blank and state filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlens.fixed_values import MAX_RETRIES, OK_RATINGS, VARIANTS
from pairlens.functions.columns import is_true
from pairlens.functions.hashing import key_hash
from pairlens.functions.text import is_blank

def exact_sample(df: DataFrame, n: int, seed: int, key: str = "row_id") -> DataFrame:
    """Exactly ``min(n, rows)`` rows, chosen by a seeded hash of the key.

    The choice depends on keys and seed only, not on partitions or order. ``key`` must be unique; rows with a null key are never
    drawn. A histogram of the draws finds the bucket with the n-th key, whose keys alone are ranked; the rows then pass one
    filter, and none is shuffled or joined. The two small lookups run while the plan is built.
    """
    draw = key_hash(F.lit(seed), F.col(key))
    bucket, df = F.shiftright(draw, 12), df.where(F.col(key).isNotNull())
    if n <= 0:
        return df.limit(0)
    # At most 2^20 buckets; their running total needs no more than one small task.
    total = Window.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    border = (df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).withColumn("through", F.sum("n").over(total))
              .where(F.col("through") >= n).orderBy("bucket").first())
    if border is None:
        return df
    inside = df.where(bucket == border["bucket"]).select(draw.alias("draw"), F.col(key).alias("key"))
    last = (inside.orderBy("draw", "key").limit(n - border["through"] + border["n"])
            .agg(F.max(F.struct("draw", "key")).alias("last")).first()["last"])
    return df.where((draw < last["draw"]) | ((draw == last["draw"]) & (F.col(key) <= last["key"])))


def variant_rank(variant: Column) -> Column:
    """1, 2, 3 for source, masculine, feminine."""
    return F.array_position(F.array(*[F.lit(v) for v in VARIANTS]), variant)


def first_examples(long: DataFrame, n: int) -> DataFrame:
    """First ``n`` long-form examples in row and variant order."""
    return long.orderBy("row_id", variant_rank(F.col("variant"))).limit(n)


def drop_blank(df: DataFrame, *columns: str) -> DataFrame:
    """Keep rows where none of the columns is null or blank."""
    for c in columns:
        df = df.where(~is_blank(F.col(c)))
    return df


def is_undecided() -> Column:
    """Neither accepted nor rejected; null flags count as undecided."""
    return ~is_true(F.col("accepted")) & ~is_true(F.col("eval_reject"))


def undecided(corpus: DataFrame) -> DataFrame:
    return corpus.where(is_undecided())


def _failed() -> Column:
    return is_true(~F.col("accepted"))


def _below_cap(max_retries: int) -> Column:
    return F.coalesce(F.col("retry_count"), F.lit(0)) < max_retries


def is_retryable(max_retries: int = MAX_RETRIES) -> Column:
    """Failed, not rejected, below the retry cap. A null ``accepted`` is not a failure."""
    return _failed() & ~is_true(F.col("eval_reject")) & _below_cap(max_retries)


def retryable(corpus: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    return corpus.where(is_retryable(max_retries))


def retry_census(corpus: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Counts of rows, failures and their split; a failure can be both rejected and at the cap."""
    return corpus.agg(
        F.count("*").alias("rows"),
        F.count_if(_failed()).alias("failures"),
        F.count_if(_failed() & is_true(F.col("eval_reject"))).alias("rejected"),
        F.count_if(_failed() & ~_below_cap(max_retries)).alias("at_cap"),
        F.count_if(is_retryable(max_retries)).alias("retryable"))


def reviewed_ok(rated: DataFrame, rating: str = "rating") -> DataFrame:
    """Rows that the reviewer rated good or meh."""
    return rated.where(F.col(rating).isin(*OK_RATINGS))
