"""Sinks: parquet with CSV, training records, split outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.functions.columns import is_true
from pairlens.operators.leakage import may_hold, sieve

# Files a task holds open while it writes runs.
OPEN_RUNS = 16
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def write_with_csv(df: DataFrame, path: str) -> None:
    """Parquet at ``path`` and the same rows as CSV beside it; the CSV is made from the parquet."""
    df.write.mode("overwrite").parquet(path)
    flat = df.sparkSession.read.parquet(path)
    nested = [f.name for f in flat.schema.fields if f.dataType.typeName() in ("struct", "array", "map")]
    flat = flat.withColumns({c: F.to_json(c) for c in nested}) if nested else flat
    csv = path.removesuffix(".parquet") + ".csv"
    flat.write.mode("overwrite").csv(csv, header=True, quoteAll=True, escape='"')


def write_records(records: DataFrame, path: str) -> None:
    """Training records as gzipped JSON lines ``{"messages": [...]}``; text stays as it is, not escaped to ASCII."""
    records.select(F.to_json(F.struct("messages")).alias("value")).write.mode("overwrite").text(path, compression="gzip")


def count_records(records: DataFrame) -> DataFrame:
    """The distinct rows with their number ``n``. Hashes are shuffled, and texts of rows alone whose hash may come twice; a row of
    a hash of its own is unlike any other and stays where it is."""
    hashed = records.withColumn("_hash", F.xxhash64(*records.columns))
    twice = hashed.groupBy("_hash").agg(F.count("*").alias("n")).where("n > 1")
    held = may_hold(sieve(twice.select(F.col("_hash").alias("key"))), F.col("_hash"))
    alone = hashed.where(~held).select(*records.columns, F.lit(1).cast("bigint").alias("n"))
    return alone.unionByName(hashed.where(held).groupBy(*records.columns).agg(F.count("*").alias("n")))


def write_split(df: DataFrame, condition: Column, path: str, hit: str, rest: str) -> None:
    """One pass, two folders: ``status=<hit>`` where the condition holds, ``status=<rest>`` elsewhere."""
    status = F.when(is_true(condition), F.lit(hit)).otherwise(F.lit(rest))
    df.withColumn("status", status).write.mode("overwrite").partitionBy("status").parquet(path)


def write_runs(predictions: DataFrame, path: str) -> None:
    """Predictions in model=/condition= folders, packed by zstd, since every run repeats the texts.

    A task holds a file open for each of up to ``OPEN_RUNS`` runs, so its rows are not sorted by run (and spilled) first; rows of
    further runs are.
    """
    conf, before = predictions.sparkSession.conf, predictions.sparkSession.conf.get(_WRITERS, None)
    conf.set(_WRITERS, str(OPEN_RUNS))
    try:
        predictions.write.mode("overwrite").partitionBy("model", "condition").parquet(path, compression="zstd")
    finally:
        conf.unset(_WRITERS) if before is None else conf.set(_WRITERS, before)


def error_rows(rows: DataFrame) -> DataFrame:
    """Id, referent and reason of the rows whose generation did not work."""
    return rows.where(F.col("generation_status") != "ok").select(
        "row_id", "referent", F.col("generation_status").alias("error"))


def write_generated(rows: DataFrame, path: str) -> None:
    """All rows at ``path`` and the failed ones, as JSON lines, beside them; nothing is dropped."""
    rows.write.mode("overwrite").parquet(path)
    written = rows.sparkSession.read.parquet(path)
    error_rows(written).write.mode("overwrite").json(path.removesuffix(".parquet") + "_errors.json")
