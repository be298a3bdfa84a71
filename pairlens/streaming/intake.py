"""Replies as they land: label them, keep the last one of each id as keyed state, and append all of them to a table if asked to."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pairlens.operators.responses import closed_answers, latest, open_answers, with_correct

RESPONSE_SCHEMA = "custom_id string, status string, text string, arrival timestamp"
# State on local disk with a bounded memory share, of which a commit writes the changes.
_STORE = "spark.sql.streaming.stateStore"
DISK_STATE = {f"{_STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
              f"{_STORE}.rocksdb.changelogCheckpointing.enabled": "true", f"{_STORE}.rocksdb.boundedMemoryUsage": "true"}


def read_responses(spark: SparkSession, folder: str, fmt: str = "json", files_per_trigger: int | None = None) -> DataFrame:
    """Stream of response files."""
    reader = spark.readStream.schema(RESPONSE_SCHEMA).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)


def labelled(stream: DataFrame, examples: DataFrame, open_task: bool) -> DataFrame:
    """Join the static examples by ``custom_id`` and read the label off each reply.

    The examples are read again in every micro-batch: give a stored table, and few large micro-batches. Every reply stays, late and repeated ones too; ``known`` is false where no example has the id.
    """
    rows = stream.join(examples.withColumn("known", F.lit(True)), "custom_id", "left").withColumn(
        "known", F.coalesce("known", F.lit(False)))
    answered = open_answers(rows) if open_task else closed_answers(rows)
    return with_correct(answered)


@contextmanager
def _disk_state(spark: SparkSession):
    """A query that starts inside keeps its state by ``DISK_STATE``; one that goes on from a checkpoint keeps that one's store."""
    before = {k: spark.conf.get(k, None) for k in DISK_STATE}
    try:
        for k, v in DISK_STATE.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def keep_last(stream: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Keep the last labelled reply by ``arrival`` of each id as the query's state, in ``checkpoint``, a folder that all
    executors share.

    A micro-batch touches the ids it brings and no others. A query that starts again on the same checkpoint goes on
    behind its last finished micro-batch; one that broke off is done again from the same state, so no reply counts
    twice and none gets lost. With ``once`` it takes everything that is there, in as many micro-batches as the reader's limit
    makes, then stops. State follows the number of ids and lies on disk (``DISK_STATE``).
    """
    rest = [c for c in stream.columns if c != "custom_id"]
    ranked = F.struct("arrival", *[c for c in rest if c != "arrival"])
    last = stream.where(F.col("custom_id").isNotNull()).groupBy("custom_id").agg(F.max(ranked).alias("last"))
    writer = last.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint)
    with _disk_state(stream.sparkSession):
        return (writer.trigger(availableNow=True) if once else writer).start()


def last_replies(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What ``keep_last`` has kept: one row per id, read from its state. Nothing is grouped or shuffled."""
    state = spark.read.format("statestore").load(checkpoint)
    return state.select("key.custom_id", "value.max.*")


def settled(appended: DataFrame, batch: DataFrame | None = None) -> DataFrame:
    """The last reply by ``arrival`` of each known id, of the appended table and a batch of the same columns."""
    rows = appended if batch is None else appended.unionByName(batch)
    return latest(rows.where("known"))


def unknown(appended: DataFrame) -> DataFrame:
    """Replies to ids that no example has."""
    return appended.where("NOT known")


def write_counts(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep a table of ``status_counts`` up to date until everything that is there is counted. The whole small table is
    written anew after every micro-batch, so a repeated batch changes nothing."""
    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return (counts.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def status_counts(stream: DataFrame, delay: str | None = None, window: str = "10 minutes") -> DataFrame:
    """Responses per state and arrival window. All windows stay open (one row per window and state) unless ``delay`` lets
    those behind the watermark go, with the replies that come for them later."""
    stream = stream if delay is None else stream.withWatermark("arrival", delay)
    return (stream.groupBy(F.window("arrival", window).alias("window"), "status")
            .agg(F.count("*").alias("n")))


def append(stream: DataFrame, folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append to a parquet table; with ``once`` everything that is there now, then stop."""
    writer = (stream.writeStream.format("parquet").outputMode("append")
              .option("path", folder).option("checkpointLocation", checkpoint))
    return (writer.trigger(availableNow=True) if once else writer).start()
