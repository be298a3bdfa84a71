"""Token counts by source, language and tokenizer version, kept up to date by signed deltas.

A ledger holds signed rows: +1 for a count that holds from a batch on, -1 for the one it replaces. A batch
of events (insert, revise, delete) is netted against the ledger, appended as its own batch folder, and
reduced to additive deltas per (source, lang, tokenizer); totals are sums of deltas, so no batch reads
documents again. A batch is written to the folder of its id and committed by a marker table written last:
a batch that failed half-way is overwritten by its retry, and a committed batch that is sent again changes
nothing.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer")
LEDGER = "doc_id bigint, tokenizer string, source string, lang string, n_tokens bigint, sign int, batch string"
DELTAS = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint, batch string"


class TokenRollup:
    """State under ``path``, a folder that all executors share. One writer at a time.

    Null source, language and tokenizer are values of their own (and sum up as such). Events without a
    doc_id are ignored. Of several events for one document and tokenizer in a batch, the one with the
    largest ``seq`` holds; among equal ``seq`` delete, then the larger count. An insert of a known document
    is a revision, a revision of an unknown one an insert, and a delete of an unknown one does nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _committed(self) -> list[str]:
        try:
            return [r["batch"] for r in self.spark.read.schema("batch string").parquet(f"{self.path}/commits/*").collect()]
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return []
            raise

    def _read(self, table: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{table}/{b}" for b in sorted(self._committed())]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def current(self) -> DataFrame:
        """The counts that hold now: doc_id, tokenizer, source, lang, n_tokens."""
        columns = ["doc_id", "tokenizer", "source", "lang", "n_tokens"]
        return (self._read("ledger", LEDGER).groupBy(*columns).agg(F.sum("sign").alias("_sign"))
                .where("_sign > 0").select(*columns))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens from the deltas alone; groups without documents are left out."""
        return (self._read("deltas", DELTAS).groupBy(*KEYS)
                .agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs > 0"))

    def commit(self, batch: str, events: DataFrame) -> bool:
        """Apply a batch of (doc_id, op, tokenizer, source, lang, n_tokens, seq); False if it was applied before.

        op is ``insert``, ``revise`` or ``delete``; other columns of ``events`` are ignored.
        """
        if batch in self._committed():
            return False
        latest = Window.partitionBy("doc_id", "tokenizer").orderBy(
            F.desc("seq"), F.asc("op"), F.desc("n_tokens"), "source", "lang")
        events = (events.where(F.col("doc_id").isNotNull())
                  .select("doc_id", "tokenizer", "op", "source", "lang", "n_tokens", "seq")
                  .withColumn("_rank", F.row_number().over(latest)).where("_rank = 1"))
        touched = events.select("doc_id", "tokenizer")
        same = (F.col("e.doc_id") == F.col("o.doc_id")) & F.col("e.tokenizer").eqNullSafe(F.col("o.tokenizer"))
        # only the ledger rows of touched documents are netted; the join's partitioning by doc_id serves the sum as well
        rows = self._read("ledger", LEDGER).alias("o").join(touched.alias("e"), same, "left_semi")
        retired = (rows.groupBy("doc_id", "tokenizer", "source", "lang", "n_tokens").agg(F.sum("sign").alias("_sign"))
                   .where("_sign > 0").drop("_sign").withColumn("sign", F.lit(-1)))
        added = (events.where("op in ('insert', 'revise')")
                 .select("doc_id", "tokenizer", "source", "lang",
                         F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"), F.lit(1).alias("sign")))
        signed = added.unionByName(retired).withColumn("batch", F.lit(batch))
        signed.write.mode("overwrite").parquet(f"{self.path}/ledger/{batch}")
        (self.spark.read.schema(LEDGER).parquet(f"{self.path}/ledger/{batch}").groupBy(*KEYS)
         .agg(F.sum("sign").cast("bigint").alias("n_docs"),
              F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens"))
         .withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{self.path}/deltas/{batch}"))
        (self.spark.createDataFrame([(batch,)], "batch string").coalesce(1)
         .write.mode("overwrite").parquet(f"{self.path}/commits/{batch}"))
        return True


WORDS = r"[^\x20\x09-\x0D]+"
PIECES = r"[A-Za-z]+|[0-9]|[^\x00-\x7F]+"


def document_batches(docs: DataFrame, short: int = 200) -> dict[str, DataFrame]:
    """Four batches of events of a growing corpus, over every document.

    ``arrive``: all documents, counted exactly by tokenizer ``words-1`` and by a quarter of their characters
    for ``pieces-1``. ``recount``: exact piece counts for all. ``retire``: documents under ``short``
    characters go. ``return``: they come back, with exact counts, so that the totals cover every document.
    A null text has no tokens and no characters. Rows that share a doc_id count as one document, see ``TokenRollup``.
    """
    text, keys = F.coalesce("text", F.lit("")), ["doc_id", "source", "lang"]

    def events(op: str, tokenizer: str, count, rows: DataFrame = docs) -> DataFrame:
        return rows.select(*keys, F.lit(op).alias("op"), F.lit(tokenizer).alias("tokenizer"),
                           count.cast("bigint").alias("n_tokens"), F.lit(1).alias("seq"))

    gone = docs.where(F.char_length(text) < short)
    return {
        "arrive": events("insert", "words-1", F.regexp_count(text, F.lit(WORDS))).unionByName(
            events("insert", "pieces-1", F.floor(F.char_length(text) / 4))),
        "recount": events("revise", "pieces-1", F.regexp_count(text, F.lit(PIECES))),
        "retire": events("delete", "words-1", F.lit(0), gone).unionByName(
            events("delete", "pieces-1", F.lit(0), gone)),
        "return": events("insert", "words-1", F.regexp_count(text, F.lit(WORDS)), gone).unionByName(
            events("insert", "pieces-1", F.regexp_count(text, F.lit(PIECES)), gone)),
    }


def document_rollup(docs: DataFrame, path: str) -> DataFrame:
    """Totals of every document after the four batches, two of them sent twice."""
    rollup = TokenRollup(docs.sparkSession, path)
    batches = document_batches(docs)
    for name in ("arrive", "recount", "arrive", "retire", "recount", "return"):
        rollup.commit(name, batches[name])
    return rollup.totals()


ROLLUP_SQL = """
WITH kept AS (SELECT * FROM documents WHERE doc_id IS NOT NULL)
SELECT source, lang, 'words-1' AS tokenizer, CAST(count(*) AS BIGINT) AS n_docs,
  CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))) AS BIGINT) AS n_tokens
FROM kept GROUP BY source, lang
UNION ALL
SELECT source, lang, 'pieces-1', CAST(count(*) AS BIGINT),
  CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[0-9]|[^\\x00-\\x7F]+'))) AS BIGINT)
FROM kept GROUP BY source, lang
"""
