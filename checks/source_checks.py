"""Sources and sinks as round trips through the shared folder: written, read back, and compared with what went in."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.check import Check
from checks.corpus_checks import with_corpus
from checks.exchange_checks import PROMPT, record_text, sql_closed_target, sql_records
from checks.prediction_checks import with_predictions
from checks.tables import PLAIN, corpus, predictions, table
from pairlens.operators import records as N
from pairlens.session import new_state_path
from pairlens.sources import readers, writers


def corpus_file(spark, sf_dir):
    """The corpus written as parquet and read with a declared schema."""
    path = new_state_path(spark, "corpus")
    corpus(spark, sf_dir).write.parquet(path)
    return readers.read_corpus(spark, path, readers.corpus_schema("row_id", "referent", "EN_source_sentence", "EN_feminine_sentence"))


def review_sheet(spark, sf_dir):
    """Whole texts, line breaks and quotes inside, through the CSV beside the parquet."""
    path = new_state_path(spark, "review") + ".parquet"
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_id"), F.concat(F.lit('"'), F.col("text"), F.lit('", "'), F.col("lang")).alias("EN_source_sentence"))
    writers.write_with_csv(docs, path)
    return readers.read_csv(spark, path.removesuffix(".parquet") + ".csv", readers.corpus_schema("row_id", "EN_source_sentence"))


def term_lists(spark, sf_dir):
    """One list per language, one line of text per term."""
    path = new_state_path(spark, "terms")
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("value"), "lang")
    lines.write.partitionBy("lang").text(path)
    terms = readers.read_term_lists(spark, f"{path}/*")
    return terms.groupBy("list_name", "term").agg(F.count("*").alias("n"))


def record_file(spark, sf_dir):
    """Training records as JSON lines; the row's id rides in no file, so whole records are counted."""
    path = new_state_path(spark, "records")
    writers.write_records(N.closed_records(corpus(spark, sf_dir), PROMPT), path)
    back = spark.read.schema("messages array<struct<role string, content string>>").json(path)
    rows = record_text(back.withColumns({"row_id": F.lit(0), "variant": F.lit("")}))
    return writers.count_records(rows.select("system", "question", "target"))


def split_rows(spark, sf_dir):
    path = new_state_path(spark, "split")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    writers.write_split(docs, F.char_length("text") < 500, path, "short", "long")
    return spark.read.parquet(path).select("doc_id", "source", "text", "status")


def run_table(spark, sf_dir):
    """Predictions of all plain runs in folders by model and condition, one run of them listed by path."""
    path = new_state_path(spark, "runs")
    writers.write_runs(predictions(spark, sf_dir, PLAIN), path)
    columns = ["model", "condition", "row_id", "variant", "predicted_label"]
    listed = readers.read_runs(spark, {("m1", "zero_shot"): f"{path}/model=m1/condition=zero_shot", ("m9", "none"): f"{path}/model=m9"})
    rest = readers.read_run_table(spark, path).where("NOT (model = 'm1' AND condition = 'zero_shot')")
    return listed.select(*columns).unionByName(rest.select(*columns))


def failed_rows(spark, sf_dir):
    """Rows whose generation did not work, as JSON lines beside the table."""
    path = new_state_path(spark, "generated") + ".parquet"
    rows = corpus(spark, sf_dir).select("row_id", "referent", F.when(F.col("h") % 7 == 0, "expired").otherwise("ok").alias("generation_status"))
    writers.write_generated(rows, path)
    return spark.read.schema("row_id bigint, referent string, error string").json(path.removesuffix(".parquet") + "_errors.json")


CHECKS = {
    "corpus_file": Check(corpus_file, with_corpus("SELECT row_id, referent, EN_source_sentence, EN_feminine_sentence FROM corpus")),
    "review_sheet": Check(review_sheet, "SELECT doc_id AS row_id, '\"' || text || '\", \"' || lang AS EN_source_sentence FROM documents"),
    "term_lists": Check(term_lists, """SELECT list_name, term, count(*) AS n FROM (
        SELECT coalesce(lang, '__HIVE_DEFAULT_PARTITION__') AS list_name, trim(unnest(string_split(text, chr(10)))) AS term FROM documents)
        WHERE term <> '' GROUP BY list_name, term"""),
    "record_file": Check(record_file, f"""SELECT system, question, target, count(*) AS n FROM (
        {sql_records(sql_closed_target("label"), False, False)}) GROUP BY ALL"""),
    "split_rows": Check(split_rows, "SELECT doc_id, source, text, CASE WHEN length(text) < 500 THEN 'short' ELSE 'long' END AS status FROM documents"),
    "run_table": Check(run_table, with_predictions("SELECT model, condition, row_id, variant, predicted_label FROM predictions", PLAIN)),
    "failed_rows": Check(failed_rows, with_corpus("SELECT row_id, referent, 'expired' AS error FROM corpus WHERE h % 7 = 0")),
}
