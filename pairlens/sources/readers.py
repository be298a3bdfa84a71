"""Sources: corpora, review sheets, word lists and run tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.functions.text import strip

# Column types of a corpus file.
CORPUS_TYPES = {
    **{c: "string" for c in (
        "referent", "EN_source_sentence", "masc_referent", "EN_masculine_sentence", "fem_referent",
        "EN_feminine_sentence", "disambiguation_strategy", "recommended_strategy", "eval_strategy_label",
        "eval_issues", "eval_suggestion", "symbolic_check_failures", "eval_human", "eval_human_explained")},
    **{f"eval_{k}": "double" for k in (
        "referent_disambiguated", "correctness", "naturalness", "no_extra_sentence", "consistency")},
    **{c: "boolean" for c in ("eval_pos_change", "eval_reject", "accepted", "symbolic_checks_passed")},
    "row_id": "bigint", "retry_count": "int"}

_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
          "bigint": T.LongType(), "int": T.IntegerType()}


def corpus_schema(*columns: str) -> T.StructType:
    """Schema of the named corpus columns."""
    return T.StructType([T.StructField(c, _TYPES[CORPUS_TYPES[c]]) for c in columns])


def read_corpus(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Corpus from parquet; with a schema no footer is read to infer one."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with header and quoted line breaks, such as a review sheet."""
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"')


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their place: file, path, 1-based number and text. Files are read whole, one row each,
    which suits word lists."""
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("path"), "value")
    return files.select("file", "path", F.posexplode(F.split("value", "\r?\n")).alias("pos", "line")).select(
        "file", "path", (F.col("pos") + 1).cast("bigint").alias("line_no"), "line")


def list_name(file: Column, path: Column) -> Column:
    """The file's name without its ending; of a part file, as Spark writes them, the name of its folder (of ``key=value`` the value)."""
    folder = F.url_decode(F.regexp_extract(path, r"([^/=]*)/[^/]*$", 1))
    return F.when(F.startswith(file, F.lit("part-")), folder).otherwise(F.regexp_replace(file, r"\.[^.]*$", ""))


def read_term_lists(spark: SparkSession, path: str) -> DataFrame:
    """Term lists, one term per line: term, list_name (see ``list_name``)."""
    lines = read_text_lines(spark, path)
    return lines.select(strip(F.col("line")).alias("term"), list_name(F.col("file"), F.col("path")).alias("list_name")).where(
        F.col("term") != "")


def _forms(cell: Column, separators: str) -> Column:
    return F.transform(F.split(cell, separators), lambda f: F.lower(strip(f)))


def pair_lexicon(lines: DataFrame) -> DataFrame:
    """Lexicon rows form, masc, fem out of the rows of a markdown table: line_no, line.

    Every masculine, neutral and feminine form leads to the row's first masculine and feminine
    form. A form that several rows have belongs to the first row; within a row masculine and
    neutral forms come before feminine ones. The choice is a ``min`` aggregate per form, so a form
    that is on very many lines is reduced before it is moved.
    """
    line = strip(F.col("line"))
    table = lines.where(F.startswith(line, F.lit("|")) & ~F.contains(line, F.lit("Masculine")) & ~F.contains(line, F.lit("---")))
    inner = F.btrim(line, F.lit("|"))
    cells = table.select("line_no", F.transform(F.split(inner, r"\|"), strip).alias("c")).where(F.size("c") >= 2)
    cells = cells.select("line_no", F.col("c")[0].alias("masc"), F.col("c")[1].alias("fem"),
                         F.coalesce(F.try_element_at("c", F.lit(3)), F.lit("")).alias("neutral"))
    usable = cells.where(~F.col("masc").isin("-", "") & ~F.col("fem").isin("-", ""))
    none = F.array().cast("array<string>")
    masc, fem = _forms(F.col("masc"), "/"), _forms(F.col("fem"), "/")
    neutral = F.when(F.col("neutral").isin("-", ""), none).otherwise(_forms(F.col("neutral"), "[,/]"))
    forms = usable.select("line_no", masc[0].alias("m"), fem[0].alias("f"),
                          F.posexplode(F.concat(masc, neutral, fem)).alias("pos", "form")).where(F.col("form") != "")
    first = F.min(F.struct("line_no", "pos", "m", "f")).alias("first")
    return forms.groupBy("form").agg(first).select("form", F.col("first.m").alias("masc"), F.col("first.f").alias("fem"))


def read_pair_lexicon(spark: SparkSession, path: str) -> DataFrame:
    return pair_lexicon(read_text_lines(spark, path).where(F.startswith(strip(F.col("line")), F.lit("|"))))


def read_runs(spark: SparkSession, paths: dict[tuple[str, str], str]) -> DataFrame:
    """Prediction files of many runs as one table, keyed by model and condition.

    Missing files are skipped; columns that only some runs have are null elsewhere.
    """
    runs = None
    for (model, condition), path in paths.items():
        try:
            run = spark.read.parquet(path)
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                continue
            raise
        run = run.withColumns({"model": F.lit(model), "condition": F.lit(condition)})
        runs = run if runs is None else runs.unionByName(run, allowMissingColumns=True)
    if runs is None:
        raise FileNotFoundError(f"no run found among {sorted(paths.values())}")
    return runs


def read_run_table(spark: SparkSession, path: str) -> DataFrame:
    """Prediction table laid out as model=/condition= folders; filters on them prune folders."""
    return spark.read.parquet(path)
