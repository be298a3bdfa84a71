"""Tables that Spark derives from the given ones, and the same derivations as SQL.

Every line of every document is one corpus row; keyed hashes decide which rewrite, score or
prediction a row gets, so both engines derive the same rows at any scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.fixed_values import RUBRIC_COLUMNS, STRATEGY_NAMES
from pairlens.functions.hashing import key_hash
from pairlens.operators.reshape import to_long

STRATEGIES = tuple(STRATEGY_NAMES)
RUBRIC_LABELS = STRATEGIES + ("combination", "no_change")

# (model, condition, thinking); open conditions end in _identify.
RUNS = (
    ("m1", "zero_shot", False), ("m1", "zero_shot_identify", False),
    ("m1", "zero_shot", True), ("m1", "zero_shot_identify", True),
    ("m1", "few_shot_full", False),
    ("m2", "zero_shot", False), ("m2", "zero_shot_identify", False),
    ("m2", "zero_shot", True), ("m2", "zero_shot_identify", True),
)
# Few-shot runs of both tasks and models, beside the ones above.
FEW_SHOT = tuple((m, c, False) for m in ("m1", "m2") for c in ("few_shot", "few_shot_identify"))
# The conditions of one model, and the runs without thinking.
M1 = tuple(r for r in RUNS if r[0] == "m1" and not r[2])
PLAIN = tuple(r for r in RUNS if not r[2])
ZERO_SHOT = tuple(r for r in RUNS if r[1] != "few_shot_full")
PLAIN_ZERO_SHOT = tuple(r for r in PLAIN if r[1] != "few_shot_full")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Rows of a given table in one task: each becomes many, so what a task holds follows this and not the input.
TASK_ROWS = 2000


def dealt(df: DataFrame, key: str) -> DataFrame:
    """The fixture's tables are single files; their rows are dealt to the tasks by a hash of the key. The number of tasks is given,
    as it grows with the rows and tasks must not be merged by the size of what they get."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, df.count() // TASK_ROWS + 1), F.col(key))


def _pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _sql_pick(values, index: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][{index} + 1]"


# ---------------------------------------------------------------- corpus

def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    lines = (docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
             .select("doc_id", (F.col("doc_id") * 4294967296 + F.col("pos")).alias("row_id"),
                     F.trim("raw").alias("line"))
             .where(F.col("line") != ""))
    h, line, ref, src, kind = (F.col(c) for c in ("h", "line", "referent", "EN_source_sentence", "kind"))
    rows = (lines.withColumn("h", key_hash(F.col("row_id")))
            .withColumn("referent", F.lower(F.coalesce(
                F.nullif(F.regexp_extract("line", r"\p{L}{3,}", 0), F.lit("")), F.lit("item"))))
            .withColumn("kind", F.when(h % 41 == 0, "vocative").when(h % 43 == 0, "closing")
                        .when(h % 47 == 0, "speaker").when(h % 59 == 0, "contraction").otherwise("plain"))
            .withColumn("EN_source_sentence",
                        F.when(kind == "vocative", F.concat(F.lit("Yes, "), ref, F.lit(", "), line))
                        .when(kind == "closing", F.concat(line, F.lit(", "), ref, F.lit(".")))
                        .when(kind == "speaker", F.concat(F.lit("I'm a "), ref, F.lit(" "), line))
                        .when(kind == "contraction", F.concat(F.lit("I' m sure "), line))
                        .otherwise(line)))
    at = F.position(ref, F.lower(src))
    masc = (F.when(h % 53 == 0, src)
            .when(kind == "contraction", F.concat(F.lit("I'm sure "), line))
            .when(h % 29 == 0, F.concat(src, F.lit(" and then he went on to say a lot more words")))
            .when(h % 19 == 0, F.concat(src, F.lit(" He left.")))
            .when(h % 13 == 0, F.concat(ref, F.lit(" man "), src))
            .when(h % 17 == 0, F.concat(F.substr(src, F.lit(1), at - 1), F.lit("someone"),
                                        F.substr(src, at + F.char_length(ref))))
            .otherwise(F.concat(src, F.lit(", sir"))))
    rows = rows.withColumn("EN_masculine_sentence", masc)
    fem = (F.when(h % 11 == 0, F.lit(None).cast("string"))
           .when(h % 53 == 0, src)
           .when(h % 23 == 0, F.col("EN_masculine_sentence"))
           .when(kind == "contraction", F.concat(F.lit("I'm so sure "), line))
           .when(h % 29 == 0, F.concat(src, F.lit(" and then she left us")))
           .otherwise(F.concat(src, F.lit(", ma'am"))))
    rows = rows.withColumn("EN_feminine_sentence", fem)
    # One-element explode: filters above it read the finished texts instead of repeating the rules.
    texts = F.struct("h", "referent", "EN_source_sentence", "EN_masculine_sentence", "EN_feminine_sentence")
    rows = rows.select("row_id", "doc_id", F.explode(F.array(texts)).alias("t")).select("row_id", "doc_id", "t.*")

    def score(k: int) -> Column:
        m = key_hash(F.col("row_id"), f"c{k}")
        return (F.when(m % 17 == 0, F.lit(None).cast("int"))
                .when(m % 10 == 0, (F.floor(m / 10) % 5 + 1).cast("int")).otherwise((m % 2 + 4).cast("int")))

    return rows.select(
        "row_id", "doc_id", "h", "referent", "EN_source_sentence", "EN_masculine_sentence", "EN_feminine_sentence",
        F.when(h % 7 != 0, ref).alias("masc_referent"),
        F.when(h % 10 != 3, ref).alias("fem_referent"),
        F.when(h % 61 != 0, _pick(STRATEGIES, h % 9)).alias("disambiguation_strategy"),
        F.when(h % 67 != 0, _pick(RUBRIC_LABELS, F.floor(h / 9) % 11)).alias("eval_strategy_label"),
        *[score(k).alias(c) for k, c in enumerate(RUBRIC_COLUMNS, 1)],
        (h % 31 == 0).alias("eval_reject"), (h % 37 == 0).alias("eval_pos_change"),
        F.when(h % 4 == 0, "minor wording").otherwise("").alias("eval_issues"),
        F.when(h % 3 == 0, "use a title").otherwise("").alias("eval_suggestion"),
        F.when(h % 5 == 0, F.lit(None).cast("boolean")).otherwise(h % 5 > 2).alias("accepted"),
        F.when(h % 71 != 0, (h % 7).cast("int")).alias("retry_count"),
        F.when(h % 6 == 0, "variants_edited: both variants identical to the source").otherwise("")
        .alias("symbolic_check_failures"),
        F.when(h % 14 != 0, (h % 5 + 1).cast("int")).alias("grammaticality_score"),
        F.when(h % 73 == 0, F.lit(None).cast("string")).when(h % 79 == 0, "  ").when(h % 83 == 0, "Unsure")
        .otherwise(_pick(("good", " Good", "meh", "BAD"), F.floor(h / 3) % 4)).alias("eval_human"),
        F.when(h % 3 == 0, "A Great pair").when(h % 3 == 1, "greater detail").alias("eval_human_explained"))


_SQL_SCORES = ",\n  ".join(
    f"""CASE WHEN {m} % 17 = 0 THEN NULL WHEN {m} % 10 = 0 THEN (({m} // 10) % 5 + 1)::INT
       ELSE ({m} % 2 + 4)::INT END AS {c}"""
    for k, c in enumerate(RUBRIC_COLUMNS, 1)
    for m in [f"('0x' || substr(md5(row_id || '|c{k}'), 1, 8))::BIGINT"])

SQL_CORPUS = f"""
raw_lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw,
                     generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
lines AS (SELECT doc_id, doc_id * 4294967296 + pos AS row_id, trim(raw) AS line FROM raw_lines WHERE trim(raw) <> ''),
hashed AS (SELECT *, ('0x' || substr(md5(row_id::VARCHAR), 1, 8))::BIGINT AS h,
           lower(coalesce(nullif(regexp_extract(line, '\\p{{L}}{{3,}}'), ''), 'item')) AS referent FROM lines),
kinds AS (SELECT *, CASE WHEN h % 41 = 0 THEN 'vocative' WHEN h % 43 = 0 THEN 'closing' WHEN h % 47 = 0 THEN 'speaker'
          WHEN h % 59 = 0 THEN 'contraction' ELSE 'plain' END AS kind FROM hashed),
sources AS (SELECT *, CASE kind WHEN 'vocative' THEN 'Yes, ' || referent || ', ' || line
            WHEN 'closing' THEN line || ', ' || referent || '.' WHEN 'speaker' THEN 'I''m a ' || referent || ' ' || line
            WHEN 'contraction' THEN 'I'' m sure ' || line ELSE line END AS src FROM kinds),
mascs AS (SELECT *, CASE WHEN h % 53 = 0 THEN src WHEN kind = 'contraction' THEN 'I''m sure ' || line
          WHEN h % 29 = 0 THEN src || ' and then he went on to say a lot more words'
          WHEN h % 19 = 0 THEN src || ' He left.' WHEN h % 13 = 0 THEN referent || ' man ' || src
          WHEN h % 17 = 0 THEN substr(src, 1, position(referent IN lower(src)) - 1) || 'someone'
               || substr(src, position(referent IN lower(src)) + length(referent))
          ELSE src || ', sir' END AS masc FROM sources),
corpus AS (SELECT row_id, doc_id, h, referent, src AS EN_source_sentence, masc AS EN_masculine_sentence,
  CASE WHEN h % 11 = 0 THEN NULL WHEN h % 53 = 0 THEN src WHEN h % 23 = 0 THEN masc
       WHEN kind = 'contraction' THEN 'I''m so sure ' || line WHEN h % 29 = 0 THEN src || ' and then she left us'
       ELSE src || ', ma''am' END AS EN_feminine_sentence,
  CASE WHEN h % 7 <> 0 THEN referent END AS masc_referent, CASE WHEN h % 10 <> 3 THEN referent END AS fem_referent,
  CASE WHEN h % 61 <> 0 THEN {_sql_pick(STRATEGIES, 'h % 9')} END AS disambiguation_strategy,
  CASE WHEN h % 67 <> 0 THEN {_sql_pick(RUBRIC_LABELS, '(h // 9) % 11')} END AS eval_strategy_label,
  {_SQL_SCORES},
  h % 31 = 0 AS eval_reject, h % 37 = 0 AS eval_pos_change,
  CASE WHEN h % 4 = 0 THEN 'minor wording' ELSE '' END AS eval_issues,
  CASE WHEN h % 3 = 0 THEN 'use a title' ELSE '' END AS eval_suggestion,
  CASE WHEN h % 5 = 0 THEN NULL ELSE h % 5 > 2 END AS accepted,
  CASE WHEN h % 71 <> 0 THEN (h % 7)::INT END AS retry_count,
  CASE WHEN h % 6 = 0 THEN 'variants_edited: both variants identical to the source' ELSE '' END AS symbolic_check_failures,
  CASE WHEN h % 14 <> 0 THEN (h % 5 + 1)::INT END AS grammaticality_score,
  CASE WHEN h % 73 = 0 THEN NULL WHEN h % 79 = 0 THEN '  ' WHEN h % 83 = 0 THEN 'Unsure'
       ELSE ['good', ' Good', 'meh', 'BAD'][(h // 3) % 4 + 1] END AS eval_human,
  CASE h % 3 WHEN 0 THEN 'A Great pair' WHEN 1 THEN 'greater detail' END AS eval_human_explained
  FROM mascs)"""

SQL_LONG = """
long_form AS (
  SELECT row_id, 'source' AS variant, EN_source_sentence AS sentence, referent, 'ambiguous' AS expected_label FROM corpus
  UNION ALL SELECT row_id, 'masculine', EN_masculine_sentence, coalesce(masc_referent, referent), 'masculine'
            FROM corpus WHERE EN_masculine_sentence IS NOT NULL
  UNION ALL SELECT row_id, 'feminine', EN_feminine_sentence, coalesce(fem_referent, referent), 'feminine'
            FROM corpus WHERE EN_feminine_sentence IS NOT NULL)"""


# ---------------------------------------------------------------- predictions

def predictions(spark: SparkSession, sf_dir: str, runs=RUNS, columns=None) -> DataFrame:
    """Scored predictions, one row per (row_id, variant, model, condition, thinking)."""
    long = to_long(corpus(spark, sf_dir))
    run = F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.lit(c).alias("condition"), F.lit(t).alias("thinking"))
        for m, c, t in runs])).alias("run")
    g = F.col("g")
    rows = (long.select("*", run).select(*long.columns, "run.*")
            .withColumn("g", key_hash(F.col("row_id"), F.col("variant"), F.col("model"), F.col("condition"),
                                      F.col("thinking"))))
    at = g % 100
    label = (F.when(g % 1009 == 0, F.lit(None).cast("string")).when(at < 80, F.col("expected_label"))
             .when(at < 92, "ambiguous").when(at < 95, "masculine").when(at < 97, "feminine")
             .when(at < 98, "not_found").otherwise("parse_error"))
    out = (rows.withColumn("predicted_label", label)
           .withColumn("confidence", F.when(F.col("predicted_label").isin("masculine", "feminine", "ambiguous"),
                                            (F.floor(g / 100) % 5 + 1).cast("int")))
           .withColumn("task", F.when(F.endswith("condition", F.lit("_identify")), "open").otherwise("closed"))
           .withColumn("correct", F.coalesce(F.col("predicted_label") == F.col("expected_label"), F.lit(False))))
    return out if columns is None else out.select(*columns)


def sql_predictions(runs=RUNS) -> str:
    values = ", ".join(f"('{m}', '{c}', {str(t).lower()})" for m, c, t in runs)
    return f"""{SQL_CORPUS}, {SQL_LONG},
runs(model, condition, thinking) AS (VALUES {values}),
drawn AS (SELECT l.*, r.*, ('0x' || substr(md5(l.row_id || '|' || l.variant || '|' || r.model || '|' || r.condition
          || '|' || r.thinking), 1, 8))::BIGINT AS g FROM long_form l CROSS JOIN runs r),
labelled AS (SELECT *, CASE WHEN g % 1009 = 0 THEN NULL WHEN g % 100 < 80 THEN expected_label
   WHEN g % 100 < 92 THEN 'ambiguous' WHEN g % 100 < 95 THEN 'masculine' WHEN g % 100 < 97 THEN 'feminine'
   WHEN g % 100 < 98 THEN 'not_found' ELSE 'parse_error' END AS predicted_label FROM drawn),
predictions AS (SELECT *, CASE WHEN predicted_label IN ('masculine', 'feminine', 'ambiguous')
   THEN ((g // 100) % 5 + 1)::INT END AS confidence,
   CASE WHEN suffix(condition, '_identify') THEN 'open' ELSE 'closed' END AS task,
   coalesce(predicted_label = expected_label, false) AS correct FROM labelled)"""


# ---------------------------------------------------------------- responses

# Styles of a reply around its JSON body.
_STYLES = (
    ("", ""), ("Let me think. ", ""), ("```json\n", "\n```"),
    ('Draft {"gender": "ambiguous", "confidence": 1, "referents": []} then ', ""),
    ("thought about it: {not json} so ", " done"), ("", "  trailing words"), ("{ not closed", ""),
)
_LOWER = "abcdefghijklmnopqrstuvwxyz"
_STATUSES = ("errored", "canceled", "expired", "processing")


def answers(preds: DataFrame) -> DataFrame:
    """Raw reply text and status per prediction row; a null prediction has no reply."""
    g, label, ref = F.col("g"), F.col("predicted_label"), F.col("referent")
    style = F.floor(g / 1000) % len(_STYLES)
    number = (F.when(F.floor(g / 7000) % 5 == 0, F.concat(F.col("confidence").cast("string"), F.lit(".7")))
              .when(F.floor(g / 7000) % 5 == 1, '"high"').when(F.floor(g / 7000) % 5 == 2, "true")
              .when(F.floor(g / 7000) % 35 == 3, "3000000000").when(F.floor(g / 7000) % 35 == 8, "1e20")
              .otherwise(F.col("confidence").cast("string")))
    fields = F.concat(F.lit('"gender": "'), label, F.lit('", "confidence": '), number,
                      F.lit(', "reasoning": "near '), ref, F.lit('"'))
    surface = (F.when(F.floor(g / 35000) % 4 == 0, ref).when(F.floor(g / 35000) % 4 == 1, F.concat(F.lit("The "), ref))
               .when(F.floor(g / 35000) % 4 == 2, F.concat(F.translate(ref, _LOWER, _LOWER.upper()), F.lit(".")))
               .otherwise(F.concat(ref, F.lit("s"))))
    other = '{"referent": "zq0", "gender": "feminine", "confidence": 2, "reasoning": "aside"}'
    entry = F.concat(F.lit('{"referent": "'), surface, F.lit('", '), fields, F.lit("}"))
    closed = F.when(label.isin("masculine", "feminine", "ambiguous"), F.concat(F.lit("{"), fields, F.lit("}")))
    opened = (F.when(label.isin("masculine", "feminine", "ambiguous"),
                     F.concat(F.lit('{"referents": [' + other + ", 7, "), entry, F.lit("]}")))
              .when(label == "not_found", F.lit('{"referents": [' + other + "]}")))
    body = F.coalesce(F.when(F.col("task") == "open", opened).otherwise(closed), F.lit("I cannot answer."))
    before, after = _pick([a for a, _ in _STYLES], style), _pick([b for _, b in _STYLES], style)
    status = F.when(g % 97 == 0, _pick(_STATUSES, F.floor(g / 97) % 4)).otherwise("succeeded")
    return (preds.where(label.isNotNull())
            .withColumn("status", status)
            .withColumn("text", F.when(F.col("status") == "succeeded", F.concat(before, body, after))))


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


SQL_ANSWERS = f"""
answer_parts AS (SELECT *, (g // 1000) % {len(_STYLES)} AS style,
   CASE (g // 7000) % 5 WHEN 0 THEN confidence || '.7' WHEN 1 THEN '"high"' WHEN 2 THEN 'true'
     ELSE CASE (g // 7000) % 35 WHEN 3 THEN '3000000000' WHEN 8 THEN '1e20' ELSE confidence::VARCHAR END END AS number,
   CASE (g // 35000) % 4 WHEN 0 THEN referent WHEN 1 THEN 'The ' || referent WHEN 2 THEN translate(referent, '{_LOWER}', '{_LOWER.upper()}') || '.'
        ELSE referent || 's' END AS surface,
   CASE WHEN g % 97 = 0 THEN {_sql_pick(_STATUSES, '(g // 97) % 4')} ELSE 'succeeded' END AS status
   FROM predictions WHERE predicted_label IS NOT NULL),
answer_fields AS (SELECT *, '"gender": "' || predicted_label || '", "confidence": ' || number
   || ', "reasoning": "near ' || referent || '"' AS fields,
   '{{"referent": "zq0", "gender": "feminine", "confidence": 2, "reasoning": "aside"}}' AS other FROM answer_parts),
answer_bodies AS (SELECT *, CASE WHEN predicted_label IN ('masculine', 'feminine', 'ambiguous') AND task = 'open'
     THEN '{{"referents": [' || other || ', 7, {{"referent": "' || surface || '", ' || fields || '}}]}}'
   WHEN predicted_label IN ('masculine', 'feminine', 'ambiguous') THEN '{{' || fields || '}}'
   WHEN predicted_label = 'not_found' AND task = 'open' THEN '{{"referents": [' || other || ']}}'
   ELSE 'I cannot answer.' END AS body FROM answer_fields),
answers AS (SELECT row_id, variant, sentence, referent, expected_label, model, condition, thinking, task, g, status, style, body,
   CASE WHEN status = 'succeeded' THEN CASE style
   {' '.join(f"WHEN {i} THEN {_sql_text(a)} || body || {_sql_text(b)}" for i, (a, b) in enumerate(_STYLES))} END END AS text
   FROM answer_bodies)"""
