"""Requests, replies, demonstrations, training records, leakage and the response stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.check import Check
from checks.corpus_checks import SQL_LEXICON, SQL_ROUTING, SQL_TURNS, routed, with_corpus
from checks.prediction_checks import CLOSED_M1, OPEN_M1, with_predictions
from checks.tables import SQL_ANSWERS, SQL_LONG, answers, corpus, dealt, predictions, table
from pairlens.fixed_values import CANNED_REASON, CONDITIONS, OPEN_CONDITIONS, RUBRIC
from pairlens.operators import assignment as A
from pairlens.operators import leakage as J
from pairlens.operators import records as N
from pairlens.operators import requests as R
from pairlens.operators import responses as H
from pairlens.operators.reshape import to_long
from pairlens.session import new_state_path
from pairlens.streaming import intake

PROMPT = "You label the REFERENT of a sentence."
GRAMMAR_PROMPT = "Rate the grammar from 1 to 5.\n\nSentence: {sentence}\n\nAnswer as JSON."
PROMPTS = {c: f"Judge by {c}." for c in CONDITIONS}


def _q(value: str) -> str:
    return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


# ---------------------------------------------------------------- requests

def first_content(requests, *extra):
    return requests.select("custom_id", "model", "max_tokens", F.col("messages")[0]["role"].alias("role"),
                           F.col("messages")[0]["content"].alias("content"), *extra)


def generation_requests(spark, sf_dir):
    names = A.rotate_names(corpus(spark, sf_dir).select("row_id"))
    rows = routed(spark, sf_dir).join(names, "row_id")
    return first_content(R.generation_requests(rows, "writer"), "recommended_strategy")


def condition_requests(spark, sf_dir):
    """All conditions with the system block of each."""
    conditions = R.condition_table(spark, PROMPTS)
    rows = R.condition_requests(to_long(corpus(spark, sf_dir)), conditions, "judge")
    rows = R.with_system(rows.join(F.broadcast(conditions.select("condition", "system_prompt")), "condition"), F.col("system_prompt"))
    block = F.col("system")[0]
    return first_content(rows, "condition", "is_open", block["text"].alias("system_text"), block["cache_control"]["type"].alias("cache"))


SQL_FEEDBACK = """array_to_string(list_filter([
   CASE WHEN EN_masculine_sentence = EN_feminine_sentence THEN 'The masculine and feminine variants are IDENTICAL. They MUST differ.' END,
   CASE WHEN EN_masculine_sentence = EN_source_sentence AND EN_feminine_sentence = EN_source_sentence THEN 'Both variants are UNCHANGED. You MUST make edits.' END,
   CASE WHEN eval_referent_disambiguated <= 3 THEN 'CRITICAL: The referent ''' || referent || ''' was NOT disambiguated. Make sure the gender of ''' || referent || ''' specifically is clear.' END,
   CASE WHEN eval_no_extra_sentence <= 3 THEN 'CRITICAL: You added a second sentence. All edits must be WITHIN the original sentence.' END,
   CASE WHEN eval_pos_change THEN 'CRITICAL: You turned the referent ''' || referent || ''' from a noun into an adjective. Keep it as a noun and try a different strategy.' END,
   CASE WHEN eval_correctness < 4 THEN 'Correctness issue: ' || eval_issues END,
   CASE WHEN eval_naturalness < 4 THEN 'Naturalness issue: ' || eval_issues END,
   CASE WHEN trim(symbolic_check_failures) <> '' THEN 'SYMBOLIC CHECK FAILURES: ' || symbolic_check_failures END,
   CASE WHEN trim(eval_suggestion) <> '' THEN 'SUGGESTED FIX FROM EVALUATOR: ' || eval_suggestion END], lambda x: x IS NOT NULL), ' ')"""
SQL_FEEDBACK = f"coalesce(nullif({SQL_FEEDBACK}, ''), 'Previous attempt had issues: ' || eval_issues || '. Try a different strategy.')"


def request_sql(kind: str, identity: str, model: str, tokens: int, content: str, tail: str, extra: str = "") -> str:
    return (f"SELECT '{kind}_' || {identity} AS custom_id, '{model}' AS model, {tokens} AS max_tokens, 'user' AS role, "
            f"{content} AS content{extra} {tail}")


# ---------------------------------------------------------------- demonstrations

def demo_pool(spark, sf_dir):
    return R.demo_pool(corpus(spark, sf_dir))


def drawn(spark, sf_dir, ambiguous_only=False, columns=("*",)):
    long = to_long(corpus(spark, sf_dir)).select(*columns)
    return R.draw_demos(long, demo_pool(spark, sf_dir), per_class=2, seed=5, ambiguous_only=ambiguous_only)


def demo_trace(ambiguous_only):
    def query(spark, sf_dir):
        return drawn(spark, sf_dir, ambiguous_only, ("row_id", "variant")).select("row_id", "variant", R.demo_trace(F.col("demos")).alias("demos_used"))
    return query


def demo_chat(spark, sf_dir):
    """Closed-task chats with demonstrations, as one text per example."""
    rows = drawn(spark, sf_dir)
    chat = R.chat_messages(F.lit(PROMPT), R.question(False), R.demo_messages(F.col("demos"), include_think=True))
    return rows.select("row_id", "variant", F.array_join(F.transform(chat, lambda m: F.concat(
        m["role"], F.lit(": "), m["content"])), "\n").alias("chat"))


SQL_POOL = """
pool AS (SELECT expected_label AS label, row_number() OVER (PARTITION BY expected_label ORDER BY row_id) - 1 AS idx, sentence, referent
   FROM (SELECT row_id, 'ambiguous' AS expected_label, EN_source_sentence AS sentence, referent FROM corpus
         UNION ALL SELECT row_id, 'masculine', EN_masculine_sentence, masc_referent FROM corpus
         UNION ALL SELECT row_id, 'feminine', EN_feminine_sentence, fem_referent FROM corpus)
   WHERE trim(coalesce(sentence, '')) <> '' AND trim(coalesce(referent, '')) <> '')"""


def _md(*parts: str) -> str:
    return f"('0x' || substr(md5({' || chr(124) || '.join(parts)}), 1, 8))::BIGINT"


def sql_draws(wanted) -> str:
    ident = ("'5'", "row_id", "variant", "label")
    draws = "".join(f"""
drawn{i + 1} AS (SELECT * EXCLUDE (taken, t), list_append(taken, CASE WHEN list_contains(taken, t) THEN size - k + {i} ELSE t END) AS taken
   FROM (SELECT *, {_md(*ident, "'draw'", f"(size - k + {i})")} % (size - k + {i + 1}) AS t FROM drawn{i})),""" for i in range(wanted[0][1]))
    return f"""
wanted(label, k) AS (VALUES {', '.join(f"('{label}', {k})" for label, k in wanted)}),
sized AS (SELECT label, k, size FROM wanted JOIN (SELECT label, count(*) AS size FROM pool GROUP BY 1) USING (label)),
drawn0 AS (SELECT row_id, variant, label, k, size, []::BIGINT[] AS taken FROM long_form CROSS JOIN sized),{draws}
draws AS (SELECT row_id, variant, label, unnest(taken) AS idx FROM drawn{wanted[0][1]}),
demos AS (SELECT row_id, variant, list({{'gold': label, 'sentence': sentence, 'referent': referent}}
   ORDER BY {_md(*ident, "idx")}, label, idx) AS demos
   FROM draws JOIN pool USING (label, idx) GROUP BY ALL)"""


EACH = [("masculine", 2), ("feminine", 2), ("ambiguous", 2)]
_REASON = "CASE {0} " + " ".join(f"WHEN '{k}' THEN {_q(v)}" for k, v in CANNED_REASON.items()) + " END"


def sql_closed_target(label: str) -> str:
    return f"""'{{"gender": "' || {label} || '", "confidence": 5, "reasoning": "' || {_REASON.format(label)} || '"}}'"""


def sql_open_target(referent: str, label: str) -> str:
    return (f"""'{{"referents": [{{"referent": ' || to_json({referent})::VARCHAR || ', "gender": "' || {label} """
            f"""|| '", "confidence": 5, "reasoning": "' || {_REASON.format(label)} || '"}}]}}'""")


SQL_TRACE = """'[' || array_to_string(list_transform(demos, lambda d: '{"sentence": ' || to_json(d.sentence)::VARCHAR
   || ', "referent": ' || to_json(d.referent)::VARCHAR || ', "gold": "' || d.gold || '"}'), ', ') || ']'"""
SQL_CHAT = f"""'system: {PROMPT}' || chr(10) || array_to_string(list_transform(demos, lambda d:
   'user: Sentence: ' || d.sentence || chr(10) || 'Referent: ' || d.referent || chr(10) || 'assistant: <think>' || chr(10)
   || 'The referent is "' || d.referent || '". I check the sentence for gendered pronouns, titles, or morphology bound to it. '
   || {_REASON.format('d.gold')} || ', so the gender is ' || d.gold || '.' || chr(10) || '</think>' || chr(10)
   || {sql_closed_target('d.gold')}), chr(10)) || chr(10) || 'user: Sentence: ' || sentence || chr(10) || 'Referent: ' || referent"""


# ---------------------------------------------------------------- replies

def responses(preds):
    """Response table with repeats: every fifth id has an earlier, superseded reply."""
    rows = answers(preds).withColumn("custom_id", F.concat(
        F.lit("cls_"), F.col("row_id").cast("string"), F.lit("_"), F.col("variant")))
    last = rows.select("custom_id", "status", "text", F.lit(2).alias("arrival"))
    early = rows.withColumn("first_text", F.when(F.col("g") % 5 == 0, F.lit('{"gender": "feminine"}')))
    early = early.where(F.col("first_text").isNotNull()).select(
        "custom_id", F.lit("succeeded").alias("status"), F.col("first_text").alias("text"), F.lit(1).alias("arrival"))
    return last.unionByName(early)


def _examples(preds):
    key = F.concat(F.col("row_id").cast("string"), F.lit("_"), F.col("variant"))
    return preds.select("row_id", "variant", "referent", "expected_label", key.alias("key"))


def labels(open_task):
    def query(spark, sf_dir):
        preds = predictions(spark, sf_dir, OPEN_M1 if open_task else CLOSED_M1)
        rows = H.attach(_examples(preds), responses(preds), "cls", "key")
        answered = H.open_answers(rows) if open_task else H.closed_answers(rows)
        return H.with_correct(answered).select("row_id", "variant", "predicted_label", "confidence", "reasoning", "correct")
    return query


def progress(spark, sf_dir):
    return H.progress(responses(predictions(spark, sf_dir, CLOSED_M1)))


_BLOCK = "\\{(?:[^{}]|\\{(?:[^{}]|\\{[^{}]*\\})*\\})*\\}"
# An unclosed brace takes everything after it; otherwise the last valid block counts.
SQL_REPLIES = f"""
parsed AS (SELECT p.row_id, p.variant, p.referent, p.expected_label, a.status, a.text,
   CASE WHEN a.status = 'succeeded' AND a.text NOT LIKE '{{ not closed%' THEN
     list_filter(regexp_extract_all(a.text, '{_BLOCK}'), lambda b: json_valid(b))[-1] END AS block
   FROM predictions p LEFT JOIN answers a USING (row_id, variant, model, condition, thinking))"""


def _sql_confidence(value: str) -> str:
    return (f"CASE WHEN json_type({value}, '$.confidence') IN ('UBIGINT', 'BIGINT', 'DOUBLE') "
            f"THEN TRY_CAST(trunc(json_extract_string({value}, '$.confidence')::DOUBLE) AS INT) "
            f"WHEN json_type({value}, '$.confidence') = 'BOOLEAN' THEN (json_extract_string({value}, '$.confidence') = 'true')::INT END")


def _sql_label(value: str) -> str:
    return (f"CASE WHEN json_extract_string({value}, '$.gender') IN ('masculine', 'feminine', 'ambiguous') "
            f"THEN json_extract_string({value}, '$.gender') ELSE 'parse_error' END")


SQL_CLOSED = f"""
closed_labels AS (SELECT row_id, variant, expected_label, CASE WHEN status IS NOT NULL THEN {_sql_label('block')} END AS predicted_label,
   {_sql_confidence('block')} AS confidence, json_extract_string(block, '$.reasoning') AS reasoning FROM parsed)"""


def sql_match(source: str, target: str, name: str) -> str:
    """CTEs from ``source`` with ``entries`` (list of struct with ref) to ``name`` with position ``pos``."""
    return f"""
{name}_normal AS (SELECT *, rtrim(lower(trim({target})), '.,!?:;') AS wanted,
   list_transform(entries, lambda e: rtrim(lower(trim(coalesce(e.ref, ''))), '.,!?:;')) AS names FROM {source}),
{name} AS (SELECT *, CASE WHEN wanted <> '' THEN coalesce(nullif(list_position(names, wanted), 0),
   list_filter(range(1, len(names) + 1), lambda i: names[i] <> '' AND (list_contains(string_split_regex(names[i], '\\s+'), wanted)
     OR list_contains(string_split_regex(wanted, '\\s+'), names[i]) OR contains(names[i], wanted) OR contains(wanted, names[i])))[1])
   END AS pos FROM {name}_normal)"""


SQL_OPEN = f"""
listed AS (SELECT *, CASE WHEN json_type(block, '$.referents') = 'ARRAY' THEN list_transform(
   json_extract(block, '$.referents[*]'), lambda e: {{'ref': json_extract_string(e, '$.referent'), 'body': e}}) END AS entries FROM parsed),
{sql_match('listed', 'referent', 'located')},
open_labels AS (SELECT row_id, variant, expected_label, CASE WHEN status IS NULL THEN NULL
   WHEN block IS NULL OR block = '{{}}' THEN 'parse_error' WHEN pos IS NULL THEN 'not_found'
   ELSE {_sql_label('entries[pos].body')} END AS predicted_label,
   {_sql_confidence('entries[pos].body')} AS confidence, json_extract_string(entries[pos].body, '$.reasoning') AS reasoning FROM located)"""


def sql_labels(name: str) -> str:
    return f"""SELECT row_id, variant, predicted_label, confidence, reasoning,
        coalesce(predicted_label = expected_label, false) AS correct FROM {name}"""


def rubric_replies(spark, sf_dir):
    """Rubric replies of each row: plain, fenced, cut off, failed or missing."""
    rows = corpus(spark, sf_dir)
    h = F.col("h")
    scores = F.concat_ws(", ", *[F.concat(F.lit(f'"{k}": '), F.coalesce(F.col(f"eval_{k}").cast("string"), F.lit("null"))) for k in RUBRIC])
    tail = F.concat(
        F.when(h % 4 != 0, F.lit(', "strategy_label": "adjective"')).otherwise(""), F.lit(', "pos_change": '),
        F.col("eval_pos_change").cast("string"), F.when(h % 5 != 0, F.concat(F.lit(', "reject": '), F.col("eval_reject").cast("string"))).otherwise(""),
        F.lit(', "issues": "'), F.col("eval_issues"), F.lit('"}'))
    body = F.concat(F.lit("{"), scores, tail)
    text = (F.when(h % 6 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
            .when(h % 6 == 1, F.concat(F.lit("Scores: "), body, F.lit(' and {"reject": true}')))
            .when(h % 6 == 2, F.concat(F.lit("{oops} "), body)).otherwise(body))
    status = F.when(h % 12 == 5, F.lit(None)).when(h % 10 == 0, "errored").otherwise("succeeded")
    replies = rows.select(
        F.concat(F.lit("eval_"), F.col("row_id").cast("string")).alias("custom_id"), status.alias("status"),
        text.alias("text"), F.lit(1).alias("arrival"))
    return replies.where(F.col("status").isNotNull())


def rubric_flat(spark, sf_dir):
    rows = H.attach(corpus(spark, sf_dir).select("row_id"), rubric_replies(spark, sf_dir), "eval")
    return H.rubric_scores(rows).drop("custom_id", "text")


def _sql_rubric_value(k: str) -> str:
    return f"CASE WHEN ok THEN eval_{k}::DOUBLE END AS eval_{k}"


SQL_RUBRIC = f"""SELECT row_id, status, {', '.join(_sql_rubric_value(k) for k in RUBRIC)},
   CASE WHEN status IS NOT NULL THEN CASE WHEN ok AND h % 4 <> 0 THEN 'adjective' ELSE 'unknown' END END AS eval_strategy_label,
   CASE WHEN status IS NOT NULL THEN ok AND eval_pos_change END AS eval_pos_change,
   CASE WHEN status IS NOT NULL THEN ok AND h % 5 <> 0 AND eval_reject END AS eval_reject,
   CASE WHEN status IS NOT NULL THEN CASE WHEN ok THEN eval_issues ELSE '' END END AS eval_issues,
   CASE WHEN status IS NOT NULL THEN '' END AS eval_suggestion
   FROM (SELECT *, CASE WHEN h % 12 <> 5 THEN CASE WHEN h % 10 = 0 THEN 'errored' ELSE 'succeeded' END END AS status,
         h % 12 <> 5 AND h % 10 <> 0 AND h % 6 <> 2 AS ok FROM corpus)"""


def generated(spark, sf_dir):
    """Rewrites read back from generation replies; h picks missing fields, bad text and failures."""
    rows = corpus(spark, sf_dir).select("row_id", "h", "referent", "EN_source_sentence")
    h = F.col("h")
    masc, fem = R.json_text(F.concat("EN_source_sentence", F.lit(", sir"))), R.json_text(F.concat("EN_source_sentence", F.lit(", ma'am")))
    body = F.concat(
        F.lit('{"masculine_sentence": '), masc, F.lit(', "feminine_sentence": '), F.when(h % 9 == 0, F.lit("null")).otherwise(fem),
        F.when(h % 4 != 0, F.lit(', "strategy": "sir_maam"')).otherwise(""),
        F.when(h % 5 == 0, F.concat(F.lit(', "masc_referent": "'), F.col("referent"), F.lit(' man"'))).otherwise(""), F.lit("}"))
    replies = rows.select(
        F.concat(F.lit("gen_"), F.col("row_id").cast("string")).alias("custom_id"),
        F.when(h % 13 == 3, F.lit(None)).when(h % 11 == 0, "expired").otherwise("succeeded").alias("status"),
        F.when(h % 7 == 0, F.lit("no object here")).when(h % 7 == 1, F.concat(F.lit("```\n"), body, F.lit("\n```"))).otherwise(body).alias("text"),
        F.lit(1).alias("arrival")).where(F.col("status").isNotNull())
    return H.generated_variants(H.attach(rows, replies, "gen")).drop("custom_id", "h", "status", "text", "EN_source_sentence")


SQL_GENERATED = """SELECT row_id, referent, CASE WHEN ok THEN EN_source_sentence || ', sir' END AS EN_masculine_sentence,
   CASE WHEN ok AND h % 9 <> 0 THEN EN_source_sentence || ', ma''am' END AS EN_feminine_sentence,
   CASE WHEN here THEN CASE WHEN ok AND h % 4 <> 0 THEN 'sir_maam' ELSE 'unknown' END END AS disambiguation_strategy,
   CASE WHEN here THEN CASE WHEN ok AND h % 5 = 0 THEN referent || ' man' ELSE referent END END AS masc_referent,
   CASE WHEN here THEN referent END AS fem_referent,
   CASE WHEN NOT here THEN 'missing' WHEN h % 11 = 0 THEN 'expired' WHEN h % 7 = 0 THEN 'parse_error' ELSE 'ok' END AS generation_status
   FROM (SELECT *, h % 13 <> 3 AS here, h % 13 <> 3 AND h % 11 <> 0 AND h % 7 <> 0 AS ok FROM corpus)"""


# ---------------------------------------------------------------- training records

def record_text(records):
    m = F.col("messages")
    return records.select("row_id", "variant", m[0]["content"].alias("system"), m[1]["content"].alias("question"),
                          m[2]["content"].alias("target"))


def sql_records(target: str, open_task: bool, source_only: bool) -> str:
    question = "'Sentence: ' || trim(sentence)" + ("" if open_task else " || chr(10) || 'Referent: ' || trim(referent)")
    where = "AND variant = 'source'" if source_only else ""
    return with_corpus(f"""SELECT row_id, variant, '{PROMPT}' AS system, {question} AS question, {target} AS target FROM own
        WHERE coalesce(sentence, '') <> '' AND coalesce(referent, '') <> '' {where}""", """
own AS (SELECT row_id, 'source' AS variant, EN_source_sentence AS sentence, referent, 'ambiguous' AS label FROM corpus
   UNION ALL SELECT row_id, 'masculine', EN_masculine_sentence, masc_referent, 'masculine' FROM corpus
   UNION ALL SELECT row_id, 'feminine', EN_feminine_sentence, fem_referent, 'feminine' FROM corpus)""")


def taught(spark, sf_dir):
    rows = answers(predictions(spark, sf_dir, OPEN_M1)).withColumnRenamed("text", "raw_response")
    return N.taught_rows(rows.select("row_id", "variant", "sentence", "referent", "expected_label", "raw_response"))


SQL_TAUGHT = f"""
taught_parsed AS (SELECT row_id, variant, sentence, referent, expected_label,
   CASE WHEN status = 'succeeded' AND text NOT LIKE '{{ not closed%' THEN
     list_filter(regexp_extract_all(text, '{_BLOCK}'), lambda b: json_valid(b))[-1] END AS block FROM answers),
taught_listed AS (SELECT *, list_filter(list_transform(json_extract(block, '$.referents[*]'), lambda e: {{
     'ref': trim(json_extract_string(e, '$.referent')), 'gender': json_extract_string(e, '$.gender'),
     'confidence': coalesce({_sql_confidence('e')}, 5), 'reasoning': trim(coalesce(json_extract_string(e, '$.reasoning'), ''))}}),
   lambda r: coalesce(r.ref, '') <> '' AND r.gender IN ('masculine', 'feminine', 'ambiguous')) AS entries FROM taught_parsed),
{sql_match('taught_listed', 'referent', 'taught_at')},
taught AS (SELECT *, CASE WHEN entries IS NULL OR len(entries) = 0 THEN 'parse_error' WHEN pos IS NULL THEN 'not_found'
   WHEN entries[pos].gender <> expected_label THEN 'overridden' ELSE 'kept' END AS outcome FROM taught_at)"""


def merged(spark, sf_dir):
    rows = answers(predictions(spark, sf_dir, CLOSED_M1)).withColumns({
        "raw_response": F.col("text"), "reasoning": F.concat(F.lit("near "), F.col("referent"))})
    return N.merge_teacher(corpus(spark, sf_dir).select("row_id", "doc_id"), rows)


_MERGED = ", ".join(
    f"max({column}) FILTER (variant = '{v}') AS teacher_{name}_{v}" for v in ("source", "masculine", "feminine")
    for column, name in (("'near ' || referent", "reasoning"), ("text", "raw_response"), ("predicted_label", "predicted"), ("correct", "correct")))
SQL_MERGED = f"""
replies AS (SELECT a.*, p.predicted_label, p.correct FROM answers a JOIN predictions p USING (row_id, variant, model, condition, thinking)),
merged AS (SELECT c.row_id, c.doc_id, w.* EXCLUDE (row_id) FROM (SELECT row_id, doc_id FROM corpus) c LEFT JOIN (
   SELECT row_id, {_MERGED} FROM replies GROUP BY 1) w USING (row_id))"""


# ---------------------------------------------------------------- leakage

def halves(spark, sf_dir):
    """Train and test: all lines of the documents without and with a label."""
    rows = corpus(spark, sf_dir).select("row_id", "doc_id", "EN_source_sentence", "EN_masculine_sentence", "EN_feminine_sentence")
    labelled = table(spark, sf_dir, "labels").select("doc_id")
    return rows.join(labelled, "doc_id", "left_anti"), rows.join(labelled, "doc_id", "left_semi")


SQL_HALVES = """
sides AS (SELECT c.*, l.doc_id IS NOT NULL AS is_test FROM corpus c LEFT JOIN labels l USING (doc_id)),
sentences AS (SELECT row_id, is_test, lower(trim(unnest([EN_source_sentence, EN_masculine_sentence, EN_feminine_sentence]))) AS s FROM sides),
bad AS (SELECT DISTINCT row_id FROM sentences WHERE NOT is_test AND s <> '' AND s IN (SELECT s FROM sentences WHERE is_test AND s IS NOT NULL))"""


def containment_leak(spark, sf_dir):
    examples = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("example_id"), "text")
    docs = dealt(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sentence_id"), "text"), "sentence_id")
    return J.example_overlap(examples, docs)


def line_leak(spark, sf_dir):
    """Lines of the benchmark passages against the corpus lines, in both directions."""
    parts = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    examples = parts.select((F.col("item_id") * 4294967296 + F.col("pos")).alias("example_id"), F.trim("text").alias("text")).where("text <> ''")
    lines = corpus(spark, sf_dir).select(F.col("row_id").alias("sentence_id"), F.col("EN_source_sentence").alias("text"))
    return J.example_overlap(examples, lines)


def sql_overlap(examples: str, sentences: str) -> str:
    return f"""SELECT e.example_id, count(*) FILTER (s.text = e.text) AS n_equal,
        count(*) FILTER (s.text <> e.text AND contains(s.text, e.text)) AS n_containing,
        count(*) FILTER (s.text <> e.text AND trim(s.text) <> '' AND contains(e.text, s.text)) AS n_contained
        FROM ({examples}) e CROSS JOIN ({sentences}) s GROUP BY 1"""


# ---------------------------------------------------------------- stream

def _landed(spark, preds, folder, lots=2, triggers=4):
    """All replies, superseded, repeated, late and unknown ones too, as files that land in lots; yields after each how many of
    its files make one of ``triggers`` micro-batches, so their number doesn't grow with the input."""
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.xxhash64("custom_id"), F.lit(600)) + F.col("arrival") * 86_400)
    copies = F.array(F.col("custom_id"), F.col("custom_id"), F.concat("custom_id", F.lit("_gone")))
    rows = responses(preds).select(F.explode(copies).alias("custom_id"), "status", "text", at.alias("arrival"))
    lot = F.pmod(F.xxhash64("custom_id", "arrival"), F.lit(lots))
    seen = 0
    for k in range(lots):
        rows.where(lot == k).write.mode("append").json(f"{folder}/in", compression="gzip")
        files = len(spark.read.schema(intake.RESPONSE_SCHEMA).json(f"{folder}/in").inputFiles())
        yield max(1, -(-(files - seen) // triggers))
        seen = files


def _kept_replies(spark, sf_dir):
    """The lots are read in several micro-batches each, by a query that starts again on its checkpoint for each lot."""
    preds = predictions(spark, sf_dir, CLOSED_M1)
    folder = new_state_path(spark, "intake")
    key = F.concat(F.lit("cls_"), F.col("row_id").cast("string"), F.lit("_"), F.col("variant"))
    preds.select(key.alias("custom_id"), "row_id", "variant", "referent", "expected_label").write.parquet(f"{folder}/examples")
    examples = spark.read.parquet(f"{folder}/examples")
    for files in _landed(spark, preds, folder):
        stream = intake.labelled(intake.read_responses(spark, f"{folder}/in", files_per_trigger=files), examples, open_task=False)
        intake.keep_last(stream.select("custom_id", "arrival", "known", "row_id", "variant", "predicted_label", "confidence", "correct"),
                         f"{folder}/state", once=True).awaitTermination()
    return intake.last_replies(spark, f"{folder}/state")


def response_stream(spark, sf_dir):
    """The last reply of each known id, out of the stream's state."""
    return _kept_replies(spark, sf_dir).where("known").select("row_id", "variant", "predicted_label", "confidence", "correct")


def unknown_replies(spark, sf_dir):
    """The last reply of each id that no example has."""
    return intake.unknown(_kept_replies(spark, sf_dir)).select("custom_id", "predicted_label", "confidence")


def response_states(spark, sf_dir):
    """Replies by state, summed over the arrival windows that the stream counts."""
    preds, folder = predictions(spark, sf_dir, CLOSED_M1), new_state_path(spark, "intake")
    for files in _landed(spark, preds, folder):
        counts = intake.status_counts(intake.read_responses(spark, f"{folder}/in", files_per_trigger=files))
        intake.write_counts(counts, f"{folder}/counts", f"{folder}/state").awaitTermination()
    table = spark.read.parquet(f"{folder}/counts")
    return table.groupBy("status").agg(F.sum("n").alias("n"))


LONG_REQUEST = "'cls_' || row_id || '_' || variant"

CHECKS = {
    "generation_requests": Check(generation_requests, with_corpus(
        request_sql("gen", "r.row_id", "writer", 1024, """'Referent: ' || r.referent || chr(10) || 'Original sentence: ' || r.EN_source_sentence
            || coalesce(chr(10) || chr(10) || nullif(trim(rendered, ' ' || chr(10)), ''), '') || chr(10) || chr(10)
            || 'ASSIGNED_SURNAME_IF_TITLE: ' || surname || chr(10) || 'ASSIGNED_RELATIONAL_PAIR_IF_RELATIONAL: ' || kin_masc || '/' || kin_fem""",
                    "FROM routing r JOIN named n USING (row_id)", ", coalesce(strategy, '') AS recommended_strategy"),
        SQL_LEXICON, SQL_ROUTING, SQL_TURNS)),
    "evaluation_requests": Check(
        lambda s, d: first_content(R.evaluation_requests(corpus(s, d), "judge", only_undecided=True)),
        with_corpus(request_sql("eval", "row_id", "judge", 256, """'Referent: "' || referent || '"' || chr(10) || 'Original: ' || EN_source_sentence
            || chr(10) || 'Masculine: ' || EN_masculine_sentence || chr(10) || 'Feminine: ' || EN_feminine_sentence""",
                                """FROM corpus WHERE EN_feminine_sentence IS NOT NULL AND accepted IS NOT TRUE AND eval_reject IS NOT TRUE"""))),
    "retry_requests": Check(
        lambda s, d: first_content(R.retry_requests(corpus(s, d), "writer")),
        with_corpus(request_sql("retry", "row_id", "writer", 1024, f"""'Referent: ' || referent || chr(10) || 'Original sentence: '
            || EN_source_sentence || chr(10) || chr(10) || 'FEEDBACK ON PREVIOUS ATTEMPT: ' || {SQL_FEEDBACK} || chr(10) || chr(10)
            || 'Try again with a better strategy.'""", """FROM corpus WHERE accepted = false AND eval_reject IS NOT TRUE
            AND coalesce(retry_count, 0) < 5"""))),
    "grammaticality_requests": Check(
        lambda s, d: first_content(R.grammaticality_requests(corpus(s, d), "judge", GRAMMAR_PROMPT)),
        with_corpus(request_sql("gram", "row_id", "judge", 64, " || ".join(
            [_q(GRAMMAR_PROMPT.split("{sentence}")[0]), "EN_source_sentence", _q(GRAMMAR_PROMPT.split("{sentence}")[1])]), "FROM corpus"))),
    "classification_requests": Check(
        lambda s, d: first_content(R.classification_requests(to_long(corpus(s, d)), "judge")),
        with_corpus(request_sql("cls", "row_id || '_' || variant", "judge", 200,
                                "'Sentence: ' || sentence || chr(10) || 'Referent: ' || referent", "FROM long_form"), SQL_LONG)),
    "condition_requests": Check(condition_requests, with_corpus(
        request_sql("cls", "row_id || '_' || variant", "judge", 200,
                    "'Sentence: ' || sentence || CASE WHEN is_open THEN '' ELSE chr(10) || 'Referent: ' || referent END",
                    "FROM long_form CROSS JOIN (VALUES " + ", ".join(
                        f"('{c}', {str(c in OPEN_CONDITIONS).lower()}, '{p}')" for c, p in PROMPTS.items()) + ") c(condition, is_open, prompt)",
                    ", condition, is_open, prompt AS system_text, 'ephemeral' AS cache"), SQL_LONG)),
    "demo_pool": Check(demo_pool, with_corpus("SELECT * FROM pool", SQL_POOL)),
    "demo_draw": Check(demo_trace(False), with_corpus(
        f"SELECT row_id, variant, {SQL_TRACE} AS demos_used FROM demos", SQL_LONG, SQL_POOL, sql_draws(EACH))),
    "demo_draw_ambiguous": Check(demo_trace(True), with_corpus(
        f"SELECT row_id, variant, {SQL_TRACE} AS demos_used FROM demos", SQL_LONG, SQL_POOL, sql_draws([("ambiguous", 6)]))),
    "demo_chat": Check(demo_chat, with_corpus(
        f"SELECT row_id, variant, {SQL_CHAT} AS chat FROM long_form JOIN demos USING (row_id, variant)",
        SQL_LONG, SQL_POOL, sql_draws(EACH))),
    "response_progress": Check(progress, with_predictions(
        """SELECT status, count(*) FILTER (kind <> 'none') AS n FROM (SELECT status, 'last' AS kind FROM answers
           UNION ALL SELECT 'succeeded', 'early' FROM answers WHERE g % 5 = 0
           UNION ALL SELECT unnest(['processing', 'succeeded', 'errored', 'canceled', 'expired']), 'none') GROUP BY 1""",
        CLOSED_M1, SQL_ANSWERS)),
    "closed_labels": Check(labels(False), with_predictions(sql_labels("closed_labels"), CLOSED_M1, SQL_ANSWERS, SQL_REPLIES, SQL_CLOSED)),
    "open_match": Check(labels(True), with_predictions(sql_labels("open_labels"), OPEN_M1, SQL_ANSWERS, SQL_REPLIES, SQL_OPEN)),
    "rubric_flat": Check(rubric_flat, with_corpus(SQL_RUBRIC)),
    "generation_flat": Check(generated, with_corpus(SQL_GENERATED)),
    "closed_records": Check(
        lambda s, d: record_text(N.closed_records(corpus(s, d), PROMPT)), sql_records(sql_closed_target("label"), False, False)),
    "closed_source_records": Check(
        lambda s, d: record_text(N.closed_records(corpus(s, d), PROMPT, source_only=True)),
        sql_records(sql_closed_target("label"), False, True)),
    "open_records": Check(
        lambda s, d: record_text(N.open_records(corpus(s, d), PROMPT)),
        sql_records(sql_open_target("trim(referent)", "label"), True, False)),
    "open_source_records": Check(
        lambda s, d: record_text(N.open_records(corpus(s, d), PROMPT, source_only=True)),
        sql_records(sql_open_target("trim(referent)", "label"), True, True)),
    "multi_records": Check(
        lambda s, d: record_text(N.multi_records(taught(s, d), PROMPT)),
        with_predictions(f"""SELECT row_id, variant, '{PROMPT}' AS system, 'Sentence: ' || sentence AS question,
            '{{"referents": [' || array_to_string(list_transform(entries, lambda e, i: '{{"referent": ' || to_json(e.ref)::VARCHAR || ', "gender": "'
            || CASE WHEN i = pos THEN expected_label ELSE e.gender END || '", "confidence": ' || e.confidence || ', "reasoning": '
            || to_json(e.reasoning)::VARCHAR || '}}'), ', ') || ']}}' AS target FROM taught WHERE outcome IN ('kept', 'overridden')""",
                         OPEN_M1, SQL_ANSWERS, SQL_TAUGHT)),
    "multi_counts": Check(
        lambda s, d: N.multi_counts(taught(s, d)),
        with_predictions("""SELECT total, parse_errors, not_found, overridden, kept, refs - kept AS extra_referents,
            refs::DOUBLE / kept AS mean_referents FROM (SELECT count(*) AS total, count(*) FILTER (outcome = 'parse_error') AS parse_errors,
            count(*) FILTER (outcome = 'not_found') AS not_found, count(*) FILTER (outcome = 'overridden') AS overridden,
            count(*) FILTER (outcome IN ('kept', 'overridden')) AS kept,
            (sum(len(entries)) FILTER (outcome IN ('kept', 'overridden')))::BIGINT AS refs FROM taught)""", OPEN_M1, SQL_ANSWERS, SQL_TAUGHT)),
    "teacher_merge": Check(merged, with_predictions("SELECT * FROM merged", CLOSED_M1, SQL_ANSWERS, SQL_MERGED)),
    "teacher_accuracy": Check(
        lambda s, d: N.teacher_accuracy(merged(s, d)),
        with_predictions("""SELECT variant, count(*) AS n, count(*) FILTER (correct) AS correct,
            count(*) FILTER (correct)::DOUBLE / count(*) AS accuracy FROM replies GROUP BY 1""", CLOSED_M1, SQL_ANSWERS, SQL_MERGED)),
    "merge_warnings": Check(
        lambda s, d: N.merge_warnings(corpus(s, d), answers(predictions(s, d, CLOSED_M1))),
        with_predictions("""SELECT c.n AS corpus_rows, c.a AS corpus_first, c.z AS corpus_last, p.n AS prediction_rows,
            p.a AS prediction_first, p.z AS prediction_last, p.n <> 3 * c.n AS count_differs, p.a <> c.a OR p.z <> c.z AS span_differs
            FROM (SELECT count(*) AS n, min(row_id) AS a, max(row_id) AS z FROM corpus) c,
            (SELECT count(*) AS n, min(row_id) AS a, max(row_id) AS z FROM answers) p""", CLOSED_M1, SQL_ANSWERS)),
    "contamination_exact": Check(
        lambda s, d: J.drop_contaminated(*halves(s, d)).select("row_id"),
        with_corpus("SELECT row_id FROM sides WHERE NOT is_test AND row_id NOT IN (SELECT row_id FROM bad)", SQL_HALVES)),
    "contamination_report": Check(
        lambda s, d: J.contamination_report(*halves(s, d)),
        with_corpus("""SELECT count(*) FILTER (NOT is_test) AS "rows", (SELECT count(*) FROM bad) AS dropped,
            round(100.0::DOUBLE * (SELECT count(*) FROM bad) / count(*) FILTER (NOT is_test), 2) AS percent FROM sides""", SQL_HALVES)),
    "containment_leak": Check(containment_leak, sql_overlap(
        "SELECT item_id AS example_id, text FROM benchmark", "SELECT text FROM documents")),
    "line_overlap": Check(line_leak, with_corpus(sql_overlap(
        """SELECT item_id * 4294967296 + pos AS example_id, trim(raw) AS text FROM (SELECT item_id, unnest(string_split(text, chr(10))) AS raw,
           generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM benchmark) WHERE trim(raw) <> ''""",
        "SELECT EN_source_sentence AS text FROM corpus"))),
    "response_stream": Check(response_stream, with_predictions(
        """SELECT row_id, variant, predicted_label, confidence, coalesce(predicted_label = expected_label, false) AS correct
           FROM closed_labels WHERE predicted_label IS NOT NULL""", CLOSED_M1, SQL_ANSWERS, SQL_REPLIES, SQL_CLOSED)),
    "unknown_replies": Check(unknown_replies, with_predictions(
        """SELECT 'cls_' || row_id || '_' || variant || '_gone' AS custom_id, predicted_label, confidence
           FROM closed_labels WHERE predicted_label IS NOT NULL""", CLOSED_M1, SQL_ANSWERS, SQL_REPLIES, SQL_CLOSED)),
    "response_states": Check(response_states, with_predictions(
        """SELECT status, CAST(3 * count(*) AS BIGINT) AS n FROM (
             SELECT status FROM answers UNION ALL SELECT 'succeeded' FROM answers WHERE g % 5 = 0) GROUP BY status""", CLOSED_M1, SQL_ANSWERS)),
}
