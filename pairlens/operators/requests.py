"""Request tables for generation, rubric evaluation, retry, grammaticality and classification.

System prompts are configuration. They are added by ``with_system`` when a table is written, so they
do not travel through shuffles with every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.fixed_values import (
    CANNED_CONFIDENCE, CANNED_REASON, CONDITIONS, LABELS, MAX_RETRIES, MAX_TOKENS, OPEN_CONDITIONS)
from pairlens.functions.columns import bind, is_true, present
from pairlens.functions.hashing import key_hash
from pairlens.functions.text import strip
from pairlens.operators.assignment import with_ordinal
from pairlens.operators.gathering import gather
from pairlens.operators.reshape import variant_rows
from pairlens.operators.routing import render_hint
from pairlens.operators.selection import drop_blank, retryable, undecided


def _line(*parts) -> Column:
    """Concatenate; null values read as nothing instead of voiding the message."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _requests(rows: DataFrame, kind: str, identity: Column, model: str, content: Column, *extra) -> DataFrame:
    return rows.select(
        F.concat(F.lit(f"{kind}_"), identity.cast("string")).alias("custom_id"), *extra,
        F.lit(model).alias("model"), F.lit(MAX_TOKENS[kind]).alias("max_tokens"),
        F.array(message("user", content)).alias("messages"))


def with_system(requests: DataFrame, prompt: str | Column) -> DataFrame:
    """Add the system block, marked for prompt caching; ``prompt`` is a text or a column."""
    block = F.struct(F.lit("text").alias("type"), (F.lit(prompt) if isinstance(prompt, str) else prompt).alias("text"),
                     F.struct(F.lit("ephemeral").alias("type")).alias("cache_control"))
    return requests.withColumn("system", F.array(block))


# The message formats below are fixed values.

def generation_requests(routed: DataFrame, model: str, grounded: bool = True) -> DataFrame:
    """Rewrite requests; with grounding, hint and assigned names follow the sentence.

    Needs ``hint``, ``assigned_surname`` and ``assigned_kin`` when grounded.
    """
    content = _line("Referent: ", F.col("referent"), "\nOriginal sentence: ", F.col("EN_source_sentence"))
    extra = []
    if grounded:
        hint = F.nullif(strip(render_hint(F.col("hint"))), F.lit(""))
        names = _line("ASSIGNED_SURNAME_IF_TITLE: ", F.col("assigned_surname"),
                      "\nASSIGNED_RELATIONAL_PAIR_IF_RELATIONAL: ", F.col("assigned_kin.masc"), "/",
                      F.col("assigned_kin.fem"))
        content = present([content, hint, names], "\n\n")
        extra = [F.coalesce(F.col("hint.strategy"), F.lit("")).alias("recommended_strategy")]
    return _requests(routed, "gen", F.col("row_id"), model, content, *extra)


def evaluation_requests(corpus: DataFrame, model: str, only_undecided: bool = False) -> DataFrame:
    """Rubric requests for rows with both rewrites."""
    rows = corpus.where(F.col("EN_masculine_sentence").isNotNull() & F.col("EN_feminine_sentence").isNotNull())
    if only_undecided:
        rows = undecided(rows)
    content = _line('Referent: "', F.col("referent"), '"\nOriginal: ', F.col("EN_source_sentence"),
                    "\nMasculine: ", F.col("EN_masculine_sentence"), "\nFeminine: ", F.col("EN_feminine_sentence"))
    return _requests(rows, "eval", F.col("row_id"), model, content)


def retry_feedback() -> Column:
    """What was wrong with the last attempt, in one line."""
    source, masc, fem, ref = (F.col(c) for c in (
        "EN_source_sentence", "EN_masculine_sentence", "EN_feminine_sentence", "referent"))
    issues, suggestion, failures = F.col("eval_issues"), F.col("eval_suggestion"), F.col("symbolic_check_failures")

    def nonblank(c: Column) -> Column:
        return is_true(strip(c) != "")

    parts = [
        F.when(is_true(masc == fem), F.lit("The masculine and feminine variants are IDENTICAL. They MUST differ.")),
        F.when(is_true((masc == source) & (fem == source)), F.lit("Both variants are UNCHANGED. You MUST make edits.")),
        F.when(is_true(F.col("eval_referent_disambiguated") <= 3), _line(
            "CRITICAL: The referent '", ref, "' was NOT disambiguated. Make sure the gender of '", ref,
            "' specifically is clear.")),
        F.when(is_true(F.col("eval_no_extra_sentence") <= 3), F.lit(
            "CRITICAL: You added a second sentence. All edits must be WITHIN the original sentence.")),
        F.when(is_true(F.col("eval_pos_change")), _line(
            "CRITICAL: You turned the referent '", ref,
            "' from a noun into an adjective. Keep it as a noun and try a different strategy.")),
        F.when(is_true(F.col("eval_correctness") < 4), _line("Correctness issue: ", issues)),
        F.when(is_true(F.col("eval_naturalness") < 4), _line("Naturalness issue: ", issues)),
        F.when(nonblank(failures), _line("SYMBOLIC CHECK FAILURES: ", failures)),
        F.when(nonblank(suggestion), _line("SUGGESTED FIX FROM EVALUATOR: ", suggestion)),
    ]
    return bind(present(parts, " "), lambda said: F.when(said != "", said).otherwise(
        _line("Previous attempt had issues: ", issues, ". Try a different strategy.")))


def retry_requests(corpus: DataFrame, model: str, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Requests with feedback for the rows that may be retried."""
    content = _line("Referent: ", F.col("referent"), "\nOriginal sentence: ", F.col("EN_source_sentence"),
                    "\n\nFEEDBACK ON PREVIOUS ATTEMPT: ", retry_feedback(),
                    "\n\nTry again with a better strategy.")
    return _requests(retryable(corpus, max_retries), "retry", F.col("row_id"), model, content)


def grammaticality_requests(corpus: DataFrame, model: str, prompt: str) -> DataFrame:
    """One scoring request per row; ``{sentence}`` in the prompt is replaced by the sentence."""
    before, after = prompt.split("{sentence}", 1)
    return _requests(corpus, "gram", F.col("row_id"), model, _line(before, F.col("EN_source_sentence"), after))


def question(open_task: bool) -> Column:
    """User turn of a classification request."""
    sentence = _line("Sentence: ", F.col("sentence"))
    return sentence if open_task else F.concat(sentence, _line("\nReferent: ", F.col("referent")))


def classification_requests(long: DataFrame, model: str, open_task: bool = False) -> DataFrame:
    """One request per long-form example."""
    identity = F.concat(F.col("row_id").cast("string"), F.lit("_"), F.col("variant"))
    return _requests(long, "cls", identity, model, question(open_task))


def condition_table(spark: SparkSession, prompts: dict[str, str], examples: dict[str, list[str]] | None = None) -> DataFrame:
    """Dimension table of conditions: system prompt, open or closed, example sentences."""
    unknown = set(prompts) - set(CONDITIONS)
    if unknown:
        raise ValueError(f"unknown condition: {sorted(unknown)}")
    rows = [(c, c in OPEN_CONDITIONS, p, (examples or {}).get(c, [])) for c, p in prompts.items()]
    return spark.createDataFrame(
        rows, "condition string, is_open boolean, system_prompt string, examples array<string>")


def condition_examples(conditions: DataFrame, condition: str) -> DataFrame:
    """The example sentences of a condition, for the overlap check: example_id, text."""
    return conditions.where(F.col("condition") == condition).select(
        F.posexplode("examples").alias("example_id", "text"))


def condition_requests(long: DataFrame, conditions: DataFrame, model: str) -> DataFrame:
    """Requests of every condition in one table, keyed by condition; prompts stay in the dimension.

    The dimension holds at most one row per known condition, so it can always be broadcast.
    """
    known = conditions.where(F.col("condition").isin(*CONDITIONS)).select("condition", "is_open")
    each = long.withColumn("condition", F.explode(F.array(*[F.lit(c) for c in CONDITIONS])))
    rows = each.join(F.broadcast(known), "condition")
    identity = F.concat(F.col("row_id").cast("string"), F.lit("_"), F.col("variant"))
    content = F.when(F.col("is_open"), question(True)).otherwise(question(False))
    return _requests(rows, "cls", identity, model, content, "condition", "is_open")


# ---------------------------------------------------------------- demonstrations

def demo_pool(corpus: DataFrame) -> DataFrame:
    """Labelled demonstrations: label, position in its label's pool, sentence, referent.

    Blank sentences and referents are dropped; rewrites need their own referent.
    """
    rows = drop_blank(variant_rows(corpus, referent_fallback=False), "sentence", "referent")
    return with_ordinal(rows, "row_id", "idx", within=("expected_label",)).select(
        F.col("expected_label").alias("label"), "idx", "sentence", "referent")


def draw_demos(long: DataFrame, pool: DataFrame, per_class: int = 2, seed: int = 0,
               ambiguous_only: bool = False) -> DataFrame:
    """Add ``demos``: array<struct<sentence, referent, gold>>, drawn per row without replacement.

    Each row draws a uniform subset of the positions of a label's pool by Floyd's method: one keyed hash per draw,
    no retry. Every draw is an equi-join on (label, position). A pool smaller than the number of draws is an error.
    The texts drawn are a multiple of the pool and pass one shuffle, packed (``gathering``). The pool's sizes are read
    while the plan is built.
    """
    wanted = [("ambiguous", per_class * len(LABELS))] if ambiguous_only else [(label, per_class) for label in LABELS]
    found = (pool.where(F.col("label").isin(*LABELS)).groupBy("label")
             .agg(F.count("*").alias("n"), F.sum(F.octet_length("sentence")).alias("bytes"))
             .unionByName(long.agg(F.lit(None).cast("string").alias("label"), F.count("*").alias("n"), F.lit(0).cast("bigint").alias("bytes"))))
    told = {r["label"]: r for r in found.collect()}  # one row per label, and the number of examples
    sizes = {label: told[label]["n"] if label in told else 0 for label, _ in wanted}
    drawn_bytes = told[None]["n"] * sum(k * (told[label]["bytes"] or 0) / max(1, sizes[label]) for label, k in wanted if label in told)

    def draws_of(label: str, k: int) -> Column:
        ident = (F.lit(seed), F.col("row_id"), F.col("variant"), F.lit(label))
        size = F.when(F.lit(sizes[label]) >= k, F.lit(sizes[label]).cast("bigint")).otherwise(F.raise_error(
            F.lit(f"pool of {label} has {sizes[label]} rows, {k} are drawn")).cast("bigint"))

        def draw(taken: Column, last: Column) -> Column:
            """A position up to ``last``; the last one itself if the drawn one is taken."""
            return bind(key_hash(*ident, F.lit("draw"), last) % (last + 1), lambda t: F.array_append(
                taken, F.when(F.array_contains(taken, t), last).otherwise(t)))

        positions = F.aggregate(F.sequence(size - k, size - 1), F.array().cast("array<bigint>"), draw)
        return F.transform(positions, lambda i: F.struct(
            key_hash(*ident, i).alias("shuffle"), F.lit(label).alias("label"), i.alias("idx")))

    order = F.array_sort(F.concat(*[draws_of(label, k) for label, k in wanted]))
    draws = long.select("row_id", "variant", F.posexplode(order).alias("pos", "d")).select("row_id", "variant", "pos", "d.label", "d.idx")
    taken = draws.join(pool.select("label", "idx", "sentence", "referent"), ["label", "idx"])
    return gather(long, taken.select("row_id", "variant", "pos", "sentence", "referent", F.col("label").alias("gold")),
                  ("row_id", "variant"), "pos", "demos", drawn_bytes)


def json_text(c: Column) -> Column:
    """The value as a JSON string literal."""
    wrapped = F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("v")))
    return F.substr(wrapped, F.lit(6), F.char_length(wrapped) - 6)


def json_members(*members) -> Column:
    """``{"name": value, ...}`` with values that are JSON text already."""
    parts = []
    for i, (name, value) in enumerate(members):
        parts += [F.lit(("{" if i == 0 else ", ") + f'"{name}": '), value]
    return F.concat(*parts, F.lit("}"))


def canned_reason(label: Column) -> Column:
    chain = None
    for name, reason in CANNED_REASON.items():
        chain = F.when(label == name, reason) if chain is None else chain.when(label == name, reason)
    return chain


def closed_target(label: Column) -> Column:
    """Assistant text of a closed example."""
    return json_members(("gender", json_text(label)), ("confidence", F.lit(str(CANNED_CONFIDENCE))),
                        ("reasoning", json_text(canned_reason(label))))


def open_target(referent: Column, label: Column) -> Column:
    """Assistant text of an open example with one referent."""
    entry = json_members(("referent", json_text(referent)), ("gender", json_text(label)),
                         ("confidence", F.lit(str(CANNED_CONFIDENCE))), ("reasoning", json_text(canned_reason(label))))
    return F.concat(F.lit('{"referents": ['), entry, F.lit("]}"))


def think_block(demo: Column, open_task: bool) -> Column:
    """Short canned reasoning in front of an assistant turn."""
    reason = canned_reason(demo["gold"])
    if open_task:
        parts = ['I read the sentence and look for role/occupation/relational nouns. For "', demo["referent"],
                 '" I check the surrounding context for gendered pronouns, titles, or morphology bound to it. ']
    else:
        parts = ['The referent is "', demo["referent"],
                 '". I check the sentence for gendered pronouns, titles, or morphology bound to it. ']
    return _line("<think>\n", *parts, reason, ", so the gender is ", demo["gold"], ".\n</think>\n")


def demo_messages(demos: Column, open_task: bool = False, include_think: bool = False) -> Column:
    """Alternating user and assistant turns of the demonstrations."""

    def turns(d: Column) -> Column:
        sentence = _line("Sentence: ", d["sentence"])
        if open_task:
            user, reply = sentence, open_target(d["referent"], d["gold"])
        else:
            user, reply = F.concat(sentence, _line("\nReferent: ", d["referent"])), closed_target(d["gold"])
        if include_think:
            reply = F.concat(think_block(d, open_task), reply)
        return F.array(message("user", user), message("assistant", reply))

    return F.flatten(F.transform(demos, turns))


def demo_trace(demos: Column) -> Column:
    """The demonstrations as JSON, for the prediction table."""
    return F.concat(F.lit("["), F.array_join(F.transform(demos, lambda d: json_members(
        ("sentence", json_text(d["sentence"])), ("referent", json_text(d["referent"])),
        ("gold", json_text(d["gold"])))), ", "), F.lit("]"))


def chat_messages(system_prompt: Column, user: Column, demos: Column | None = None) -> Column:
    """System turn, demonstrations if any, user turn."""
    first, last = F.array(message("system", system_prompt)), F.array(message("user", user))
    return F.concat(first, last) if demos is None else F.concat(first, demos, last)
