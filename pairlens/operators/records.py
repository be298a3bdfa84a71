"""Fine-tuning records in messages form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.fixed_values import CANNED_CONFIDENCE, LABELS, VARIANTS
from pairlens.functions.columns import ratio, settle
from pairlens.functions.jsontext import integer_field, last_object, string_field
from pairlens.functions.text import strip
from pairlens.operators.requests import closed_target, json_members, json_text, message, open_target
from pairlens.operators.responses import listed_referents, matching_entry
from pairlens.operators.reshape import variant_rows, to_wide


def _record(system_prompt: str, user: Column, assistant: Column) -> Column:
    return F.array(message("system", F.lit(system_prompt)), message("user", user), message("assistant", assistant))


def _examples(corpus: DataFrame, source_only: bool) -> DataFrame:
    """Examples with sentence and referent; a rewrite without its own referent is skipped."""
    rows = variant_rows(corpus, referent_fallback=False)
    if source_only:
        rows = rows.where(F.col("variant") == VARIANTS[0])
    filled = rows.where((F.coalesce(F.col("sentence"), F.lit("")) != "") & (F.coalesce(F.col("referent"), F.lit("")) != ""))
    return filled.withColumns({"sentence": strip(F.col("sentence")), "referent": strip(F.col("referent"))})


def closed_records(corpus: DataFrame, system_prompt: str, source_only: bool = False) -> DataFrame:
    """One record per example: sentence and referent in, label out."""
    user = F.concat(F.lit("Sentence: "), F.col("sentence"), F.lit("\nReferent: "), F.col("referent"))
    return _examples(corpus, source_only).select(
        "row_id", "variant", _record(system_prompt, user, closed_target(F.col("expected_label"))).alias("messages"))


def open_records(corpus: DataFrame, system_prompt: str, source_only: bool = False) -> DataFrame:
    """One record per example: sentence in, a list with the one known referent out."""
    user = F.concat(F.lit("Sentence: "), F.col("sentence"))
    return _examples(corpus, source_only).select(
        "row_id", "variant", _record(
            system_prompt, user, open_target(F.col("referent"), F.col("expected_label"))).alias("messages"))


def taught_referents(raw_response: Column) -> Column:
    """Cleaned referent list of an open reply, null if it has no usable entry.

    Entries need a referent and a valid label; a missing confidence becomes 5.
    """
    cleaned = F.transform(listed_referents(last_object(raw_response)), lambda e: F.struct(
        string_field(e, "referent").alias("referent"), string_field(e, "gender").alias("gender"),
        F.coalesce(integer_field(e, "confidence"), F.lit(CANNED_CONFIDENCE)).alias("confidence"),
        strip(F.coalesce(string_field(e, "reasoning"), F.lit(""))).alias("reasoning")))
    usable = F.filter(cleaned, lambda e: (F.coalesce(e["referent"], F.lit("")) != "") & e["gender"].isin(*LABELS))
    return F.transform(usable, lambda e: e.withField("referent", strip(e["referent"])))


def taught_rows(predictions: DataFrame) -> DataFrame:
    """Add ``refs`` (with the gold label put on the annotated entry) and ``outcome``.

    Outcomes: ``parse_error``, ``not_found``, ``overridden`` and ``kept``; the first two have no record.
    """
    rows = settle(predictions, {"_refs": taught_referents(F.col("raw_response"))})
    rows = settle(rows, {"_at": matching_entry(F.col("_refs"), F.col("referent"), lambda e: e["referent"])})
    rows = rows.withColumn("_said", F.when(F.col("_at").isNotNull(), F.try_element_at(
        F.col("_refs"), F.col("_at").cast("int"))["gender"]))
    empty = F.col("_refs").isNull() | (F.size("_refs") == 0)
    outcome = (F.when(empty, "parse_error").when(F.col("_at").isNull(), "not_found")
               .when(F.col("_said") != F.col("expected_label"), "overridden").otherwise("kept"))
    refs = F.transform(F.col("_refs"), lambda e, i: F.when(
        i + 1 == F.col("_at"), e.withField("gender", F.col("expected_label"))).otherwise(e))
    return rows.select(*predictions.columns, F.when(F.col("_at").isNotNull(), refs).alias("refs"), outcome.alias("outcome"))


def multi_records(taught: DataFrame, system_prompt: str) -> DataFrame:
    """Records that list every referent the teacher named."""
    entries = F.transform(F.col("refs"), lambda e: json_members(
        ("referent", json_text(e["referent"])), ("gender", json_text(e["gender"])),
        ("confidence", e["confidence"].cast("string")), ("reasoning", json_text(e["reasoning"]))))
    target = F.concat(F.lit('{"referents": ['), F.array_join(entries, ", "), F.lit("]}"))
    user = F.concat(F.lit("Sentence: "), F.col("sentence"))
    kept = taught.where(F.col("outcome").isin("kept", "overridden"))
    return kept.select("row_id", "variant", _record(system_prompt, user, target).alias("messages"))


def multi_counts(taught: DataFrame) -> DataFrame:
    """Build counters: rows read, dropped, overridden, kept, and referents per record."""
    def with_outcome(*names):
        return F.count_if(F.col("outcome").isin(*names))

    counts = taught.agg(
        F.count("*").alias("total"), with_outcome("parse_error").alias("parse_errors"),
        with_outcome("not_found").alias("not_found"), with_outcome("overridden").alias("overridden"),
        with_outcome("kept", "overridden").alias("kept"), F.coalesce(F.sum(F.size("refs")), F.lit(0)).alias("_refs"))
    return counts.select(
        "total", "parse_errors", "not_found", "overridden", "kept",
        (F.col("_refs") - F.col("kept")).alias("extra_referents"),
        ratio(F.col("_refs"), F.col("kept")).alias("mean_referents"))


def merge_teacher(corpus: DataFrame, predictions: DataFrame, prefix: str = "teacher") -> DataFrame:
    """Wide corpus with the teacher's reasoning, raw reply, label and verdict per variant."""
    wide = to_wide(predictions, {
        "reasoning": f"{prefix}_reasoning", "raw_response": f"{prefix}_raw_response",
        "predicted_label": f"{prefix}_predicted", "correct": f"{prefix}_correct"})
    return corpus.join(wide, "row_id", "left")


def merge_warnings(corpus: DataFrame, predictions: DataFrame) -> DataFrame:
    """Row-count and id-span checks of a teacher merge, one row."""
    ours = corpus.agg(F.count("*").alias("corpus_rows"), F.min("row_id").alias("corpus_first"),
                      F.max("row_id").alias("corpus_last")).withColumn("one", F.lit(1))
    theirs = predictions.agg(F.count("*").alias("prediction_rows"), F.min("row_id").alias("prediction_first"),
                             F.max("row_id").alias("prediction_last")).withColumn("one", F.lit(1))
    both = ours.join(theirs, "one").drop("one")
    return both.withColumns({
        "count_differs": F.col("prediction_rows") != F.col("corpus_rows") * len(VARIANTS),
        "span_differs": ~(F.col("prediction_first").eqNullSafe(F.col("corpus_first"))
                          & F.col("prediction_last").eqNullSafe(F.col("corpus_last")))})


def teacher_accuracy(merged: DataFrame, prefix: str = "teacher") -> DataFrame:
    """Correct and answered rows per variant; variants without an answer do not count."""
    sums = merged.agg(*[c for v in VARIANTS for c in (
        F.count(f"{prefix}_correct_{v}").alias(f"n_{v}"), F.count_if(F.col(f"{prefix}_correct_{v}")).alias(f"c_{v}"))])
    per = F.explode(F.array(*[F.struct(
        F.lit(v).alias("variant"), F.col(f"n_{v}").alias("n"), F.col(f"c_{v}").alias("correct"),
        F.when(F.col(f"n_{v}") > 0, ratio(F.col(f"c_{v}"), F.col(f"n_{v}"))).alias("accuracy"))
        for v in VARIANTS])).alias("r")
    return sums.select(per).select("r.*")
