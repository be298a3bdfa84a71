"""Source-quality rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.fixed_values import (
    GENDERED_PRONOUNS, LOW_GRAMMATICALITY, MULTI_SENTENCE_TOKENS, PRE_GENDERED_WINDOW)
from pairlens.functions.columns import bind, is_true, present, settle, string_array
from pairlens.functions.text import BOUNDARY, tokens, words


def multi_sentence(sentence: Column, max_tokens: int = MULTI_SENTENCE_TOKENS) -> Column:
    """Longer than ``max_tokens`` and with an inner sentence boundary."""
    return is_true((F.size(tokens(sentence)) > max_tokens) & F.regexp_like(sentence, F.lit(BOUNDARY)))


def pre_gendered(sentence: Column, referent: Column, pronouns=GENDERED_PRONOUNS,
                 window: int = PRE_GENDERED_WINDOW) -> Column:
    """A gendered pronoun stands within ``window`` words of a word that starts with the referent."""
    ref = F.lower(referent)

    def near(found: Column) -> Column:
        def hit(word: Column, i: Column) -> Column:
            before = F.slice(found, F.greatest(i - window, F.lit(0)) + 1, F.least(i, F.lit(window)))
            after = F.slice(found, i + 2, F.lit(window))
            listed = string_array(pronouns)
            return F.startswith(word, ref) & (F.arrays_overlap(before, listed) | F.arrays_overlap(after, listed))

        return F.exists(F.transform(found, hit), lambda x: x)

    return is_true(bind(words(sentence), near))


def low_grammaticality(score: Column, threshold: int = LOW_GRAMMATICALITY) -> Column:
    return is_true(score <= threshold)


def with_scores(corpus: DataFrame, scores: DataFrame) -> DataFrame:
    """Attach ``grammaticality_score`` by row id; rows without a score stay."""
    return corpus.join(scores.select("row_id", "grammaticality_score"), "row_id", "left")


def quality_flags(corpus: DataFrame, pronouns=GENDERED_PRONOUNS, threshold: int = LOW_GRAMMATICALITY) -> DataFrame:
    """Add the three flags, ``flagged`` and the list of reasons.

    A corpus without ``grammaticality_score`` gets a null score, which never flags.
    """
    if "grammaticality_score" not in corpus.columns:
        corpus = corpus.withColumn("grammaticality_score", F.lit(None).cast("int"))
    sentence, score = F.col("EN_source_sentence"), F.col("grammaticality_score")
    flagged = settle(corpus, {
        "flag_multi_sentence": multi_sentence(sentence),
        "flag_pre_gendered": pre_gendered(sentence, F.col("referent"), pronouns),
        "flag_low_grammaticality": low_grammaticality(score, threshold)})
    reasons = present([
        F.when(F.col("flag_multi_sentence"), F.lit("multi_sentence")),
        F.when(F.col("flag_pre_gendered"), F.lit("pre_gendered")),
        F.when(F.col("flag_low_grammaticality"), F.concat(
            F.lit("low_grammaticality(score="), score.cast("string"), F.lit(")")))], ", ")
    return flagged.withColumns({
        "flagged": F.col("flag_multi_sentence") | F.col("flag_pre_gendered") | F.col("flag_low_grammaticality"),
        "flag_reasons": reasons})


def prefilter(corpus: DataFrame, pronouns=GENDERED_PRONOUNS, threshold: int = LOW_GRAMMATICALITY) -> DataFrame:
    """``filter_*`` flags, ``filter_any`` and ``auto_reject``; a pre-gendered source is no reject."""
    if "grammaticality_score" not in corpus.columns:
        corpus = corpus.withColumn("grammaticality_score", F.lit(None).cast("int"))
    sentence = F.col("EN_source_sentence")
    multi, gendered, low = (F.col(f"filter_{k}") for k in ("multi_sentence", "pre_gendered", "low_grammaticality"))
    return settle(corpus, {
        "filter_multi_sentence": multi_sentence(sentence),
        "filter_pre_gendered": pre_gendered(sentence, F.col("referent"), pronouns),
        "filter_low_grammaticality": low_grammaticality(F.col("grammaticality_score"), threshold),
    }).withColumns({"filter_any": multi | gendered | low, "auto_reject": multi | low})


def flag_counts(tagged: DataFrame) -> DataFrame:
    """One row with the number of rows per ``flag_``/``filter_`` flag and per verdict."""
    verdicts = ("flagged", "filter_any", "auto_reject")
    flags = [c for c in tagged.columns if c in verdicts or (
        c.startswith(("flag_", "filter_")) and c != "flag_reasons")]
    return tagged.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c)).alias(c) for c in flags])
