"""Reports over generated rows, evaluation rounds, strata and human reviews."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlens.fixed_values import (
    APPOSITIVE_WARNING_SHARE, EDIT_SOFT_LIMIT, NOT_FOUND, OK_RATINGS, PARSE_ERROR, RATINGS, RUBRIC_COLUMNS,
    SAMPLE_RUBRIC, STRATA_NAMES, STRATA_TOTAL)
from pairlens.functions.columns import is_true, ratio, settle
from pairlens.functions.text import strip, word_distance
from pairlens.operators.reshape import strategy_display
from pairlens.operators.validation import has_great, normal_rating


# ---------------------------------------------------------------- generation

def generation_metrics(corpus: DataFrame) -> DataFrame:
    """Per row: case-blind edit distances, equality flags, and an error flag for missing rewrites.

    Rows in error have null metrics.
    """
    source, masc, fem = (F.col(f"EN_{k}_sentence") for k in ("source", "masculine", "feminine"))
    error = masc.isNull() | fem.isNull()

    def unless_error(value: Column) -> Column:
        return F.when(~error, value)

    measured = settle(corpus, {
        "strategy": unless_error(F.coalesce(F.col("disambiguation_strategy"), F.lit("unknown"))),
        "masc_edit_dist": unless_error(word_distance(source, masc, ignore_case=True)),
        "fem_edit_dist": unless_error(word_distance(source, fem, ignore_case=True)),
        "masc_equals_original": unless_error(strip(masc) == strip(source)),
        "fem_equals_original": unless_error(strip(fem) == strip(source)),
        "masc_equals_fem": unless_error(strip(masc) == strip(fem)), "error": error})
    return measured.select("row_id", "referent", "strategy", "masc_edit_dist", "fem_edit_dist", "masc_equals_original",
                           "fem_equals_original", "masc_equals_fem", "error")


def generation_report(metrics: DataFrame, limit: int = EDIT_SOFT_LIMIT) -> DataFrame:
    """One row: success rate, edit distances and flag sums."""
    n, errors = F.count("*"), F.count_if("error")
    return metrics.agg(
        n.alias("total"), errors.alias("errors"), ratio(n - errors, n).alias("success_rate"),
        F.avg("masc_edit_dist").alias("masc_mean"), F.avg("fem_edit_dist").alias("fem_mean"),
        F.max("masc_edit_dist").alias("masc_max"), F.max("fem_edit_dist").alias("fem_max"),
        F.count_if("masc_equals_original").alias("masc_unedited"), F.count_if("fem_equals_original").alias("fem_unedited"),
        F.count_if("masc_equals_fem").alias("identical"), F.count_if(_far(limit)).alias("high_edit"))


def _far(limit: int) -> Column:
    return is_true((F.col("masc_edit_dist") > limit) | (F.col("fem_edit_dist") > limit))


def strategy_counts(metrics: DataFrame) -> DataFrame:
    """Strategies of the rows without error."""
    return metrics.where(~F.col("error")).groupBy("strategy").agg(F.count("*").alias("n"))


def high_edit_rows(metrics: DataFrame, corpus: DataFrame, limit: int = EDIT_SOFT_LIMIT) -> DataFrame:
    """Rows with an edit distance over the limit, with their sentences."""
    far = metrics.where(_far(limit)).select("row_id", "masc_edit_dist", "fem_edit_dist")
    return far.join(corpus.select("row_id", "referent", "EN_source_sentence", "EN_masculine_sentence",
                                  "EN_feminine_sentence"), "row_id")


def rubric_means(scored: DataFrame, criteria=SAMPLE_RUBRIC) -> DataFrame:
    """Mean of each criterion over the rows that have it."""
    means = scored.agg(*[c for k in criteria for c in (F.avg(k).alias(f"m_{k}"), F.count(k).alias(f"n_{k}"))])
    rows = F.explode(F.array(*[F.struct(
        F.lit(k).alias("criterion"), F.col(f"n_{k}").alias("n"), F.col(f"m_{k}").alias("mean")) for k in criteria]))
    return means.select(rows.alias("r")).select("r.*")


def issue_list(scored: DataFrame) -> DataFrame:
    return scored.where(F.coalesce(F.col("issues"), F.lit("")) != "").select("row_id", "referent", "issues")


# ---------------------------------------------------------------- evaluation rounds

def round_summary(corpus: DataFrame) -> DataFrame:
    """One row: accepted share, mean of each score, rejects, and the appositive overuse warning."""
    n, accepted = F.count("*"), F.count_if("accepted")
    dashes = F.count_if(is_true(F.col("accepted")) & is_true(F.col("eval_strategy_label") == "appositive_dash"))
    return corpus.agg(
        n.alias("total"), accepted.alias("accepted"), ratio(accepted, n).alias("accepted_share"),
        *[F.avg(c).alias(c.replace("eval_", "mean_")) for c in RUBRIC_COLUMNS],
        F.count_if("eval_reject").alias("rejected"), dashes.alias("appositive_dash"),
        (ratio(dashes, accepted) > APPOSITIVE_WARNING_SHARE).alias("appositive_warning"))


def accepted_strategies(corpus: DataFrame) -> DataFrame:
    """Strategies among the accepted rows with their share."""
    counts = (corpus.where(is_true(F.col("accepted")) & F.col("eval_strategy_label").isNotNull())
              .groupBy(F.col("eval_strategy_label").alias("strategy")).agg(F.count("*").alias("n")))
    accepted = corpus.agg(F.count_if("accepted").alias("accepted"))
    one = counts.withColumn("_one", F.lit(1)).join(F.broadcast(accepted.withColumn("_one", F.lit(1))), "_one")
    return one.select("strategy", "n", ratio(F.col("n"), F.greatest("accepted", F.lit(1))).alias("share"))


def appositive_examples(corpus: DataFrame, n: int = 3) -> DataFrame:
    """First accepted rows with a dashed appositive."""
    return (corpus.where(is_true(F.col("accepted")) & (F.col("eval_strategy_label") == "appositive_dash"))
            .orderBy("row_id").limit(n).select("row_id", "referent", "EN_masculine_sentence"))


# ---------------------------------------------------------------- strata

def with_outcome_flags(joined: DataFrame, strategy: str = "disambiguation_strategy") -> DataFrame:
    """Add display strategy, cue group, parsed, matched and correct-within-matched.

    A missing prediction counts as parsed and matched, as it equals neither failure label.
    """
    shown = strategy_display(F.col(strategy))
    label = F.coalesce(F.col("predicted_label"), F.lit(""))
    matched = ~label.isin(PARSE_ERROR, NOT_FOUND)
    return joined.withColumns({
        "display": shown["display"], "cue_group": shown["cue_group"], "parsed": label != PARSE_ERROR,
        "matched": matched, "correct_in_match": matched & F.col("correct")})


def strata(flagged: DataFrame) -> DataFrame:
    """Parse, match and accuracy percentages per strategy, per cue group and in total.

    One grouping-sets pass; rows without a known strategy count in the total only.
    """
    sums = [F.count("*").alias("n"), F.count_if("parsed").alias("n_parsed"), F.count_if("matched").alias("n_matched"),
            F.count_if("correct_in_match").alias("n_correct"), F.grouping_id().alias("level")]
    keys = [F.col("cue_group"), F.col("display")]
    grouped = flagged.groupingSets([keys, keys[:1], []], *keys).agg(*sums)
    level = F.col("level")
    names = F.create_map(*[F.lit(v) for pair in STRATA_NAMES.items() for v in pair])
    stratum = (F.when(level == 0, F.col("display")).when(level == 1, F.try_element_at(names, F.col("cue_group")))
               .otherwise(F.lit(STRATA_TOTAL)))
    return grouped.withColumn("stratum", stratum).where(F.col("stratum").isNotNull()).select(
        "stratum", "n", (ratio(F.col("n_parsed"), F.col("n")) * 100).alias("parse_pct"),
        (ratio(F.col("n_matched"), F.col("n")) * 100).alias("match_pct"),
        F.when(F.col("n_matched") > 0, ratio(F.col("n_correct"), F.col("n_matched")) * 100)
        .otherwise(F.lit(math.nan)).alias("acc_match"),
        (ratio(F.col("n_correct"), F.col("n")) * 100).alias("acc_all"), "n_matched", "n_correct")


_TAIL_TERMS = 150


def tail_probability(chi2: Column) -> Column:
    """Upper tail of the chi-square distribution with one degree of freedom: erfc(sqrt(chi2 / 2)).

    Below 18 one minus the series of positive terms, above it the continued fraction; both are evaluated from the last term on.
    """
    terms, half = F.sequence(F.lit(_TAIL_TERMS), F.lit(1)), chi2 / 2
    series = F.aggregate(terms, F.lit(1.0), lambda a, k: a * chi2 / (k * 2 + 1) + 1.0)
    fraction = F.aggregate(terms, F.lit(1.0), lambda a, k: k / (chi2 * a) + 1.0)
    density = F.exp(-half) / F.lit(math.sqrt(math.pi))
    return (F.when(chi2 <= 0, F.lit(1.0)).when(chi2 < 18, F.lit(1.0) - density * 2.0 * F.sqrt(half) * series)
            .otherwise(density / (F.sqrt(half) * fraction)))


def chi_square(flagged: DataFrame, with_p: bool = True) -> DataFrame:
    """Cue group against parsed: the four counts and Pearson's statistic with Yates' correction.

    A table with an empty row or column has no degree of freedom, statistic 0 and p 1.
    """
    cells = {f"{g}_{k}": (F.col("cue_group") == g) & (F.col("parsed") == (k == "parsed"))
             for g in ("local", "cross") for k in ("parsed", "unparsed")}
    counts = flagged.agg(*[F.count_if(c).alias(name) for name, c in cells.items()])
    rows = {g: F.col(f"{g}_parsed") + F.col(f"{g}_unparsed") for g in ("local", "cross")}
    columns = {k: F.col(f"local_{k}") + F.col(f"cross_{k}") for k in ("parsed", "unparsed")}
    total = rows["local"] + rows["cross"]
    full = (rows["local"] > 0) & (rows["cross"] > 0) & (columns["parsed"] > 0) & (columns["unparsed"] > 0)
    statistic = F.lit(0.0)
    for g, row in rows.items():
        for k, column in columns.items():
            expected = row.cast("double") * column / total
            gap = F.abs(F.col(f"{g}_{k}") - expected)
            moved = gap - F.least(F.lit(0.5), gap)
            statistic = statistic + moved * moved / expected
    out = counts.select(*cells, F.when(full, statistic).otherwise(F.lit(0.0)).alias("chi2"),
                        F.when(full, F.lit(1)).otherwise(F.lit(0)).alias("dof"))
    if not with_p:
        return out
    return out.withColumn("p", F.when(F.col("dof") == 1, tail_probability(F.col("chi2"))).otherwise(F.lit(1.0)))


def matched_accuracy(flagged: DataFrame) -> DataFrame:
    n = F.count_if("matched")
    return flagged.agg(n.alias("n_matched"), F.when(n > 0, ratio(F.count_if("correct_in_match"), n)).alias("accuracy"))


# ---------------------------------------------------------------- human review

def rated(review: DataFrame) -> DataFrame:
    """Add the normalised rating, the "great" marker and the strategy with ``(missing)`` for null."""
    return review.withColumns({
        "rating": normal_rating(F.col("eval_human")), "has_great": has_great(F.col("eval_human_explained")),
        "strategy": F.coalesce("eval_strategy_label", F.lit("(missing)"))})


def rating_counts(reviews: DataFrame) -> DataFrame:
    """Count and percent of good, meh, bad, ok and, if there are any, all others."""
    hit = {r: F.col("rating") == r for r in RATINGS}
    hit["ok (good+meh)"] = F.col("rating").isin(*OK_RATINGS)
    hit["other/unrated"] = ~F.col("rating").isin(*RATINGS)
    counts = reviews.agg(F.count("*").alias("total"), *[F.count_if(c).alias(f"n{i}") for i, c in enumerate(hit.values())])
    rows = F.explode(F.array(*[F.struct(F.lit(r).alias("rating"), F.col(f"n{i}").alias("count"))
                               for i, r in enumerate(hit)]))
    return counts.select("total", rows.alias("r")).select(
        "r.rating", "r.count", ratio(100 * F.col("r.count"), F.col("total"), 1).alias("percent")).where(
        (F.col("rating") != "other/unrated") | (F.col("count") > 0))


def great_count(reviews: DataFrame) -> DataFrame:
    return reviews.agg(F.count_if("has_great").alias("n_great"))


def rating_by_strategy(reviews: DataFrame) -> DataFrame:
    """Ratings per strategy; ``n`` counts unrated and other ratings too."""
    n = F.count("*")
    return reviews.groupBy("strategy").agg(
        n.alias("n"), *[F.count_if(F.col("rating") == r).alias(r) for r in RATINGS],
        ratio(100 * F.count_if(F.col("rating").isin(*OK_RATINGS)), n, 1).alias("pct_ok"))
