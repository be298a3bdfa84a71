"""Deterministic checks of rewrites, the acceptance rule and review ratings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.fixed_values import (
    ACCEPT_THRESHOLD, EDIT_HARD_LIMIT, EDIT_SOFT_LIMIT, RATINGS, RUBRIC_COLUMNS, UNRATED)
from pairlens.functions.columns import bind, is_true, settle
from pairlens.functions.text import (
    contraction_drift, mentions, person_suffix_after, sentence_boundaries, stands_without_suffix, strip,
    word_distance)

_SWAP = "referent_swap"


def _result(passed: Column, message: Column) -> Column:
    return F.struct(passed.alias("passed"), F.coalesce(message, F.lit("")).alias("message"))


def _concat(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# Each check gives struct<passed, message>; the message formats are fixed values.

def edit_distance_check(source: Column, variant: Column, hard: int = EDIT_HARD_LIMIT,
                        soft: int = EDIT_SOFT_LIMIT) -> Column:
    """Fails beyond the hard limit; beyond the soft one it passes with a message."""
    return bind(word_distance(source, variant), lambda d: _result(
        d <= hard,
        F.when(d > hard, _concat("edit_distance=", d, f" exceeds hard limit {hard}"))
        .when(d > soft, _concat("edit_distance=", d, f" over soft limit {soft}"))))


def formatting_check(source: Column, variant: Column) -> Column:
    """Fails when a contraction spelled with a space in the source is tight in the variant."""
    return bind(contraction_drift(source, variant), lambda m: _result(
        m.isNull(), _concat("formatting drift: '", m["found"], "' -> '", m["tight"], "'")))


def extra_sentence_check(source: Column, variant: Column) -> Column:
    counts = F.struct(sentence_boundaries(source).alias("s"), sentence_boundaries(variant).alias("v"))
    return bind(counts, lambda n: _result(
        n["v"] <= n["s"],
        F.when(n["v"] > n["s"], _concat("variant has ", n["v"], " sentence boundaries vs source's ", n["s"]))))


def variants_differ_check(masc: Column, fem: Column) -> Column:
    same = strip(masc) == strip(fem)
    return _result(~same, F.when(same, F.lit("masculine and feminine variants are identical")))


def variants_edited_check(source: Column, masc: Column, fem: Column) -> Column:
    unedited = (strip(masc) == strip(source)) & (strip(fem) == strip(source))
    return _result(~unedited, F.when(unedited, F.lit("both variants identical to the source")))


def referent_kept_check(source: Column, variant: Column, referent: Column, strategy: Column) -> Column:
    """Fails when the source names the referent and the variant does not; swaps are exempt."""
    applies = (strategy != _SWAP) & (referent != "")
    lost = F.when(applies, mentions(source, referent, plural=True) & ~mentions(variant, referent, plural=True))
    return bind(is_true(lost), lambda bad: _result(~bad, F.when(bad, _concat(
        "referent '", referent, "' was removed under non-swap strategy '", strategy, "'"))))


def pos_change_check(source: Column, variant: Column, referent: Column) -> Column:
    """Fails when "the X" of the source became "the X man" (woman, ...) in the variant."""
    suffix = F.when((referent != "") & stands_without_suffix(source, referent), person_suffix_after(variant, referent))
    return bind(F.coalesce(suffix, F.lit("")), lambda s: _result(s == "", F.when(s != "", _concat(
        "possible POS change: '", referent, " ", s, "' turns referent into adjective"))))


def check_results() -> Column:
    """All twelve checks of a row: array<struct<check, passed, message>>; nulls count as ''."""
    source, masc, fem, referent = (F.coalesce(F.col(c), F.lit("")) for c in (
        "EN_source_sentence", "EN_masculine_sentence", "EN_feminine_sentence", "referent"))
    chosen = F.nullif(F.col("disambiguation_strategy"), F.lit(""))
    strategy = F.coalesce(chosen, F.col("eval_strategy_label"), F.lit(""))
    sides = (("masc", masc), ("fem", fem))
    checks = [
        *[(f"edit_distance_{k}", edit_distance_check(source, v)) for k, v in sides],
        *[(f"formatting_{k}", formatting_check(source, v)) for k, v in sides],
        *[(f"no_extra_sentence_{k}", extra_sentence_check(source, v)) for k, v in sides],
        ("variants_differ", variants_differ_check(masc, fem)),
        ("variants_edited", variants_edited_check(source, masc, fem)),
        *[(f"referent_preserved_{k}", referent_kept_check(source, v, referent, strategy)) for k, v in sides],
        *[(f"no_pos_change_{k}", pos_change_check(source, v, referent)) for k, v in sides],
    ]
    return F.array(*[bind(result, _named(name)) for name, result in checks])


def _named(name: str):
    return lambda r: F.struct(F.lit(name).alias("check"), r["passed"].alias("passed"), r["message"].alias("message"))


def _with_strategy_columns(df: DataFrame) -> DataFrame:
    for c in ("disambiguation_strategy", "eval_strategy_label"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return df


def all_passed(results: Column) -> Column:
    return F.forall(results, lambda r: r["passed"])


def messages(results: Column) -> Column:
    """Failures and soft messages as ``check: message``."""
    told = F.filter(results, lambda r: ~r["passed"] | (r["message"] != ""))
    return F.transform(told, lambda r: F.concat(r["check"], F.lit(": "), r["message"]))


def validate(corpus: DataFrame) -> DataFrame:
    """Add ``checks``, ``passed`` and ``messages``."""
    checked = settle(_with_strategy_columns(corpus), {"checks": check_results()})
    checked = checked.withColumns({"passed": all_passed(F.col("checks")), "messages": messages(F.col("checks"))})
    return checked.select(*corpus.columns, "checks", "passed", "messages")


def acceptance(threshold: float = ACCEPT_THRESHOLD) -> Column:
    """Verdict of the rubric scores: reject and part-of-speech change first, then the two hard
    minimums, then the mean of the five scores with nulls as 0."""
    disambiguated, extra = F.col("eval_referent_disambiguated"), F.col("eval_no_extra_sentence")
    total = sum(F.coalesce(F.col(c), F.lit(0)).cast("double") for c in RUBRIC_COLUMNS)
    return (F.when(is_true(F.col("eval_reject")), F.lit(False))
            .when(is_true(F.col("eval_pos_change")), F.lit(False))
            .when(is_true(disambiguated <= 2), F.lit(False))
            .when(is_true(extra <= 2), F.lit(False))
            .otherwise(total / len(RUBRIC_COLUMNS) >= threshold))


def symbolic_override(corpus: DataFrame) -> DataFrame:
    """Run the checks on accepted rows only; a failure withdraws the acceptance and is noted.

    Rows that were not accepted keep whatever symbolic columns they had.
    """
    base = _with_strategy_columns(corpus)
    for name, kind in (("symbolic_checks_passed", "boolean"), ("symbolic_check_failures", "string")):
        if name not in base.columns:
            base = base.withColumn(name, F.lit(None).cast(kind))
    accepted = is_true(F.col("accepted"))
    checked = settle(base, {"_checks": F.when(accepted, check_results())})
    checked = checked.withColumns({
        "_passed": all_passed(F.col("_checks")), "_messages": messages(F.col("_checks"))})
    failed = accepted & ~F.col("_passed")
    noted = strip(F.concat(F.coalesce(F.col("eval_issues"), F.lit("")), F.lit(" [SYMBOLIC] "),
                           F.array_join("_messages", " | ")))
    return checked.withColumns({
        "symbolic_checks_passed": F.when(accepted, F.col("_passed")).otherwise(F.col("symbolic_checks_passed")),
        "symbolic_check_failures": F.when(accepted, F.array_join("_messages", "; "))
        .otherwise(F.col("symbolic_check_failures")),
        "eval_issues": F.when(failed, noted).otherwise(F.col("eval_issues")),
        "accepted": F.when(failed, F.lit(False)).otherwise(F.col("accepted")),
        "symbolic_override": failed,
    }).select(*corpus.columns, *[c for c in (
        "symbolic_checks_passed", "symbolic_check_failures") if c not in corpus.columns], "symbolic_override")


def normal_rating(value: Column) -> Column:
    """good, meh, bad; blank becomes ``(unrated)`` and anything else ``(other: x)``."""
    return bind(F.lower(strip(F.coalesce(value, F.lit("")))), lambda s: (
        F.when(s == "", F.lit(UNRATED)).when(s.isin(*RATINGS), s)
        .otherwise(F.concat(F.lit("(other: "), s, F.lit(")")))))


def has_great(value: Column) -> Column:
    """The comment says "great" as a word of its own."""
    return is_true(F.regexp_like(value, F.lit(r"(?iu)(?<![\p{L}\p{N}_])great(?![\p{L}\p{N}_])")))
