"""Evaluate-and-retry rounds over a corpus."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.fixed_values import ACCEPT_THRESHOLD, CLEARED_ON_RETRY, MAX_RETRIES
from pairlens.operators.selection import is_retryable, is_undecided, retryable, undecided
from pairlens.operators.validation import acceptance, symbolic_override
from pairlens.session import new_state_path

_STATE = {
    **{c: "double" for c in CLEARED_ON_RETRY if c.startswith("eval_")},
    "eval_issues": "string", "eval_strategy_label": "string", "eval_suggestion": "string",
    "eval_reject": "boolean", "eval_pos_change": "boolean", "accepted": "boolean",
    "retry_count": "int", "symbolic_checks_passed": "boolean", "symbolic_check_failures": "string"}
_REWRITE = ("EN_masculine_sentence", "EN_feminine_sentence", "disambiguation_strategy", "masc_referent", "fem_referent")


def with_state(corpus: DataFrame) -> DataFrame:
    """Add the state columns a fresh corpus lacks and fix the types of those it has."""
    return corpus.withColumns({
        c: (F.col(c) if c in corpus.columns else F.lit(None)).cast(kind) for c, kind in _STATE.items()})


def apply_evaluations(corpus: DataFrame, scores: DataFrame, threshold: float = ACCEPT_THRESHOLD,
                      use_symbolic: bool = True) -> DataFrame:
    """Write the scores of evaluated rows and decide on them; other rows keep their state.

    ``scores``: row_id and the ``eval_*`` columns. The symbolic checks then look at every accepted row.
    """
    columns = [c for c in CLEARED_ON_RETRY if c != "accepted"]
    given = scores.select("row_id", F.struct(*columns).alias("_scores"))
    joined = corpus.join(given, "row_id", "left")
    got = F.col("_scores").isNotNull()
    scored = joined.withColumns({
        c: F.when(got, F.col("_scores")[c]).otherwise(F.col(c)).cast(_STATE[c]) for c in columns})
    decided = scored.withColumn("accepted", F.when(got, acceptance(threshold)).otherwise(F.col("accepted")))
    decided = decided.select(*corpus.columns)
    return symbolic_override(decided).drop("symbolic_override") if use_symbolic else decided


def apply_retries(corpus: DataFrame, rewrites: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Take over the rewrites that came back and send every retryable row to a fresh evaluation.

    Rewrites are replaced only if a masculine sentence came back. Every retryable row loses its
    verdict and scores and gains a retry, answered or not; the symbolic columns stay as they are.
    """
    given = rewrites.select("row_id", F.struct(*_REWRITE).alias("_new"))
    joined = corpus.withColumn("_retry", is_retryable(max_retries)).join(given, "row_id", "left")
    retry = F.col("_retry")
    came = retry & F.coalesce(F.col("_new")["EN_masculine_sentence"].isNotNull(), F.lit(False))
    fallback = {"disambiguation_strategy": F.lit("unknown"), "masc_referent": F.col("referent"),
                "fem_referent": F.col("referent")}
    renewed = {c: F.when(came, F.coalesce(F.col("_new")[c], fallback[c]) if c in fallback else F.col("_new")[c])
               .otherwise(F.col(c)) for c in _REWRITE}
    cleared = {c: F.when(~retry, F.col(c)) for c in CLEARED_ON_RETRY}
    counted = F.coalesce("retry_count", F.lit(0)) + F.when(retry, 1).otherwise(0)
    count = F.when(retry, counted).otherwise(F.col("retry_count"))
    return joined.withColumns({**renewed, **cleared, "retry_count": count.cast("int")}).select(*corpus.columns)


def repair_rounds(corpus: DataFrame, evaluate: Callable[[DataFrame, int], DataFrame],
                  rewrite: Callable[[DataFrame, int], DataFrame], max_retries: int = MAX_RETRIES,
                  threshold: float = ACCEPT_THRESHOLD, use_symbolic: bool = True, path: str | None = None) -> DataFrame:
    """Up to ``max_retries + 1`` evaluation rounds, with retries in between.

    ``evaluate(rows, round)`` returns scores for the undecided rows with both rewrites, and
    ``rewrite(rows, round)`` new rewrites for the retryable ones. Each round writes the rows that were open as
    ``round=r`` under the shared folder and goes on with those that still are; rows that are settled never change
    again, so they are checked and written once. A lost executor costs no earlier round. The loop ends when nothing
    is retryable.
    """
    spark = corpus.sparkSession
    path = path or new_state_path(spark, "repair")
    state, settled = with_state(corpus), []
    for turn in range(max_retries + 1):
        open_rows = undecided(state).where(
            F.col("EN_masculine_sentence").isNotNull() & F.col("EN_feminine_sentence").isNotNull())
        decided = apply_evaluations(state, evaluate(open_rows, turn), threshold, use_symbolic)
        decided.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/round={turn}")
        state = spark.read.parquet(f"{path}/round={turn}")
        failed = retryable(state, max_retries)
        if turn == max_retries or failed.isEmpty():
            break
        goes_on = is_undecided() | is_retryable(max_retries)
        settled.append(state.where(~goes_on))
        state = apply_retries(state.where(goes_on), rewrite(failed, turn), max_retries)
    return reduce(DataFrame.unionByName, settled, state)
