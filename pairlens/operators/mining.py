"""Example mining: short, telling rows out of the prediction tables.

Single picks are ``min`` aggregates and small picks are top-n queries, which Spark reduces inside
each partition before it moves rows; no group is gathered as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlens.fixed_values import NEUTRAL_READING, NOT_FOUND
from pairlens.operators.selection import variant_rank


def _length() -> Column:
    return F.char_length("sentence").alias("_length")


def shortest_failures(joined: DataFrame, strategies) -> DataFrame:
    """Per listed strategy the shortest rewrite that was called ambiguous."""
    rows = joined.where(F.col("variant").isin("masculine", "feminine") & (F.col("predicted_label") == "ambiguous")
                        & F.col("strategy").isin(*strategies))
    first = F.min(F.struct(_length(), "row_id", "variant", "sentence", "referent")).alias("first")
    return rows.groupBy("strategy").agg(first).select(
        "strategy", "first.row_id", "first.variant", "first.sentence", "first.referent")


def missing_referents(predictions: DataFrame, picks: int = 2) -> DataFrame:
    """The shortest ``not_found`` rows of distinct row ids."""
    shortest = (predictions.where(F.col("predicted_label") == NOT_FOUND)
                .select("row_id", "variant", "sentence", "referent", _length()))
    first = F.min(F.struct("_length", "variant", "sentence", "referent")).alias("first")
    return (shortest.groupBy("row_id").agg(first).orderBy("first._length", "row_id").limit(picks)
            .select("row_id", "first.variant", "first.sentence", "first.referent"))


def _both(first: DataFrame, second: DataFrame) -> DataFrame:
    a = first.select("row_id", "variant", "sentence", "referent", F.col("correct").alias("was_correct"))
    b = second.select("row_id", "variant", F.col("correct").alias("is_correct"), F.col("predicted_label").alias("now_label"),
                      *([F.col("raw_response")] if "raw_response" in second.columns else []))
    return a.join(b, ["row_id", "variant"])


def flips(first: DataFrame, second: DataFrame, strategies: DataFrame, listed) -> DataFrame:
    """Per listed strategy one row that the second run got right and the first did not.

    A masculine row is preferred, then the shortest. ``strategies``: row_id, strategy.
    """
    rows = _both(first, second).where(~F.col("was_correct") & F.col("is_correct"))
    rows = rows.join(strategies.where(F.col("strategy").isin(*listed)), "row_id")
    other = (F.col("variant") != "masculine").alias("_other")
    pick = F.min(F.struct(other, _length(), "row_id", "variant", "sentence", "referent")).alias("first")
    return rows.groupBy("strategy").agg(pick).select(
        "strategy", "first.row_id", "first.variant", "first.sentence", "first.referent")


def neutral_regressions(first: DataFrame, second: DataFrame, picks: int = 2) -> DataFrame:
    """Feminine rows lost to ``ambiguous`` in the second run, those whose reply speaks of a neutral reading first,
    then the shortest."""
    lost = _both(first, second).where(
        (F.col("variant") == "feminine") & F.col("was_correct") & ~F.col("is_correct") & (F.col("now_label") == "ambiguous"))
    said = F.lower(F.coalesce("raw_response", F.lit("")))
    neutral = F.exists(F.array(*[F.lit(w) for w in NEUTRAL_READING]), lambda w: F.contains(said, w))
    return (lost.withColumns({"_length": F.char_length("sentence"), "neutral_reading": neutral})
            .orderBy(F.desc("neutral_reading"), "_length", "row_id").limit(picks)
            .select("row_id", "variant", "sentence", "referent", "neutral_reading"))


def marked_reply(predictions: DataFrame, marker: str, within: int | None = None, partner: DataFrame | None = None) -> DataFrame:
    """The first source row whose reply has the marker (in its first ``within`` characters, if given), else the first
    source row; with ``partner``, another model's predictions, also its reply to that row (null if it has none)."""
    reply = F.coalesce("raw_response", F.lit(""))
    said = reply if within is None else F.left(reply, F.lit(within))
    rows = predictions.where(F.col("variant") == "source").withColumn("marked", F.contains(F.lower(said), F.lit(marker.lower())))
    picked = (rows.orderBy(F.desc("marked"), "row_id").limit(1)
              .select("row_id", "variant", "sentence", "referent", "expected_label", "raw_response", "marked"))
    if partner is None:
        return picked
    theirs = partner.select("row_id", "variant", F.col("raw_response").alias("partner_response"))
    return theirs.join(F.broadcast(picked), ["row_id", "variant"], "right").select(*picked.columns, "partner_response")


def head_per_run(rows: DataFrame, by, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of every run."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)


def confident_errors(predictions: DataFrame, by, n: int = 5) -> DataFrame:
    wrong = predictions.where(~F.col("correct"))
    return head_per_run(wrong, by, [F.desc_nulls_last("confidence"), F.col("row_id"), variant_rank(F.col("variant"))], n)


def bias_head(bias: DataFrame, by, n: int = 15) -> DataFrame:
    return head_per_run(bias, by, [F.desc("n_confident_guesses"), F.col("referent")], n)
