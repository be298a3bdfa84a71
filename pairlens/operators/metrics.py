"""Scores of prediction tables.

Every function takes the run columns in ``by`` and scores all runs in one pass: a single aggregate
with a fixed set of conditional counts, unfolded afterwards on the few rows that are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlens.fixed_values import CONFIDENT, LABELS, PARSE_ERROR, POOLED_SOURCE, PREDICTION_LABELS
from pairlens.functions.columns import is_true, ratio

RUN = ("model", "condition", "thinking")


def _unfold(df: DataFrame, by, rows: list[Column]) -> DataFrame:
    """One output row per struct in ``rows``."""
    return df.select(*by, F.explode(F.array(*rows)).alias("_r")).select(*by, "_r.*")


def accuracy_columns() -> list[Column]:
    n, right = F.count("*"), F.count_if(F.col("correct"))
    return [n.alias("n"), ratio(right, n, 4).alias("accuracy")]


def attach_attributes(predictions: DataFrame, attributes: DataFrame) -> DataFrame:
    """Left join test-row attributes by ``row_id``. A task holds a hash table of its attributes, one row an example, and sorts none of
    the predictions, which are several for each run."""
    return predictions.join(attributes.hint("shuffle_hash"), "row_id", "left")


def overall(predictions: DataFrame, by=RUN) -> DataFrame:
    n, right = F.count("*"), F.count_if(F.col("correct"))
    return predictions.groupBy(*by).agg(
        n.alias("total"), right.alias("n_correct"), ratio(right, n).alias("accuracy"),
        F.count_if(F.col("predicted_label") == PARSE_ERROR).alias("parse_errors"))


def _cells() -> list[tuple[str, str, str]]:
    return [(f"_{e}_{p}", e, p) for e in LABELS for p in PREDICTION_LABELS]


def confusion(predictions: DataFrame, by=RUN) -> DataFrame:
    """Counts of all expected and predicted label pairs, zeros included; other labels are left out."""
    counted = predictions.groupBy(*by).agg(*[
        F.count_if((F.col("expected_label") == e) & (F.col("predicted_label") == p)).alias(name)
        for name, e, p in _cells()])
    return _unfold(counted, by, [
        F.struct(F.lit(e).alias("expected_label"), F.lit(p).alias("predicted_label"), F.col(name).alias("n"))
        for name, e, p in _cells()])


def confusion_share(matrix: DataFrame, by=RUN) -> DataFrame:
    """Each cell as a share of its expected label; an empty row has shares of 0."""
    row = Window.partitionBy(*by, "expected_label")
    return matrix.withColumn("fraction", ratio(F.col("n"), F.sum("n").over(row)))


def confusion_difference(predictions: DataFrame, run: str, first: str, second: str, by=()) -> DataFrame:
    """Cell counts of run ``second`` minus run ``first``, both read in one pass."""
    sign = F.when(F.col(run) == second, 1).otherwise(-1).cast("bigint")
    picked = predictions.where(F.col(run).isin(first, second))
    counted = picked.groupBy(*by).agg(*[
        F.coalesce(F.sum(F.when((F.col("expected_label") == e) & (F.col("predicted_label") == p), sign)),
                   F.lit(0)).cast("bigint").alias(name) for name, e, p in _cells()])
    return _unfold(counted, by, [
        F.struct(F.lit(e).alias("expected_label"), F.lit(p).alias("predicted_label"), F.col(name).alias("difference"))
        for name, e, p in _cells()])


def class_counts(predictions: DataFrame, by=RUN) -> DataFrame:
    """tp, fp and fn of each class as columns; failure labels only ever count as fn."""
    expected, predicted = F.col("expected_label"), F.col("predicted_label")
    aggregates = []
    for label in LABELS:
        said, is_it = is_true(predicted == label), is_true(expected == label)
        aggregates += [F.count_if(said & is_it).alias(f"tp_{label}"), F.count_if(said & ~is_it).alias(f"fp_{label}"),
                       F.count_if(~said & is_it).alias(f"fn_{label}")]
    return predictions.groupBy(*by).agg(*aggregates)


def prf_from_counts(counts: DataFrame, by=RUN) -> DataFrame:
    """Precision, recall and F1 per class, rounded to 4 places, and their macro row.

    The macro row averages the rounded class values and sums the counts.
    """
    scored = counts
    for label in LABELS:
        tp, fp, fn = (F.col(f"{k}_{label}") for k in ("tp", "fp", "fn"))
        scored = scored.withColumns({f"_p_{label}": ratio(tp, tp + fp), f"_r_{label}": ratio(tp, tp + fn)})
        p, r = F.col(f"_p_{label}"), F.col(f"_r_{label}")
        scored = scored.withColumns({
            f"p_{label}": F.round(p, 4), f"r_{label}": F.round(r, 4), f"f_{label}": F.round(ratio(2 * p * r, p + r), 4)})

    def row(name: str, values: dict[str, Column]) -> Column:
        return F.struct(F.lit(name).alias("label"), *[v.alias(k) for k, v in values.items()])

    short = {"precision": "p", "recall": "r", "f1": "f"}
    rows = [row(label, {**{k: F.col(f"{k}_{label}") for k in ("tp", "fp", "fn")},
                        **{k: F.col(f"{s}_{label}") for k, s in short.items()}}) for label in LABELS]
    rows.append(row("macro", {
        **{k: sum(F.col(f"{k}_{label}") for label in LABELS) for k in ("tp", "fp", "fn")},
        **{k: F.round(sum(F.col(f"{s}_{label}") for label in LABELS) / len(LABELS), 4) for k, s in short.items()}}))
    return _unfold(scored, by, rows)


def prf(predictions: DataFrame, by=RUN) -> DataFrame:
    return prf_from_counts(class_counts(predictions, by), by)


def counts_from_confusion(matrix: DataFrame, by=RUN) -> DataFrame:
    """tp, fp and fn out of a confusion table."""
    expected, predicted, n = F.col("expected_label"), F.col("predicted_label"), F.col("n")
    aggregates = []
    for label in LABELS:
        for k, hit in (("tp", (expected == label) & (predicted == label)),
                       ("fp", (expected != label) & (predicted == label)),
                       ("fn", (expected == label) & (predicted != label))):
            aggregates.append(F.coalesce(F.sum(F.when(hit, n)), F.lit(0)).alias(f"{k}_{label}"))
    return matrix.groupBy(*by).agg(*aggregates)


def accuracy_by_strategy(joined: DataFrame, by=RUN, strategy: str = "strategy") -> DataFrame:
    """Accuracy per strategy and variant, and one pooled row for all sources.

    Rewrites without a strategy are left out.
    """
    key = F.when(F.col("variant") == "source", F.lit(POOLED_SOURCE)).otherwise(F.col(strategy))
    return (joined.withColumn("strategy", key).where(F.col("strategy").isNotNull())
            .groupBy(*by, "strategy", "variant").agg(*accuracy_columns()))


def accuracy_by_flag(joined: DataFrame, flags, by=RUN) -> DataFrame:
    """Accuracy per flag and value; null values are left out, as are flags the table lacks.

    Rows are first counted per combination of all flags, so they are not repeated per flag.
    """
    known = [f for f in flags if f in joined.columns]
    combined = joined.groupBy(*by, *known).agg(
        F.count("*").alias("_n"), F.count_if(F.col("correct")).alias("_right"))
    each = F.explode(F.array(*[
        F.struct(F.lit(f).alias("flag"), F.col(f).cast("boolean").alias("value")) for f in known])).alias("_f")
    rows = combined.select(*by, "_n", "_right", each).select(*by, "_n", "_right", "_f.*").where(F.col("value").isNotNull())
    n, right = F.sum("_n"), F.sum("_right")
    return rows.groupBy(*by, "flag", "value").agg(n.alias("n"), ratio(right, n, 4).alias("accuracy"))


def accuracy_by_acceptance(joined: DataFrame, by=RUN) -> DataFrame:
    return (joined.where(F.col("accepted").isNotNull()).groupBy(*by, "accepted").agg(*accuracy_columns()))


def calibration(predictions: DataFrame, by=RUN) -> DataFrame:
    """Rows and mean confidence of right and wrong predictions; both rows are always there.

    Null confidences do not enter the mean; no rows at all give a mean of 0.
    """
    def side(flag: bool) -> list[Column]:
        hit = F.col("correct") == flag
        return [F.count_if(hit).alias(f"n_{flag}"), F.count(F.when(hit, F.col("confidence"))).alias(f"k_{flag}"),
                F.sum(F.when(hit, F.col("confidence"))).alias(f"s_{flag}")]

    counted = predictions.groupBy(*by).agg(*side(True), *side(False))
    return _unfold(counted, by, [F.struct(
        F.lit(flag).alias("correct"), F.col(f"n_{flag}").alias("n"),
        F.when(F.col(f"n_{flag}") == 0, F.lit(0.0)).otherwise(
            F.round(F.when(F.col(f"k_{flag}") > 0, F.col(f"s_{flag}").cast("double") / F.col(f"k_{flag}")), 3))
        .alias("mean_confidence")) for flag in (True, False)])


def top_referents(predictions: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` most frequent referents with their accuracy; ties in alphabetical order."""
    return (predictions.groupBy("referent").agg(*accuracy_columns())
            .orderBy(F.desc("n"), "referent").limit(n))


def bias_table(predictions: DataFrame, by=RUN, confident: int = CONFIDENT) -> DataFrame:
    """Confident gendered guesses on source rows, per referent."""
    guess = F.col("predicted_label")
    rows = predictions.where((F.col("variant") == "source") & guess.isin("masculine", "feminine")
                             & (F.coalesce(F.col("confidence"), F.lit(0)) >= confident)
                             & F.col("referent").isNotNull())
    masc, fem = F.count_if(guess == "masculine"), F.count_if(guess == "feminine")
    return rows.groupBy(*by, "referent").agg(
        F.count("*").alias("n_confident_guesses"), masc.alias("guessed_masculine"), fem.alias("guessed_feminine"),
        ratio(masc, masc + fem, 3).alias("male_share"))


def misclassified(predictions: DataFrame, highest: bool, n: int = 50) -> DataFrame:
    """The ``n`` wrong predictions with the lowest or highest confidence, nulls last."""
    confidence = F.col("confidence").desc_nulls_last() if highest else F.col("confidence").asc_nulls_last()
    return predictions.where(~F.col("correct")).orderBy(confidence, "row_id", "variant").limit(n)


# ---------------------------------------------------------------- runs against runs

def summary_metrics(predictions: DataFrame, by=RUN) -> DataFrame:
    """overall, macro_f1 and the three recalls of each run, in columns."""
    return summary_from_prf(prf(predictions, by), by)


def summary_from_prf(table: DataFrame, by=RUN) -> DataFrame:
    def value(label: str, column: str) -> Column:
        return F.max(F.when(F.col("label") == label, F.col(column)))

    tp, fn = value("macro", "tp"), value("macro", "fn")
    return table.groupBy(*by).agg(
        F.when(tp + fn > 0, ratio(tp, tp + fn)).alias("accuracy"), value("macro", "f1").alias("macro_f1"),
        value("masculine", "recall").alias("masc_recall"), value("feminine", "recall").alias("fem_recall"),
        value("ambiguous", "recall").alias("ambig_recall"))


def condition_summary(predictions: DataFrame, conditions) -> DataFrame:
    """Metric by condition, for at least two conditions."""
    if len(conditions) < 2:
        raise ValueError("a condition summary needs at least two conditions")
    by = ("condition",)
    runs = predictions.where(F.col("condition").isin(*conditions))
    table = prf(runs, by).join(overall(runs, by).select("condition", F.col("accuracy").alias("overall")), "condition")

    def value(label: str, column: str) -> Column:
        return F.max(F.when(F.col("label") == label, F.col(column)))

    metrics = {"overall": F.round(F.max("overall"), 4), "macro_f1": value("macro", "f1"),
               "ambiguity_recall": value("ambiguous", "recall"), "masculine_recall": value("masculine", "recall"),
               "feminine_recall": value("feminine", "recall")}
    wide = table.groupBy("condition").agg(*[v.alias(k) for k, v in metrics.items()])
    long = _unfold(wide, by, [F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in metrics])
    return long.groupBy("metric").pivot("condition", list(conditions)).agg(F.first("value"))


def comparison_pairs(conditions, baseline: str = "zero_shot") -> list[tuple[str, str]]:
    """The baseline against each other run, or every pair if there is no baseline."""
    if baseline in conditions:
        return [(baseline, c) for c in conditions if c != baseline]
    return [(a, b) for i, a in enumerate(conditions) for b in conditions[i + 1:]]


def side_by_side(predictions: DataFrame, run: str, values) -> DataFrame:
    """One row per (row_id, variant) with the label and verdict of every run.

    One shuffle serves any number of run pairs. A run without the row has a null verdict.
    """
    return predictions.where(F.col(run).isin(*values)).groupBy("row_id", "variant").agg(*[
        F.max(F.when(F.col(run) == v, F.struct("correct", "predicted_label"))).alias(v) for v in values])


def compare_runs(predictions: DataFrame, conditions, run: str = "condition", baseline: str = "zero_shot") -> DataFrame:
    """Fixed, broken, net gain and agreement of each run pair over the rows both have."""
    pairs = comparison_pairs(conditions, baseline)
    wide = side_by_side(predictions, run, conditions)
    aggregates = []
    for i, (a, b) in enumerate(pairs):
        first, second = F.col(a), F.col(b)
        both = first.isNotNull() & second.isNotNull()
        aggregates += [
            F.count_if(both).alias(f"n_{i}"),
            F.count_if(both & ~first["correct"] & second["correct"]).alias(f"fixed_{i}"),
            F.count_if(both & first["correct"] & ~second["correct"]).alias(f"broken_{i}"),
            F.count_if(both & is_true(first["predicted_label"] == second["predicted_label"])).alias(f"agree_{i}")]
    return _unfold(wide.agg(*aggregates), (), [F.struct(
        F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(f"n_{i}").alias("n"),
        F.col(f"fixed_{i}").alias("fixed"), F.col(f"broken_{i}").alias("broken"),
        (F.col(f"fixed_{i}") - F.col(f"broken_{i}")).alias("net_gain"), F.col(f"agree_{i}").alias("agree"),
        ratio(F.col(f"agree_{i}"), F.col(f"n_{i}"), 3).alias("agreement_rate"))
        for i, (a, b) in enumerate(pairs)])


def changed_rows(first: DataFrame, second: DataFrame, fixed: bool) -> DataFrame:
    """Rows that the second run fixed (or broke), with the labels of both runs."""
    a = first.select("row_id", "variant", "sentence", "referent", "expected_label",
                     F.col("correct").alias("first_correct"), F.col("predicted_label").alias("first_label"))
    b = second.select("row_id", "variant", F.col("correct").alias("second_correct"),
                      F.col("predicted_label").alias("second_label"))
    flip = (~F.col("first_correct") & F.col("second_correct")) if fixed else (F.col("first_correct") & ~F.col("second_correct"))
    return a.join(b, ["row_id", "variant"]).where(flip)


def _task_columns(kind: dict[str, str], value) -> list[Column]:
    return [value(task, column).alias(f"{task}_{out}") for task in ("closed", "open") for column, out in kind.items()]


_METRICS = {c: c for c in ("accuracy", "macro_f1", "masc_recall", "fem_recall", "ambig_recall")}


def leaderboard(summary: DataFrame) -> DataFrame:
    """One row per model with closed and open metrics side by side; needs model, task, metrics."""
    def value(task: str, column: str) -> Column:
        return F.max(F.when(F.col("task") == task, F.col(column)))

    board = summary.groupBy("model").agg(*_task_columns(_METRICS, value))
    return board.withColumn("closed_minus_open_acc", F.round(F.col("closed_accuracy") - F.col("open_accuracy"), 4))


def shot_deltas(zero: DataFrame, few: DataFrame) -> DataFrame:
    """Few-shot minus zero-shot accuracy per model, and the closed-open gaps of both leaderboards."""
    z = zero.select("model", F.col("closed_accuracy").alias("closed_zs"), F.col("open_accuracy").alias("open_zs"))
    f = few.select("model", F.col("closed_accuracy").alias("closed_fs"), F.col("open_accuracy").alias("open_fs"))
    c = F.col
    return z.join(f, "model").select(
        "model", "closed_zs", "closed_fs", (c("closed_fs") - c("closed_zs")).alias("closed_delta"),
        "open_zs", "open_fs", (c("open_fs") - c("open_zs")).alias("open_delta"),
        (c("closed_zs") - c("open_zs")).alias("closed_to_open_zs"),
        (c("closed_fs") - c("open_fs")).alias("closed_to_open_fs"))


def thinking_delta(summary: DataFrame) -> DataFrame:
    """Accuracy with thinking minus without, per model and task; needs model, task, thinking, accuracy."""
    def value(flag: bool) -> Column:
        return F.max(F.when(F.col("thinking") == flag, F.round("accuracy", 4)))

    both = summary.groupBy("model", "task").agg(value(False).alias("no_thinking"), value(True).alias("with_thinking"))
    return both.withColumn("delta", F.col("with_thinking") - F.col("no_thinking"))


def headline(summary: DataFrame) -> DataFrame:
    """Tidy table model, thinking, task and the five metrics, accuracy rounded to 4 places."""
    return summary.select("model", "thinking", "task", F.round("accuracy", 4).alias("accuracy"), "macro_f1",
                          "ambig_recall", "masc_recall", "fem_recall")


def strategy_across_models(by_strategy: DataFrame, models) -> DataFrame:
    """Masculine accuracy per strategy with a column per model; ``n`` is the first model's.

    A strategy that only some models have keeps nulls for the others, as a full outer join does.
    """
    rows = by_strategy.where((F.col("variant") == "masculine") & (F.col("strategy") != POOLED_SOURCE))
    return rows.groupBy("strategy").agg(
        F.max(F.when(F.col("model") == models[0], F.col("n"))).alias("n"),
        *[F.max(F.when(F.col("model") == m, F.col("accuracy"))).alias(f"accuracy_{m}") for m in models])


def bias_overlap(bias: DataFrame, n_models: int) -> DataFrame:
    """Bias rows with lower-cased referents, marked if every model has the referent for the task."""
    rows = bias.withColumn("referent", F.lower("referent"))
    shared = F.size(F.collect_set("model").over(Window.partitionBy("task", "referent"))) == n_models
    return rows.select("model", "task", "referent", "n_confident_guesses", "guessed_masculine",
                       "guessed_feminine", "male_share", shared.alias("cross_model_overlap"))


def bias_intersection(bias: DataFrame, first: str, second: str) -> DataFrame:
    """Referents that both models are biased on, per task, with the size of each set."""
    names = bias.select("model", "task", F.lower("referent").alias("referent")).distinct()
    per = names.groupBy("task", "referent").agg(
        F.max(F.col("model") == first).alias("a"), F.max(F.col("model") == second).alias("b"))
    return per.groupBy("task").agg(
        F.count_if("a").alias("n_first"), F.count_if("b").alias("n_second"),
        F.count_if(F.col("a") & F.col("b")).alias("n_both"))


def examples_across_runs(predictions: DataFrame, runs: dict[str, Column]) -> DataFrame:
    """One row per example with the outcome of every named run; ``runs`` maps names to run filters."""
    outcome = F.struct("predicted_label", "confidence", "correct")
    return predictions.groupBy("row_id", "variant").agg(*[
        F.max(F.when(condition, outcome)).alias(name) for name, condition in runs.items()])
