"""Metrics on small tables and the published confusion -> PRF -> leaderboard chain."""

import math
import os

import pytest
from pyspark.sql import functions as F

from pairlens.fixed_values import LABELS, PREDICTION_LABELS
from pairlens.operators import metrics as M
from pairlens.operators import reports as L
from pairlens.plans.evaluation import evaluate_runs, write_evaluation

PRED = ("row_id bigint, variant string, sentence string, referent string, expected_label string, predicted_label string, "
        "confidence int, model string, condition string, thinking boolean, correct boolean")


@pytest.fixture
def preds(spark):
    rows = []
    for i, (e, p, c) in enumerate([("ambiguous", "masculine", 5), ("ambiguous", "ambiguous", 3), ("masculine", "masculine", None),
                                   ("feminine", "parse_error", None), ("feminine", None, None), ("masculine", "ambiguous", 4)]):
        variant = {"ambiguous": "source"}.get(e, e)
        rows.append((i, variant, "s" * (i + 1), "cook", e, p, c, "m", "zero_shot", False, p == e))
    return spark.createDataFrame(rows, PRED)


def test_published_chain(spark):
    # Published confusion of one open run; its PRF and accuracy are published too.
    counts = {"masculine": (293, 0, 163, 0, 9), "feminine": (0, 295, 157, 0, 13), "ambiguous": (2, 3, 447, 0, 13)}
    cells = [("m", "zero_shot_identify", True, e, p, n) for e, row in counts.items() for p, n in zip(PREDICTION_LABELS, row)]
    matrix = spark.createDataFrame(cells, "model string, condition string, thinking boolean, expected_label string, predicted_label string, n bigint")
    table = M.prf_from_counts(M.counts_from_confusion(matrix))
    got = {r["label"]: (r["tp"], r["fp"], r["fn"], r["precision"], r["recall"], r["f1"]) for r in table.collect()}
    assert got == {"masculine": (293, 2, 172, 0.9932, 0.6301, 0.7711), "feminine": (295, 3, 170, 0.9899, 0.6344, 0.7733),
                   "ambiguous": (447, 320, 18, 0.5828, 0.9613, 0.7256), "macro": (1035, 325, 360, 0.8553, 0.7419, 0.7567)}
    summary = M.summary_from_prf(table).withColumn("task", F.lit("open"))
    board = M.leaderboard(summary).first()
    assert round(board["open_accuracy"], 4) == 0.7419 and board["closed_accuracy"] is None and board["closed_minus_open_acc"] is None


def test_prf_counts_add_up(preds):
    rows = {r["label"]: r for r in M.prf(preds).collect()}
    for label in LABELS:
        assert rows[label]["tp"] + rows[label]["fn"] == 2
    assert rows["macro"]["tp"] == 2 and rows["feminine"]["precision"] == 0.0
    assert M.confusion(preds).agg(F.sum("n")).first()[0] == 5  # the missing prediction is left out
    assert M.overall(preds).first()["parse_errors"] == 1


def test_calibration_has_both_rows(preds):
    got = {r["correct"]: (r["n"], r["mean_confidence"]) for r in M.calibration(preds).collect()}
    assert got == {True: (2, 3.0), False: (4, 4.5)}
    right = M.calibration(preds.where("correct"))
    assert {r["correct"]: (r["n"], r["mean_confidence"]) for r in right.collect()} == {True: (2, 3.0), False: (0, 0.0)}


def test_bias_and_slices(preds, spark):
    assert M.bias_table(preds).first()["male_share"] == 1.0
    flags = spark.createDataFrame([(0, True), (1, False), (2, None)], "row_id bigint, filter_any boolean")
    got = {(r["flag"], r["value"]): r["n"] for r in M.accuracy_by_flag(preds.join(flags, "row_id", "left"), ("filter_any", "gone")).collect()}
    assert got == {("filter_any", True): 1, ("filter_any", False): 1}
    order = [r["confidence"] for r in M.misclassified(preds, highest=False).collect()]
    assert order == [4, 5, None, None]
    assert [r["confidence"] for r in M.misclassified(preds, highest=True).collect()] == [5, 4, None, None]


def test_run_comparison_identity(spark):
    rows = []
    for i in range(40):
        for c, ok in (("zero_shot", i % 3 == 0), ("few_shot", i % 4 == 0), ("few_shot_full", i % 5 > 1)):
            if not (c == "few_shot" and i == 7):
                rows.append((i, "source", "s", "r", "ambiguous", "ambiguous" if ok else "masculine", 1, "m", c, False, ok))
    df = spark.createDataFrame(rows, PRED)
    got = {r["second"]: r for r in M.compare_runs(df, ("zero_shot", "few_shot", "few_shot_full")).collect()}
    assert got["few_shot"]["n"] == 39
    right = {r["condition"]: r["n_correct"] for r in M.overall(df).collect()}
    assert got["few_shot_full"]["net_gain"] == right["few_shot_full"] - right["zero_shot"]
    assert M.comparison_pairs(("a", "b", "c")) == [("a", "b"), ("a", "c"), ("b", "c")]
    with pytest.raises(ValueError):
        M.condition_summary(df, ("zero_shot",))


def test_strata_and_chi_square(spark):
    rows = []
    for strategy, parsed, n in (("adjective", True, 30), ("adjective", False, 10), ("sir_maam", True, 12), ("sir_maam", False, 18), (None, True, 5)):
        rows += [(len(rows) + i, strategy, "masculine" if parsed else "parse_error", parsed and i % 2 == 0) for i in range(n)]
    df = spark.createDataFrame(rows, "row_id bigint, disambiguation_strategy string, predicted_label string, correct boolean")
    flagged = L.with_outcome_flags(df)
    got = {r["stratum"]: r for r in L.strata(flagged).collect()}
    assert set(got) == {"gender adjective", "vocative address", "LOCAL (all)", "CROSS-CLAUSE (all)", "TOTAL"}
    assert got["TOTAL"]["n"] == 75 and got["LOCAL (all)"]["parse_pct"] == 75.0 and got["vocative address"]["n_matched"] == 12
    chi = L.chi_square(flagged).first()
    a, b, c, d = 30, 10, 12, 18
    n = a + b + c + d
    expected = n * (abs(a * d - b * c) - n / 2) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d))
    assert chi["chi2"] == pytest.approx(expected) and chi["dof"] == 1
    assert chi["p"] == pytest.approx(math.erfc(math.sqrt(expected / 2)))
    flat = L.chi_square(flagged.where("parsed")).first()
    assert (flat["chi2"], flat["dof"], flat["p"]) == (0.0, 0, 1.0)


def test_tail_probability_equals_erfc(spark):
    values = [0.0, 1e-9, 0.01, 0.5, 1.0, 3.84, 10.0, 17.99, 18.0, 18.01, 40.0, 100.0, 400.0, 1400.0]
    rows = spark.createDataFrame([(x,) for x in values], "chi2 double").select("chi2", L.tail_probability(F.col("chi2")).alias("p")).collect()
    for r in rows:
        assert r["p"] == pytest.approx(math.erfc(math.sqrt(r["chi2"] / 2)), rel=1e-9), r["chi2"]


def test_evaluation_writes_all_tables(preds, spark, tmp_path):
    attributes = spark.createDataFrame([(2, "adjective", True, False, True)],
                                       "row_id bigint, strategy string, filter_any boolean, filter_multi_sentence boolean, accepted boolean")
    tables = evaluate_runs(preds, attributes)
    write_evaluation(tables, str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == sorted(set(tables) - {"joined"})
    strategies = spark.read.parquet(str(tmp_path / "by_strategy")).collect()
    assert {(r["strategy"], r["n"]) for r in strategies} == {("adjective", 1), ("(source rows - ambiguous)", 2)}


def test_attributes_join_without_sorting_predictions(spark):
    """F16: a task held its predictions, several an example and run, to sort them."""
    left = spark.createDataFrame([(i % 5, i) for i in range(20)] + [(None, 20)], "row_id bigint, k int")
    right = spark.createDataFrame([(1, "a"), (2, None), (2, "b"), (None, "c")], "row_id bigint, strategy string")
    got = M.attach_attributes(left, right)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Sort " not in plan
    want = [(r, k, s) for r, k in [(i % 5, i) for i in range(20)] + [(None, 20)]
            for s in ([None, "b"] if r == 2 else ["a"] if r == 1 else [None])]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_tasks_grow_in_number_with_the_rows(spark):
    """merged by the size of their texts, tasks held ever more rows, each of which becomes many."""
    from checks.tables import TASK_ROWS, dealt

    rows = dealt(spark.range(20 * TASK_ROWS).withColumnRenamed("id", "doc_id"), "doc_id")
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) >= 20 and sum(sizes) == 20 * TASK_ROWS and max(sizes) < 2 * TASK_ROWS
