"""Scores, slices, run comparisons, strata and mined examples over derived predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.check import Check
from checks.corpus_checks import PRONOUNS, SQL_FLAGS
from checks.tables import (
    FEW_SHOT, M1, PLAIN, PLAIN_ZERO_SHOT, RUNS, SQL_ANSWERS, ZERO_SHOT, answers, corpus, predictions, sql_predictions, table)
from pairlens.fixed_values import LABELS, PREDICTION_LABELS
from pairlens.operators import metrics as M
from pairlens.operators import mining as X
from pairlens.operators import quality as Q
from pairlens.operators import reports as L

CLOSED_M1 = (("m1", "zero_shot", False),)
CLOSED_M2 = (("m2", "zero_shot", False),)
OPEN_M1 = (("m1", "zero_shot_identify", False),)
CLOSED_M1_THINK = (("m1", "zero_shot", False), ("m1", "zero_shot", True))
OPEN_M1_THINK = (("m1", "zero_shot_identify", False), ("m1", "zero_shot_identify", True))
M1_CONDITIONS = ("zero_shot", "zero_shot_identify", "few_shot_full")
RUN = "model, condition, thinking"


def with_predictions(body: str, runs, *ctes: str) -> str:
    return "WITH " + ",\n".join([sql_predictions(runs), *ctes]) + "\n" + body


def attributes(spark, sf_dir):
    """Strategy from the corpus, flags from the quality rules, acceptance from the labels table."""
    rows = Q.prefilter(corpus(spark, sf_dir), PRONOUNS)
    accepted = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("is_ok"))
    return rows.join(accepted, "doc_id", "left").select(
        "row_id", F.col("eval_strategy_label").alias("strategy"), "filter_any", "filter_multi_sentence",
        "filter_pre_gendered", F.col("is_ok").alias("accepted"))


def strategies(spark, sf_dir):
    return corpus(spark, sf_dir).select("row_id", F.col("eval_strategy_label").alias("strategy"))


def joined(spark, sf_dir, runs=RUNS):
    return M.attach_attributes(predictions(spark, sf_dir, runs), attributes(spark, sf_dir))


SQL_JOINED = f"""{SQL_FLAGS},
joined AS (SELECT p.*, c.eval_strategy_label AS strategy, f.multi OR f.gendered OR f.low AS filter_any,
   f.multi AS filter_multi_sentence, f.gendered AS filter_pre_gendered, l.quality = 1 AS accepted
   FROM predictions p LEFT JOIN corpus c USING (row_id) LEFT JOIN flags f USING (row_id)
   LEFT JOIN labels l ON l.doc_id = c.doc_id)"""

SQL_GRID = f"""
grid AS (SELECT * FROM (SELECT DISTINCT {RUN} FROM runs)
   CROSS JOIN (SELECT unnest({list(LABELS)}) AS expected_label) CROSS JOIN (SELECT unnest({list(PREDICTION_LABELS)}) AS predicted_label)),
matrix AS (SELECT g.*, count(p.row_id) AS n FROM grid g LEFT JOIN predictions p
   USING ({RUN}, expected_label, predicted_label) GROUP BY ALL)"""

SQL_PRF = f"""
classes AS (SELECT unnest({list(LABELS)}) AS label),
tallies AS (SELECT {RUN}, label, count(*) FILTER (predicted_label = label AND expected_label = label) AS tp,
   count(*) FILTER (predicted_label = label AND expected_label <> label) AS fp,
   count(*) FILTER (predicted_label IS DISTINCT FROM label AND expected_label = label) AS fn
   FROM predictions CROSS JOIN classes GROUP BY ALL),
rates AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fp) END AS p,
   CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fn) END AS r FROM tallies),
class_prf AS (SELECT {RUN}, label, tp, fp, fn, round(p, 4) AS precision, round(r, 4) AS recall,
   round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 4) AS f1 FROM rates),
prf AS (SELECT * FROM class_prf UNION ALL SELECT {RUN}, 'macro', sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT,
   round(sum(precision) / 3, 4), round(sum(recall) / 3, 4), round(sum(f1) / 3, 4) FROM class_prf GROUP BY ALL),
summary AS (SELECT {RUN}, CASE WHEN suffix(condition, '_identify') THEN 'open' ELSE 'closed' END AS task,
   max(tp::DOUBLE / (tp + fn)) FILTER (label = 'macro') AS accuracy, max(f1) FILTER (label = 'macro') AS macro_f1,
   max(recall) FILTER (label = 'masculine') AS masc_recall, max(recall) FILTER (label = 'feminine') AS fem_recall,
   max(recall) FILTER (label = 'ambiguous') AS ambig_recall FROM prf GROUP BY ALL),
board AS (SELECT model, {', '.join(f"max({c}) FILTER (task = '{t}') AS {t}_{c}" for t in ('closed', 'open')
     for c in ('accuracy', 'macro_f1', 'masc_recall', 'fem_recall', 'ambig_recall'))} FROM summary
   WHERE NOT thinking AND condition <> 'few_shot_full' GROUP BY 1),
board_thinking AS (SELECT model, {', '.join(f"max({c}) FILTER (task = '{t}') AS {t}_{c}" for t in ('closed', 'open')
     for c in ('accuracy',))} FROM summary WHERE thinking GROUP BY 1)"""

SQL_BIAS = f"""
bias AS (SELECT {RUN}, task, referent, count(*) AS n_confident_guesses,
   count(*) FILTER (predicted_label = 'masculine') AS guessed_masculine,
   count(*) FILTER (predicted_label = 'feminine') AS guessed_feminine,
   round(count(*) FILTER (predicted_label = 'masculine')::DOUBLE / count(*), 3) AS male_share
   FROM predictions WHERE variant = 'source' AND predicted_label IN ('masculine', 'feminine') AND coalesce(confidence, 0) >= 4
   GROUP BY ALL)"""

SQL_STRATA = """
shown AS (SELECT p.*, n.display, n.cue_group, coalesce(predicted_label, '') <> 'parse_error' AS parsed,
   coalesce(predicted_label, '') NOT IN ('parse_error', 'not_found') AS matched,
   coalesce(predicted_label, '') NOT IN ('parse_error', 'not_found') AND correct AS right_in_match
   FROM predictions p LEFT JOIN corpus c USING (row_id) LEFT JOIN (VALUES ('referent_swap', 'lexical swap', 'local'),
   ('pronoun_swap', 'pronoun rewrite', 'local'), ('pronoun_insertion', 'possessive tag', 'local'),
   ('context_modifier', 'distal noun cue', 'local'), ('relational_insertion', 'kin appositive', 'cross'),
   ('title_insertion', 'title appositive', 'cross'), ('sir_maam', 'vocative address', 'cross'),
   ('adjective', 'gender adjective', 'local'), ('appositive_dash', 'dashed appositive', 'local')) n(s, display, cue_group)
   ON n.s = c.disambiguation_strategy)"""


def summaries(spark, sf_dir, runs):
    by = ("model", "condition", "thinking", "task")
    return M.summary_metrics(predictions(spark, sf_dir, runs), by)


def leaderboard(spark, sf_dir, thinking=False):
    return M.leaderboard(summaries(spark, sf_dir, tuple(r for r in ZERO_SHOT if r[2] == thinking)))


def bias(spark, sf_dir, runs):
    return M.bias_table(predictions(spark, sf_dir, runs), ("model", "condition", "thinking", "task"))


def flagged(spark, sf_dir):
    rows = corpus(spark, sf_dir).select("row_id", "disambiguation_strategy")
    return L.with_outcome_flags(predictions(spark, sf_dir, OPEN_M1).join(rows, "row_id", "left"))


def with_replies(spark, sf_dir, runs):
    return answers(predictions(spark, sf_dir, runs)).withColumnRenamed("text", "raw_response")


def split(rows, thinking):
    return rows.where(F.col("thinking") == thinking)


def changed(fixed):
    def query(spark, sf_dir):
        rows = predictions(spark, sf_dir, M1)
        first, second = (rows.where(F.col("condition") == c) for c in ("zero_shot", "few_shot_full"))
        return M.changed_rows(first, second, fixed).drop("sentence")
    return query


def sql_changed(condition: str) -> str:
    return with_predictions(f"""SELECT a.row_id, a.variant, a.referent, a.expected_label, a.correct AS first_correct,
        a.predicted_label AS first_label, b.correct AS second_correct, b.predicted_label AS second_label
        FROM predictions a JOIN predictions b USING (row_id, variant)
        WHERE a.condition = 'zero_shot' AND b.condition = 'few_shot_full' AND {condition}""", M1)


def across(spark, sf_dir):
    runs = {"_".join((m, "open" if c == "zero_shot_identify" else "closed", "think" if t else "plain")):
            (F.col("model") == m) & (F.col("condition") == c) & (F.col("thinking") == t) for m, c, t in ZERO_SHOT}
    wide = M.examples_across_runs(predictions(spark, sf_dir, ZERO_SHOT), runs)
    return wide.select("row_id", "variant", *[F.col(r)["predicted_label"].alias(f"{r}_label") for r in runs],
                       *[F.col(r)["confidence"].alias(f"{r}_confidence") for r in runs],
                       *[F.col(r)["correct"].alias(f"{r}_correct") for r in runs])


_ACROSS = ", ".join(
    f"max({column}) FILTER (model = '{m}' AND condition = '{c}' AND thinking = {str(t).lower()}) AS "
    f"{m}_{'open' if c == 'zero_shot_identify' else 'closed'}_{'think' if t else 'plain'}_{name}"
    for column, name in (("predicted_label", "label"), ("confidence", "confidence"), ("correct", "correct"))
    for m, c, t in ZERO_SHOT)

FLAGS = ("filter_any", "filter_multi_sentence", "filter_pre_gendered")
MINED = ("pronoun_insertion", "sir_maam", "relational_insertion")
FLIPPED = ("referent_swap", "sir_maam")

CHECKS = {
    "predictions": Check(
        lambda s, d: predictions(s, d, RUNS, ["row_id", "variant", "model", "condition", "thinking", "referent",
                                              "predicted_label", "confidence", "correct"]),
        with_predictions("""SELECT row_id, variant, model, condition, thinking, referent, predicted_label, confidence, correct
            FROM predictions""", RUNS)),
    "accuracy_by_strategy": Check(
        lambda s, d: M.accuracy_by_strategy(M.attach_attributes(predictions(s, d), strategies(s, d))),
        with_predictions(f"""SELECT {RUN}, CASE WHEN variant = 'source' THEN '(source rows - ambiguous)' ELSE c.eval_strategy_label END
            AS strategy, variant, count(*) AS n, round(count(*) FILTER (correct)::DOUBLE / count(*), 4) AS accuracy
            FROM predictions LEFT JOIN corpus c USING (row_id)
            WHERE variant = 'source' OR c.eval_strategy_label IS NOT NULL GROUP BY ALL""", RUNS)),
    "overall": Check(
        lambda s, d: M.overall(predictions(s, d)),
        with_predictions(f"""SELECT {RUN}, count(*) AS total, count(*) FILTER (correct) AS n_correct,
            count(*) FILTER (correct)::DOUBLE / count(*) AS accuracy,
            count(*) FILTER (predicted_label = 'parse_error') AS parse_errors FROM predictions GROUP BY ALL""", RUNS)),
    "confusion": Check(
        lambda s, d: M.confusion(predictions(s, d)), with_predictions("SELECT * FROM matrix", RUNS, SQL_GRID)),
    "confusion_share": Check(
        lambda s, d: M.confusion_share(M.confusion(predictions(s, d))),
        with_predictions(f"""SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY {RUN}, expected_label) AS fraction FROM matrix""",
                         RUNS, SQL_GRID)),
    "confusion_difference": Check(
        lambda s, d: M.confusion_difference(predictions(s, d, M1), "condition", "zero_shot", "few_shot_full"),
        with_predictions("""SELECT expected_label, predicted_label, (sum(n) FILTER (condition = 'few_shot_full')
            - sum(n) FILTER (condition = 'zero_shot'))::BIGINT AS difference FROM matrix GROUP BY ALL""", M1, SQL_GRID)),
    "prf": Check(lambda s, d: M.prf(predictions(s, d)), with_predictions("SELECT * FROM prf", RUNS, SQL_PRF)),
    "prf_from_confusion": Check(
        lambda s, d: M.prf_from_counts(M.counts_from_confusion(M.confusion(predictions(s, d)))),
        with_predictions("""SELECT model, condition, thinking, label, tp, fp, fn, precision, recall, f1 FROM prf""", RUNS,
                         SQL_PRF.replace("predicted_label IS DISTINCT FROM label", "predicted_label <> label"))),
    "accuracy_by_flag": Check(
        lambda s, d: M.accuracy_by_flag(joined(s, d), FLAGS),
        with_predictions(" UNION ALL ".join(
            f"""SELECT {RUN}, '{f}' AS flag, {f} AS value, count(*) AS n,
            round(count(*) FILTER (correct)::DOUBLE / count(*), 4) AS accuracy FROM joined WHERE {f} IS NOT NULL GROUP BY ALL"""
            for f in FLAGS), RUNS, SQL_JOINED)),
    "accuracy_by_acceptance": Check(
        lambda s, d: M.accuracy_by_acceptance(joined(s, d)),
        with_predictions(f"""SELECT {RUN}, accepted, count(*) AS n, round(count(*) FILTER (correct)::DOUBLE / count(*), 4) AS accuracy
            FROM joined WHERE accepted IS NOT NULL GROUP BY ALL""", RUNS, SQL_JOINED)),
    "calibration": Check(
        lambda s, d: M.calibration(predictions(s, d)),
        with_predictions(f"""SELECT {RUN}, correct, count(*) AS n, round(sum(confidence)::DOUBLE / count(confidence), 3) AS mean_confidence
            FROM predictions GROUP BY ALL""", RUNS)),
    "top_referents": Check(
        lambda s, d: M.top_referents(predictions(s, d, CLOSED_M1)),
        with_predictions("""SELECT referent, count(*) AS n, round(count(*) FILTER (correct)::DOUBLE / count(*), 4) AS accuracy
            FROM predictions GROUP BY 1 ORDER BY n DESC, referent LIMIT 20""", CLOSED_M1)),
    "bias_table": Check(
        lambda s, d: bias(s, d, RUNS), with_predictions("SELECT * FROM bias", RUNS, SQL_BIAS)),
    "misclassified_low": Check(
        lambda s, d: M.misclassified(predictions(s, d, CLOSED_M1), highest=False).select(
            "row_id", "variant", "predicted_label", "confidence"),
        with_predictions("""SELECT row_id, variant, predicted_label, confidence FROM predictions WHERE NOT correct
            ORDER BY confidence ASC NULLS LAST, row_id, variant LIMIT 50""", CLOSED_M1)),
    "misclassified_high": Check(
        lambda s, d: M.misclassified(predictions(s, d, CLOSED_M1), highest=True).select(
            "row_id", "variant", "predicted_label", "confidence"),
        with_predictions("""SELECT row_id, variant, predicted_label, confidence FROM predictions WHERE NOT correct
            ORDER BY confidence DESC NULLS LAST, row_id, variant LIMIT 50""", CLOSED_M1)),
    "condition_summary": Check(
        lambda s, d: M.condition_summary(predictions(s, d, M1), M1_CONDITIONS),
        with_predictions("""SELECT metric, {} FROM (
            SELECT condition, unnest(['overall', 'macro_f1', 'ambiguity_recall', 'masculine_recall', 'feminine_recall']) AS metric,
            unnest([round(s.right_n::DOUBLE / s.n, 4), macro_f1, ambig_recall, masc_recall, fem_recall]) AS value
            FROM summary JOIN (SELECT condition, count(*) AS n, count(*) FILTER (correct) AS right_n FROM predictions GROUP BY 1) s
            USING (condition)) GROUP BY 1""".format(", ".join(
                f"max(value) FILTER (condition = '{c}') AS {c}" for c in M1_CONDITIONS)), M1, SQL_PRF)),
    "run_comparison": Check(
        lambda s, d: M.compare_runs(predictions(s, d, M1), M1_CONDITIONS),
        with_predictions("""SELECT a.condition AS first, b.condition AS second, count(*) AS n,
            count(*) FILTER (NOT a.correct AND b.correct) AS fixed, count(*) FILTER (a.correct AND NOT b.correct) AS broken,
            count(*) FILTER (NOT a.correct AND b.correct) - count(*) FILTER (a.correct AND NOT b.correct) AS net_gain,
            count(*) FILTER (a.predicted_label = b.predicted_label) AS agree,
            round(count(*) FILTER (a.predicted_label = b.predicted_label)::DOUBLE / count(*), 3) AS agreement_rate
            FROM predictions a JOIN predictions b USING (row_id, variant)
            WHERE a.condition = 'zero_shot' AND b.condition <> 'zero_shot' GROUP BY 1, 2""", M1)),
    "fixed_rows": Check(changed(True), sql_changed("NOT a.correct AND b.correct")),
    "broken_rows": Check(changed(False), sql_changed("a.correct AND NOT b.correct")),
    "leaderboard": Check(leaderboard, with_predictions(
        "SELECT *, round(closed_accuracy - open_accuracy, 4) AS closed_minus_open_acc FROM board", PLAIN_ZERO_SHOT, SQL_PRF)),
    "shot_deltas": Check(
        lambda s, d: M.shot_deltas(leaderboard(s, d), M.leaderboard(summaries(s, d, FEW_SHOT))),
        with_predictions("""SELECT a.model, a.closed_accuracy AS closed_zs, b.closed_accuracy AS closed_fs,
            b.closed_accuracy - a.closed_accuracy AS closed_delta, a.open_accuracy AS open_zs, b.open_accuracy AS open_fs,
            b.open_accuracy - a.open_accuracy AS open_delta, a.closed_accuracy - a.open_accuracy AS closed_to_open_zs,
            b.closed_accuracy - b.open_accuracy AS closed_to_open_fs FROM zero a JOIN few b USING (model)""",
                         PLAIN_ZERO_SHOT + FEW_SHOT, SQL_PRF, ", ".join(f"""{name} AS (SELECT model,
            max(accuracy) FILTER (task = 'closed') AS closed_accuracy, max(accuracy) FILTER (task = 'open') AS open_accuracy
            FROM summary WHERE starts_with(condition, '{name}_shot') GROUP BY 1)""" for name in ("zero", "few")))),
    "thinking_delta": Check(
        lambda s, d: M.thinking_delta(summaries(s, d, ZERO_SHOT)),
        with_predictions("""SELECT model, task, round(max(accuracy) FILTER (NOT thinking), 4) AS no_thinking,
            round(max(accuracy) FILTER (thinking), 4) AS with_thinking,
            round(max(accuracy) FILTER (thinking), 4) - round(max(accuracy) FILTER (NOT thinking), 4) AS delta
            FROM summary GROUP BY ALL""", ZERO_SHOT, SQL_PRF)),
    "headline": Check(
        lambda s, d: M.headline(summaries(s, d, ZERO_SHOT)),
        with_predictions("""SELECT model, thinking, task, round(accuracy, 4) AS accuracy, macro_f1, ambig_recall, masc_recall,
            fem_recall FROM summary""", ZERO_SHOT, SQL_PRF)),
    "strategy_across_models": Check(
        lambda s, d: M.strategy_across_models(M.accuracy_by_strategy(M.attach_attributes(
            predictions(s, d, tuple(r for r in PLAIN if r[1] == "zero_shot")), strategies(s, d)), ("model",)), ("m1", "m2")),
        with_predictions("""SELECT strategy, max(n) FILTER (model = 'm1') AS n, max(accuracy) FILTER (model = 'm1') AS accuracy_m1,
            max(accuracy) FILTER (model = 'm2') AS accuracy_m2 FROM (
            SELECT model, c.eval_strategy_label AS strategy, count(*) AS n, round(count(*) FILTER (correct)::DOUBLE / count(*), 4)
            AS accuracy FROM predictions JOIN corpus c USING (row_id) WHERE variant = 'masculine'
            AND c.eval_strategy_label IS NOT NULL GROUP BY ALL) GROUP BY 1""",
                         tuple(r for r in PLAIN if r[1] == "zero_shot"))),
    "bias_overlap": Check(
        lambda s, d: M.bias_overlap(bias(s, d, PLAIN_ZERO_SHOT), 2),
        with_predictions("""SELECT model, task, lower(referent) AS referent, n_confident_guesses, guessed_masculine, guessed_feminine,
            male_share, (SELECT count(DISTINCT o.model) FROM bias o WHERE o.task = b.task AND lower(o.referent) = lower(b.referent)) = 2
            AS cross_model_overlap FROM bias b""", PLAIN_ZERO_SHOT, SQL_BIAS)),
    "bias_intersection": Check(
        lambda s, d: M.bias_intersection(bias(s, d, PLAIN_ZERO_SHOT), "m1", "m2"),
        with_predictions("""SELECT task, count(DISTINCT lower(referent)) FILTER (model = 'm1') AS n_first,
            count(DISTINCT lower(referent)) FILTER (model = 'm2') AS n_second,
            count(DISTINCT lower(referent)) FILTER (model = 'm1' AND lower(referent) IN
              (SELECT lower(o.referent) FROM bias o WHERE o.model = 'm2' AND o.task = bias.task)) AS n_both
            FROM bias GROUP BY 1""", PLAIN_ZERO_SHOT, SQL_BIAS)),
    "examples_across_runs": Check(across, with_predictions(
        f"SELECT row_id, variant, {_ACROSS} FROM predictions GROUP BY 1, 2", ZERO_SHOT)),
    "strata": Check(
        lambda s, d: L.strata(flagged(s, d)),
        with_predictions("""SELECT coalesce(display, CASE cue_group WHEN 'local' THEN 'LOCAL (all)' WHEN 'cross' THEN 'CROSS-CLAUSE (all)' END,
            'TOTAL') AS stratum, count(*) AS n, 100 * (count(*) FILTER (parsed)::DOUBLE / count(*)) AS parse_pct,
            100 * (count(*) FILTER (matched)::DOUBLE / count(*)) AS match_pct,
            100 * (count(*) FILTER (right_in_match)::DOUBLE / count(*) FILTER (matched)) AS acc_match,
            100 * (count(*) FILTER (right_in_match)::DOUBLE / count(*)) AS acc_all, count(*) FILTER (matched) AS n_matched,
            count(*) FILTER (right_in_match) AS n_correct FROM shown
            GROUP BY GROUPING SETS ((cue_group, display), (cue_group), ())
            HAVING grouping(cue_group) = 1 OR cue_group IS NOT NULL""", OPEN_M1, SQL_STRATA)),
    "chi_square": Check(
        lambda s, d: L.chi_square(flagged(s, d)).withColumn("p", F.round("p", 9)),
        with_predictions("""SELECT local_parsed, local_unparsed, cross_parsed, cross_unparsed, dof, chi2, round(CASE WHEN dof = 0 OR chi2 <= 0 THEN 1.0
              WHEN chi2 < 18 THEN 1 - density * 2 * sqrt(chi2 / 2) * list_reduce(terms, lambda a, k: a * chi2 / (2 * k + 1) + 1, 1.0::DOUBLE)
              ELSE density / (sqrt(chi2 / 2) * list_reduce(terms, lambda a, k: k / (chi2 * a) + 1, 1.0::DOUBLE)) END, 9) AS p
            FROM (SELECT *, exp(-chi2 / 2) / sqrt(pi()) AS density FROM tested) AS t, (SELECT range(150, 0, -1)::DOUBLE[] AS terms) AS r""", OPEN_M1, SQL_STRATA,
                         """counted AS (SELECT count(*) FILTER (cue_group = 'local' AND parsed) AS local_parsed,
              count(*) FILTER (cue_group = 'local' AND NOT parsed) AS local_unparsed,
              count(*) FILTER (cue_group = 'cross' AND parsed) AS cross_parsed,
              count(*) FILTER (cue_group = 'cross' AND NOT parsed) AS cross_unparsed FROM shown),
            margins AS (SELECT *, (local_parsed + local_unparsed)::DOUBLE AS a, (cross_parsed + cross_unparsed)::DOUBLE AS b,
              (local_parsed + cross_parsed)::DOUBLE AS c, (local_unparsed + cross_unparsed)::DOUBLE AS d FROM counted),
            tested AS (SELECT local_parsed, local_unparsed, cross_parsed, cross_unparsed,
              CASE WHEN a * b * c * d > 0 THEN 1 ELSE 0 END AS dof, CASE WHEN a * b * c * d > 0 THEN (a + b) * power(greatest(
                abs(local_parsed::DOUBLE * cross_unparsed - local_unparsed::DOUBLE * cross_parsed) - (a + b) / 2, 0), 2) / (a * b * c * d)
                ELSE 0.0 END AS chi2 FROM margins)""")),
    "matched_accuracy": Check(
        lambda s, d: L.matched_accuracy(flagged(s, d)),
        with_predictions("""SELECT count(*) AS n_matched, count(*) FILTER (correct)::DOUBLE / count(*) AS accuracy
            FROM shown WHERE matched""", OPEN_M1, SQL_STRATA)),
    "shortest_failures": Check(
        lambda s, d: X.shortest_failures(M.attach_attributes(predictions(s, d, OPEN_M1), strategies(s, d)), MINED),
        with_predictions(f"""SELECT strategy, row_id, variant, sentence, referent FROM (
            SELECT c.eval_strategy_label AS strategy, p.row_id, variant, sentence, p.referent, row_number() OVER (
            PARTITION BY c.eval_strategy_label ORDER BY length(sentence), p.row_id, variant) AS rn
            FROM predictions p JOIN corpus c USING (row_id) WHERE variant IN ('masculine', 'feminine') AND predicted_label = 'ambiguous'
            AND c.eval_strategy_label IN {MINED}) WHERE rn = 1""", OPEN_M1)),
    "missing_referents": Check(
        lambda s, d: X.missing_referents(predictions(s, d, OPEN_M1)),
        with_predictions("""SELECT row_id, variant, sentence, referent FROM (SELECT *, row_number() OVER (
            PARTITION BY row_id ORDER BY n, variant) AS rn FROM (SELECT row_id, variant, sentence, referent, length(sentence) AS n
            FROM predictions WHERE predicted_label = 'not_found')) WHERE rn = 1
            ORDER BY n, row_id LIMIT 2""", OPEN_M1)),
    "flips": Check(
        lambda s, d: X.flips(*[split(predictions(s, d, CLOSED_M1_THINK), t) for t in (False, True)], strategies(s, d), FLIPPED),
        with_predictions(f"""SELECT strategy, row_id, variant, sentence, referent FROM (
            SELECT c.eval_strategy_label AS strategy, a.row_id, a.variant, a.sentence, a.referent, row_number() OVER (
            PARTITION BY c.eval_strategy_label ORDER BY a.variant <> 'masculine', length(a.sentence), a.row_id, a.variant) AS rn
            FROM predictions a JOIN predictions b USING (row_id, variant) JOIN corpus c ON c.row_id = a.row_id
            WHERE NOT a.thinking AND b.thinking AND NOT a.correct AND b.correct AND c.eval_strategy_label IN {FLIPPED}) WHERE rn = 1""",
                         CLOSED_M1_THINK)),
    "neutral_regressions": Check(
        lambda s, d: X.neutral_regressions(*[split(with_replies(s, d, OPEN_M1_THINK), t) for t in (False, True)]),
        with_predictions("""SELECT row_id, variant, sentence, referent, neutral AS neutral_reading FROM (
            SELECT a.row_id, a.variant, a.sentence, a.referent, length(a.sentence) AS n,
            contains(lower(coalesce(b.text, '')), 'neutral') OR contains(lower(coalesce(b.text, '')), 'no gendered') AS neutral
            FROM labelled_answers a JOIN labelled_answers b USING (row_id, variant) WHERE NOT a.thinking AND b.thinking
            AND a.variant = 'feminine' AND a.correct AND NOT b.correct AND b.predicted_label = 'ambiguous'
            ) ORDER BY neutral DESC, n, row_id LIMIT 2""", OPEN_M1_THINK, SQL_ANSWERS,
                         """labelled_answers AS (SELECT a.*, p.predicted_label, p.correct FROM answers a
            JOIN predictions p USING (row_id, variant, model, condition, thinking))""")),
    "marked_reply": Check(
        lambda s, d: X.marked_reply(with_replies(s, d, CLOSED_M1), "thought", partner=with_replies(s, d, CLOSED_M2)).select(
            "row_id", "variant", "referent", "raw_response", "marked", "partner_response"),
        with_predictions("""SELECT p.row_id, p.variant, p.referent, p.text AS raw_response, p.marked, q.text AS partner_response
            FROM (SELECT row_id, variant, referent, text, contains(lower(coalesce(text, '')), 'thought') AS marked
                  FROM answers WHERE variant = 'source' AND model = 'm1' ORDER BY marked DESC, row_id LIMIT 1) p
            LEFT JOIN (SELECT * FROM answers WHERE model = 'm2') q USING (row_id, variant)""",
                         CLOSED_M1 + CLOSED_M2, SQL_ANSWERS)),
    "confident_errors": Check(
        lambda s, d: X.confident_errors(predictions(s, d), M.RUN).select(
            *M.RUN, "row_id", "variant", "confidence", "predicted_label", "rank"),
        with_predictions(f"""SELECT {RUN}, row_id, variant, confidence, predicted_label, rank FROM (SELECT *, row_number() OVER (
            PARTITION BY {RUN} ORDER BY confidence DESC NULLS LAST, row_id,
            list_position(['source', 'masculine', 'feminine'], variant)) AS rank FROM predictions WHERE NOT correct) WHERE rank <= 5""",
                         RUNS)),
    "bias_head": Check(
        lambda s, d: X.bias_head(bias(s, d, RUNS), M.RUN),
        with_predictions(f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {RUN} ORDER BY n_confident_guesses DESC, referent)
            AS rank FROM bias) WHERE rank <= 15""", RUNS, SQL_BIAS)),
}
