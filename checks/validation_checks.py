"""Rewrite checks, acceptance, generation and round reports, human review, retry state."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.check import Check
from checks.corpus_checks import with_corpus
from checks.tables import corpus
from pairlens.fixed_values import RUBRIC_COLUMNS
from pairlens.functions.text import word_distance
from pairlens.operators import reports as L
from pairlens.operators import selection as B
from pairlens.operators import validation as V
from pairlens.plans import repair

# ---------------------------------------------------------------- SQL: word distance

def _head(a: str, b: str) -> str:
    return (f"coalesce(nullif(list_position(list_transform(list_zip({a}, {b}), lambda x: coalesce(x[1] = x[2], false)), false), 0) - 1, "
            f"len(list_zip({a}, {b})))")


def sql_distances(pairs: str, name: str) -> str:
    """CTEs from ``pairs`` (row_id, side, a, b) to ``name`` (row_id, side, d)."""
    return f"""
{name}_tokens AS (SELECT row_id, side, list_filter(string_split_regex(a, '\\s+'), lambda x: x <> '') AS ta,
   list_filter(string_split_regex(b, '\\s+'), lambda x: x <> '') AS tb FROM {pairs}),
{name}_heads AS (SELECT *, {_head('ta', 'tb')} AS p FROM {name}_tokens),
{name}_mids AS (SELECT row_id, side, list_reverse(ta[p + 1:]) AS ra, list_reverse(tb[p + 1:]) AS rb FROM {name}_heads),
{name}_tails AS (SELECT *, {_head('ra', 'rb')} AS q FROM {name}_mids),
{name}_cores AS (SELECT row_id, side, ra[q + 1:] AS ca, rb[q + 1:] AS cb FROM {name}_tails),
{name}_coded AS (SELECT *, list_distinct(list_concat(ca, cb)) AS abc FROM {name}_cores),
{name} AS (SELECT row_id, side, CASE WHEN len(ca) = 0 OR len(cb) = 0 THEN len(ca) + len(cb) WHEN len(abc) > 126 THEN error('too many distinct words') ELSE levenshtein(
   array_to_string(list_transform(ca, lambda t: chr(list_position(abc, t)::INT)), ''),
   array_to_string(list_transform(cb, lambda t: chr(list_position(abc, t)::INT)), '')) END::INT AS d FROM {name}_coded)"""


def sql_checks(source: str = "corpus", prefix: str = "v") -> str:
    """CTEs from a corpus-shaped table to ``<prefix>_rows`` (row_id, checks, passed, messages)."""
    suffixes = "man|woman|boy|girl|lady|gentleman"
    contractions = ", ".join(
        f"regexp_extract_all(a, '{h}''\\s*{t}\\b')"
        for h, t in (("I", "m"), ("you", "re"), ("don", "t"), ("won", "t"), ("can", "t"), ("I", "ve"), ("I", "ll")))

    def boundaries(c: str) -> str:
        return (f"len(regexp_extract_all(regexp_replace({c}, '\\b(Mr|Mrs|Ms|Dr|St)[.!?]', '\\1', 'g'), '[.!?]\\s+[A-Z]'))")

    def pieces(c: str) -> str:
        return f"regexp_extract_all({c}, '[\\p{{L}}\\p{{N}}_]+|\\s+|[^\\p{{L}}\\p{{N}}_\\s]+')"

    def named(c: str) -> str:
        return f"len(list_filter({c}, lambda x: lower(x) = ref OR lower(x) = ref || 's')) > 0"

    return f"""
{prefix}_base AS (SELECT row_id, coalesce(EN_source_sentence, '') AS a, coalesce(EN_masculine_sentence, '') AS m,
   coalesce(EN_feminine_sentence, '') AS f, coalesce(referent, '') AS ref,
   coalesce(nullif(disambiguation_strategy, ''), eval_strategy_label, '') AS strategy FROM {source}),
{prefix}_sides AS (SELECT row_id, 'masc' AS side, a, m AS b, ref, strategy FROM {prefix}_base
   UNION ALL SELECT row_id, 'fem', a, f, ref, strategy FROM {prefix}_base),
{sql_distances(f'{prefix}_sides', f'{prefix}_dist')},
{prefix}_found AS (SELECT *,
   list_filter(list_transform(flatten([{contractions}]), lambda x: [x, regexp_replace(x, '''\\s+', '''', 'g')]),
     lambda x: NOT contains(b, x[1]) AND x[1] <> x[2] AND contains(b, x[2]))[1] AS drift,
   {boundaries('a')} AS na, {boundaries('b')} AS nb,
   strategy <> 'referent_swap' AND ref <> '' AND {named('pa')} AND NOT {named('pb')} AS lost,
   CASE WHEN len(list_filter(range(1, len(pa) + 1), lambda i: lower(pa[i]) = ref
       AND NOT coalesce(trim(pa[i + 1]) = '' AND regexp_matches(pa[i + 2], '(?i)^({suffixes})'), false))) > 0
     THEN coalesce(list_transform(list_filter(range(1, len(pb) + 1), lambda i: lower(pb[i]) = ref
       AND coalesce(trim(pb[i + 1]) = '' AND regexp_full_match(pb[i + 2], '(?i)({suffixes})'), false)), lambda i: pb[i + 2])[1], '')
     ELSE '' END AS suffix
   FROM (SELECT *, {pieces('a')} AS pa, {pieces('b')} AS pb FROM {prefix}_sides) JOIN {prefix}_dist USING (row_id, side)),
{prefix}_told AS (
   SELECT row_id, CASE side WHEN 'masc' THEN 1 ELSE 2 END AS pos, 'edit_distance_' || side AS name, d <= 8 AS ok,
     CASE WHEN d > 8 THEN 'edit_distance=' || d || ' exceeds hard limit 8' WHEN d > 5 THEN 'edit_distance=' || d || ' over soft limit 5' ELSE '' END AS msg
     FROM {prefix}_found
   UNION ALL SELECT row_id, CASE side WHEN 'masc' THEN 3 ELSE 4 END, 'formatting_' || side,
     a = '' OR b = '' OR drift IS NULL,
     CASE WHEN a = '' OR b = '' OR drift IS NULL THEN '' ELSE 'formatting drift: ''' || drift[1] || ''' -> ''' || drift[2] || '''' END FROM {prefix}_found
   UNION ALL SELECT row_id, CASE side WHEN 'masc' THEN 5 ELSE 6 END, 'no_extra_sentence_' || side, nb <= na,
     CASE WHEN nb > na THEN 'variant has ' || nb || ' sentence boundaries vs source''s ' || na ELSE '' END FROM {prefix}_found
   UNION ALL SELECT row_id, 7, 'variants_differ', trim(m) <> trim(f),
     CASE WHEN trim(m) = trim(f) THEN 'masculine and feminine variants are identical' ELSE '' END FROM {prefix}_base
   UNION ALL SELECT row_id, 8, 'variants_edited', NOT (trim(m) = trim(a) AND trim(f) = trim(a)),
     CASE WHEN trim(m) = trim(a) AND trim(f) = trim(a) THEN 'both variants identical to the source' ELSE '' END FROM {prefix}_base
   UNION ALL SELECT row_id, CASE side WHEN 'masc' THEN 9 ELSE 10 END, 'referent_preserved_' || side, NOT lost,
     CASE WHEN lost THEN 'referent ''' || ref || ''' was removed under non-swap strategy ''' || strategy || '''' ELSE '' END FROM {prefix}_found
   UNION ALL SELECT row_id, CASE side WHEN 'masc' THEN 11 ELSE 12 END, 'no_pos_change_' || side, suffix = '',
     CASE WHEN suffix <> '' THEN 'possible POS change: ''' || ref || ' ' || suffix || ''' turns referent into adjective' ELSE '' END FROM {prefix}_found),
{prefix}_rows AS (SELECT row_id, bool_and(ok) AS passed, string_agg(CASE WHEN ok THEN '+' ELSE '-' END, '' ORDER BY pos) AS marks,
   coalesce(list(name || ': ' || msg ORDER BY pos) FILTER (NOT ok OR msg <> ''), []) AS messages FROM {prefix}_told GROUP BY row_id)"""


SQL_ACCEPTANCE = f"""CASE WHEN eval_reject IS TRUE OR eval_pos_change IS TRUE OR eval_referent_disambiguated <= 2
   OR eval_no_extra_sentence <= 2 THEN false
   ELSE ({' + '.join(f'coalesce({c}, 0)' for c in RUBRIC_COLUMNS)})::DOUBLE / 5 >= 4.0 END"""

SQL_METRICS = f"""
metric_pairs AS (SELECT row_id, 'masc' AS side, lower(EN_source_sentence) AS a, lower(EN_masculine_sentence) AS b FROM corpus
   UNION ALL SELECT row_id, 'fem', lower(EN_source_sentence), lower(coalesce(EN_feminine_sentence, '')) FROM corpus),
{sql_distances('metric_pairs', 'metric_dist')},
metrics AS (SELECT c.row_id, referent, EN_source_sentence, EN_masculine_sentence, EN_feminine_sentence,
   EN_feminine_sentence IS NULL AS error,
   CASE WHEN NOT error THEN coalesce(disambiguation_strategy, 'unknown') END AS strategy,
   CASE WHEN NOT error THEN dm.d END AS masc_edit_dist, CASE WHEN NOT error THEN df.d END AS fem_edit_dist,
   CASE WHEN NOT error THEN trim(EN_masculine_sentence) = trim(EN_source_sentence) END AS masc_equals_original,
   CASE WHEN NOT error THEN trim(EN_feminine_sentence) = trim(EN_source_sentence) END AS fem_equals_original,
   CASE WHEN NOT error THEN trim(EN_masculine_sentence) = trim(EN_feminine_sentence) END AS masc_equals_fem
   FROM corpus c JOIN metric_dist dm ON dm.row_id = c.row_id AND dm.side = 'masc'
   JOIN metric_dist df ON df.row_id = c.row_id AND df.side = 'fem')"""

SQL_RATED = """
rated AS (SELECT *, lower(trim(coalesce(eval_human, ''))) AS said,
   CASE WHEN lower(trim(coalesce(eval_human, ''))) = '' THEN '(unrated)'
        WHEN lower(trim(eval_human)) IN ('good', 'meh', 'bad') THEN lower(trim(eval_human))
        ELSE '(other: ' || lower(trim(eval_human)) || ')' END AS rating,
   coalesce(regexp_matches(eval_human_explained, '(?i)\\bgreat\\b'), false) AS has_great,
   coalesce(eval_strategy_label, '(missing)') AS strategy FROM corpus)"""


# ---------------------------------------------------------------- Spark

def edit_distance(spark, sf_dir):
    source, masc, fem = (F.col(f"EN_{k}_sentence") for k in ("source", "masculine", "feminine"))
    return corpus(spark, sf_dir).select(
        "row_id", word_distance(source, masc).alias("masc"), word_distance(source, fem).alias("fem"),
        word_distance(source, fem, ignore_case=True).alias("fem_lower"))


def row_checks(spark, sf_dir):
    marks = F.array_join(F.transform("checks", lambda r: F.when(r["passed"], "+").otherwise("-")), "")
    return V.validate(corpus(spark, sf_dir)).select(
        "row_id", "passed", marks.alias("marks"), F.array_join("messages", "; ").alias("messages"))


def symbolic_override(spark, sf_dir):
    return V.symbolic_override(corpus(spark, sf_dir)).select(
        "row_id", "accepted", "eval_issues", "symbolic_checks_passed", "symbolic_check_failures", "symbolic_override")


def metrics(spark, sf_dir):
    return L.generation_metrics(corpus(spark, sf_dir))


def reviews(spark, sf_dir):
    return L.rated(corpus(spark, sf_dir))


def rewrites(rows):
    """Retry answers derived from the rows: some give no masculine sentence, some no strategy."""
    h = F.col("h")
    return rows.select(
        "row_id", F.when((h % 3 != 0) & (h % 4 != 1), F.concat("EN_source_sentence", F.lit(", my lord"))).alias("EN_masculine_sentence"),
        F.concat("EN_source_sentence", F.lit(", my lady")).alias("EN_feminine_sentence"),
        F.when(h % 8 != 2, F.lit("sir_maam")).alias("disambiguation_strategy"),
        F.lit(None).cast("string").alias("masc_referent"), F.concat("referent", F.lit(" lady")).alias("fem_referent"))


STATE_COLUMNS = ["row_id", "EN_masculine_sentence", "EN_feminine_sentence", "disambiguation_strategy", "masc_referent",
                 "fem_referent", *RUBRIC_COLUMNS, "eval_issues", "accepted", "eval_strategy_label", "eval_reject",
                 "eval_pos_change", "eval_suggestion", "retry_count", "symbolic_check_failures"]


def retry_state(spark, sf_dir):
    rows = corpus(spark, sf_dir)
    return repair.apply_retries(rows, rewrites(rows)).select(*STATE_COLUMNS)


_CLEARED = ", ".join(f"CASE WHEN NOT retry THEN {c} END AS {c}" for c in (
    *RUBRIC_COLUMNS, "eval_issues", "accepted", "eval_strategy_label", "eval_reject", "eval_pos_change", "eval_suggestion"))
SQL_RETRY = f"""
marked AS (SELECT *, coalesce(accepted = false AND eval_reject IS NOT TRUE AND coalesce(retry_count, 0) < 5, false) AS retry,
   h % 3 <> 0 AND h % 4 <> 1 AS answered FROM corpus),
retried AS (SELECT row_id, h, referent,
   CASE WHEN retry AND answered THEN EN_source_sentence || ', my lord' ELSE EN_masculine_sentence END AS EN_masculine_sentence,
   CASE WHEN retry AND answered THEN EN_source_sentence || ', my lady' ELSE EN_feminine_sentence END AS EN_feminine_sentence,
   CASE WHEN retry AND answered THEN CASE WHEN h % 8 <> 2 THEN 'sir_maam' ELSE 'unknown' END ELSE disambiguation_strategy END
     AS disambiguation_strategy,
   CASE WHEN retry AND answered THEN referent ELSE masc_referent END AS masc_referent,
   CASE WHEN retry AND answered THEN referent || ' lady' ELSE fem_referent END AS fem_referent,
   {_CLEARED}, (CASE WHEN retry THEN coalesce(retry_count, 0) + 1 ELSE retry_count END)::INT AS retry_count,
   symbolic_check_failures FROM marked)"""


# ---------------------------------------------------------------- repair rounds

ROUNDS = 2


def round_scores(rows, turn: int):
    """Rubric scores of a round, from a hash of row and round."""
    from pairlens.functions.hashing import key_hash
    e = key_hash(F.col("row_id"), f"round{turn}")
    return rows.select(
        "row_id", *[(F.floor(e / 3 ** i) % 4 + 2).cast("double").alias(c) for i, c in enumerate(RUBRIC_COLUMNS)],
        F.lit("scored").alias("eval_issues"), F.lit("sir_maam").alias("eval_strategy_label"),
        (e % 31 == 0).alias("eval_reject"), (e % 37 == 0).alias("eval_pos_change"), F.lit("").alias("eval_suggestion"))


def round_rewrites(rows, turn: int):
    return rewrites(rows).withColumn("EN_masculine_sentence", F.concat("EN_masculine_sentence", F.lit(f" {turn}")))


def fresh(rows):
    """A corpus as it is after generation: no scores, no verdicts, no retries."""
    return rows.select("row_id", "h", "referent", "EN_source_sentence", "EN_masculine_sentence", "EN_feminine_sentence",
                       "disambiguation_strategy", "masc_referent", "fem_referent")


REPAIRED = ["row_id", "EN_masculine_sentence", "EN_feminine_sentence", "disambiguation_strategy", "accepted",
            "eval_reject", "eval_issues", "retry_count", "symbolic_checks_passed", "symbolic_check_failures"]


def repair_rounds(spark, sf_dir):
    done = repair.repair_rounds(fresh(corpus(spark, sf_dir)), round_scores, round_rewrites, max_retries=ROUNDS)
    return done.select(*REPAIRED)


def _sql_round(r: int) -> str:
    """Evaluation and, unless it is the last round, retry of the state ``s<r>``."""
    scores = ", ".join(f"CASE WHEN got THEN ((e // {3 ** i}) % 4 + 2)::DOUBLE ELSE {c} END AS {c}" for i, c in enumerate(RUBRIC_COLUMNS))
    accept = SQL_ACCEPTANCE
    evaluation = f"""
e{r} AS (SELECT *, ('0x' || substr(md5(row_id || '|round{r}'), 1, 8))::BIGINT AS e,
   accepted IS NOT TRUE AND eval_reject IS NOT TRUE AND EN_masculine_sentence IS NOT NULL AND EN_feminine_sentence IS NOT NULL AS got FROM s{r}),
g{r} AS (SELECT * REPLACE ({scores}, CASE WHEN got THEN 'scored' ELSE eval_issues END AS eval_issues,
   CASE WHEN got THEN 'sir_maam' ELSE eval_strategy_label END AS eval_strategy_label,
   CASE WHEN got THEN e % 31 = 0 ELSE eval_reject END AS eval_reject,
   CASE WHEN got THEN e % 37 = 0 ELSE eval_pos_change END AS eval_pos_change) FROM e{r}),
d{r} AS (SELECT * REPLACE (CASE WHEN got THEN {accept} ELSE accepted END AS accepted) FROM g{r}),
{sql_checks(f'd{r}', f'k{r}')},
o{r} AS (SELECT d.* EXCLUDE (e, got) REPLACE (
   CASE WHEN accepted THEN k.passed ELSE symbolic_checks_passed END AS symbolic_checks_passed,
   CASE WHEN accepted THEN array_to_string(k.messages, '; ') ELSE symbolic_check_failures END AS symbolic_check_failures,
   CASE WHEN accepted AND NOT k.passed THEN trim(coalesce(eval_issues, '') || ' [SYMBOLIC] ' || array_to_string(k.messages, ' | '))
        ELSE eval_issues END AS eval_issues,
   CASE WHEN accepted AND NOT k.passed THEN false ELSE accepted END AS accepted) FROM d{r} d JOIN k{r}_rows k USING (row_id))"""
    if r == ROUNDS:
        return evaluation
    cleared = ", ".join(f"CASE WHEN NOT retry THEN {c} END AS {c}" for c in (
        *RUBRIC_COLUMNS, "eval_issues", "accepted", "eval_strategy_label", "eval_reject", "eval_pos_change"))
    return evaluation + f""",
m{r} AS (SELECT *, coalesce(accepted = false AND eval_reject IS NOT TRUE AND coalesce(retry_count, 0) < {ROUNDS}, false) AS retry,
   h % 3 <> 0 AND h % 4 <> 1 AS answered FROM o{r}),
s{r + 1} AS (SELECT * EXCLUDE (retry, answered) REPLACE (
   CASE WHEN retry AND answered THEN EN_source_sentence || ', my lord {r}' ELSE EN_masculine_sentence END AS EN_masculine_sentence,
   CASE WHEN retry AND answered THEN EN_source_sentence || ', my lady' ELSE EN_feminine_sentence END AS EN_feminine_sentence,
   CASE WHEN retry AND answered THEN CASE WHEN h % 8 <> 2 THEN 'sir_maam' ELSE 'unknown' END ELSE disambiguation_strategy END AS disambiguation_strategy,
   {cleared}, (CASE WHEN retry THEN coalesce(retry_count, 0) + 1 ELSE retry_count END)::INT AS retry_count) FROM m{r})"""


SQL_REPAIR = f"""
s0 AS (SELECT row_id, h, referent, EN_source_sentence, EN_masculine_sentence, EN_feminine_sentence, disambiguation_strategy,
   {', '.join(f'NULL::DOUBLE AS {c}' for c in RUBRIC_COLUMNS)}, NULL::VARCHAR AS eval_issues, NULL::VARCHAR AS eval_strategy_label,
   NULL::BOOLEAN AS eval_reject, NULL::BOOLEAN AS eval_pos_change, NULL::BOOLEAN AS accepted, NULL::INT AS retry_count,
   NULL::BOOLEAN AS symbolic_checks_passed, NULL::VARCHAR AS symbolic_check_failures FROM corpus),
{','.join(_sql_round(r) for r in range(ROUNDS + 1))}"""


CHECKS = {
    "edit_distance": Check(edit_distance, with_corpus(
        """SELECT row_id, max(d) FILTER (side = 'masc') AS masc, max(d) FILTER (side = 'fem') AS fem,
           max(d) FILTER (side = 'low') AS fem_lower FROM dist GROUP BY row_id""",
        """pairs AS (SELECT row_id, 'masc' AS side, EN_source_sentence AS a, EN_masculine_sentence AS b FROM corpus
           UNION ALL SELECT row_id, 'fem', EN_source_sentence, coalesce(EN_feminine_sentence, '') FROM corpus
           UNION ALL SELECT row_id, 'low', lower(EN_source_sentence), lower(coalesce(EN_feminine_sentence, '')) FROM corpus)""",
        sql_distances("pairs", "dist"))),
    "row_checks": Check(row_checks, with_corpus(
        "SELECT row_id, passed, marks, array_to_string(messages, '; ') AS messages FROM v_rows", sql_checks())),
    "acceptance": Check(
        lambda s, d: corpus(s, d).select("row_id", V.acceptance().alias("accepted")),
        with_corpus(f"SELECT row_id, {SQL_ACCEPTANCE} AS accepted FROM corpus")),
    "symbolic_override": Check(symbolic_override, with_corpus(
        """SELECT c.row_id, CASE WHEN c.accepted AND NOT v.passed THEN false ELSE c.accepted END AS accepted,
           CASE WHEN c.accepted AND NOT v.passed THEN trim(coalesce(eval_issues, '') || ' [SYMBOLIC] ' || array_to_string(v.messages, ' | '))
                ELSE eval_issues END AS eval_issues,
           CASE WHEN c.accepted THEN v.passed END AS symbolic_checks_passed,
           CASE WHEN c.accepted THEN array_to_string(v.messages, '; ') ELSE symbolic_check_failures END AS symbolic_check_failures,
           coalesce(c.accepted, false) AND NOT v.passed AS symbolic_override
           FROM corpus c JOIN v_rows v USING (row_id)""", sql_checks())),
    "generation_metrics": Check(metrics, with_corpus(
        """SELECT row_id, referent, strategy, masc_edit_dist, fem_edit_dist, masc_equals_original, fem_equals_original,
           masc_equals_fem, error FROM metrics""", SQL_METRICS)),
    "generation_report": Check(
        lambda s, d: L.generation_report(metrics(s, d)),
        with_corpus("""SELECT count(*) AS total, count(*) FILTER (error) AS errors,
           count(*) FILTER (NOT error)::DOUBLE / count(*) AS success_rate, avg(masc_edit_dist) AS masc_mean,
           avg(fem_edit_dist) AS fem_mean, max(masc_edit_dist) AS masc_max, max(fem_edit_dist) AS fem_max,
           count(*) FILTER (masc_equals_original) AS masc_unedited, count(*) FILTER (fem_equals_original) AS fem_unedited,
           count(*) FILTER (masc_equals_fem) AS identical,
           count(*) FILTER (masc_edit_dist > 5 OR fem_edit_dist > 5) AS high_edit FROM metrics""", SQL_METRICS)),
    "generated_strategies": Check(
        lambda s, d: L.strategy_counts(metrics(s, d)),
        with_corpus("SELECT strategy, count(*) AS n FROM metrics WHERE NOT error GROUP BY 1", SQL_METRICS)),
    "high_edit_rows": Check(
        lambda s, d: L.high_edit_rows(metrics(s, d), corpus(s, d)),
        with_corpus("""SELECT row_id, masc_edit_dist, fem_edit_dist, referent, EN_source_sentence, EN_masculine_sentence,
           EN_feminine_sentence FROM metrics WHERE masc_edit_dist > 5 OR fem_edit_dist > 5""", SQL_METRICS)),
    "round_summary": Check(
        lambda s, d: L.round_summary(corpus(s, d)),
        with_corpus(f"""SELECT count(*) AS total, count(*) FILTER (accepted) AS accepted,
           count(*) FILTER (accepted)::DOUBLE / count(*) AS accepted_share,
           {', '.join(f"avg({c}) AS {c.replace('eval_', 'mean_')}" for c in RUBRIC_COLUMNS)},
           count(*) FILTER (eval_reject) AS rejected,
           count(*) FILTER (accepted AND eval_strategy_label = 'appositive_dash') AS appositive_dash,
           count(*) FILTER (accepted AND eval_strategy_label = 'appositive_dash')::DOUBLE / count(*) FILTER (accepted) > 0.15
             AS appositive_warning FROM corpus""")),
    "accepted_strategies": Check(
        lambda s, d: L.accepted_strategies(corpus(s, d)),
        with_corpus("""SELECT eval_strategy_label AS strategy, count(*) AS n,
           count(*)::DOUBLE / (SELECT greatest(count(*) FILTER (accepted), 1) FROM corpus) AS share
           FROM corpus WHERE accepted AND eval_strategy_label IS NOT NULL GROUP BY 1""")),
    "appositive_examples": Check(
        lambda s, d: L.appositive_examples(corpus(s, d)),
        with_corpus("""SELECT row_id, referent, EN_masculine_sentence FROM corpus
           WHERE accepted AND eval_strategy_label = 'appositive_dash' ORDER BY row_id LIMIT 3""")),
    "rubric_means": Check(
        lambda s, d: L.rubric_means(corpus(s, d), RUBRIC_COLUMNS),
        with_corpus(" UNION ALL ".join(
            f"SELECT '{c}' AS criterion, count({c}) AS n, avg({c}) AS mean FROM corpus" for c in RUBRIC_COLUMNS))),
    "issue_list": Check(
        lambda s, d: L.issue_list(corpus(s, d).withColumnRenamed("eval_issues", "issues")),
        with_corpus("SELECT row_id, referent, eval_issues AS issues FROM corpus WHERE coalesce(eval_issues, '') <> ''")),
    "normal_rating": Check(
        lambda s, d: reviews(s, d).select("row_id", "rating", "has_great", "strategy"),
        with_corpus("SELECT row_id, rating, has_great, strategy FROM rated", SQL_RATED)),
    "reviewed_rows": Check(
        lambda s, d: B.reviewed_ok(reviews(s, d)).select("row_id", "rating"),
        with_corpus("SELECT row_id, rating FROM rated WHERE rating IN ('good', 'meh')", SQL_RATED)),
    "rating_counts": Check(
        lambda s, d: L.rating_counts(reviews(s, d)),
        with_corpus("""SELECT rating, n AS count, round(100.0::DOUBLE * n / t, 1) AS percent FROM (
             SELECT 'good' AS rating, count(*) FILTER (rating = 'good') AS n, count(*) AS t FROM rated
             UNION ALL SELECT 'meh', count(*) FILTER (rating = 'meh'), count(*) FROM rated
             UNION ALL SELECT 'bad', count(*) FILTER (rating = 'bad'), count(*) FROM rated
             UNION ALL SELECT 'ok (good+meh)', count(*) FILTER (rating IN ('good', 'meh')), count(*) FROM rated
             UNION ALL SELECT 'other/unrated', nullif(count(*) FILTER (rating NOT IN ('good', 'meh', 'bad')), 0), count(*) FROM rated)
           WHERE n IS NOT NULL""", SQL_RATED)),
    "great_count": Check(
        lambda s, d: L.great_count(reviews(s, d)),
        with_corpus("SELECT count(*) FILTER (has_great) AS n_great FROM rated", SQL_RATED)),
    "rating_by_strategy": Check(
        lambda s, d: L.rating_by_strategy(reviews(s, d)),
        with_corpus("""SELECT strategy, count(*) AS n, count(*) FILTER (rating = 'good') AS good,
           count(*) FILTER (rating = 'meh') AS meh, count(*) FILTER (rating = 'bad') AS bad,
           round(100.0::DOUBLE * count(*) FILTER (rating IN ('good', 'meh')) / count(*), 1) AS pct_ok
           FROM rated GROUP BY 1""", SQL_RATED)),
    "retry_state": Check(retry_state, with_corpus(
        f"SELECT {', '.join(STATE_COLUMNS)} FROM retried", SQL_RETRY)),
    "repair_rounds": Check(repair_rounds, with_corpus(
        f"SELECT {', '.join(REPAIRED)} FROM o{ROUNDS}", SQL_REPAIR)),
}
