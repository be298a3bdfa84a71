"""Corpus shape, selection, source quality, routing and assignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.check import Check
from checks.tables import SQL_CORPUS, SQL_LONG, corpus, dealt, table
from pairlens.fixed_values import FEMALE_FIRST_NAMES, KIN_PAIRS, MALE_FIRST_NAMES, SURNAMES
from pairlens.functions.columns import settle
from pairlens.operators import assignment as A
from pairlens.operators import quality as Q
from pairlens.operators import reshape as G
from pairlens.operators import responses as H
from pairlens.operators import routing as R
from pairlens.operators import selection as B
from pairlens.sources.readers import pair_lexicon

# Frequent words of the four languages stand in for pronouns; the documents have no English ones.
PRONOUNS = ("that", "was", "den", "les", "las", "with", "of")
NEUTRAL = ("that", "it", "der", "que", "this", "are")
FORBIDDEN = (("the", "of"), ("les", "la"), ("der", "das"))


def _sql_array(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def with_corpus(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([SQL_CORPUS, *ctes]) + "\n" + body


# ---------------------------------------------------------------- source quality

SQL_WORDS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_'']+')"

SQL_FLAGS = f"""
worded AS (SELECT *, {SQL_WORDS.format('EN_source_sentence')} AS w,
   len(list_filter(string_split_regex(EN_source_sentence, '\\s+'), lambda x: x <> '')) AS n_tokens FROM corpus),
positions AS (SELECT *, list_filter(range(1, len(w) + 1), lambda i: starts_with(w[i], referent)) AS ref_at,
   list_filter(range(1, len(w) + 1), lambda i: list_contains({_sql_array(PRONOUNS)}, w[i])) AS pro_at FROM worded),
flags AS (SELECT row_id, referent, grammaticality_score,
   n_tokens > 30 AND regexp_matches(EN_source_sentence, '[.!?]\\s+[A-Z]') AS multi,
   len(list_filter(ref_at, lambda r: len(list_filter(pro_at, lambda p: p <> r AND abs(p - r) <= 5)) > 0)) > 0 AS gendered,
   coalesce(grammaticality_score <= 2, false) AS low FROM positions)"""


def quality_flags(spark, sf_dir):
    return Q.quality_flags(corpus(spark, sf_dir), PRONOUNS).select(
        "row_id", "flag_multi_sentence", "flag_pre_gendered", "flag_low_grammaticality", "flagged", "flag_reasons")


def scored_flags(spark, sf_dir):
    """The same flags with scores that come back as replies; a missing score is a failed or garbled reply."""
    rows = corpus(spark, sf_dir)
    score = F.col("grammaticality_score")
    replies = rows.select(
        F.concat(F.lit("gram_"), F.col("row_id").cast("string")).alias("custom_id"),
        F.when(score.isNull() & (F.col("h") % 2 == 0), "errored").otherwise("succeeded").alias("status"),
        F.coalesce(F.concat(F.lit('Rated: {"score": '), score.cast("string"), F.lit("}")), F.lit("no score")).alias("text"),
        F.lit(1).alias("arrival"))
    scored = H.grammaticality_scores(H.attach(rows.select("row_id"), replies, "gram"))
    return Q.quality_flags(Q.with_scores(rows.drop("grammaticality_score"), scored), PRONOUNS).select(
        "row_id", "flag_multi_sentence", "flag_pre_gendered", "flag_low_grammaticality", "flagged", "flag_reasons")


def prefilter(spark, sf_dir):
    return Q.prefilter(corpus(spark, sf_dir), PRONOUNS).select(
        "row_id", "filter_multi_sentence", "filter_pre_gendered", "filter_low_grammaticality", "filter_any", "auto_reject")


def quality_counts(spark, sf_dir):
    return Q.flag_counts(Q.prefilter(corpus(spark, sf_dir), PRONOUNS))


# ---------------------------------------------------------------- lexicon and routing

def lexicon_lines(spark, sf_dir):
    """One markdown table row per line of text, from its first words; short lines give dashes."""
    w = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{2,}"), F.lit(0))
    def word(i):
        return F.coalesce(F.try_element_at("w", F.lit(i)), F.lit("-"))
    line = F.concat(F.lit("| "), word(1), F.lit(" / "), word(2), F.lit(" | "), word(3), F.lit(" | "),
                    word(4), F.lit(", "), word(5), F.lit(" / "), word(6), F.lit(" |"))
    docs = dealt(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    worded = settle(lines.select((F.col("doc_id") * 4294967296 + F.col("pos")).alias("line_no"), "text"), {"w": w}).select("line_no", "w")
    return settle(worded, {"line": line}).drop("w")


SQL_LEXICON = """
lexicon_texts AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS pos
   FROM documents),
lexicon_words AS (SELECT doc_id * 4294967296 + pos AS line_no, regexp_extract_all(lower(text), '\\p{L}{2,}') AS w FROM lexicon_texts),
lexicon_rows AS (SELECT line_no, coalesce(w[1], '-') AS m1, coalesce(w[2], '-') AS m2, coalesce(w[3], '-') AS f1,
   coalesce(w[4], '-') AS n1, coalesce(w[5], '-') AS n2, coalesce(w[6], '-') AS n3 FROM lexicon_words),
lexicon_forms AS (SELECT line_no, m1, f1, unnest([m1, m2, n1, n2, n3, f1]) AS form, unnest(range(6)) AS pos
   FROM lexicon_rows WHERE f1 <> '-'),
lexicon AS (SELECT form, m1 AS masc, f1 AS fem FROM (
   SELECT *, row_number() OVER (PARTITION BY form ORDER BY line_no, pos) AS rn FROM lexicon_forms) WHERE rn = 1)"""


def routed(spark, sf_dir):
    return R.route(corpus(spark, sf_dir), pair_lexicon(lexicon_lines(spark, sf_dir)), FORBIDDEN, NEUTRAL)


def routing(spark, sf_dir):
    h = F.col("hint")
    signals = F.array_join(F.array_sort(F.map_keys(h["signals"])), ",")
    return routed(spark, sf_dir).select(
        "row_id", h["strategy"].alias("strategy"), h["masc"].alias("masc"), h["fem"].alias("fem"),
        h["note"].alias("note"), signals.alias("signals"), R.render_hint(h).alias("rendered"))


SQL_ROUTING = f"""
keyed AS (SELECT *, lower(trim(referent)) AS k1, regexp_replace(lower(trim(referent)), '[^a-z]', '', 'g') AS k2,
   lower(EN_source_sentence) AS lowered,
   regexp_extract_all(lower(EN_source_sentence), '[\\p{{L}}\\p{{N}}_]+|\\s+|[^\\p{{L}}\\p{{N}}_\\s]+') AS p,
   {SQL_WORDS.format('EN_source_sentence')} AS w FROM corpus),
paired AS (SELECT k.*, CASE WHEN a.form IS NOT NULL THEN a.masc ELSE b.masc END AS pm,
   CASE WHEN a.form IS NOT NULL THEN a.fem ELSE b.fem END AS pf
   FROM keyed k LEFT JOIN lexicon a ON a.form = k.k1 LEFT JOIN lexicon b ON b.form = k.k2),
judged AS (SELECT *, pm IS NOT NULL AS has_pair,
   coalesce((pm, pf) IN ({", ".join(f"('{m}', '{f}')" for m, f in FORBIDDEN)}), false) AS forbidden,
   (list_contains(['yes', 'hey', 'look', 'listen', 'oh', 'no', 'well', 'please'], p[1])
     AND coalesce(p[2] = ',' AND trim(p[3]) = '' AND p[4] = referent OR trim(p[2]) = '' AND p[3] = referent, false))
   OR len(list_filter(range(1, len(p) + 1), lambda i: p[i] = referent AND (
     (i > 2 AND trim(p[i - 1]) = '' AND suffix(p[i - 2], ',') AND (
        coalesce(starts_with(p[i + 1], ','), false)
        OR regexp_full_match(array_to_string(p[i + 1:], ''), '\\s*[.!?]\\s*')))
     OR coalesce(trim(p[i + 1]) = '' AND p[i + 2] = 'you' OR p[i + 1] = ',' AND trim(p[i + 2]) = '' AND p[i + 3] = 'you', false)))) > 0
     AS addressee,
   list_filter(range(1, len(w) + 1), lambda i: w[i] = referent) AS ref_at,
   position(referent IN lowered) AS ref_pos FROM paired),
neared AS (SELECT *, list_sort(list_distinct(list_filter(flatten(list_transform(ref_at,
     lambda r: w[greatest(r - 10, 1):r + 10])), lambda x: list_contains({_sql_array(NEUTRAL)}, x)))) AS pronouns,
   ref_pos > 0 AND len(list_filter(['i''m', 'i am', 'i''ve', 'i''ll', 'i had', 'i was', 'as a '],
     lambda m: position(m IN lowered) > 0 AND abs(ref_pos - position(m IN lowered) - length(m)) <= 50)) > 0 AS speaker FROM judged),
cased AS (SELECT *, CASE WHEN has_pair AND NOT forbidden THEN 'pair' WHEN addressee THEN 'addressee'
   WHEN len(pronouns) > 0 THEN 'pronoun' WHEN speaker THEN 'speaker' ELSE 'none' END AS kase FROM neared),
noted AS (SELECT *, CASE kase WHEN 'pair' THEN 'referent_swap' WHEN 'addressee' THEN 'sir_maam'
     WHEN 'pronoun' THEN 'pronoun_swap' WHEN 'speaker' THEN 'pronoun_swap' END AS strategy,
   CASE kase WHEN 'addressee' THEN 'Referent ''' || referent || ''' is the addressee - use sir/ma''am as a vocative.'
     WHEN 'pronoun' THEN 'Source has ' || array_to_string(pronouns, ', ') || ' referring to ''' || referent
       || ''' - swap to he/she, his/her, him/her, himself/herself.'
     WHEN 'speaker' THEN 'Referent ''' || referent || ''' is the first-person speaker - swap every I/me/my that refers to the speaker.'
     END AS note FROM cased),
routing AS (SELECT row_id, referent, EN_source_sentence, strategy, CASE WHEN kase = 'pair' THEN pm END AS masc,
   CASE WHEN kase = 'pair' THEN pf END AS fem, note,
   array_to_string(list_sort(list_filter([CASE WHEN has_pair THEN 'has_pair' END, CASE WHEN has_pair AND forbidden THEN 'forbidden_pair' END,
     CASE kase WHEN 'addressee' THEN 'addressee' WHEN 'pronoun' THEN 'existing_pronouns' WHEN 'speaker' THEN 'first_person' END],
     lambda x: x IS NOT NULL)), ',') AS signals,
   CASE WHEN strategy IS NULL THEN '' ELSE chr(10) || '[HINTS]' || chr(10) || 'RECOMMENDED_STRATEGY: ' || strategy
     || CASE WHEN kase = 'pair' THEN chr(10) || 'MASC_REFERENT: ' || pm || chr(10) || 'FEM_REFERENT: ' || pf ELSE '' END
     || coalesce(chr(10) || 'NOTE: ' || note, '') END AS rendered FROM noted)"""


# ---------------------------------------------------------------- assignment

SQL_TURNS = f"""
turns AS (SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS turn FROM corpus),
named AS (SELECT *, {_sql_array(SURNAMES)}[turn % 12 + 1] AS surname,
   {_sql_array(m for m, _ in KIN_PAIRS)}[turn % 5 + 1] AS kin_masc,
   {_sql_array(f for _, f in KIN_PAIRS)}[turn % 5 + 1] AS kin_fem FROM turns)"""


def rotation(spark, sf_dir):
    return A.rotate_names(corpus(spark, sf_dir).select("row_id")).select(
        "row_id", F.col("assigned_surname").alias("surname"), F.col("assigned_kin.masc").alias("kin_masc"),
        F.col("assigned_kin.fem").alias("kin_fem"))


SQL_QUALITY = with_corpus("""SELECT row_id, multi AS flag_multi_sentence,
        gendered AS flag_pre_gendered, low AS flag_low_grammaticality, multi OR gendered OR low AS flagged,
        array_to_string(list_filter([CASE WHEN multi THEN 'multi_sentence' END, CASE WHEN gendered THEN 'pre_gendered' END,
          CASE WHEN low THEN 'low_grammaticality(score=' || grammaticality_score || ')' END], lambda x: x IS NOT NULL), ', ')
          AS flag_reasons FROM flags""", SQL_FLAGS)

CHECKS = {
    "corpus": Check(corpus, with_corpus("SELECT * FROM corpus")),
    "long_form": Check(lambda s, d: G.to_long(corpus(s, d)), with_corpus("SELECT * FROM long_form", SQL_LONG)),
    "review_columns": Check(
        lambda s, d: G.review_order(corpus(s, d)).drop("h", "doc_id"),
        with_corpus("SELECT * EXCLUDE (h, doc_id) FROM corpus")),
    "exact_sample": Check(
        lambda s, d: B.exact_sample(corpus(s, d).select("row_id", "referent"), 500, 7),
        with_corpus("""SELECT row_id, referent FROM corpus
            ORDER BY ('0x' || substr(md5('7|' || row_id), 1, 8))::BIGINT, row_id LIMIT 500""")),
    "exact_sample_large": Check(
        lambda s, d: B.exact_sample(corpus(s, d).select("row_id", "referent"), 700, 11),
        with_corpus("""SELECT row_id, referent FROM corpus
            ORDER BY ('0x' || substr(md5('11|' || row_id), 1, 8))::BIGINT, row_id LIMIT 700""")),
    "first_examples": Check(
        lambda s, d: B.first_examples(G.to_long(corpus(s, d)), 100),
        with_corpus("""SELECT * FROM long_form ORDER BY row_id,
            list_position(['source', 'masculine', 'feminine'], variant) LIMIT 100""", SQL_LONG)),
    "nonblank_rows": Check(
        lambda s, d: B.drop_blank(corpus(s, d), "EN_feminine_sentence", "eval_human").select("row_id", "eval_human"),
        with_corpus("""SELECT row_id, eval_human FROM corpus WHERE trim(coalesce(EN_feminine_sentence, '')) <> ''
            AND trim(coalesce(eval_human, '')) <> ''""")),
    "undecided_rows": Check(
        lambda s, d: B.undecided(corpus(s, d)).select("row_id", "accepted", "eval_reject"),
        with_corpus("""SELECT row_id, accepted, eval_reject FROM corpus
            WHERE accepted IS NOT TRUE AND eval_reject IS NOT TRUE""")),
    "retryable_rows": Check(
        lambda s, d: B.retryable(corpus(s, d)).select("row_id", "retry_count"),
        with_corpus("""SELECT row_id, retry_count FROM corpus WHERE accepted = false AND eval_reject IS NOT TRUE
            AND coalesce(retry_count, 0) < 5""")),
    "retry_census": Check(
        lambda s, d: B.retry_census(corpus(s, d)),
        with_corpus("""SELECT count(*) AS "rows", count(*) FILTER (accepted = false) AS failures,
            count(*) FILTER (accepted = false AND eval_reject) AS rejected,
            count(*) FILTER (accepted = false AND coalesce(retry_count, 0) >= 5) AS at_cap,
            count(*) FILTER (accepted = false AND eval_reject IS NOT TRUE AND coalesce(retry_count, 0) < 5) AS retryable
            FROM corpus""")),
    "quality_flags": Check(quality_flags, SQL_QUALITY),
    "scored_flags": Check(scored_flags, SQL_QUALITY),
    "prefilter": Check(prefilter, with_corpus("""SELECT row_id, multi AS filter_multi_sentence,
        gendered AS filter_pre_gendered, low AS filter_low_grammaticality, multi OR gendered OR low AS filter_any,
        multi OR low AS auto_reject FROM flags""", SQL_FLAGS)),
    "quality_counts": Check(quality_counts, with_corpus("""SELECT count(*) AS "rows",
        count(*) FILTER (multi) AS filter_multi_sentence, count(*) FILTER (gendered) AS filter_pre_gendered,
        count(*) FILTER (low) AS filter_low_grammaticality, count(*) FILTER (multi OR gendered OR low) AS filter_any,
        count(*) FILTER (multi OR low) AS auto_reject FROM flags""", SQL_FLAGS)),
    "lexicon_dim": Check(
        lambda s, d: pair_lexicon(lexicon_lines(s, d)), f"WITH {SQL_LEXICON} SELECT * FROM lexicon"),
    "routing": Check(routing, with_corpus("""SELECT row_id, strategy, masc, fem, note, signals, rendered FROM routing""",
                                          SQL_LEXICON, SQL_ROUTING)),
    "hint_counts": Check(
        lambda s, d: R.hint_counts(routed(s, d)),
        with_corpus("SELECT strategy, count(*) AS n FROM routing WHERE strategy IS NOT NULL GROUP BY 1",
                    SQL_LEXICON, SQL_ROUTING)),
    "rotation": Check(rotation, with_corpus("SELECT row_id, surname, kin_masc, kin_fem FROM named", SQL_TURNS)),
    "rotation_counts": Check(
        lambda s, d: A.usage_counts(A.rotate_names(corpus(s, d).select("row_id")), "assigned_surname"),
        with_corpus("SELECT surname AS item, count(*) AS n FROM named GROUP BY 1", SQL_TURNS)),
    "first_name_rotation": Check(
        lambda s, d: A.rotate_first_names(corpus(s, d).select("row_id")),
        with_corpus(f"""SELECT row_id, {_sql_array(MALE_FIRST_NAMES)}[turn % 12 + 1] AS male_name,
            {_sql_array(FEMALE_FIRST_NAMES)}[turn % 12 + 1] AS female_name FROM turns""", SQL_TURNS)),
    "strategy_share": Check(
        lambda s, d: A.strategy_share(corpus(s, d)),
        with_corpus("""SELECT disambiguation_strategy AS strategy, count(*) AS n,
            floor(100 * count(*) / sum(count(*)) OVER ())::BIGINT AS percent
            FROM corpus WHERE disambiguation_strategy IS NOT NULL GROUP BY 1""")),
    "strategy_names": Check(
        lambda s, d: corpus(s, d).select("row_id", G.strategy_display(F.col("disambiguation_strategy")).alias("x"))
        .select("row_id", F.col("x.display").alias("display"), F.col("x.cue_group").alias("cue_group")),
        with_corpus("""SELECT c.row_id, n.display, n.cue_group FROM corpus c LEFT JOIN names n ON n.s = c.disambiguation_strategy""",
                    """names(s, display, cue_group) AS (VALUES ('referent_swap', 'lexical swap', 'local'),
            ('pronoun_swap', 'pronoun rewrite', 'local'), ('pronoun_insertion', 'possessive tag', 'local'),
            ('context_modifier', 'distal noun cue', 'local'), ('relational_insertion', 'kin appositive', 'cross'),
            ('title_insertion', 'title appositive', 'cross'), ('sir_maam', 'vocative address', 'cross'),
            ('adjective', 'gender adjective', 'local'), ('appositive_dash', 'dashed appositive', 'local'))""")),
}
