"""Quality rules and a hashed n-gram log-likelihood ratio, in native expressions only.

Two multinomials over hashed word 1- and 2-grams are counted: one over every document (raw), one over the
trusted target, documents labelled good and not toxic. A document scores the mean of
log p_target(bucket) - log p_raw(bucket) over its n-grams. Half of the trusted documents fit the target; the
other half fixes the threshold: the exact quantile of its scores that loses ``LOSS`` of those that pass the base rules.
A quantile doesn't follow how far outliers lie, and a verdict never depends on other verdicts.

Bounds: the two count vectors have ``BUCKETS`` numbers each whatever the corpus. Every trusted document is used. Ids, bucket
counts and the numbers of the held-out half are shuffled; texts are only for documents that two sieves of trusted ids leave
open, which are few up to some millions of trusted documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.functions.columns import bind, settle
from pairlens.operators.leakage import may_hold, sieve_row
from pairlens.session import new_state_path

BUCKETS = 1 << 16
SMOOTHING = 0.5
LOSS = 0.005
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = r"[#*$%&|<>]"
SPACES = " \t\n\x0b\x0c\r"
SPLIT = r"[\x20\x09-\x0D]+"


def word_array(text: Column) -> Column:
    """Words between spaces and ASCII control spaces; of a null or blank text: none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPLIT))


def window_hashes(hashes: Column, window: int = WINDOW) -> Column:
    """One hash for each run of ``window`` elements: hashes of runs half as long are joined, so each costs a few steps."""
    def joined(runs: Column, step: int) -> Column:
        return bind(runs, lambda a: F.transform(a, lambda x, i: F.xxhash64(x, F.get(a, i + step))))

    size, found = 1, hashes
    while size < window:
        step = min(size, window - size)
        found, size = joined(found, step), size + step
    return F.slice(found, 1, F.greatest(F.size(hashes) - (window - 1), F.lit(0)))


def repeated_words(hashes: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words that the text has twice or more, by their word hashes."""
    def covered(w: Column) -> Column:
        def neighbours(s: Column) -> Column:
            last = F.size(s) - 1
            flagged = F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"]))
                               | ((i < last) & (F.get(s, i + 1)["h"] == x["h"])))
            return F.array_sort(F.transform(flagged, lambda x: x["p"]))

        ordered = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return bind(bind(ordered, neighbours), lambda p: F.aggregate(
            p, F.struct(F.lit(-window).alias("end"), F.lit(0).alias("n")),
            lambda a, x: F.struct((x + window).alias("end"), (a["n"] + F.least(F.lit(window), x + window - a["end"])).alias("n")),
            lambda a: a["n"]))

    return bind(window_hashes(hashes, window), lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(F.lit(0)))


def ngram_buckets(hashes: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of all 1-grams and 2-grams."""
    mask = F.lit(buckets - 1).cast("bigint")
    ones = F.transform(hashes, lambda h: h.bitwiseAND(mask).cast("int"))
    twos = F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + 1)).bitwiseAND(mask).cast("int"))
    return F.concat(ones, F.slice(twos, 1, F.greatest(F.size(hashes) - 1, F.lit(0))))


def _hashes() -> Column:
    return F.transform(word_array(F.col("text")), lambda w: F.xxhash64(w))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id and ``_ql_fit`` of all documents whose labels all say good and not toxic. A hash deals them to the half that
    fits the target and the half that sets the threshold."""
    good = (labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id")
            .agg(F.min(F.coalesce("quality", F.lit(0))).alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
            .where("quality = 1 AND toxic = 0").select("doc_id"))
    return good.withColumn("_ql_fit", F.pmod(F.xxhash64(F.lit(12), "doc_id"), F.lit(2)) == 0)


def _held(ids: DataFrame, path: str) -> Column:
    """Whether the sieve of these ids, kept at ``path``, may hold a row's doc_id; plans only read it, wherever it stands in them."""
    sieve_row(ids.select(F.xxhash64("doc_id").alias("key"))).write.parquet(path)
    return may_hold(ids.sparkSession.read.parquet(path).scalar(), F.xxhash64("doc_id"))


def _by_trust(docs: DataFrame, trusted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, text and ``_ql_fit`` (true: trusted, of the half that fits the target), in two parts: the few documents that two
    sieves leave open, kept in the shared folder, and all others, which don't leave the scan.

    The first sieve has the fitting ids, the second the ids that the first one holds by mistake, which ids alone tell. What the
    first holds and the second doesn't is trusted.
    """
    folder, plain = new_state_path(docs.sparkSession, "trusted"), docs.select("doc_id", "text")
    fit = trusted.where("_ql_fit").select("doc_id")
    taken = _held(fit, f"{folder}/fit_sieve")
    mistaken = docs.where(taken).select("doc_id").distinct().join(fit, "doc_id", "left_anti")
    open_ = taken & _held(mistaken, f"{folder}/mistaken_sieve")
    plain.where(open_).join(fit.withColumn("_ql_fit", F.lit(True)), "doc_id", "left").write.parquet(f"{folder}/open")
    return docs.sparkSession.read.parquet(f"{folder}/open"), plain.where(~open_).withColumn("_ql_fit", taken)


def bucket_weights(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row: ``weights``, the log ratio of every bucket, smoothed; all 0 without trusted documents."""
    unsure, rest = _by_trust(docs, trusted)
    return _weights(unsure.unionByName(rest), buckets)


def _weights(flagged: DataFrame, buckets: int) -> DataFrame:
    spark = flagged.sparkSession
    counts = (flagged.withColumn("_ql_hashes", _hashes()).select("_ql_fit", F.explode(ngram_buckets(F.col("_ql_hashes"), buckets)).alias("bucket"))
              .groupBy("bucket").agg(F.count("*").alias("raw"), F.count_if("_ql_fit").alias("target")))
    filled = (spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
              .na.fill(0, ["raw", "target"]))
    collected = filled.agg(
        F.sum("raw").alias("n_raw"), F.sum("target").alias("n_target"),
        F.array_sort(F.collect_list(F.struct("bucket", "raw", "target"))).alias("cells"))
    smooth = F.lit(SMOOTHING)

    def log_share(count: Column, total: Column) -> Column:
        return F.log((count + smooth) / (total + smooth * buckets))

    return collected.select(F.when(F.col("n_target") > 0, F.transform("cells", lambda c: log_share(
        c["target"], F.col("n_target")) - log_share(c["raw"], F.col("n_raw")))).otherwise(
            F.array_repeat(F.lit(0.0), buckets)).alias("weights"))


def _score(hashes: Column, weights: Column, buckets: int) -> Column:
    """Mean weight of the buckets of ``ngram_buckets``, added up in their order without an array of them."""
    mask = F.lit(buckets - 1).cast("bigint")

    def mean(h: Column, w: Column) -> Column:
        def weight(x: Column) -> Column:
            return F.get(w, x.bitwiseAND(mask).cast("int"))

        n = F.size(h)
        ones = F.aggregate(h, F.lit(0.0), lambda a, x: a + weight(x))
        twos = bind(window_hashes(h, 2), lambda t: F.aggregate(t, ones, lambda a, x: a + weight(x)))
        return F.when(n == 0, F.lit(0.0)).otherwise(twos / (n * 2 - 1))

    return bind(F.struct(hashes.alias("h"), weights.alias("w")), lambda p: bind(p["w"], lambda w: bind(p["h"], lambda h: mean(h, w))))


def _scored(hashed: DataFrame, weights: DataFrame, buckets: int) -> DataFrame:
    """``hashed`` with ``_ql_llr``. The weights are a scalar subquery: as a literal they stood in every plan, and in each of the
    texts of plans that the driver keeps. They have a column of their own for the analyzer alone, which allows none in lambdas;
    it is used once, right above a settled step, and so becomes part of the score."""
    return hashed.withColumn("_ql_weights", weights.scalar()).select(
        *hashed.columns, _score(F.col("_ql_hashes"), F.col("_ql_weights"), buckets).alias("_ql_llr"))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (n_repeat_words * 100 > n_words * MAX_REPEAT_PERCENT)


def score_threshold(held_out: DataFrame, loss: float = LOSS) -> float:
    """The quantile ``loss`` of ``llr`` over rows (n_words, n_repeat_words, llr) that pass the base rules, of all rows if
    none does; 0 without rows."""
    passed = ~base_failed(F.col("n_words"), F.col("n_repeat_words"))
    found = held_out.agg(F.coalesce(F.percentile(F.when(passed, F.col("llr")), loss), F.percentile("llr", loss))).first()[0]
    return 0.0 if found is None else float(f"{found:.9g}")


def judged(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, loss: float = LOSS) -> DataFrame:
    """``docs``, all columns, with the verdict of each row in the struct column ``_quality``: n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words (long), base_failed, llr (double, mean log ratio), llr_threshold (double), kept.

    A null text counts as empty: no words, base_failed. Repeated rows and null ids are judged row by row (a
    null id has no label). Without labels nothing is trusted: all scores and the threshold are 0, and the
    base rules decide. Window repeats are found by 64-bit hashes.
    """
    spark, folder = docs.sparkSession, new_state_path(docs.sparkSession, "quality")
    trusted_ids(labels).write.parquet(f"{folder}/trusted")
    trusted = spark.read.parquet(f"{folder}/trusted")
    bucket_weights(docs, trusted, buckets).write.parquet(f"{folder}/weights")
    weights = spark.read.parquet(f"{folder}/weights").select(  # one number per bucket, nine digits each
        F.transform("weights", lambda w: F.format_string("%.8e", w).cast("double")).alias("weights"))
    weights.write.parquet(f"{folder}/rounded")
    weights = spark.read.parquet(f"{folder}/rounded")
    held_out = trusted.where("NOT _ql_fit").select("doc_id")
    held = _held(held_out, f"{folder}/held_sieve")
    hashed = settle(docs.select("doc_id", "text").where(held), {"_ql_hashes": _hashes()}).drop("text")
    measured = settle(_scored(hashed, weights, buckets), {"_ql_held": F.struct(
        F.size("_ql_hashes").alias("n_words"), repeated_words(F.col("_ql_hashes")).alias("n_repeat_words"),
        F.col("_ql_llr").alias("llr"))}).select("doc_id", "_ql_held.*")
    threshold = score_threshold(measured.join(held_out, "doc_id"), loss)  # three numbers a document move, no text

    text, hashes = F.coalesce("text", F.lit("")), F.col("_ql_hashes")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    of_words = bind(word_array(F.col("text")), lambda w: F.struct(
        F.transform(w, lambda x: F.xxhash64(x)).alias("hashes"), F.char_length(F.array_join(w, "")).cast("bigint").alias("word_chars")))
    measures = F.struct(
        F.size(hashes).cast("bigint").alias("n_words"),
        F.col("_ql_word_chars").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        repeated_words(hashes).cast("bigint").alias("n_repeat_words"),
        F.col("_ql_llr").alias("llr"))
    q = F.col("_quality")
    failed = base_failed(q["n_words"], q["n_repeat_words"])
    hashed = settle(docs, {"_ql_words": of_words}).select(
        *docs.columns, F.col("_ql_words.hashes").alias("_ql_hashes"), F.col("_ql_words.word_chars").alias("_ql_word_chars"))
    return (settle(_scored(hashed, weights, buckets), {"_quality": measures}).drop("_ql_hashes", "_ql_word_chars", "_ql_llr")
            .withColumn("_quality", q.withField("base_failed", failed).withField("llr_threshold", F.lit(threshold))
                        .withField("kept", ~failed & (q["llr"] >= threshold))))


def quality_verdicts(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id and the verdict's fields, one row per document row; extra columns of ``docs`` are ignored. See ``judged``."""
    return judged(docs.select("doc_id", "text"), labels, **options).select("doc_id", "_quality.*")
