"""Overlap between train, test and example texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.fixed_values import VARIANT_COLUMNS
from pairlens.functions.columns import bind, ratio, settle
from pairlens.functions.text import NO_SPACE, SPACE, is_blank, strip, tokens
from pairlens.session import new_state_path

# A text of three tokens or more.
_THREE = f"{NO_SPACE}{SPACE}++{NO_SPACE}++{SPACE}++{NO_SPACE}"
# Runs of whole tokens used to find a passage: the longest of these that lies inside it.
_RUNS = (4, 3, 2, 1)


def normal_sentence(c: Column) -> Column:
    return F.lower(strip(c))


def _keys(corpus: DataFrame) -> DataFrame:
    """Normalised sentences of all variants as 128 bits of hash: row_id, a, b. A row without any has one row of nulls."""
    columns = [s for s, _ in VARIANT_COLUMNS.values() if s in corpus.columns]
    sentences = F.filter(F.transform(F.array(*[F.col(c) for c in columns]), normal_sentence), lambda x: ~is_blank(x))
    keys = F.transform(sentences, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b")))
    return corpus.select("row_id", F.explode_outer(F.array_distinct(keys)).alias("_key")).select("row_id", "_key.a", "_key.b")


def _suspects(train: DataFrame, known: DataFrame) -> DataFrame:
    """Train sentences (row_id, a, b) that the test side's sieve may hold; the others don't leave the scan."""
    return _keys(train).where(may_hold(sieve(known.select(F.col("a").alias("key"))), F.col("a")))


def contaminated_ids(train: DataFrame, test: DataFrame) -> DataFrame:
    """Ids of train rows with any variant equal to any variant of any test row.

    The test side is reduced to distinct sentences. Hashes are shuffled, of the train side only those that its sieve may
    hold, so the exchange follows the hits and not the train corpus.
    """
    known = _keys(test).where(F.col("a").isNotNull()).select("a", "b").distinct()
    return _suspects(train, known).join(known, ["a", "b"], "left_semi").select("row_id").distinct()


def drop_contaminated(train: DataFrame, test: DataFrame) -> DataFrame:
    return train.join(contaminated_ids(train, test), "row_id", "left_anti")


def contamination_report(train: DataFrame, test: DataFrame) -> DataFrame:
    """Rows, dropped rows and dropped percent; ``row_id`` is unique."""
    marks = train.select(F.lit(False).alias("hit")).unionByName(contaminated_ids(train, test).select(F.lit(True).alias("hit")))
    counted = marks.agg(F.count_if(~F.col("hit")).alias("rows"), F.count_if("hit").alias("dropped"))
    return counted.withColumn("percent", ratio(F.col("dropped") * 100, F.col("rows"), 2))


def _hashed(t: Column) -> Column:
    """Hashes, first and last characters of the tokens, each as an array."""
    return F.struct(
        F.transform(t, lambda x: F.xxhash64(x)).alias("hash"), F.transform(t, lambda x: F.left(x, F.lit(1))).alias("first"),
        F.transform(t, lambda x: F.right(x, F.lit(1))).alias("last"))


def _tokens(c: Column) -> Column:
    return bind(tokens(c), _hashed)


def _runs(found: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` consecutive tokens that have a neighbour on each side, with the touching
    characters of the neighbours; candidates are verified on the text."""
    at = F.size(found["hash"]) - size
    return F.when(at > 1, F.transform(F.sequence(F.lit(1), at - 1), lambda i: F.xxhash64(
        F.get(found["last"], i - 1), *[F.get(found["hash"], i + k) for k in range(size)], F.get(found["first"], i + size))))


# A sieve is a blocked Bloom filter: SIEVE_CELLS words of 64 bits, three bits of one word per key.
SIEVE_CELLS = 1 << 18


def _cell(key: Column) -> Column:
    return key.bitwiseAND(F.lit(SIEVE_CELLS - 1)).cast("int")


def _bits(key: Column) -> Column:
    one = F.lit(1).cast("bigint")
    masks = [F.call_function("shiftleft", one, F.shiftrightunsigned(key, n).bitwiseAND(F.lit(63)).cast("int")) for n in (18, 24, 30)]
    return masks[0].bitwiseOR(masks[1]).bitwiseOR(masks[2])


def sieve_row(keys: DataFrame) -> DataFrame:
    """Bloom filter of the 64-bit hashes in column ``key``: one row with one array, of a fixed size whatever their number.

    An aggregate with partial results of at most ``SIEVE_CELLS`` rows. Beyond some millions of keys it lets more and more pass,
    but stops no key.
    """
    cells = keys.select(_cell(F.col("key")).alias("cell"), _bits(F.col("key")).alias("mask")).groupBy("cell").agg(F.bit_or("mask").alias("mask"))
    filled = cells.agg(F.array_sort(F.collect_list(F.struct("cell", "mask"))).alias("c"))

    def spread(c: Column) -> Column:
        """The masks at their cells, zeros between them: gaps before each cell, and up to the end."""
        gaps = F.transform(c, lambda x, i: F.concat(
            F.array_repeat(F.lit(0).cast("bigint"), x["cell"] - F.coalesce(F.get(c, i - 1)["cell"], F.lit(-1)) - 1), F.array(x["mask"])))
        last = F.coalesce(F.try_element_at(c, F.lit(-1))["cell"], F.lit(-1))
        return F.concat(F.flatten(gaps), F.array_repeat(F.lit(0).cast("bigint"), F.lit(SIEVE_CELLS - 1) - last))

    return filled.select(bind(F.col("c"), spread).alias("sieve"))


def sieve(keys: DataFrame) -> Column:
    """``sieve_row`` as a scalar subquery: built once and read by every task before anything is shuffled."""
    return sieve_row(keys).scalar()


def may_hold(found: Column, key: Column) -> Column:
    """False only for keys that the sieve doesn't hold."""
    return F.get(found, _cell(key)).bitwiseAND(_bits(key)) == _bits(key)


def _inner_runs(t: Column) -> Column:
    n = F.size(t["hash"]) - 2
    inside = F.when(n >= _RUNS[0], _runs(t, _RUNS[0]))
    for size in _RUNS[1:]:
        inside = inside.when(n == size, _runs(t, size))
    return F.struct(F.least(n, F.lit(_RUNS[0])).alias("size"), F.array_distinct(inside).alias("runs"))


def _end_runs(t: Column) -> Column:
    """The first and the last inner run, from the tokens at either end alone."""
    reach = _RUNS[0] + 2
    ends = {"first": F.slice(t, F.lit(1), F.lit(reach)), "last": F.slice(t, F.greatest(F.size(t) - reach + 1, F.lit(1)), F.lit(reach))}
    return F.struct(*[F.get(bind(_hashed(part), _inner_runs)["runs"], F.lit(0)).alias(name) for name, part in ends.items()])


def _inner(needles: DataFrame, held: Column | None = None) -> DataFrame:
    """Runs of whole tokens inside each needle of three tokens or more, with ``held`` only of those whose first and last run
    that sieve may hold.

    The first and last token of a needle may be cut from longer ones in the haystack; the tokens
    between stand there whole, and so do the characters that touch them, so every haystack text with the
    needle has every inner run.
    """
    texts = needles.select("needle_id", "text")
    if held is not None:
        texts = settle(texts, {"ends": bind(tokens(F.col("text")), _end_runs)}).where(
            may_hold(held, F.col("ends.first")) & may_hold(held, F.col("ends.last"))).drop("ends")
    rows = settle(texts, {"found": bind(_tokens(F.col("text")), _inner_runs)})
    return rows.where(F.col("found.runs").isNotNull()).select("needle_id", "found.*")


def _hay_runs(haystack: DataFrame, sizes: tuple[int, ...] = _RUNS) -> DataFrame:
    """One row per text and token run of one of these sizes, repeated ones too; rows go on to the filter above, not to a shuffle."""
    every = bind(_tokens(F.col("text")), lambda t: F.flatten(F.array_compact(F.array(*[_runs(t, n) for n in sizes]))))
    return haystack.select("hay_id", F.explode(every).alias("run"))


def _written(df: DataFrame, folder: str, name: str) -> DataFrame:
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.parquet(f"{folder}/{name}")


def _run_candidates(needles: DataFrame, haystack: DataFrame, few_texts: bool, folder: str) -> DataFrame:
    """(needle_id, hay_id) pairs that share the needle's inner run which the fewest haystack texts have.

    Token runs of the haystack leave the scan only if the needles' sieve may hold them; what does is kept once, for the
    counts and for the pairs. With ``few_texts``, needles leave theirs only if the haystack's sieve may hold their first and
    last run.
    """
    runs = _inner(needles, sieve(_hay_runs(haystack).select(F.col("run").alias("key"))) if few_texts else None)
    runs = _written(runs.select("needle_id", "size", F.explode("runs").alias("run")).distinct(), folder, "runs")
    sizes = tuple(r["size"] for r in runs.select("size").distinct().collect())  # of _RUNS
    if not sizes:
        return runs.select("needle_id", F.lit(None).alias("hay_id")).limit(0)
    hits = _written(_hay_runs(haystack, sizes).where(may_hold(sieve(runs.select(F.col("run").alias("key"))), F.col("run"))).distinct(), folder, "hits")
    frequency = hits.groupBy("run").agg(F.count("*").alias("texts"))
    # a run that no text has makes its needle a needle of none
    rarest = (runs.join(frequency, "run", "left").groupBy("needle_id")
              .agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), F.col("run"))).alias("rarest"))
              .where(F.col("rarest.texts") > 0).select("needle_id", F.col("rarest.run").alias("run")))
    return hits.join(rarest, "run").select("needle_id", "hay_id")


def _pieces(c: Column, sizes) -> Column:
    """Distinct substrings of these sizes."""
    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.char_length(c) - (n - 1))
        return F.when(F.char_length(c) >= n, F.transform(starts, lambda i: F.substr(c, i, F.lit(n))))

    return F.array_distinct(F.flatten(F.array_compact(F.array(*map(of, sizes)))))


def _ends(c: Column, side, sizes) -> Column:
    return F.array_compact(F.array(*[F.when(F.char_length(c) >= n, side(c, F.lit(n))) for n in sizes]))


def _short_candidates(needles: DataFrame, haystack: DataFrame, folder: str) -> DataFrame:
    """(needle_id, hay_id) pairs for needles of one or two tokens, which have no inner token.

    One token must lie inside a token of the text; two must meet at the border of two neighbours. Both are looked up
    in the distinct vocabulary, by pieces of up to three characters; words and pairs of neighbours leave the scan only if the sieve
    of the needles' pieces may hold one of theirs, and without short needles no text is cut into words.
    """
    few = needles.select("needle_id", "text").where(~F.rlike("text", F.lit(_THREE)))  # others are not cut into tokens
    short = settle(few, {"t": tokens(F.col("text"))}).where(F.size("t").isin(1, 2)).select(
        "needle_id", F.col("t")[0].alias("a"), F.try_element_at("t", F.lit(2)).alias("b"))
    left = F.when(F.col("b").isNull(), F.left("a", F.lit(3))).otherwise(F.right("a", F.lit(3)))
    short = _written(short.select("needle_id", "a", "b", left.alias("p"), F.left("b", F.lit(3)).alias("q")), folder, "short")
    sizes = [tuple(r) for r in short.select(F.char_length("p"), F.char_length("q")).distinct().collect()]  # at most 3 and 9
    ones, ps, qs = ([*{p for p, q in sizes if q is None}], [*{p for p, q in sizes if q}], [*{q for _, q in sizes if q}])
    if not sizes:
        return short.select("needle_id", F.lit(None).alias("hay_id")).limit(0)

    cut = settle(haystack.select("hay_id", "text"), {"t": tokens(F.col("text"))}).drop("text")
    held, none, found = sieve(short.select(F.xxhash64("p", "q").alias("key"))), F.lit(None).cast("string"), []
    if ones:
        words = cut.select("hay_id", F.explode(F.array_distinct("t")).alias("x"), none.alias("y"))
        found.append(words.select("*", F.explode(_pieces(F.col("x"), ones)).alias("p")).where(may_hold(held, F.xxhash64("p", none))))
    if ps:
        last = F.slice("t", F.lit(1), F.greatest(F.size("t") - 1, F.lit(0)))
        meet = F.zip_with(last, F.slice("t", F.lit(2), F.size("t")), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
        pairs = cut.where(F.size("t") >= 2).select("hay_id", F.explode(meet).alias("w")).select("hay_id", "w.x", "w.y")
        pairs = pairs.select("*", F.explode(_ends(F.col("x"), F.right, ps)).alias("p")).select(
            "*", F.explode(_ends(F.col("y"), F.left, qs)).alias("q"))
        found.append(pairs.where(may_hold(held, F.xxhash64("p", "q"))))
    found = [f.select("hay_id", "x", "y").distinct() for f in found]
    postings = _written(found[0] if len(found) == 1 else found[0].unionByName(found[1]), folder, "words")
    vocabulary = postings.select("x", "y").distinct()
    one = vocabulary.where(F.col("y").isNull()).select("x", F.explode(_pieces(F.col("x"), ones or [1])).alias("p"))
    one = (one.join(short.where(F.col("b").isNull()), "p").where(F.contains("x", "a"))
           .select("needle_id", "x", F.lit("").alias("y")))
    two = vocabulary.where(F.col("y").isNotNull()).select("x", "y", F.explode(_ends(F.col("x"), F.right, ps or [1])).alias("p"))
    two = two.select("x", "y", "p", F.explode(_ends(F.col("y"), F.left, qs or [1])).alias("q"))
    two = (two.join(short.where(F.col("b").isNotNull()), ["p", "q"])
           .where(F.endswith("x", "a") & F.startswith("y", "b")).select("needle_id", "x", "y"))
    hits = one.unionByName(two)
    return hits.join(postings.withColumn("y", F.coalesce("y", F.lit(""))), ["x", "y"]).select("needle_id", "hay_id")


def _texts_of(rows: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """The texts of candidates, each once; other texts don't leave the scan."""
    held = sieve(candidates.select(F.xxhash64(key).alias("key")))
    return rows.where(may_hold(held, F.xxhash64(key))).select(key, "text").dropDuplicates([key])


def containing(needles: DataFrame, haystack: DataFrame, few_texts: bool = False) -> DataFrame:
    """(needle_id, hay_id, equal) for every haystack text that contains the needle text.

    ``needles``: needle_id, text; ``haystack``: hay_id, text; rows of one id have one text, which counts once. Ids can be of any type.
    Ids and hashes of token runs are shuffled, those alone that may match; every match is found by an equi-join and verified
    on the whole texts. ``few_texts``: the haystack is the small side, which only changes what is sieved first. Blank needles match
    nothing. Hits are kept in the shared folder while the plan is built, so they are computed once.
    """
    folder = new_state_path(needles.sparkSession, "containment")
    pairs = _run_candidates(needles, haystack, few_texts, f"{folder}/runs")
    candidates = _written(pairs.unionByName(_short_candidates(needles, haystack, f"{folder}/short")).distinct(), folder, "candidates")
    return (candidates.join(_texts_of(needles, candidates, "needle_id").withColumnRenamed("text", "_needle"), "needle_id")
            .join(_texts_of(haystack, candidates, "hay_id"), "hay_id").where(F.contains("text", "_needle"))
            .select("needle_id", "hay_id", (F.col("text") == F.col("_needle")).alias("equal")))


def _by_text(rows: DataFrame, name: str) -> DataFrame:
    """Rows keyed by 128 bits of their text's hash, so that copies share an id without any shuffle of texts."""
    return rows.where(F.col("text").isNotNull()).select(
        F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b")).alias(name), "text")


def _copies(rows: DataFrame, name: str, matched: DataFrame) -> DataFrame:
    """How many rows have each matched text."""
    held = sieve(matched.select(F.xxhash64(name).alias("key")))
    return rows.where(may_hold(held, F.xxhash64(name))).groupBy(name).agg(F.count("*").alias("copies"))


def example_overlap(examples: DataFrame, sentences: DataFrame) -> DataFrame:
    """Per example: sentences equal to it, containing it, and contained in it.

    ``examples``: example_id, text; ``sentences``: sentence_id, text. Equal texts are not counted
    as containing. Equal sentences are matched once and counted by their number; examples are the small side.
    """
    folder = new_state_path(examples.sparkSession, "overlap")
    ours, theirs = _by_text(examples, "needle_id"), _by_text(sentences, "hay_id")
    inside = _written(containing(ours, theirs), folder, "inside")
    around = _written(containing(theirs.withColumnRenamed("hay_id", "needle_id"), ours.withColumnRenamed("needle_id", "hay_id"), few_texts=True)
                      .where(~F.col("equal")).select(F.col("needle_id").alias("hay_id"), F.col("hay_id").alias("needle_id")), folder, "around")
    matched = inside.select("needle_id", "hay_id", F.when(F.col("equal"), "n_equal").otherwise("n_containing").alias("kind")).unionByName(
        around.select("needle_id", "hay_id", F.lit("n_contained").alias("kind")))
    counted = (matched.join(_copies(theirs, "hay_id", matched), "hay_id").groupBy("needle_id")
               .pivot("kind", ["n_equal", "n_containing", "n_contained"]).agg(F.sum("copies")))
    members = examples.select("example_id", F.when(F.col("text").isNotNull(), F.struct(
        F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))).alias("needle_id"))
    return members.join(counted, "needle_id", "left").select(
        "example_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_equal", "n_containing", "n_contained")])


def require_clean_examples(overlap: DataFrame, shown: int = 5) -> None:
    """Raise if any example overlaps a test sentence."""
    bad = overlap.where((F.col("n_equal") > 0) | (F.col("n_containing") > 0) | (F.col("n_contained") > 0))
    found = [r["example_id"] for r in bad.orderBy("example_id").limit(shown).collect()]
    if found:
        raise ValueError(f"{bad.count()} examples overlap with test sentences, first {found}")
