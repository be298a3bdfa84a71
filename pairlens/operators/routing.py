"""Rule-based choice of a rewrite strategy before generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.fixed_values import (
    FIRST_PERSON_DISTANCE, FIRST_PERSON_MARKERS, FORBIDDEN_SWAP_PAIRS, NEUTRAL_PRONOUN_WINDOW,
    NEUTRAL_PRONOUNS, SECOND_PERSON, VOCATIVE_OPENERS)
from pairlens.functions.columns import bind, is_true, present, settle, string_array
from pairlens.functions.text import EDGE, SPACE, pattern, quoted, strip, words


def attach_pair(corpus: DataFrame, lexicon: DataFrame, out: str = "pair") -> DataFrame:
    """Add the lexicon pair of the referent: by its lower-cased form, else by its letters only.

    The lexicon has one row per form. It is looked up for distinct referents, so a frequent referent meets it once and
    the rows of the corpus are joined once.
    """
    pair = lexicon.select("form", F.struct("masc", "fem").alias("_pair"))
    exact = pair.select(F.col("form").alias("_key"), F.col("_pair").alias("_exact"))
    letters = pair.select(F.col("form").alias("_letters"), F.col("_pair").alias("_stripped"))
    keyed = corpus.select("referent").distinct().withColumn("_key", F.lower(strip(F.col("referent"))))
    keyed = keyed.withColumn("_letters", F.regexp_replace("_key", "[^a-z]", ""))
    found = (keyed.join(exact, "_key", "left").join(letters, "_letters", "left")
             .select("referent", F.coalesce("_exact", "_stripped").alias(out)).where(F.col(out).isNotNull()))
    return corpus.join(found, "referent", "left").select(*corpus.columns, out)


def is_forbidden(pair: Column, forbidden=FORBIDDEN_SWAP_PAIRS) -> Column:
    if not forbidden:
        return F.lit(False)
    listed = F.array(*[F.struct(F.lit(m).alias("masc"), F.lit(f).alias("fem")) for m, f in forbidden])
    return is_true(F.array_contains(listed, pair))


def is_addressee(sentence: Column, referent: Column) -> Column:
    """The referent is spoken to: opening, closing or inner vocative, or followed by you."""
    ref = quoted(referent)
    ways = [
        pattern(rf"^(?:{'|'.join(VOCATIVE_OPENERS)}),?{SPACE}+", ref, EDGE),
        pattern(rf",{SPACE}+", ref, rf"{SPACE}*[.!?]{SPACE}*$"),
        pattern(rf",{SPACE}+", ref, ","),
        pattern(EDGE, ref, rf",?{SPACE}+(?:{'|'.join(SECOND_PERSON)}){EDGE}"),
    ]
    either = F.concat_ws("|", *ways)
    return is_true(F.regexp_like(sentence, F.concat(F.lit("(?iu)"), either)))


def is_first_person(sentence: Column, referent: Column, markers=FIRST_PERSON_MARKERS,
                    distance: int = FIRST_PERSON_DISTANCE) -> Column:
    """The first occurrence of a marker ends at most ``distance`` characters from the referent's first."""

    def near(s: Column) -> Column:
        ref_at = F.position(F.lower(referent), s)

        def marker_near(marker: Column) -> Column:
            at = F.position(marker, s)
            return (at > 0) & (F.abs(ref_at - at - F.char_length(marker)) <= distance)

        return (ref_at > 0) & F.exists(string_array(markers), marker_near)

    return is_true(bind(F.lower(sentence), near))


def neutral_pronouns(sentence: Column, referent: Column, pronouns=NEUTRAL_PRONOUNS,
                     window: int = NEUTRAL_PRONOUN_WINDOW) -> Column:
    """Sorted set of the listed pronouns within ``window`` words of the referent word."""
    ref = F.lower(referent)

    def around(found: Column) -> Column:
        def taken(word: Column, i: Column) -> Column:
            low = F.greatest(i - window, F.lit(0))
            near = F.slice(found, low + 1, i - low + window + 1)
            return F.when(word == ref, F.array_intersect(near, string_array(pronouns)))

        return F.array_sort(F.array_distinct(F.flatten(F.array_compact(F.transform(found, taken)))))

    return F.coalesce(bind(words(sentence), around), F.array().cast("array<string>"))


def route(corpus: DataFrame, lexicon: DataFrame, forbidden=FORBIDDEN_SWAP_PAIRS,
          pronouns=NEUTRAL_PRONOUNS, markers=FIRST_PERSON_MARKERS) -> DataFrame:
    """Add ``hint``: struct<strategy, masc, fem, note, signals>.

    Lexicon pair, then addressee, then neutral pronoun, then first person; else no strategy. A
    forbidden pair counts as no pair.
    """
    sentence, ref, pair = F.col("EN_source_sentence"), F.col("referent"), F.col("_pair_found")
    found = F.col("_pronouns")
    blocked = F.col("_blocked")
    rows = attach_pair(corpus, lexicon, "_pair_found").withColumn("_blocked", is_forbidden(pair, forbidden))
    swap = pair.isNotNull() & ~blocked
    rows = settle(rows, {"_case": F.when(swap, "pair").when(is_addressee(sentence, ref), "addressee")
                         .otherwise("other")})
    rows = settle(rows, {"_pronouns": F.when(F.col("_case") == "other", neutral_pronouns(sentence, ref, pronouns))})
    rows = settle(rows, {"_case": F.when(F.col("_case") != "other", F.col("_case"))
                         .when(F.size("_pronouns") > 0, "pronoun")
                         .when(is_first_person(sentence, ref, markers), "speaker").otherwise("none")})
    case = F.col("_case")
    strategy = (F.when(case == "pair", "referent_swap").when(case == "addressee", "sir_maam")
                .when(case.isin("pronoun", "speaker"), "pronoun_swap"))
    # Note formats.
    note = (F.when(case == "addressee", F.concat(
                F.lit("Referent '"), ref, F.lit("' is the addressee - use sir/ma'am as a vocative.")))
            .when(case == "pronoun", F.concat(
                F.lit("Source has "), F.array_join(found, ", "), F.lit(" referring to '"), ref,
                F.lit("' - swap to he/she, his/her, him/her, himself/herself.")))
            .when(case == "speaker", F.concat(
                F.lit("Referent '"), ref,
                F.lit("' is the first-person speaker - swap every I/me/my that refers to the speaker."))))

    def signal(condition: Column, name: str, value: Column) -> Column:
        return F.when(condition, F.struct(F.lit(name).alias("key"), value.alias("value")))

    signals = F.map_from_entries(F.array_compact(F.array(
        signal(pair.isNotNull(), "has_pair", F.lit("true")),
        signal(blocked, "forbidden_pair", F.lit("true")),
        signal(case == "addressee", "addressee", F.lit("true")),
        signal(case == "pronoun", "existing_pronouns", F.array_join(found, ", ")),
        signal(case == "speaker", "first_person", F.lit("true")))))
    hint = F.struct(
        strategy.alias("strategy"), F.when(swap, pair["masc"]).alias("masc"), F.when(swap, pair["fem"]).alias("fem"),
        note.alias("note"), signals.alias("signals"))
    return rows.select(*corpus.columns, hint.alias("hint"))


def render_hint(hint: Column) -> Column:
    """The hint as a text block, '' if there is nothing to say."""
    # Block format.
    both = hint["masc"].isNotNull() & hint["fem"].isNotNull()
    lines = present([
        F.concat(F.lit("RECOMMENDED_STRATEGY: "), hint["strategy"]),
        F.when(both, F.concat(F.lit("MASC_REFERENT: "), hint["masc"])),
        F.when(both, F.concat(F.lit("FEM_REFERENT: "), hint["fem"])),
        F.concat(F.lit("NOTE: "), hint["note"])], "\n")
    return bind(lines, lambda block: F.when(block == "", F.lit("")).otherwise(F.concat(F.lit("\n[HINTS]\n"), block)))


def hint_counts(routed: DataFrame) -> DataFrame:
    """Rows per recommended strategy; rows without one are left out."""
    strategy = F.col("hint.strategy")
    return routed.where(strategy.isNotNull()).groupBy(strategy.alias("strategy")).agg(F.count("*").alias("n"))
