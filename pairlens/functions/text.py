"""Text rules as native column expressions.

Word characters are Unicode letters, digits and underscore, and white space is the Unicode set, so
accented text is treated as words; patterns spell the classes out instead of relying on ``\\w``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairlens.fixed_values import CONTRACTIONS, PERSON_SUFFIXES, TITLE_ABBREVIATIONS
from pairlens.functions.columns import bind

# Character classes.
WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
NO_SPACE = r"[^\s\x1c-\x1f\x85\p{Z}]"
SPACE_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0        "
               "        　")
EDGE = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
BOUNDARY = rf"[.!?]{SPACE}+[A-Z]"
# Shared tokens are encoded from this code point on (the CJK block), stepping over the surrogates.
_FIRST_CODE = 0x4E00


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def is_blank(c: Column) -> Column:
    """Null or only white space."""
    return F.coalesce(strip(c) == "", F.lit(True))


def tokens(c: Column) -> Column:
    """White-space separated tokens."""
    return F.array_remove(F.split(c, SPACE + "+"), "")


def words(c: Column) -> Column:
    """Lower-cased runs of word characters and apostrophes."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_']+"), F.lit(0))


def quoted(c: Column) -> Column:
    """Regex that matches the value literally."""
    return F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def pattern(*parts) -> Column:
    """Concatenate pattern pieces; plain strings are literals."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _shared_head(a: Column, b: Column) -> Column:
    """Number of equal leading elements."""
    return bind(
        F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))),
        lambda same: bind(
            F.array_position(same, False),
            lambda at: F.when(at == 0, F.size(same)).otherwise((at - 1).cast("int"))))


def _drop_shared_head(pair: Column) -> Column:
    return bind(
        _shared_head(pair["a"], pair["b"]),
        lambda n: F.struct(
            F.slice(pair["a"], n + 1, F.size(pair["a"])).alias("a"),
            F.slice(pair["b"], n + 1, F.size(pair["b"])).alias("b")))


def token_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance between two token arrays.

    Equal heads and tails never change the distance and are dropped first, so the built-in
    ``levenshtein`` only sees the edited span. There each token found on both sides is written as
    one character; tokens of one side only can never match and share one character per side.
    """
    heads_off = bind(F.struct(a.alias("a"), b.alias("b")), _drop_shared_head)
    reversed_pair = bind(
        heads_off, lambda p: F.struct(F.reverse(p["a"]).alias("a"), F.reverse(p["b"]).alias("b")))
    tails_off = bind(reversed_pair, _drop_shared_head)

    def distance(p: Column) -> Column:
        one_side_empty = (F.size(p["a"]) == 0) | (F.size(p["b"]) == 0)
        return F.when(one_side_empty, F.size(p["a"]) + F.size(p["b"])).otherwise(
            bind(F.array_intersect(p["a"], p["b"]), lambda shared: F.levenshtein(
                _encoded(p["a"], shared, _FIRST_CODE - 1), _encoded(p["b"], shared, _FIRST_CODE - 2))))

    return bind(tails_off, distance)


def _encoded(items: Column, shared: Column, unshared_code: int) -> Column:
    def code(n: Column) -> Column:
        return F.when(n == 0, F.lit(unshared_code)).when(
            n < 0xD800 - _FIRST_CODE, n + F.lit(_FIRST_CODE)).otherwise(n + F.lit(_FIRST_CODE + 0x800))

    codes = F.transform(items, lambda t: F.lpad(F.hex(bind(F.array_position(shared, t), code)), 8, "0"))
    return F.decode(F.unhex(F.array_join(codes, "")), "UTF-32")


def word_distance(a: Column, b: Column, ignore_case: bool = False) -> Column:
    """Word-level edit distance between two texts; null counts as the empty text."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    if ignore_case:
        a, b = F.lower(a), F.lower(b)
    return token_distance(tokens(a), tokens(b))


def sentence_boundaries(c: Column) -> Column:
    """Count ``[.!?]``, white space, capital; a point after a title abbreviation does not count."""
    not_after_title = "".join(rf"(?<!(?<!{WORD}){t})" for t in TITLE_ABBREVIATIONS)
    return F.coalesce(F.regexp_count(c, F.lit("(?=[.!?])" + not_after_title + BOUNDARY)), F.lit(0))


def contraction_drift(source: Column, variant: Column) -> Column:
    """First contraction whose inner space was lost: struct<found, tight>, or null."""
    found = F.when(F.contains(source, F.lit("'")), F.flatten(F.array(*[
        F.regexp_extract_all(source, F.lit(rf"{head}'{SPACE}*{tail}{EDGE}"), F.lit(0))
        for head, tail in CONTRACTIONS]))).otherwise(F.array().cast("array<string>"))
    drifted = F.filter(
        F.transform(found, lambda m: F.struct(
            m.alias("found"), F.regexp_replace(m, rf"'{SPACE}+", "'").alias("tight"))),
        lambda p: ~F.contains(variant, p["found"]) & (p["found"] != p["tight"]) & F.contains(variant, p["tight"]))
    return F.when((source != "") & (variant != ""), F.try_element_at(drifted, F.lit(1)))


def mentions(c: Column, term: Column, plural: bool = False) -> Column:
    """The term occurs as a word of its own, ignoring case, with an optional ``s``."""
    return F.regexp_like(c, pattern("(?iu)" + EDGE, quoted(term), ("s?" if plural else "") + EDGE))


def person_suffix_after(c: Column, term: Column) -> Column:
    """The man/woman/... word that directly follows the term, '' if none does."""
    suffixes = "|".join(PERSON_SUFFIXES)
    return F.call_function(
        "regexp_extract", c, _at_edge(term, rf"{SPACE}+({suffixes}){EDGE}"), F.lit(1))


def stands_without_suffix(c: Column, term: Column) -> Column:
    suffixes = "|".join(PERSON_SUFFIXES)
    return F.regexp_like(c, _at_edge(term, rf"{EDGE}(?!{SPACE}+(?:{suffixes}))"))


def _at_edge(term: Column, tail: str) -> Column:
    """The term from an edge on. The literal is looked for first: most places fail at its first character."""
    return pattern("(?iu)(?=", quoted(term), ")" + EDGE, quoted(term), tail)
