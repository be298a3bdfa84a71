"""Source quality, routing, assignment and rewrite checks on hand-written rows."""

import pytest
from pyspark.sql import functions as F

from pairlens.fixed_values import FORBIDDEN_SWAP_PAIRS, KIN_PAIRS, SURNAMES
from pairlens.operators import assignment as A
from pairlens.operators import quality as Q
from pairlens.operators import routing as R
from pairlens.operators import validation as V
from pairlens.sources.readers import pair_lexicon

TABLE = """intro
| Masculine | Feminine | Neutral |
|---|---|---|
| steward / cabin man | stewardess | attendant, server |
| hero | heroine | - |
| - | midwife | - |
| bull-fighter | torera | server/arena hand |
| abbot | abbess | |"""


@pytest.fixture
def lexicon(spark):
    lines = [(i, line) for i, line in enumerate(TABLE.split("\n"), 1)]
    return pair_lexicon(spark.createDataFrame(lines, "line_no bigint, line string"))


def test_pair_lexicon(lexicon):
    got = {r["form"]: (r["masc"], r["fem"]) for r in lexicon.collect()}
    assert got == {
        "steward": ("steward", "stewardess"), "cabin man": ("steward", "stewardess"), "stewardess": ("steward", "stewardess"),
        "attendant": ("steward", "stewardess"), "server": ("steward", "stewardess"), "hero": ("hero", "heroine"),
        "heroine": ("hero", "heroine"), "bull-fighter": ("bull-fighter", "torera"), "torera": ("bull-fighter", "torera"),
        "arena hand": ("bull-fighter", "torera"), "abbot": ("abbot", "abbess"), "abbess": ("abbot", "abbess")}


def test_multi_sentence(one):
    long = "word " * 30
    assert one(Q.multi_sentence, long + "end. Next one.") is True
    assert one(Q.multi_sentence, "Short. But two.") is False
    assert one(Q.multi_sentence, long + "end. next one") is False
    assert one(Q.multi_sentence, None) is False


@pytest.mark.parametrize("s, ref, flag", [
    ("The baker said she would come", "baker", True), ("Bakers know that he bakes", "baker", True),
    ("The baker of the old town near us said she would", "baker", False), ("The baker left", "baker", False),
    ("a sous chef told him", "sous chef", False), (None, "x", False), ("he ran", None, False), ("he", "he", False)])
def test_pre_gendered(one, s, ref, flag):
    assert one(Q.pre_gendered, s, ref) is flag


def test_quality_flags_and_split(spark):
    rows = [(1, "guard", "The guard waved at her", 2), (2, "guard", "The guard left", None), (3, "guard", "A guard", 1)]
    df = spark.createDataFrame(rows, "row_id bigint, referent string, EN_source_sentence string, grammaticality_score int")
    got = {r["row_id"]: r["flag_reasons"] for r in Q.quality_flags(df).collect()}
    assert got == {1: "pre_gendered, low_grammaticality(score=2)", 2: "", 3: "low_grammaticality(score=1)"}
    verdict = {r["row_id"]: (r["filter_any"], r["auto_reject"]) for r in Q.prefilter(df.drop("grammaticality_score")).collect()}
    assert verdict == {1: (True, False), 2: (False, False), 3: (False, False)}
    counts = Q.flag_counts(Q.prefilter(df)).first()
    assert (counts["rows"], counts["filter_pre_gendered"], counts["auto_reject"]) == (3, 1, 2)


@pytest.mark.parametrize("s, ref, hit", [
    ("Yes, captain, we go.", "captain", True), ("Hey captain come here", "captain", True), ("Get down, driver!", "driver", True),
    ("Thanks a lot, nurse . ", "nurse", True), ("Well, I think, nurse, it is fine", "nurse", True), ("Nurse, you're late", "nurse", True),
    ("nurse you said so", "nurse", True), ("The captain said so.", "captain", False), ("My nurse is kind.", "nurse", False),
    ("Call the c.o, you", "c.o", True), ("Call the cxo, you", "c.o", False), (None, "x", False)])
def test_addressee(one, s, ref, hit):
    assert one(R.is_addressee, s, ref) is hit


@pytest.mark.parametrize("s, ref, hit", [
    ("I'm a pilot now.", "pilot", True), ("I am the pilot here", "pilot", True), ("As a Pilot, I fly", "pilot", True),
    ("The pilot slept.", "pilot", False), ("He is a pilot", "pilot", False), ("I was " + "x" * 60 + " pilot", "pilot", False)])
def test_first_person(one, s, ref, hit):
    assert one(R.is_first_person, s, ref) is hit


@pytest.mark.parametrize("s, ref, found", [
    ("The clerk said they lost their keys", "clerk", ["their", "they"]), ("The clerk slept", "clerk", []),
    ("They saw the clerks", "clerk", []), ("clerk a b c d e f g h i they", "clerk", ["they"]),
    ("clerk a b c d e f g h i j they", "clerk", [])])
def test_neutral_pronouns(one, s, ref, found):
    assert one(R.neutral_pronouns, s, ref) == found


def test_route_priority_and_rendering(spark, lexicon):
    rows = [(1, "server", "Yes, server, I would like that."), (2, "captain", "Yes, captain, they know."),
            (3, "clerk", "The clerk said they would come."), (4, "pilot", "I'm a glider pilot."), (5, "pal", "My pal came."),
            (6, "hero", "The hero slept."), (7, "Attendant!", "An attendant."), (8, "hero", "I am the hero.")]
    df = spark.createDataFrame(rows, "row_id bigint, referent string, EN_source_sentence string")
    got = {r["row_id"]: r for r in R.route(df, lexicon).select("*", R.render_hint(F.col("hint")).alias("text")).collect()}
    strategy = {k: r["hint"]["strategy"] for k, r in got.items()}
    assert strategy == {1: "referent_swap", 2: "sir_maam", 3: "pronoun_swap", 4: "pronoun_swap", 5: None, 6: None,
                        7: "referent_swap", 8: "pronoun_swap"}
    assert got[1]["text"] == "\n[HINTS]\nRECOMMENDED_STRATEGY: referent_swap\nMASC_REFERENT: steward\nFEM_REFERENT: stewardess"
    assert got[5]["text"] == "" and got[5]["hint"]["signals"] == {}
    assert got[6]["hint"]["signals"] == {"has_pair": "true", "forbidden_pair": "true"}
    assert got[8]["hint"]["signals"] == {"has_pair": "true", "forbidden_pair": "true", "first_person": "true"}
    assert "they" in got[3]["hint"]["note"] and got[3]["hint"]["signals"]["existing_pronouns"] == "they"
    assert len(FORBIDDEN_SWAP_PAIRS) == 3


def test_ordinal_is_dense_over_sparse_and_negative_keys(spark):
    keys = [-5 * 2**40, -7, 0, 3, 2**20, 2**20 + 1, 2**41, 2**41 + 2**21, 2**62, 2**63 - 1]
    df = spark.createDataFrame([(k, i % 2) for i, k in enumerate(keys)], "row_id bigint, side int").repartition(3)
    got = {r["row_id"]: r["ordinal"] for r in A.with_ordinal(df).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}
    per = {(r["side"], r["row_id"]): r["ordinal"] for r in A.with_ordinal(df, within=("side",)).collect()}
    for side in (0, 1):
        mine = sorted(k for i, k in enumerate(keys) if i % 2 == side)
        assert [per[(side, k)] for k in mine] == list(range(len(mine)))


def test_rotation_is_balanced(spark):
    df = spark.range(100).select((F.col("id") * 7919).alias("row_id"))
    rows = A.rotate_names(df).orderBy("row_id").collect()
    assert [r["assigned_surname"] for r in rows] == [SURNAMES[i % 12] for i in range(100)]
    assert [tuple(r["assigned_kin"]) for r in rows] == [KIN_PAIRS[i % 5] for i in range(100)]
    uses = [r["n"] for r in A.usage_counts(A.rotate_names(df), "assigned_surname").collect()]
    assert max(uses) - min(uses) <= 1 and sum(uses) == 100
    first = A.rotate_first_names(df).orderBy("row_id").take(2)
    assert first[0]["male_name"] != first[1]["male_name"] and first[0]["female_name"] != first[1]["female_name"]


def test_strategy_share_cuts_percent(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,), ("",)], "disambiguation_strategy string")
    assert A.share_text(A.strategy_share(df)).first()[0] == "a=66%, b=33%"


BASE = {"EN_source_sentence": "The clerk said they would sort the mail.", "EN_masculine_sentence": "The clerk said he would sort the mail.",
        "EN_feminine_sentence": "The clerk said she would sort the mail.", "referent": "clerk", "disambiguation_strategy": "pronoun_swap"}


@pytest.mark.parametrize("change, failed", [
    ({}, []),
    ({"EN_masculine_sentence": "The clerk said he would sort the mail and then walk all the way home to eat."}, ["edit_distance_masc"]),
    ({"EN_feminine_sentence": "The clerk said she would sort the mail. She left."}, ["no_extra_sentence_fem"]),
    ({"EN_feminine_sentence": BASE["EN_masculine_sentence"]}, ["variants_differ"]),
    ({"EN_masculine_sentence": BASE["EN_source_sentence"], "EN_feminine_sentence": BASE["EN_source_sentence"] + " "},
     ["variants_differ", "variants_edited"]),
    ({"EN_masculine_sentence": "The man said he would sort the mail."}, ["referent_preserved_masc"]),
    ({"EN_masculine_sentence": "The man said he would sort the mail.", "disambiguation_strategy": "referent_swap"}, []),
    ({"EN_masculine_sentence": "The man said he would sort the mail.", "disambiguation_strategy": "combination"}, ["referent_preserved_masc"]),
    ({"EN_masculine_sentence": "The clerks said he would sort the mail."}, []),
    ({"EN_feminine_sentence": "The clerk woman said she would sort the mail."}, ["no_pos_change_fem"]),
    ({"EN_feminine_sentence": None}, ["referent_preserved_fem"]),
    ({"referent": None}, []),
    ({"EN_source_sentence": "I' m the clerk.", "EN_masculine_sentence": "I'm the clerk, sir.", "EN_feminine_sentence": "I' m the clerk, ma'am."},
     ["formatting_masc"]),
    ({"EN_source_sentence": "The clerk man came.", "EN_masculine_sentence": "The clerk man came, sir.", "EN_feminine_sentence": "The clerk man came, miss."}, []),
    ({"disambiguation_strategy": "", "eval_strategy_label": "referent_swap", "EN_masculine_sentence": "The man said he would sort the mail."}, []),
])
def test_validate(spark, change, failed):
    row = {"eval_strategy_label": None, **BASE, **change}
    schema = ", ".join(f"{c} string" for c in row)
    got = V.validate(spark.createDataFrame([tuple(row.values())], schema)).first()
    assert [c["check"] for c in got["checks"] if not c["passed"]] == failed
    assert got["passed"] is (not failed) and len(got["checks"]) == 12


def test_soft_message_does_not_fail(spark):
    row = {**BASE, "EN_masculine_sentence": "The clerk said he would sort the mail, dear old chap of mine, sir."}
    got = V.validate(spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} string" for c in row))).first()
    assert got["passed"] and got["messages"] == ["edit_distance_masc: edit_distance=8 over soft limit 5"]


@pytest.mark.parametrize("scores, reject, pos, verdict", [
    ((5, 5, 5, 5, 5), False, False, True), ((5, 5, 5, 5, 5), True, False, False), ((5, 5, 5, 5, 5), None, True, False),
    ((2, 5, 5, 5, 5), False, False, False), ((5, 5, 5, 2, 5), False, False, False), ((4, 4, 4, 4, 4), None, None, True),
    ((3, 4, 4, 4, 4), False, False, False), ((None, 5, 5, 5, 5), False, False, True), ((None, 5, 5, None, 5), False, False, False)])
def test_acceptance(spark, scores, reject, pos, verdict):
    schema = ("eval_referent_disambiguated double, eval_correctness double, eval_naturalness double, eval_no_extra_sentence double, "
              "eval_consistency double, eval_reject boolean, eval_pos_change boolean")
    row = tuple(None if s is None else float(s) for s in scores) + (reject, pos)
    assert spark.createDataFrame([row], schema).select(V.acceptance().alias("a")).first()["a"] is verdict


def test_symbolic_override_only_touches_accepted_rows(spark):
    bad = {**BASE, "EN_feminine_sentence": BASE["EN_masculine_sentence"]}
    rows = [(1, True, "slow", *BASE.values()), (2, True, "slow", *bad.values()), (3, False, "slow", *bad.values()), (4, None, None, *bad.values())]
    df = spark.createDataFrame(rows, "row_id bigint, accepted boolean, eval_issues string, " + ", ".join(f"{c} string" for c in BASE))
    got = {r["row_id"]: r for r in V.symbolic_override(df).collect()}
    assert [got[i]["accepted"] for i in (1, 2, 3, 4)] == [True, False, False, None]
    assert got[2]["eval_issues"] == "slow [SYMBOLIC] variants_differ: masculine and feminine variants are identical"
    assert [got[i]["symbolic_checks_passed"] for i in (1, 2, 3, 4)] == [True, False, None, None]
    assert got[3]["eval_issues"] == "slow" and [got[i]["symbolic_override"] for i in (1, 2, 3, 4)] == [False, True, False, False]


@pytest.mark.parametrize("value, rating", [
    ("good", "good"), (" MEH ", "meh"), ("Bad", "bad"), (None, "(unrated)"), ("  ", "(unrated)"), ("Great", "(other: great)")])
def test_normal_rating(one, value, rating):
    assert one(V.normal_rating, value) == rating


def test_has_great(one):
    assert [one(V.has_great, s) for s in ("A GREAT one", "greater", None, "so great!")] == [True, False, False, True]
