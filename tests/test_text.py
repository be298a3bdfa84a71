import random

import pytest
from pyspark.sql import functions as F

from pairlens.functions import jsontext as J
from pairlens.functions import text as T


def brute_distance(a, b):
    x, y = a.split(), b.split()
    row = list(range(len(y) + 1))
    for i, p in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, q in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (p != q))
    return row[-1]


@pytest.mark.parametrize("a, b, d", [
    ("a bird sang", "a bird sang", 0), ("a bird sang", "a crow sang", 1), ("a bird sang", "a bird", 1),
    ("", "two words", 2), (None, "one", 1), ("x  y", "x y", 0), ("Été là", "été là", 1)])
def test_word_distance(one, a, b, d):
    assert one(lambda x, y: T.word_distance(x, y), a, b) == d


def test_word_distance_random_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(400):
        a = [rng.choice("abcdeéßñ") for _ in range(rng.randint(0, 14))]
        b = list(a)
        for _ in range(rng.randint(0, 5)):
            if b and rng.random() < 0.5:
                b.pop(rng.randrange(len(b)))
            else:
                b.insert(rng.randint(0, len(b)), rng.choice("abxyz"))
        rows.append((" ".join(a), " ".join(b)))
    df = spark.createDataFrame(rows, "a string, b string")
    for r in df.select("a", "b", T.word_distance(F.col("a"), F.col("b")).alias("d")).collect():
        assert r["d"] == brute_distance(r["a"], r["b"])


def test_word_distance_many_distinct_tokens(one):
    a = " ".join(f"w{i}" for i in range(40000))
    b = "q " + a + " z"
    assert one(lambda x, y: T.word_distance(x, y), a, b) == 2
    far = " ".join(f"v{i}" for i in range(300))
    assert one(lambda x, y: T.word_distance(x, y), a, far) == 40000


def test_word_distance_ignore_case(one):
    assert one(lambda x, y: T.word_distance(x, y, ignore_case=True), "The Baker", "the baker") == 0


@pytest.mark.parametrize("s, n", [
    ("no boundary here", 0), ("One. Two follows.", 1), ("Ah! Really? Yes.", 2), ("Ask Mr. Green now. Then go.", 1),
    ("Was it Dr. No? Maybe.", 1), ("The Kst. Ended. There", 2), ("", 0), (None, 0)])
def test_sentence_boundaries(one, s, n):
    assert one(T.sentence_boundaries, s) == n


def test_words_and_tokens_are_unicode(one):
    assert one(T.words, "L'Été d'ÉCOLE, naïve_1!") == ["l'été", "d'école", "naïve_1"]
    assert one(T.tokens, " a b　c \n") == ["a", "b", "c"]


def test_contraction_drift(one):
    assert one(T.contraction_drift, "I' m late.", "I'm late and he knows.")["tight"] == "I'm"
    assert one(T.contraction_drift, "I' m late.", "He' s late.") is None
    assert one(T.contraction_drift, "I'm late.", "I'm late, sir.") is None
    assert one(T.contraction_drift, "", "I'm") is None


def test_mentions_quotes_the_term(one):
    assert one(T.mentions, "a c.m b", "c.m") is True
    assert one(T.mentions, "a cxm b", "c.m") is False
    assert one(lambda a, b: T.mentions(a, b, plural=True), "Two GUARDS came", "guard") is True
    assert one(T.mentions, "l'été", "été") is True
    assert one(T.mentions, "étés", "été") is False


@pytest.mark.parametrize("text, blocks", [
    ('a {"x": {"y": {"z": {"w": {}}}}} b {c}', ['{"x": {"y": {"z": {"w": {}}}}}', "{c}"]),
    ("} {a} { open {b}", ["{a}"]), ("none", []), ("{}{}", ["{}", "{}"])])
def test_balanced_blocks(one, text, blocks):
    assert one(J.balanced_blocks, text) == blocks


@pytest.mark.parametrize("text, first, last", [
    ('{"a":1} {"b":2}', '{"a":1}', '{"b":2}'), ('{bad} {"b":2}', None, '{"b":2}'), ('{"a":1} {bad}', '{"a":1}', '{"a":1}'),
    ('```json\n{"a":1}\n```\n{"b":2}', '{"a":1}', '{"a":1}'), ('```{"a":1}```', None, None), ("", None, None),
    ('{"a":1,"a":2}', '{"a":2}', '{"a":2}'),
    # Braces inside strings count: this block is cut short and does not parse.
    ('{"a": "}"}', None, None)])
def test_objects(one, text, first, last):
    got_first = one(lambda c: F.to_json(J.first_object(c)), text)
    got_last = one(lambda c: F.to_json(J.last_object(c)), text)
    assert (got_first, got_last) == (first, last)


@pytest.mark.parametrize("text, value", [
    ('{"confidence": 4.7}', 4), ('{"confidence": true}', 1), ('{"confidence": "4"}', None), ('{"confidence": null}', None),
    ('{"other": 1}', None), ('{"confidence": -2.9}', -2), ('{"confidence": 3000000000}', None), ('{"confidence": 1e20}', None)])
def test_integer_field(one, text, value):
    assert one(lambda c: J.integer_field(J.last_object(c), "confidence"), text) == value
