"""The string kernel against plain sums, the machine against its kernel form, held-out accuracy, changed insults."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.llm import queries, toxicity as T

SF = "/root/testdata/sf0.01"
INSULTS = re.compile("idiot|loser|pathetic|scum|worthless|moron|trash|clown|disgusting|stupid", re.I)


def key(word: str) -> bytes:
    return bytes(T._tables()[0][ord(c)] for c in word)


def plain_features(k: bytes) -> Counter:
    """All subsequences of three letters that span at most seven, by their letters."""
    s, out = bytes([T.EDGE]) + k + bytes([T.EDGE]), Counter()
    for i, j, m in itertools.combinations(range(len(s)), 3):
        if m - i < T.SPAN:
            out[s[i], s[j], s[m]] += T.DECAY ** (m - i - 2)
    return out


def plain_kernel(a: bytes, b: bytes) -> float:
    def own(k: bytes) -> float:
        return sum(T.DECAY ** (2 * (m - i - 2)) for i, _, m in itertools.combinations(range(len(k) + 2), 3) if m - i < T.SPAN)

    x, y = plain_features(a), plain_features(b)
    return sum(x[u] * y[u] for u in x) / math.sqrt(max(own(a), 1) * max(own(b), 1))


WORDS = ["idiot", "idxiot", "a", "ab", "aaaaaaaaaaaa", "mississippi", "straße", "12", "xidiotx", "qqq", "disgustingly"]


def test_kernel_equals_plain_sums():
    keys = [key(w) for w in WORDS]
    got = T.kernel(keys, keys[:5])
    for (i, a), (j, b) in itertools.product(enumerate(keys), enumerate(keys[:5])):
        assert got[i, j] == pytest.approx(plain_kernel(a, b)), (a, b)


def test_table_equals_the_sum_over_landmarks():
    rng = np.random.default_rng(1)
    positive = {key(w): 1.0 for w in ("idiot", "moron", "loser")}
    negative = {key("".join(rng.choice(list("aeinrst"), 6))): 1.0 for _ in range(40)}
    landmarks = [*positive, *list(negative)[:15]]
    machine = T.fit_machine(positive, negative, landmarks)
    windows = T.windows_of([" ".join(WORDS)])
    got = T.decisions(windows, machine.table, machine.bias)
    # the decision lies in the landmarks' span: solve for their weights on other words, then predict these
    probe = [*negative, *positive]
    values = np.array([T.decisions(T.windows_of(["".join(chr(96 + c) for c in k)]), machine.table, machine.bias)[0] for k in probe]) - machine.bias
    beta = np.linalg.lstsq(T.kernel(probe, landmarks), values, rcond=None)[0]
    assert got == pytest.approx(T.kernel(windows.keys(), landmarks) @ beta + machine.bias, abs=2e-3)
    assert (got[[0, 1, 8]] > 0).all() and got[5] < 0


def test_windows_and_their_places():
    texts = ["You i d i o t, i-d.i!o?t a b", "", "... !", "é x.y Z", "q", "w e"]
    w = T.windows_of(texts)
    spans = [(int(t), texts[t][a:b]) for t, a, b in zip(w.text, w.first, w.last, strict=True)]
    assert spans == [(0, "You"), (0, "i d i o t"), (0, "i-d.i!o?t"), (0, "a"), (0, "b"), (3, "é"), (3, "x.y"), (3, "Z"), (4, "q"), (5, "w"), (5, "e")]
    assert w.keys()[1] == w.keys()[2] == key("idiot") and w.keys()[7] == key("z")
    s = T.windows_of(["one two. three\nfour! five? six.seven"]).sentence.tolist()
    assert [s.index(x) for x in s] == [0, 0, 2, 3, 4, 5]


@pytest.fixture(scope="module")
def scored(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    return queries.op11_string_kernel_toxicity(spark, SF).join(labels, "doc_id", "left").join(docs, "doc_id").collect()


def test_held_out_accuracy(scored):
    """English toxic documents hold an insult, but for some whose labels are noise; unlabelled ones never train either."""
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in scored)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in scored)
    insult = [r for r in scored if (r["held_out"] or r["toxic"] is None) and INSULTS.search(r["text"])]
    clean = [r for r in scored if r["held_out"] and r["toxic"] == 0]
    assert len(insult) >= 10 and sum(r["predicted"] for r in insult) >= 0.95 * len(insult)
    assert len(clean) >= 50 and sum(r["predicted"] for r in clean) <= 0.03 * len(clean)
    named = [INSULTS.search(r["text"][r["worst_start"]:r["worst_end"]]) is not None for r in insult]
    assert sum(named) >= 0.9 * len(named)


def test_changed_insults_are_found(spark, monkeypatch):
    """Held-out toxic documents of the larger tables, with every insult spaced, dashed, starred, or with one more letter."""
    rng = random.Random(5)

    def one_more(m):
        i = rng.randrange(1, len(m.group()))
        return m.group()[:i] + rng.choice("jqxz") + m.group()[i:]

    labels, docs = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("labels", "documents"))
    machine = T.train(docs, labels)
    monkeypatch.setattr(T, "train", lambda *a, **b: machine)
    known = docs.join(labels.where("toxic = 1"), "doc_id", "left_semi").where(T.is_held_out(F.col("doc_id")))
    texts = [r["text"] for r in known.select("text").collect() if INSULTS.search(r["text"])]
    for change in (lambda m: " ".join(m.group()), lambda m: "-".join(m.group()), lambda m: "*".join(m.group()), one_more):
        changed = [(k, INSULTS.sub(change, t)) for k, t in enumerate(texts)]
        assert not any(INSULTS.search(t) for _, t in changed)
        found = T.toxicity(spark.createDataFrame(changed, "doc_id bigint, text string"), labels).agg(F.sum("predicted")).first()[0]
        assert found >= 0.85 * len(texts) > 40, (found, len(texts))


def test_held_out_labels_and_other_columns_change_nothing(spark, scored):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("lang", F.lit("x")).withColumn("score", F.lit(7.0)).withColumn("toxic", F.lit(1))
    got = {r["doc_id"]: r["score"] for r in T.toxicity(docs, turned.withColumn("text", F.lit("no"))).collect()}
    assert got == {r["doc_id"]: r["score"] for r in scored}


def test_odd_rows(spark):
    rng = random.Random(7)
    words = ["".join(rng.choices("aeinrstlo", k=5)) for _ in range(200)]

    def text(bad: bool) -> str:
        own = rng.choices(words, k=30)
        return " ".join(own[:15] + (["zugzwang"] if bad else []) + own[15:])

    rows = [(k, text(k % 3 == 0)) for k in range(300)]
    odd = [(None, "a zugzwang b"), (None, None), (900, None), (901, ""), (902, " .,; "), (903, "x" * 200_000), (904, "a zugzwang b"), (904, "a zugzwang b"),
           (905, " ".join(words) * 40 + " z u g z w a n g"), (906, "\U0001f600 \U00020000"), (1, "other text")]
    docs = spark.createDataFrame(rows + odd, "doc_id bigint, text string").withColumn("key", F.lit(1)).withColumn("toxic", F.lit("t")).repartition(4)
    labels = spark.createDataFrame([(k, int(k % 3 == 0), 1) for k in range(300)] + [(None, 1, 1), (7, None, 1)], "doc_id bigint, toxic int, quality int")
    out = T.toxicity(docs, labels)
    got = {(r["doc_id"], r["worst_start"], r["worst_end"], r["predicted"]) for r in out.collect()}
    assert out.count() == len(rows) + len(odd)
    assert {(None, 2, 10, 1), (904, 2, 10, 1), (None, None, None, 0), (900, None, None, 0), (901, None, None, 0), (902, None, None, 0)} <= got
    assert next(x[3] for x in got if x[0] == 905) == 1 and next(x[3] for x in got if x[0] == 903) == 0
    hits = sum(x[3] for x in got if x[0] is not None and x[0] < 300 and x[0] % 3 == 0)
    assert hits >= 98 and sum(x[3] for x in got if x[0] is not None and x[0] < 300 and x[0] % 3) <= 2

    no_labels = T.toxicity(docs, labels.limit(0)).agg(F.min("score"), F.max("score"), F.max("predicted")).first()
    assert 0 <= no_labels[0] == no_labels[1] < 0.5 and no_labels[2] == 0
    one_sided = T.toxicity(docs, labels.where("toxic = 1")).agg(F.min("score"), F.max("score")).first()
    assert one_sided[0] == one_sided[1] == pytest.approx(0.49)
    assert T.toxicity(docs.limit(0), labels).count() == 0
