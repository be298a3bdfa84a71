"""Runs and collapsed texts against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from pairlens.llm import periodic_runs as R
from pairlens.llm import queries, textcodes

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words: list) -> list[tuple[int, int, int]]:
    """Every lag, every maximal stretch of matches; only stretches without a smaller period."""
    found = []
    for q in range(1, len(words) // 3 + 1):
        i = q
        while i < len(words):
            if words[i] != words[i - q]:
                i += 1
                continue
            j = i
            while j < len(words) and words[j] == words[j - q]:
                j += 1
            start, length = i - q, j - i + q
            stretch = words[start:start + length]
            if length >= max(24, 3 * q) and not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                found.append((start, length, q))
            i = j
    return sorted(found)


def plain_planted(doc_id: int | None, words: list) -> list:
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def plain_row(doc_id: int | None, text: str | None) -> tuple:
    words = plain_planted(doc_id, WORDS.findall(text or ""))
    runs = plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def found(texts: list[str]) -> list[list[tuple[int, int, int]]]:
    return R.find_runs(*textcodes.word_codes([t.encode() for t in texts]))


@pytest.mark.parametrize("seed", range(3))
def test_runs_equal_brute_force(seed):
    """Many small texts over few words: overlapping runs, runs inside periods of longer ones, runs at both ends."""
    rng = random.Random(seed)
    texts = []
    for _ in range(120):
        words: list[str] = []
        for _ in range(rng.randint(0, 5)):
            unit = [rng.choice("abc"[:rng.randint(1, 3)]) for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 18, 31, 33, 40]))]
            if rng.random() < 0.3:
                unit = unit * rng.randint(2, 9) + [rng.choice("xyz")]
            words += (unit * rng.randint(1, 7))[rng.randint(0, 3):]
        texts.append(" ".join(words))
    got = found(texts)
    assert got == [plain_runs(t.split()) for t in texts]
    assert sum(map(len, got)) > 100 and max(q for runs in got for _, _, q in runs) > 30


def test_edges_of_the_limits():
    """23 and 24 words of one period, and one word under and at three periods."""
    assert found(["a " * 23, "a " * 24, "a b c d e f g h " * 3, "a b c d e f g h i " * 2 + "a b c d e f g h", "a b c d e f g h i " * 3]) == [
        [], [(0, 24, 1)], [(0, 24, 8)], [], [(0, 27, 9)]]
    with pytest.raises(ValueError):
        R.find_runs(np.zeros(0, np.uint64), np.zeros(1, np.int64), 23)


def test_words_that_differ_by_parity_of_bits():
    """The sequence that defeats codes made by polynomials modulo 2^64: halves of 2,048 words that only differ by exchange."""
    bits = [bin(i).count("1") & 1 for i in range(4096)]
    words = ["ab"[b] for b in bits]
    assert found([" ".join(words)]) == [[]]
    assert found([" ".join(words * 3)]) == [[(0, 3 * 4096, 4096)]]


def test_query_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
            if len(r["text"] or "") < 4_000]
    got = {tuple(r) for r in queries.op12_periodic_runs(spark, SF).collect()}
    want = {plain_row(*r) for r in rows}
    assert want <= got and sum(r[1] > 0 for r in want) > 5


def test_odd_rows(spark):
    rng = random.Random(2)
    long = " ".join(rng.choice(["a", "b", "c"]) for _ in range(300)) + " x y" * 40
    rows = [(None, "a " * 30), (None, None), (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "é " * 25), (5, "é " * 25), (6, long),
            (7, "\n".join(["one two three"] * 20)), (8, "x" * 200_000), (9, "a " * 50_000)] + [(k, long) for k in range(100, 140)]
    docs = spark.createDataFrame([(i, t, 1, "r", "c", 2) for i, t in rows],
                                 "doc_id bigint, text string, runs int, collapsed string, start string, n_words int").repartition(3)
    collapsed = R.collapse_runs(R.planted(docs))
    got = sorted(map(tuple, R.run_digests(collapsed).collect()), key=str)
    want = sorted((plain_row(i, t) for i, t in rows if i != 9), key=str)
    assert [r for r in got if r[0] != 9] == want and [r[1] for r in got if r[0] == 9] == [1]
    assert collapsed.where("doc_id = 7").first()["collapsed"] == "one two three"
    assert R.run_digests(R.collapse_runs(R.planted(docs.limit(0)))).count() == 0


def test_planted_documents_have_runs(spark):
    docs = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(90))) for k in range(200)], "doc_id bigint, text string")
    runs = {r["doc_id"]: r["n_runs"] for r in R.run_digests(R.collapse_runs(R.planted(docs))).collect()}
    chosen = [k for k in runs if zlib.crc32(str(k).encode()) % 10 == 0]
    assert len(chosen) > 10 and sum(runs[k] for k in chosen) > len(chosen) / 2 and not any(runs[k] for k in runs if k not in chosen)
