"""Collocations against brute force and SQL; the trie against a dictionary."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from pairlens.llm import collocations as C
from pairlens.llm import queries

SF = "/root/testdata/sf0.001"


def plain(rows: list[tuple[str | None, str | None]], min_count: int, top: int = 2_000, max_words: int = 4) -> list[tuple]:
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").encode().lower().decode()):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, max_words + 1):
                counts[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if a >= min_count and len(p) > 1}
        kept = []
        for p, a in candidates.items():
            within = max((b for q, b in candidates.items() if len(q) > len(p) and any(
                q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))), default=0)
            if 100 * within >= 80 * a:
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def rows_of(seed: int, n: int = 150) -> list[tuple[str | None, str | None]]:
    rng = random.Random(seed)
    vocabulary = ["a", "B", "cc", "é", "É", "d-d", "ee e", "F"]
    fixed = ["a cc d-d B", "F é", "x y z w", "q r s"]
    rows: list[tuple[str | None, str | None]] = [(None, None), ("en", ""), ("en", None), ("de", " .,;"), (None, "a b"), ("und", "A B a b")]
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        rows.append((rng.choice(["en", "en", "en", "de", "", None]), "".join(p + rng.choice([" ", " ", " ", "\t ", ", ", ".", "\n", "\x0b"]) for p in parts)))
    return rows


@pytest.mark.parametrize("seed,min_count", [(1, 5), (3, 30)])
def test_collocations_equal_brute_force(spark, monkeypatch, seed, min_count):
    rows = rows_of(seed)
    docs = spark.createDataFrame([(k, t, lang, 1, "p", 2.0) for k, (lang, t) in enumerate(rows)],
                                 "doc_id bigint, text string, lang string, f int, phrase string, score double").repartition(3)
    got = C.collocations(docs, min_count=min_count, held=40, sieve_bits=1 << 8)  # spills often; a sieve that lets much pass
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = plain(rows, min_count)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 10
    assert sorted(map(tuple, C.collocations(docs, min_count=min_count, top=3).collect())) == plain(rows, min_count, 3)
    assert sorted(map(tuple, C.collocations(docs, min_count=min_count, max_words=2).collect())) == plain(rows, min_count, max_words=2)


def test_odd_tables(spark):
    schema = "text string, lang string"
    assert C.collocations(spark.createDataFrame([], schema)).count() == 0
    assert C.collocations(spark.createDataFrame([(None, "en"), ("", None)], schema)).count() == 0
    long = "x " * 60_000
    got = C.collocations(spark.createDataFrame([(long, "en"), ("one", "en")], schema)).collect()
    # a phrase inside a longer one of nearly as many occurrences goes
    assert [tuple(r) for r in got] == [("en", 1, "x x x x", 59_997, 60_000, 59_998, 60_001, 1_000_000 * 59_997 * 2 // 119_998)]


def test_query_equals_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = db.execute(queries.SQL["op13_hat_trie_collocations"]).fetchall()
    got = [tuple(r) for r in queries.op13_hat_trie_collocations(spark, SF).collect()]
    assert sorted(got) == sorted(want) and len(got) > 40


def test_trie_counts_like_a_dictionary(monkeypatch):
    """Containers that burst at 8 phrases: ranges split, single words become nodes, everything stays in order."""
    monkeypatch.setattr(C, "BURST", 8)
    rng = random.Random(4)
    ids = [0, 1, (1 << 64) - 1, *(rng.getrandbits(64) for _ in range(20))]
    trie, want = C.HatTrie(3), Counter()
    for _ in range(60):
        first = rng.choice(ids) if rng.random() < 0.5 else 7  # one word in most phrases
        batch = Counter(b"".join(x.to_bytes(8, "big") for x in (first, rng.choice(ids), rng.choice(ids))) for _ in range(rng.randint(1, 30)))
        keys = sorted(batch)
        known = len(want)
        want.update(batch)
        assert trie.add(keys, [batch[k] for k in keys]) == len(want) - known
    found = list(trie.run())
    assert found == sorted(want.items()) and trie.size == len(want)
    depth = lambda t: 1 + max((depth(p) for p in t.parts if isinstance(p, C.HatTrie)), default=0)
    assert depth(trie) == 3 and len(trie.lows) > 5


def test_spills_take_whole_subtrees_largest_first():
    rng = np.random.default_rng(1)
    counter = C.TaskCounter(held=500)
    for lang in ("en", "de"):
        columns = [rng.integers(0, 40, 2_000).astype(np.uint64) for _ in range(2)]
        counter.add(lang, columns, C.slots_of(columns, 1, np.array([3], np.uint64), 5))
    sizes = {name: t.size for name, t in counter.tries.items()}
    assert counter.full() and counter.size == sum(sizes.values())
    rows = list(counter.spilled(250))
    assert counter.size <= 250 and [sizes[r[:3]] for r in rows] == sorted(sizes.values(), reverse=True)[:len(rows)]
    for row in rows:
        table = np.frombuffer(row[3], dtype=">u8").reshape(2, -1)
        assert table.shape[1] == len(row[4]) // 4 == sizes[row[:3]] and [*zip(*table.tolist())] == sorted(zip(*table.tolist()))


def test_hot_prefixes_are_dealt_by_one_word_more():
    first, second = np.repeat(np.array([5, 6], np.uint64), 500), np.arange(1000, dtype=np.uint64)
    slots = C.slots_of([first, second], 1, np.array([5], np.uint64), 50)
    assert len(set(slots[:500])) > 40 and len(set(slots[500:])) == 1


def test_a_sieve_never_stops_what_it_knows(spark):
    ids = np.random.default_rng(2).integers(0, 1 << 63, 5_000).astype(np.uint64)
    keys = [bytes(x.tobytes()[::-1]) for x in ids[:2_500]]
    sieve = C.sieve_of(spark.createDataFrame([(bytearray(k),) for k in keys], "key binary"), 1 << 16)
    passed = C.passes(sieve, ids)
    assert passed[:2_500].all() and 0 < passed[2_500:].mean() < 0.05
