"""What a reviewer found operators to leave out."""

from __future__ import annotations

import itertools
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pairlens.llm import jaccard_join, pii, quality_llr, sharding

SF = "/root/testdata/sf0.01"


# ------------------------------------------------------------------ 1

def test_every_bracketed_form_is_a_candidate():
    for opening, word, blank, closing in itertools.product("[({", ("at", "AT", "At"), ("", " "), "])}"):
        text = f"write ann {opening}{blank}{word}{blank}{closing} example [dot] com"
        assert [(k, text[a:b]) for k, a, b, _ in pii.candidates(text)[1]] == [("email", text[6:])], text
    assert pii.redact("to ann ( AT ) example.com now", lambda f: True) == "to [EMAIL] now"


# ------------------------------------------------------------------ 8

def test_pairs_leave_in_bounded_rows_and_tiles_are_groups(monkeypatch):
    rng = np.random.default_rng(3)
    owner, codes = np.repeat(np.arange(40), 12), rng.integers(0, 25, 480).astype(np.uint64)
    codes[:200] += np.uint64(1000) * (np.arange(200) // 40).astype(np.uint64)
    one = np.unique(np.stack([codes.astype(np.int64), owner], 1), axis=0)
    codes, owner = one[:, 0].astype("<u8"), one[:, 1]
    reps = np.array([(100 + k, n, 1) for k, n in enumerate(rng.integers(20, 30, 40))], dtype=jaccard_join.REP)
    x, y, n = jaccard_join.count_pairs(owner, codes, reps["n"].astype(np.int64))
    want = {(100 + a, 100 + b): c for a, b, c in zip(x.tolist(), y.tolist(), n.tolist(), strict=True)}
    for name, value in (("LONG_LIST", 9), ("TILE", 7), ("BUFFER", 60), ("ROW_PAIRS", 25)):
        monkeypatch.setattr(jaccard_join, name, value)
    rows = pa.record_batch({"fragment": [3], "classes": [reps.tobytes()], "owners": [owner.astype("<u4").tobytes()], "codes": [codes.tobytes()]})
    parts = [r for b in jaccard_join._fragment_parts(80)((pa.scalar(3),), iter([rows])) for r in b.to_pylist()]
    work = [r for r in parts if r["i"] >= 0]
    assert len({(r["i"], r["j"]) for r in work}) == len(work) > 3
    tiles = jaccard_join._tile_parts(80)(iter([pa.RecordBatch.from_pylist(work)]))
    counted = [r for r in parts if r["i"] < 0] + [r for b in tiles for r in b.to_pylist()]
    assert len(counted) > 10 and all(len(r["codes"]) // 4 == r["pairs"] <= 25 for r in counted)
    got = Counter()
    for b in jaccard_join._blocks(5)(iter([pa.RecordBatch.from_pylist(counted)])):
        for r in b.to_pylist():
            reps, x, y, n = jaccard_join._unpacked([(r["classes"], r["owners"], r["codes"])])
            got.update({(a, b): c for a, b, c in zip(reps["id"][x].tolist(), reps["id"][y].tolist(), n.tolist(), strict=True)})
    assert got == want


def test_rows_of_a_tile_are_bounded_and_lose_no_pair(monkeypatch):
    """30 classes share 40 shingles: tiles of 7 classes leave in rows of few postings, and each pair keeps its count."""
    owner, codes = np.tile(np.arange(30), 40), np.repeat(np.arange(40), 30).astype("<u8")
    reps = np.array([(100 + k, 40, 1) for k in range(30)], dtype=jaccard_join.REP)
    for name, value in (("LONG_LIST", 9), ("TILE", 7), ("ROW_POSTINGS", 50)):
        monkeypatch.setattr(jaccard_join, name, value)
    rows = pa.record_batch({"fragment": [3], "classes": [reps.tobytes()], "owners": [owner.astype("<u4").tobytes()], "codes": [codes.tobytes()]})
    work = [r for b in jaccard_join._fragment_parts(80)((pa.scalar(3),), iter([rows])) for r in b.to_pylist()]
    assert len(work) > 15 and all(len(r["codes"]) // 4 <= 50 for r in work)
    got = Counter()
    for b in jaccard_join._tile_parts(80)(iter([pa.RecordBatch.from_pylist(work)])):
        for r in b.to_pylist():
            found, x, y, n = jaccard_join._unpacked([(r["classes"], r["owners"], r["codes"])])
            got.update({(a, b): c for a, b, c in zip(found["id"][x].tolist(), found["id"][y].tolist(), n.tolist(), strict=True)})
    assert got == {(100 + a, 100 + b): 40 for a, b in itertools.combinations(range(30), 2)}


def test_blocks_follow_the_pairs():
    assert jaccard_join.block_side(12, 0) == 5
    assert jaccard_join.block_side(12, 10**9) ** 2 / 2 * jaccard_join.BLOCK_PAIRS >= 10**9


# ------------------------------------------------------------------ 9

def test_documents_are_shuffled_with_their_texts(spark, monkeypatch):
    seen, shuffle = [], sharding.shuffle_into_shards
    monkeypatch.setattr(sharding, "shuffle_into_shards", lambda df, *a, **b: seen.append(df.columns) or shuffle(df, *a, **b))
    docs = spark.createDataFrame([(1, "a b", "x"), (2, None, "y")], "doc_id bigint, text string, source string")
    got = {(r["doc_id"], r["size"]) for r in sharding.document_shards(docs, 2).collect()}
    assert got == {(1, 4), (2, 1)} and seen == [docs.columns]


# ------------------------------------------------------------------ 10

def test_quality_score_finds_labelled_junk(spark):
    """Share of labelled documents that base rules and score reject, and what the score takes of the trusted ones."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    verdicts = quality_llr.quality_verdicts(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    known = verdicts.join(labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")), "doc_id")
    junk, toxic, clean = (known.where(x).agg(F.count("*"), F.sum(F.expr("int(NOT kept)")), F.sum(F.expr("int(NOT kept AND NOT base_failed)"))).first()
                          for x in ("quality = 0", "toxic = 1", "quality = 1 AND toxic = 0"))
    assert junk[1] >= 0.95 * junk[0] and toxic[1] >= 0.2 * toxic[0]
    assert clean[2] <= 0.01 * clean[0]


def test_every_trusted_document_counts(spark):
    labels = spark.range(30_000).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    assert quality_llr.trusted_ids(labels).count() == 30_000


def test_threshold_ignores_how_far_outliers_lie(spark):
    def threshold(outlier: float) -> float:
        rows = [(50, 0, float(k)) for k in range(999)] + [(50, 0, outlier), (5, 0, -1e9)]
        return quality_llr.score_threshold(spark.createDataFrame(rows, "n_words int, n_repeat_words int, llr double"))

    assert threshold(-1.0) == threshold(-1e6) and threshold(-1.0) >= 0


def test_texts_of_trusted_documents_stay_in_the_scan(spark, monkeypatch):
    """Same weights whether the sieves leave no document open, some, or all; only open ones are kept with their text."""
    from pairlens.operators import leakage

    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.expr("concat('w', id % 7, ' w', id % 5, ' common')").alias("text"))
    docs = docs.unionByName(docs.where("doc_id < 9")).unionByName(spark.createDataFrame([(None, "w1 w1")], "doc_id bigint, text string"))
    trusted = spark.range(0, 400, 3).select(F.col("id").alias("doc_id"), (F.col("id") % 2 == 0).alias("_ql_fit"))
    found, kept, part = [], [], quality_llr._by_trust

    def by_trust(*args):
        unsure, rest = part(*args)
        kept.append(unsure.count())
        assert unsure.unionByName(rest).where("_ql_fit").count() == docs.join(trusted.where("_ql_fit"), "doc_id").count()
        return unsure, rest

    monkeypatch.setattr(quality_llr, "_by_trust", by_trust)
    for cells in (1 << 18, 16, 1):
        monkeypatch.setattr(leakage, "SIEVE_CELLS", cells)
        found.append(quality_llr.bucket_weights(docs, trusted, 64).first()["weights"])
    assert kept[0] == 0 < kept[1] <= kept[2] and found[0] == found[1] == found[2]
