"""The pipeline's stages, each held against brute force on its own input."""

from __future__ import annotations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from pairlens.llm import decontamination, jaccard_join, pii, quality_llr
from tests.llm.test_operators import check_pieces, plain_links, plain_quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    odd = spark.createDataFrame([(None, None), (None, "word " * 3), (9001, None)], "doc_id bigint, text string")
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(odd, allowMissingColumns=True)
    repeated = docs.where("doc_id = 1")
    out = [docs.unionByName(repeated).persist()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_quality_stage(spark, outputs):
    before, after = outputs[0], outputs[1]
    assert after.columns == before.columns
    verdicts = quality_llr.quality_verdicts(before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(after) == ids(verdicts.where("kept"))
    failed = {r["doc_id"] for r in before.collect() if plain_quality(r["text"])[-1]}
    assert not failed & set(ids(after))
    good = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 AND toxic = 0")
    clean = before.join(good, "doc_id", "left_semi").collect()
    clean = {r["doc_id"] for r in clean if r["doc_id"] not in failed}
    assert len(clean - set(ids(after))) <= 0.02 * len(clean)


def test_near_duplicate_stage(outputs):
    before, after = outputs[1], outputs[2]
    want = plain_links([(r["doc_id"], r["text"]) for r in before.select("doc_id", "text").distinct().collect()])
    assert ids(after) == sorted(i for i, (_, component, _) in want.items() if component == i)
    assert after.columns == before.columns


def test_decontamination_stage(spark, outputs):
    before, after = outputs[2], outputs[3]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    leaked = {r["doc_id"] for r in decontamination.leaks(before, bench).collect()}
    whole = [r["text"].lower() for r in bench.collect()]
    plain = {r["doc_id"] for r in before.collect() if any(w in r["text"].lower() for w in whole)}
    assert plain <= leaked and ids(after) == sorted(set(ids(before)) - leaked)


def test_personal_data_stage(outputs):
    before, after = outputs[3], outputs[4]
    texts = {r["doc_id"]: r["text"] for r in after.collect()}
    assert after.columns == before.columns and after.where(F.col("n_chars") != F.char_length("text")).count() == 0
    for r in before.collect():
        spans = pii.candidates(r["text"])[0]
        assert (texts[r["doc_id"]] == r["text"]) == (not spans)
        assert not pii.candidates(texts[r["doc_id"]])[0]


def test_packing_stage(outputs):
    from collections import Counter

    import public_tokenizers

    from pairlens.llm.tokens import encoder

    enc = encoder(public_tokenizers.path("byte_bpe_50k.json"), True)
    check_pieces(outputs[5].collect(), Counter((r["doc_id"], enc.encode(r["text"]) + b"\0\0\0\0") for r in outputs[4].collect()))


@pytest.fixture(scope="module")
def clashing(spark):
    """Good documents with columns named like the operators' own, odd rows, and rows that share an id."""
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where(
        "lang = 'en' AND n_chars BETWEEN 400 AND 3000").join(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 AND toxic = 0"), "doc_id", "left_semi")
        .orderBy("doc_id").limit(6).collect()]
    long = " ".join(f"w{k}" for k in range(120_000))
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[0]), (2, texts[2]), (3, texts[2] + " more"), (4, texts[3]), (None, texts[4]), (None, texts[4]),
            (5, long), (6, None), (7, "")]
    names = ["_row", "_id", "_quality", "_ql_words", "component_id", "f1", "row_key", "packed_row", "text_key", "nth_copy", "rep", "m"]
    data = [(i, t, "en", "s", len(t or ""), *[f"{n}{k}" for n in names]) for k, (i, t) in enumerate(rows)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame(data, schema).repartition(3), names


def test_shared_ids_and_clashing_names(spark, clashing):
    docs, names = clashing
    kept = sorted((r["doc_id"] or 0, (r["text"] or "")[:60], r["_row"]) for r in docs.collect())
    after = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert after.columns == docs.columns
    rows = after.collect()
    of_one = sorted(r["text"] for r in rows if r["doc_id"] == 1)
    both = sorted(r["text"] for r in docs.where("doc_id = 1").distinct().collect())
    assert of_one == sorted(set(both)) and len(of_one) == 2  # two documents under one id stay, the repeated row goes
    assert sorted((r["doc_id"] or 0) for r in rows) == [0, 0, 1, 1, 2, 4, 5, 6, 7]
    assert all((r["doc_id"] or 0, (r["text"] or "")[:60], r["_row"]) in kept for r in rows)
    for r in rows:
        assert len({r[n].removeprefix(n) for n in names}) == 1  # a row's own values, all of them


def test_every_stage_keeps_columns_and_takes_odd_tables(spark, clashing):
    docs, names = clashing
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        if name == "packing":
            assert {r["doc_id"] for r in out.select("doc_id").collect()} == {1, 2, 3, 4, 5, 6, 7, None}
            continue
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert any(r["doc_id"] == 5 and len(r["text"]) > 600_000 for r in rows), name
        for r in rows:
            assert len({r[n].removeprefix(n) for n in names}) == 1, name


def test_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert jaccard_join.SHINGLE == 5 and jaccard_join.PERCENT == 80


def test_documents_that_share_a_passage_are_no_pairs(spark, tmp_path, monkeypatch):
    """Stage 2 counts the two of each pair of copies, not all documents with the passage against each other."""
    passage, rows = [f"p{k}" for k in range(60)], []
    for k in range(15):
        own = [f"d{k}x{j}" for j in range(60)]
        rows += [(2 * k, " ".join(passage + own)), (2 * k + 1, " ".join(passage + own[:30] + ["e"] + own[31:]))]
    monkeypatch.setattr(jaccard_join, "new_state_path", lambda _, name: f"{tmp_path}/{name}")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert kept == set(range(0, 30, 2))
    assert spark.read.parquet(f"{tmp_path}/jaccard/parts").selectExpr("sum(pairs)").first()[0] == 15
