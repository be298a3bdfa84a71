"""Replies, demonstrations, records, leakage, sources, stream and repair rounds."""

import json
import random

import pytest
from pyspark.sql import functions as F

from pairlens.operators import leakage as J
from pairlens.operators import mining
from pairlens.operators import records as N
from pairlens.operators import requests as R
from pairlens.operators import responses as H
from pairlens.operators import selection as B
from pairlens.operators.reshape import review_order, to_long, to_wide
from pairlens.plans import repair
from pairlens.sources import readers, writers
from pairlens.streaming import intake

WIDE = ("row_id bigint, referent string, EN_source_sentence string, masc_referent string, EN_masculine_sentence string, "
        "fem_referent string, EN_feminine_sentence string")


@pytest.fixture
def wide(spark):
    return spark.createDataFrame([
        (1, "cook", "A cook ate.", None, "A cook ate, sir.", "cook", "A cook ate, miss."),
        (2, "pal", None, "pal", "Hé \"pal\"", "", None), (3, "spy", " The spy ", "spy", "", "spy", "x")], WIDE)


def test_long_and_wide(wide):
    rows = [(r["row_id"], r["variant"], r["referent"]) for r in to_long(wide).orderBy("row_id", "variant").collect()]
    assert rows == [(1, "feminine", "cook"), (1, "masculine", "cook"), (1, "source", "cook"), (2, "masculine", "pal"),
                    (2, "source", "pal"), (3, "feminine", "spy"), (3, "masculine", "spy"), (3, "source", "spy")]
    back = {r["row_id"]: r for r in to_wide(to_long(wide), {"sentence": "s"}).collect()}
    assert back[1]["s_masculine"] == "A cook ate, sir." and back[2]["s_feminine"] is None
    assert review_order(wide).columns[:3] == ["referent", "EN_source_sentence", "masc_referent"]


def test_exact_sample_is_stable(spark):
    df = spark.range(5000).withColumnRenamed("id", "row_id")
    one = {r[0] for r in B.exact_sample(df, 321, 4).collect()}
    other = {r[0] for r in B.exact_sample(df.repartition(7), 321, 4).collect()}
    assert one == other and len(one) == 321
    assert B.exact_sample(df, 9000, 4).count() == 5000


CLOSED = [
    ('{"gender": "masculine", "confidence": 4, "reasoning": "he"}', "succeeded", ("masculine", 4, "he")),
    ('Draft {"gender": "feminine"} final {"gender": "ambiguous", "confidence": 4.7}', "succeeded", ("ambiguous", 4, None)),
    ('{"gender": "male"}', "succeeded", ("parse_error", None, None)), ("nothing", "succeeded", ("parse_error", None, None)),
    (None, "errored", ("parse_error", None, None)), (None, None, (None, None, None)),
    ('```json\n{"gender": "feminine", "confidence": "5"}\n```', "succeeded", ("feminine", None, None))]


def test_closed_answers(spark):
    df = spark.createDataFrame([(i, s, t) for i, (t, s, _) in enumerate(CLOSED)], "i int, status string, text string")
    got = {r["i"]: (r["predicted_label"], r["confidence"], r["reasoning"]) for r in H.closed_answers(df).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(CLOSED)}


def listing(*names):
    return json.dumps({"referents": [{"referent": n, "gender": g, "confidence": 3} for n, g in names]})


OPEN = [
    (listing(("nurse", "feminine"), ("the nurse", "masculine")), "Nurse.", "feminine"),
    (listing(("the head nurse", "masculine"), ("nurse", "ambiguous")), "nurse", "ambiguous"),
    (listing(("the nurse", "masculine")), "nurse", "masculine"), (listing(("nurse", "masculine")), "head nurse", "masculine"),
    (listing(("nurses!", "feminine")), "nurse", "feminine"), (listing(("cook", "feminine")), "nurse", "not_found"),
    (listing(("nurse", "male")), "nurse", "parse_error"), ('{"referents": "nurse"}', "nurse", "not_found"), ("{}", "nurse", "parse_error"),
    ('{"referents": [7, "nurse", {"gender": "feminine"}]}', "nurse", "not_found"), ("no", "nurse", "parse_error"),
    (listing(("nurse", "feminine")), "", "not_found"), (listing(("", "feminine")), "nurse", "not_found")]


def test_open_answers(spark):
    df = spark.createDataFrame([(i, "succeeded", t, r) for i, (t, r, _) in enumerate(OPEN)], "i int, status string, text string, referent string")
    got = {r["i"]: r["predicted_label"] for r in H.open_answers(df).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(OPEN)}


def test_last_response_wins_and_missing_stays(spark):
    rows = spark.createDataFrame([(1,), (2,)], "row_id bigint")
    replies = spark.createDataFrame([("g_1", "errored", None, 1), ("g_1", "succeeded", "b", 3), ("g_1", "succeeded", "a", 2)],
                                    "custom_id string, status string, text string, arrival int")
    got = {r["row_id"]: (r["status"], r["text"]) for r in H.attach(rows, replies, "g").collect()}
    assert got == {1: ("succeeded", "b"), 2: (None, None)}
    assert {r["status"]: r["n"] for r in H.progress(replies).collect()} == {
        "processing": 0, "succeeded": 2, "errored": 1, "canceled": 0, "expired": 0}


def test_demos_are_distinct_and_small_pools_fail(spark, wide):
    rows = [(i, f"r{i}", f"s{i}", f"r{i}", f"m{i}", f"r{i}", f"f{i}") for i in range(7)]
    corpus = spark.createDataFrame(rows, WIDE)
    long, pool = to_long(corpus), R.demo_pool(corpus)
    for per_class, only in ((2, False), (7, False), (2, True)):
        got = R.draw_demos(long, pool, per_class, seed=1, ambiguous_only=only).collect()
        assert len(got) == 21
        for r in got:
            drawn = [(d["gold"], d["sentence"]) for d in r["demos"]]
            assert len(set(drawn)) == len(drawn) == per_class * 3
            if not only:
                assert sorted(g for g, _ in drawn) == sorted(["masculine", "feminine", "ambiguous"] * per_class)
    with pytest.raises(Exception, match="pool of"):
        R.draw_demos(long, pool, 8).collect()


def test_draws_are_uniform_subsets(spark):
    """Every pair and triple of six positions comes up about equally often, not only evenly spaced ones."""
    from collections import Counter
    from math import comb

    rows = [(i, f"r{i}", f"s{i}", f"r{i}", f"m{i}", f"r{i}", f"f{i}") for i in range(6)]
    pool = R.demo_pool(spark.createDataFrame(rows, WIDE))
    long = spark.range(3000).selectExpr("id AS row_id", "'source' AS variant")
    for k in (2, 3):
        drawn = R.draw_demos(long, pool, k, seed=3).collect()
        seen = Counter(tuple(sorted(d["sentence"] for d in r["demos"] if d["gold"] == "masculine")) for r in drawn)
        expected = 3000 / comb(6, k)
        assert len(seen) == comb(6, k) and sum((n - expected) ** 2 / expected for n in seen.values()) < 50


def test_drawn_texts_pass_one_shuffle_packed(spark):
    rows = [(i, f"r{i}", f"s{i}", f"r{i}", f"m{i}", f"r{i}", f"f{i}") for i in range(7)]
    corpus = spark.createDataFrame(rows, WIDE)
    plan = R.draw_demos(to_long(corpus), R.demo_pool(corpus))._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "collect_list" not in plan


def test_gather_lists_every_entry_of_repeated_and_missing_keys(spark):
    """Many buckets, several blocks a bucket: every row meets its own entries in order."""
    from pairlens.operators.gathering import gather

    rows = spark.range(3000).selectExpr("nullif(id % 2500, 7) AS row_id", "if(id % 3 = 0, 'a', 'b') AS variant", "id AS other")
    entries = spark.range(9000).selectExpr(
        "nullif(id * 7 % 2000, 7) AS row_id", "if(id % 2 = 0, 'a', 'b') AS variant", "8999 - id AS pos", "concat('t', id) AS text")
    got = gather(rows, entries, ("row_id", "variant"), "pos", "found", 1 << 20, bucket_bytes=1 << 15, buffer_bytes=1 << 14)
    held = {}
    for e in sorted(entries.collect(), key=lambda e: e["pos"]):
        held.setdefault((e["row_id"], e["variant"]), []).append(e["text"])
    out = got.collect()
    assert got.columns == ["row_id", "variant", "other", "found"] and sorted(r["other"] for r in out) == list(range(3000))
    for r in out:
        want = None if r["row_id"] is None else held.get((r["row_id"], r["variant"]))
        assert (None if r["found"] is None else [x["text"] for x in r["found"]]) == want


def test_demo_messages_are_valid_json(spark):
    df = spark.createDataFrame([('say "hi"\nté', "cook", "masculine")], "sentence string, referent string, gold string")
    demos = df.select(F.array(F.struct("sentence", "referent", "gold")).alias("d"))
    for open_task in (False, True):
        user, reply = demos.select(R.demo_messages(F.col("d"), open_task).alias("m")).first()["m"]
        assert user["content"].startswith("Sentence: say \"hi\"\nté")
        body = json.loads(reply["content"])
        assert (body["referents"][0] if open_task else body)["gender"] == "masculine"
    assert json.loads(demos.select(R.demo_trace(F.col("d"))).first()[0]) == [
        {"sentence": 'say "hi"\nté', "referent": "cook", "gold": "masculine"}]
    thought = demos.select(R.demo_messages(F.col("d"), True, True).alias("m")).first()["m"][1]["content"]
    assert thought.startswith("<think>\nI read") and "</think>\n{" in thought


def test_unknown_condition_is_refused(spark):
    with pytest.raises(ValueError):
        R.condition_table(spark, {"zero": "x"})
    known = R.condition_table(spark, {"few_shot": "p"}, {"few_shot": ["a cook ate", "a spy slept"]})
    assert [r["text"] for r in R.condition_examples(known, "few_shot").orderBy("example_id").collect()] == ["a cook ate", "a spy slept"]


def test_records_skip_blank_and_never_fall_back(wide, tmp_path, spark):
    got = [(r["row_id"], r["variant"]) for r in N.closed_records(wide, "sys").orderBy("row_id", "variant").collect()]
    assert got == [(1, "feminine"), (1, "source"), (2, "masculine"), (3, "feminine"), (3, "source")]
    path = str(tmp_path / "records")
    writers.write_records(N.open_records(wide, "sys"), path)
    lines = [json.loads(r[0]) for r in spark.read.text(path).collect()]
    texts = [m["content"] for line in lines for m in line["messages"] if m["role"] == "user"]
    assert 'Sentence: Hé "pal"' in texts and all(len(line["messages"]) == 3 for line in lines)


def test_records_are_packed_and_counted_without_moving_single_ones(spark, tmp_path):
    rows = spark.range(400).selectExpr("concat('t', id % 300) AS a", "nullif(id % 300, 299) AS b")
    got = {(r["a"], r["b"]): r["n"] for r in writers.count_records(rows).collect()}
    assert got == {(f"t{k}", None if k == 299 else k): 2 if k < 100 else 1 for k in range(300)}
    writers.write_records(rows.select(F.array(F.struct(F.lit("user").alias("role"), F.col("a").alias("content"))).alias("messages")), str(tmp_path / "r"))
    assert {f.suffix for f in (tmp_path / "r").glob("part-*")} == {".gz"} and spark.read.text(str(tmp_path / "r")).count() == 400


def test_multi_records_override_the_annotated_entry(spark):
    rows = [(1, "source", "s", "nurse", "ambiguous", listing(("the nurse", "feminine"), ("cook", "masculine"))),
            (2, "source", "s", "nurse", "feminine", listing(("cook", "feminine"))), (3, "source", "s", "nurse", "feminine", "none"),
            (4, "source", "s", "nurse", "feminine", '{"referents": [{"referent": " nurse ", "gender": "feminine"}, {"referent": "x", "gender": "y"}]}')]
    df = spark.createDataFrame(rows, "row_id bigint, variant string, sentence string, referent string, expected_label string, raw_response string")
    taught = N.taught_rows(df)
    assert {r["row_id"]: r["outcome"] for r in taught.collect()} == {1: "overridden", 2: "not_found", 3: "parse_error", 4: "kept"}
    targets = {r["row_id"]: json.loads(r["messages"][2]["content"])["referents"] for r in N.multi_records(taught, "p").collect()}
    assert [e["gender"] for e in targets[1]] == ["ambiguous", "masculine"]
    assert targets[4] == [{"referent": "nurse", "gender": "feminine", "confidence": 5, "reasoning": ""}]
    counts = N.multi_counts(taught).first()
    assert (counts["total"], counts["kept"], counts["extra_referents"], counts["mean_referents"]) == (4, 2, 1, 1.5)


def test_containing_against_brute_force(spark):
    rng = random.Random(5)
    words = ["ab", "abc", "b", "bc", "cab", "é", "a"]

    def text(n):
        return rng.choice(["", " ", "\n"]).join([""]) + rng.choice([" ", "  "]).join(rng.choice(words) for _ in range(n))

    hay = [text(rng.randint(1, 40)) for _ in range(60)]
    needles = [text(rng.randint(1, 9)) for _ in range(60)]
    for h in hay:
        a = rng.randrange(len(h))
        needles.append(h[a:a + rng.randint(1, 30)])
    needles += ["", " ", hay[0]]
    n = spark.createDataFrame(list(enumerate(needles)), "needle_id int, text string")
    h = spark.createDataFrame(list(enumerate(hay)), "hay_id int, text string")
    want = sorted((i, j, x == y) for i, x in enumerate(needles) for j, y in enumerate(hay) if x.strip() and x in y)
    assert sorted(tuple(r) for r in J.containing(n, h).collect()) == want


def test_overlap_counts_copies_once_per_kind(spark):
    examples = spark.createDataFrame([(1, "a red fox ran off"), (2, "nothing like it"), (3, "fox")], "example_id int, text string")
    sentences = spark.createDataFrame(
        [(i, t) for i, t in enumerate(["a red fox ran off"] * 3 + ["see: a red fox ran off!", "red fox", "fox", None])],
        "sentence_id int, text string")
    overlap = J.example_overlap(examples, sentences)
    got = {r[0]: tuple(r)[1:] for r in overlap.collect()}
    assert got == {1: (3, 1, 2), 2: (0, 0, 0), 3: (1, 5, 0)}
    with pytest.raises(ValueError, match=r"2 examples .*\[1, 3\]"):
        J.require_clean_examples(overlap)


def test_contamination_matches_any_variant(spark):
    cols = "row_id bigint, EN_source_sentence string, EN_masculine_sentence string, EN_feminine_sentence string"
    train = spark.createDataFrame([(1, "One", "x1", None), (2, "two", " THREE ", "x2"), (3, "fox", "", "")], cols)
    test = spark.createDataFrame([(9, "three", "one ", ""), (8, None, "three", None)], cols)
    assert [r[0] for r in J.drop_contaminated(train, test).select("row_id").collect()] == [3]
    assert tuple(J.contamination_report(train, test).first()) == (3, 2, 66.67)


def test_sources_and_sinks_round_trip(spark, wide, tmp_path):
    path = str(tmp_path / "c.parquet")
    writers.write_with_csv(wide, path)
    schema = readers.corpus_schema("row_id", "referent", "EN_masculine_sentence")
    assert readers.read_corpus(spark, path, schema).count() == 3
    back = readers.read_csv(spark, str(tmp_path / "c.csv"), wide.schema)
    assert {r["EN_masculine_sentence"] for r in back.where("row_id = 2").collect()} == {'Hé "pal"'}
    writers.write_split(wide, F.col("EN_source_sentence").isNull(), str(tmp_path / "s"), "skipped", "clean")
    assert {r["status"]: r["count"] for r in spark.read.parquet(str(tmp_path / "s")).groupBy("status").count().collect()} == {"skipped": 1, "clean": 2}
    (tmp_path / "terms").mkdir()
    (tmp_path / "terms" / "male.txt").write_text("king\n\n duke \n", encoding="utf-8")
    terms = readers.read_term_lists(spark, str(tmp_path / "terms")).collect()
    assert {(r["term"], r["list_name"]) for r in terms} == {("king", "male"), ("duke", "male")}
    spark.createDataFrame([("queen", "fe male")], "value string, kind string").write.partitionBy("kind").text(str(tmp_path / "parts"))
    assert [tuple(r) for r in readers.read_term_lists(spark, str(tmp_path / "parts" / "*")).collect()] == [("queen", "fe male")]
    (tmp_path / "pairs.md").write_text("# x\n| Masculine | Feminine |\n|---|---|\n| king | queen |\n", encoding="utf-8")
    assert {r["form"] for r in readers.read_pair_lexicon(spark, str(tmp_path / "pairs.md")).collect()} == {"king", "queen"}
    failed = wide.withColumn("generation_status", F.when(F.col("row_id") == 2, "expired").otherwise("ok"))
    writers.write_generated(failed, str(tmp_path / "g.parquet"))
    assert spark.read.json(str(tmp_path / "g_errors.json")).first()["error"] == "expired"


def test_runs_are_stacked_and_missing_ones_skipped(spark, wide, tmp_path):
    one = str(tmp_path / "one.parquet")
    wide.select("row_id").write.parquet(one)
    runs = readers.read_runs(spark, {("a", "zero_shot"): one, ("b", "zero_shot"): str(tmp_path / "none.parquet")})
    assert {(r["model"], r["condition"]) for r in runs.collect()} == {("a", "zero_shot")}
    writers.write_runs(runs, str(tmp_path / "runs"))
    assert readers.read_run_table(spark, str(tmp_path / "runs")).where("model = 'a'").count() == 3
    with pytest.raises(FileNotFoundError):
        readers.read_runs(spark, {("b", "zero_shot"): str(tmp_path / "none.parquet")})


def test_contamination_shuffles_hits_only(spark):
    columns = "row_id bigint, EN_source_sentence string, EN_masculine_sentence string, EN_feminine_sentence string"
    train = spark.createDataFrame([(k, f"Line {k}", f"line {k}, sir", None) for k in range(3_000)], columns)
    test = spark.createDataFrame([(9, " LINE 7", "other", ""), (10, "line 8, SIR ", None, None)], columns)
    known = J._keys(test).where("a IS NOT NULL").select("a", "b").distinct()
    assert J._suspects(train, known).count() <= 5  # of 6,000 sentences
    assert sorted(r[0] for r in J.contaminated_ids(train, test).collect()) == [7, 8]
    plan = J.contaminated_ids(train, test)._jdf.queryExecution().executedPlan().toString()
    scan_side = plan[plan.index("may") if "may" in plan else 0:]
    assert "scalar-subquery" in scan_side.lower() or "Subquery" in scan_side
    nothing = train.limit(0)
    assert J.contaminated_ids(train, nothing).count() == 0 and tuple(J.contamination_report(nothing, test).first())[:2] == (0, 0)


def test_a_sieve_holds_all_its_keys(spark):
    keys = spark.range(5_000).select(F.xxhash64("id").alias("key"))
    other = spark.range(5_000, 50_000).select(F.xxhash64("id").alias("key"))
    assert keys.where(J.may_hold(J.sieve(keys), F.col("key"))).count() == 5_000
    assert other.where(J.may_hold(J.sieve(keys), F.col("key"))).count() < 450
    assert other.where(J.may_hold(J.sieve(keys.limit(0)), F.col("key"))).count() == 0


def test_marked_reply_with_its_partner(spark):
    columns = "row_id bigint, variant string, sentence string, referent string, expected_label string, raw_response string"
    ours = spark.createDataFrame([(1, "source", "s", "r", "ambiguous", "no"), (2, "source", "s", "r", "ambiguous", "I THINK so")], columns)
    theirs = spark.createDataFrame([(2, "source", "s", "r", "ambiguous", "theirs"), (1, "source", "s", "r", "ambiguous", "x")], columns)
    assert mining.marked_reply(ours, "think", partner=theirs).first()["partner_response"] == "theirs"
    found = mining.marked_reply(ours, "think", partner=theirs.where("row_id = 1")).collect()
    assert [(r["row_id"], r["partner_response"]) for r in found] == [(2, None)]


def test_stream_intake_keeps_all_replies_and_resumes(spark, tmp_path):
    examples = spark.createDataFrame([(f"c{i}", "x", "masculine") for i in range(3)], "custom_id string, referent string, expected_label string")
    landing = tmp_path / "in"
    landing.mkdir()

    def land(name, rows):
        (landing / name).write_text("\n".join(json.dumps(r) for r in rows), encoding="utf-8")

    def reply(i, label, hour=0):
        return {"custom_id": f"c{i}", "status": "succeeded", "text": json.dumps({"gender": label}), "arrival": f"2024-01-01T{hour:02}:00:00Z"}

    def run():
        stream = intake.labelled(intake.read_responses(spark, str(landing)), examples, open_task=False)
        intake.append(stream.select("custom_id", "arrival", "known", "predicted_label", "correct"), str(tmp_path / "out"),
                      str(tmp_path / "state"), once=True).awaitTermination()
        return spark.read.parquet(str(tmp_path / "out"))

    def last(table):
        return {(r["custom_id"], r["predicted_label"], r["correct"]) for r in intake.settled(table).collect()}

    land("1.json", [reply(0, "masculine"), {**reply(1, "x"), "status": "errored", "text": None}])
    assert last(run()) == {("c0", "masculine", True), ("c1", "parse_error", False)}
    land("2.json", [reply(0, "feminine", 6), reply(9, "feminine", 7)])
    land("3.json", [reply(2, "feminine", 1), reply(0, "ambiguous", 5)])  # far behind the latest arrival
    table = run()
    assert last(table) == {("c0", "feminine", False), ("c1", "parse_error", False), ("c2", "feminine", False)}
    assert table.count() == 6 and [r["custom_id"] for r in intake.unknown(table).collect()] == ["c9"]
    batch = table.where("custom_id = 'c2'").withColumns({"arrival": F.expr("arrival + INTERVAL 1 DAY"), "predicted_label": F.lit("masculine")})
    assert {r["custom_id"]: r["predicted_label"] for r in intake.settled(table, batch).collect()}["c2"] == "masculine"
    counts = intake.status_counts(intake.read_responses(spark, str(landing)))
    query = counts.writeStream.outputMode("complete").format("memory").queryName("states").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r["status"]: r["n"] for r in spark.table("states").groupBy("status").agg(F.sum("n").alias("n")).collect()} == {"succeeded": 5, "errored": 1}


def test_stream_state_keeps_the_last_reply_of_each_id(spark, tmp_path):
    """Several micro-batches, a restart in between, late and repeated replies, an id that no example has, a null id."""
    examples = spark.createDataFrame([(f"c{i}", "x", "masculine") for i in range(3)], "custom_id string, referent string, expected_label string")
    landing, progress = tmp_path / "in", []
    landing.mkdir()

    def land(name, *replies):
        rows = [{"custom_id": i, "status": "succeeded", "text": json.dumps({"gender": g}), "arrival": f"2024-01-01T{h:02}:00:00Z"} for i, g, h in replies]
        (landing / name).write_text("\n".join(json.dumps(r) for r in rows), encoding="utf-8")

    def run():
        stream = intake.labelled(intake.read_responses(spark, str(landing), files_per_trigger=1), examples, open_task=False)
        query = intake.keep_last(stream.select("custom_id", "arrival", "known", "predicted_label"), str(tmp_path / "state"), once=True)
        query.awaitTermination()
        progress.append(len([p for p in query.recentProgress if p["numInputRows"]]))
        kept = intake.last_replies(spark, str(tmp_path / "state"))
        return {r["custom_id"]: (r["predicted_label"], r["known"]) for r in kept.collect()}, kept

    land("1.json", ("c0", "masculine", 3), ("c1", "feminine", 1))
    land("2.json", ("c0", "feminine", 2), ("c1", "masculine", 9), (None, "masculine", 9))
    assert run()[0] == {"c0": ("masculine", True), "c1": ("masculine", True)}
    land("3.json", ("c0", "ambiguous", 4), ("c9", "feminine", 1))
    land("4.json", ("c0", "feminine", 1), ("c1", "masculine", 9))
    land("5.json", ("c9", "ambiguous", 0))
    rows, kept = run()
    assert rows == {"c0": ("ambiguous", True), "c1": ("masculine", True), "c9": ("feminine", False)}
    assert progress == [2, 3] and [r["custom_id"] for r in intake.unknown(kept).collect()] == ["c9"]
    assert run()[0] == rows and "Exchange" not in kept._jdf.queryExecution().executedPlan().toString()

    counts = intake.status_counts(intake.read_responses(spark, str(landing), files_per_trigger=2))
    for _ in range(2):
        intake.write_counts(counts, str(tmp_path / "counts"), str(tmp_path / "counts_state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "counts")).agg(F.sum("n")).first()[0] == 10


def test_needles_are_told_by_their_end_runs(spark):
    """The runs at either end are those of the whole text, and texts of three tokens aren't looked up as short ones."""
    texts = [None, "", "a", "a b", "a b c", " a\u00a0b  c ", "a b c d", "a b c d e", "a b c d e f", "a b c d e f g", "x y z x y z x y z"]
    df = spark.createDataFrame(list(enumerate(texts)), "needle_id int, text string")
    whole = {r["needle_id"]: (r["runs"][0], r["runs"][-1]) for r in J._inner(df).collect()}
    ends = {r["needle_id"]: tuple(r["e"]) for r in df.select("needle_id", J.bind(J.tokens(F.col("text")), J._end_runs).alias("e")).collect()
            if r["e"] and r["e"]["first"] is not None}
    assert set(ends) == set(whole) == set(range(4, 11))
    assert all(ends[k] == whole[k] for k in range(4, 10)) and ends[10][0] == whole[10][0]
    short = {r["needle_id"] for r in df.where(~F.rlike("text", F.lit(J._THREE))).collect()}
    assert short == {1, 2, 3}


def test_rounds_are_written_packed(spark, tmp_path):
    import pyarrow.parquet as pq

    rows = spark.createDataFrame([(1, "cook", "A cook ate.", "A cook ate, sir.", "A cook ate, miss.", "x", "cook", "cook")],
                                 "row_id bigint, referent string, EN_source_sentence string, EN_masculine_sentence string, EN_feminine_sentence string, "
                                 "disambiguation_strategy string, masc_referent string, fem_referent string")

    def none(df, turn):
        return repair.with_state(df).select("row_id", *[c for c in repair.CLEARED_ON_RETRY if c != "accepted"]).limit(0)

    assert repair.repair_rounds(rows, none, lambda df, turn: df.limit(0), max_retries=0, path=str(tmp_path)).count() == 1
    found = [pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in tmp_path.rglob("*.parquet") if pq.ParquetFile(f).metadata.num_rows]
    assert found and set(found) == {"ZSTD"}


def test_repair_rounds_stop_and_count(spark):
    rows = [(i, "cook", f"The cook number {i} ate.", f"The cook number {i} ate, sir.", f"The cook number {i} ate, miss.") for i in range(4)]
    corpus = spark.createDataFrame(rows, "row_id bigint, referent string, EN_source_sentence string, EN_masculine_sentence string, EN_feminine_sentence string")
    corpus = corpus.withColumns({c: F.lit(None).cast("string") for c in ("disambiguation_strategy", "masc_referent", "fem_referent")})
    seen = []

    def evaluate(rows, turn):
        seen.append((turn, sorted(r[0] for r in rows.select("row_id").collect())))
        good = (F.col("row_id") == 0) | ((F.col("row_id") == 1) & (F.lit(turn) == 1))
        score = F.when(good, 5.0).otherwise(3.0)
        return rows.select("row_id", *[score.alias(c) for c in repair.CLEARED_ON_RETRY[:5]], F.lit("i").alias("eval_issues"),
                           F.lit("adjective").alias("eval_strategy_label"), (F.col("row_id") == 3).alias("eval_reject"),
                           F.lit(False).alias("eval_pos_change"), F.lit("").alias("eval_suggestion"))

    def rewrite(rows, turn):
        return rows.select("row_id", F.concat("EN_source_sentence", F.lit(" old man")).alias("EN_masculine_sentence"),
                           "EN_feminine_sentence", F.lit(None).cast("string").alias("disambiguation_strategy"), "masc_referent", "fem_referent")

    done = {r["row_id"]: r for r in repair.repair_rounds(corpus, evaluate, rewrite, max_retries=2).collect()}
    assert seen == [(0, [0, 1, 2, 3]), (1, [1, 2]), (2, [2])]
    assert {k: r["accepted"] for k, r in done.items()} == {0: True, 1: True, 2: False, 3: False}
    assert {k: r["retry_count"] for k, r in done.items()} == {0: None, 1: 1, 2: 2, 3: None}
    assert done[1]["disambiguation_strategy"] == "unknown" and done[1]["EN_masculine_sentence"].endswith("old man")


def test_stream_state_lies_on_disk(spark, tmp_path, monkeypatch):
    """A new query keeps its state in RocksDB, one that began in memory goes on there; the session's settings stay."""
    examples = spark.createDataFrame([("c0", "x", "masculine")], "custom_id string, referent string, expected_label string")
    store, before = "spark.sql.streaming.stateStore.providerClass", {k: spark.conf.get(k, None) for k in intake.DISK_STATE}

    def land(name, gender, hour):
        reply = {"custom_id": "c0", "status": "succeeded", "text": json.dumps({"gender": gender}), "arrival": f"2024-01-01T{hour:02}:00:00Z"}
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text(json.dumps(reply), encoding="utf-8")

    def run(state):
        stream = intake.labelled(intake.read_responses(spark, str(tmp_path / "in")), examples, open_task=False)
        intake.keep_last(stream.select("custom_id", "arrival", "known", "predicted_label"), str(tmp_path / state), once=True).awaitTermination()
        offsets = sorted((tmp_path / state / "offsets").glob("[0-9]*"), key=lambda f: int(f.name))[-1].read_text(encoding="utf-8")
        return json.loads(offsets.splitlines()[1])["conf"][store], [r["predicted_label"] for r in intake.last_replies(spark, str(tmp_path / state)).collect()]

    land("a.json", "masculine", 1)
    with monkeypatch.context() as patched:
        patched.setattr(intake, "DISK_STATE", {})
        assert "HDFSBacked" in run("old")[0]
    land("b.json", "feminine", 2)
    (provider, labels), (kept, went_on) = run("new"), run("old")
    assert "RocksDB" in provider and "HDFSBacked" in kept and labels == went_on == ["feminine"]
    assert {k: spark.conf.get(k, None) for k in intake.DISK_STATE} == before


def test_micro_batches_of_a_lot_do_not_grow_with_its_files(spark, tmp_path, monkeypatch):
    from checks import exchange_checks

    monkeypatch.setattr(exchange_checks, "responses", lambda rows: rows)
    rows = spark.range(4000).select(F.concat(F.lit("c"), F.col("id")).alias("custom_id"), F.lit("succeeded").alias("status"),
                                    F.lit("{}").alias("text"), (F.col("id") % 2).alias("arrival"))
    seen = 0
    for each in exchange_checks._landed(spark, rows.repartition(24), str(tmp_path)):
        files = len(list((tmp_path / "in").glob("part-*"))) - seen
        seen += files
        assert files > 16 and -(-files // each) <= 4
    assert spark.read.json(str(tmp_path / "in")).count() == 12_000


def test_runs_are_written_unsorted_whatever_their_number(spark, tmp_path, monkeypatch):
    """More runs than files a task holds open, null names among them; packed by zstd, and the session's setting stays."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(writers, "OPEN_RUNS", 3)
    runs = spark.range(400).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("m"), F.col("id") % 7)).alias("model"),
                                   F.concat(F.lit("c"), F.col("id") % 2).alias("condition"))
    before = spark.conf.get(writers._WRITERS)
    writers.write_runs(runs.repartition(3), str(tmp_path / "runs"))
    back = readers.read_run_table(spark, str(tmp_path / "runs")).select(*runs.columns)
    assert back.exceptAll(runs).count() == 0 == runs.exceptAll(back).count() and spark.conf.get(writers._WRITERS) == before
    file = next((tmp_path / "runs").rglob("*.parquet"))
    assert pq.ParquetFile(file).metadata.row_group(0).column(0).compression == "ZSTD"
