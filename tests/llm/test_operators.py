"""Operators against brute force, exact round trips and the edge cases their docstrings define."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pairlens.llm import (components, debruijn, decontamination, jaccard_join, licenses, packing, pii, quality_llr, rans,
                          sharding, textcodes, token_rollup, tokens)
from pairlens.session import new_state_path

SCHEMA = ("doc_id bigint, text string, source string, lang string, shard int, slot int, kept string, label string, rep bigint, "
          "n_words int, ids string, quality int, n_chars bigint")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = "an er the ti on es re ou in ha st Nd éa ß".split()


def make_texts(seed: int) -> list[tuple[int | None, str | None]]:
    """Plain texts, copies, near copies, shared passages, and the odd cases."""
    rng = random.Random(seed)

    def text(n: int) -> list[str]:
        return ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n)]

    passage, base = text(30), text(120)
    rows: list[tuple[int | None, str | None]] = [(None, " ".join(base)), (None, None), (1, None), (2, ""), (3, " \n\t "), (4, "one"),
                                                (5, "one two three"), (6, "ONE two THREE"), (5, "one two three")]
    k = 10
    for _ in range(12):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(SYLLABLES)
        rows.append((k, " ".join(words)))
        k += 1
    for _ in range(8):
        own = text(rng.randint(10, 60))
        rows.append((k, " ".join(own[:9]) + "\n" + " ".join(passage) + " " + " ".join(own[9:])))
        k += 1
    for _ in range(5):
        rows.append((k, " ".join(text(3) * 30)))
        k += 1
    rows += [(k, rows[-1][1]), (k + 1, " ".join(base)), (k + 2, "x" * 100_000), (k + 3, " ".join(text(30_000)))]
    return rows


@pytest.fixture(scope="module")
def rows():
    return make_texts(5)


@pytest.fixture(scope="module")
def docs(spark, rows):
    full = [(i, t, "s", "en", 9, 9, "k", "l", 7, 1, "i", 1, 0) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(text or "")


def lowered(text: str | None) -> str:
    return (text or "").encode().lower().decode()


# ------------------------------------------------------------------ codes

def test_codes_are_equal_for_equal_words_only():
    texts = [b"the cat", b"", b" the\tcat sat ", "éa the".encode()]
    codes, begin = textcodes.word_codes(texts)
    assert begin.tolist() == [0, 2, 2, 5, 7]
    assert codes[0] == codes[2] == codes[6] and len(set(codes.tolist())) == 4
    assert textcodes.window_codes(codes, 2)[0] == textcodes.window_codes(codes, 2)[2]
    assert [x for x in textcodes.chunks([b"a" * 9, b"b" * 9, b"", b"c" * 50], 20)] == [(0, 3), (3, 4)]


@pytest.mark.parametrize("width", [1, 2, 3, 7, 13])
def test_sliding_min(width):
    x = np.random.default_rng(width).integers(0, 99, 40)
    assert debruijn.sliding_min(x, width).tolist() == [min(x[i:i + width]) for i in range(40 - width + 1)]


# ------------------------------------------------------------------ 1

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t: str) -> list[tuple[str, int, int]]:
    def digits(m):
        return re.sub("[^0-9]", "", m.group())

    return ([("email", *m.span()) for m in EMAIL.finditer(t)]
            + [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
            + [("card", *m.span()) for m in CARD.finditer(t) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
            + [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(digits(m)) <= 15])


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    bits = ["a", "b.", "@", "@", "._", "-", "1", ".2", "255.", "256", "+4", " ", "(", ")", "12 34", "x", "4111 1111 1111 1111", "\n"]
    for _ in range(4000):
        t = "".join(rng.choices(bits, k=rng.randint(0, 30)))
        assert pii.candidates(t)[0] == plain_spans(t), t


def test_long_runs_take_linear_time():
    for t in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "@" * 300_000, "a@" * 150_000, "+1" * 150_000):
        pii.candidates(t)


def test_personal_spans(spark, docs, none):
    texts = [(1, "mail me: ann@x.example.com or bob [at] y.example.com"), (2, "call +1 (555) 010-9999, card 4111 1111 1111 1111"),
             (3, "host 10.20.30.40 version 1.2.3.4.5"), (4, "phone (020) 7946 0018 or tel 0151-4455-667"), (5, None)]
    found = {r["doc_id"]: r for r in pii.personal_spans(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    for i, t in texts:
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(t or ""))
        assert found[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(found[i]["spans"].split(","))
    assert found[2]["n_card"] == found[2]["n_phone"] == 1
    assert pii.personal_spans(docs).count() == docs.count() and pii.personal_spans(none).count() == 0


def test_reliabilities_follow_the_votes():
    """Two labelers agree with a hidden truth, one is noise: its rates are the same for both classes."""
    rng, counts = random.Random(1), Counter()
    for _ in range(3000):
        truth = rng.random() < 0.4
        votes = "".join("+" if (truth if rng.random() < right else not truth) else "-" for right in (0.95, 0.95, 0.5, 0.9, 0.9))
        counts[votes, (3, 0, 2, 2, int(truth), 0, 2, 0)] += 1
    model = pii.SpanModel(counts)
    rate = model.rates["phone"]
    assert abs(model.prior["phone"] - 0.4) < 0.05
    assert rate[1, 0, 2] > 0.9 > 0.6 > rate[1, 2, 2] and abs(rate[1, 2, 2] - rate[0, 2, 2]) < 0.1
    assert model.takes((3, 0, 2, 2, 1, 0, 2, 0)) and not model.takes((3, 0, 2, 2, 0, 0, 2, 0))


def test_redaction_keeps_the_rest(spark, docs):
    df = spark.createDataFrame([(1, "x ann@x.example.com y"), (2, None)], "doc_id bigint, text string")
    assert [r["text"] for r in pii.redacted(df).orderBy("doc_id").collect()] == ["x [EMAIL] y", None]
    assert pii.redacted(docs).columns == docs.columns


# ------------------------------------------------------------------ 2

def test_license_scan(spark, docs, none):
    texts = [(1, "Under the MIT-License! under the mit license"), (2, "cc by nc cc by, NC"), (3, "apache license version 20"),
             (4, "This is free and unencumbered software released into the public domain."), (5, None), (6, "the mit under license"),
             (7, " ".join("permission is hereby granted free of charge to any persons obtaining a copy of this software and associated documentation files".split()))]
    texts.append((8, "This work is licensed under the GNU General Public License, version 3."))
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    found = {r["doc_id"]: r for r in licenses.license_scan(df).collect()}
    assert found[8]["labels"] == "gpl" and found[8]["n_base"] == 0
    for i, t in texts:
        words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
        places = [(k, label) for phrase, label in licenses.PHRASES for k in range(len(words))
                  if words[k:k + len(phrase.split())] == phrase.split()]
        r = found[i]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert r["first_word"] == min((k for k, _ in places), default=None) and r["last_word"] == max((k for k, _ in places), default=None)
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
    assert found[4]["labels"] == "unlicense" and found[7]["labels"] == "mit" and 0.9 < found[7]["score"] < 1 and found[6]["score"] == 0
    assert licenses.license_scan(docs).count() == docs.count() and licenses.license_scan(none).count() == 0


# ------------------------------------------------------------------ 3 and 5

@pytest.mark.parametrize("name, byte_level", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_pieces_encode_like_whole_texts(name, byte_level, rows):
    enc = tokens.PieceEncoder(public_tokenizers.path(name), byte_level, max_entries=50)
    odd = ["", " a", "a ", "a  b", "it's  they're\n\n x", "don't stop ² x½ 12a", "<|endoftext|> a", "<|ENDOFTEXT|>b", "日本 text İx",
           "\x1ca b", "tab\tx \ty", "É́a", "a\r\nb", " 's 't's", "ΑΣ Σ", "x\n", "__a_b__ 3.14 $5", "ª µ a\xa0b \xa0c", "a, b. c! ?; x's. 's."]
    for t in [*odd, *(t for _, t in rows if t)]:
        assert enc.encode(t) == np.asarray(enc.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t[:60]


def test_cuts_are_the_cheapest():
    rng = random.Random(2)
    for _ in range(200):
        window, n = rng.choice([64, 100, 256]), rng.randint(1, 25)
        at = list(itertools.accumulate([0, *(rng.randint(1, window) for _ in range(n))]))
        penalty = [0, *(rng.choice([0, 4, 64]) for _ in range(n))]

        def cost(i, j):
            length = at[j] - at[i]
            return penalty[j] + (0 if length >= packing.SMALLEST_POWER and length & (length - 1) == 0 else window - length)

        best = [0, *[float("inf")] * n]
        for j in range(1, n + 1):
            best[j] = min(best[i] + cost(i, j) for i in range(j) if at[j] - at[i] <= window)
        cuts = [0, *packing.best_cuts(at, penalty, window)]
        assert sum(cost(i, j) for i, j in itertools.pairwise(cuts)) == best[-1]


def check_pieces(pieces, wanted: Counter):
    seen, by_sequence = Counter(), defaultdict(list)
    by_doc = defaultdict(list)
    for r in pieces:
        assert r["length"] > 0 and r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"]
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"], r["doc_tokens"]].append(r)
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= packing.WINDOW
    for (doc, n), parts in by_doc.items():
        starts = Counter(r["start"] for r in parts)
        copies = starts[0]
        assert sum(r["length"] for r in parts) == copies * n
        if copies == 1:
            seen[doc, b"".join(r["ids"] for r in sorted(parts, key=lambda r: r["start"]))] += 1
        else:
            seen += Counter({k: v for k, v in wanted.items() if k[0] == doc})
    assert seen == wanted


def test_packing_covers_every_id_once(docs, none, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    enc = tokens.PieceEncoder(path, True)
    wanted = Counter((i, enc.encode(t) + b"\0\0\0\0") for i, t in rows)
    check_pieces(packing.pack_documents(docs, path).collect(), wanted)
    check_pieces(packing.pack_documents(docs, path, run=500).collect(), wanted)
    assert packing.pack_documents(none, path).count() == 0


@pytest.mark.parametrize("n", [1, 2, 1023, 1024, 1025, 5000, 70_000])
def test_segments_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 49_000).astype("<u4")
    doc_ids, lengths, got = rans.unpack_segment(rans.pack_segment([None, 5], [n - 1, 1], ids))
    assert doc_ids == [None, 5] and lengths.tolist() == [n - 1, 1] and (got == ids).all()


def test_a_block_decodes_on_its_own_and_damage_is_seen():
    ids = (np.random.default_rng(1).zipf(1.3, 5000) % 900).astype("<u4")
    symbols, index, counts = np.unique(ids, return_inverse=True, return_counts=True)
    freq = rans.frequencies(counts)
    assert freq.sum() == 1 << rans.SCALE_BITS and freq.min() >= 1
    state, position, words = rans.encode_blocks(index, freq)
    second = rans.decode_blocks(rans.BLOCK, freq, state[1:2], np.zeros(1, np.int64), words[int(position[1]):int(position[2])])
    assert (symbols[second] == ids[rans.BLOCK:2 * rans.BLOCK]).all()
    payload = bytearray(rans.pack_segment([1], [5000], ids))
    payload[-3] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        rans.unpack_segment(bytes(payload))


def test_token_files(spark, docs, none, rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    enc = tokens.PieceEncoder(path, False)
    digest = rans.document_token_digest(docs, new_state_path(spark, "t"), path, False, 1).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start, wanted = 0, []
    for i, t in ordered:
        ids = enc.encode(t) + b"\1\0\0\0"
        wanted.append((i, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    assert sorted(map(tuple, digest), key=lambda r: r[1]) == wanted
    empty = new_state_path(spark, "t")
    assert rans.document_token_digest(none, empty, path, False, 1).count() == 0


# ------------------------------------------------------------------ 4

def plain_removal(rows, k: int) -> dict:
    """Of (doc_id, text) with distinct ids."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        words = words_of(t)
        gone = [False] * len(words)
        for p in range(len(words) - k + 1):
            w = tuple(words[p:p + k])
            if w in seen:
                gone[p:p + k] = [True] * k
            seen.add(w)
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[i] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("seed", [5, 6])
def test_repeated_spans(spark, seed):
    rows = [(i, t) for i, t in make_texts(seed) if i is not None and i != 5]
    rng = random.Random(seed)
    rows += [(1000 + k, " ".join(rng.choices("a b c".split(), k=rng.randint(15, 80)))) for k in range(25)]
    rows += [(2000 + k, " ".join(["a b a c"] * n)) for k, n in enumerate((4, 5, 6, 30, 6))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in debruijn.without_repeats(df).collect()}
    assert got == plain_removal(rows, debruijn.K)


@pytest.mark.parametrize("bits", [1, 64])
def test_hidden_branches_are_compared_word_by_word(spark, monkeypatch, bits):
    """With tags narrowed to one bit, paths that differ in a word in the middle look alike; that word stays."""
    monkeypatch.setattr(debruijn, "TAG_BITS", bits)
    head, tail = [f"p{k}" for k in range(30)], [f"s{k}" for k in range(30)]
    rows = [(k, " ".join([f"own{k}", *head, f"mid{k}", *tail])) for k in range(8)] + [(8 + k, " ".join([*head, f"mid{k}", *tail])) for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in debruijn.without_repeats(df).collect()}
    assert got == plain_removal(rows, debruijn.K)


def test_hot_paths_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(debruijn, "HOT", 3)
    monkeypatch.setattr(debruijn, "SALTS", 4)
    rng = random.Random(1)
    passage = [f"p{k}" for k in range(40)]
    rows = [(k, " ".join([f"a{rng.random()}", *passage, f"b{rng.random()}"])) for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in debruijn.without_repeats(df).collect()}
    assert got == plain_removal(rows, debruijn.K)


def test_repeated_spans_of_odd_rows(docs, none):
    out = debruijn.without_repeats(docs)
    assert out.count() == docs.count() and out.where("doc_id IS NULL AND n_removed > 0").count() == 0
    assert debruijn.without_repeats(none).count() == 0


# ------------------------------------------------------------------ 6

def test_leaks_survive_substitutions(spark, docs, none):
    rng = random.Random(4)
    item = [f"w{k}" for k in range(25)]
    swapped = [w if k not in (3, 9, 16, 22) else "zz" for k, w in enumerate(item)]
    texts = [(1, "a b " + " ".join(item).upper() + " c"), (2, "q " + ", ".join(swapped)), (3, " ".join(item[5:19])),
             (4, " ".join(rng.sample(item, 25))), (5, " ".join(item[:8])), (6, None), (None, " ".join(item))]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    items = [(7, " ".join(item)), (8, "w1 w2 w3"), (9, None), (10, " ".join(f"v{k}" for k in range(9))), (11, "Q")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for limit in (decontamination.MAX_SEEDS, 60):  # one block and several
        got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(df, bench, limit).collect()}
        assert got == {(1, 7), (2, 7), (3, 7), (None, 7), (1, 8), (5, 8), (None, 8), (2, 11)}
        assert {r["doc_id"] for r in decontamination.leak_free(df, bench, limit).collect()} == {4, 6}
    assert decontamination.leaks(none, bench).count() == 0 and decontamination.leaks(docs, bench.limit(0)).count() == 0
    assert decontamination.leak_free(docs, bench).columns == docs.columns


def test_leaks_equal_brute_force_alignment():
    rng = random.Random(9)
    items = [[f"u{rng.randrange(40)}" for _ in range(rng.randint(6, 30))] for _ in range(20)]
    index = decontamination.SeedIndex([(k, " ".join(w).encode()) for k, w in enumerate(items)])
    found = 0
    for _ in range(150):
        words = [f"u{rng.randrange(40)}" for _ in range(40)]
        k = rng.randrange(20)
        copy = [w if rng.random() > 0.08 else "x" for w in items[k]]
        doc = words[:20] + copy + words[20:]
        codes, _ = textcodes.word_codes([" ".join(doc).encode()], textcodes.LETTER_TABLE)
        truth = {i for i, w in enumerate(items) if any(
            decontamination.compare(codes, index.words[i], s) for s in range(-len(w), len(doc)))}
        got = {i for _, i, *_ in decontamination._found(index, [" ".join(doc).encode()])}
        assert got == truth
        found += len(truth)
    assert found > 100


def test_short_items_equal_brute_force():
    rng = random.Random(21)
    items = [[f"u{rng.randrange(3)}" for _ in range(rng.randint(0, 7))] for _ in range(60)]
    index = decontamination.SeedIndex([(k, " ".join(w).encode()) for k, w in enumerate(items)])
    docs = [[f"u{rng.randrange(3)}" for _ in range(rng.choice([0, 1, 3, 12, 60]))] for _ in range(80)]
    got = list(decontamination._found(index, [" ".join(d).encode() for d in docs]))
    short = sorted((d, i, at, len(items[i])) for d, i, at, *_ in got if len(items[i]) < decontamination.MIN_WORDS)
    truth = []
    for d, words in enumerate(docs):
        for i, w in enumerate(items):
            at = [k for k in range(len(words) - len(w) + 1) if words[k:k + len(w)] == w]
            if at and 0 < len(w) < decontamination.MIN_WORDS:
                truth.append((d, i, at[0], len(w)))
    assert short == truth and len(truth) > 300 and {n for *_, n in truth} == {1, 2, 3, 4, 5}


def test_masks_fit_between_all_allowed_substitutions():
    for n in range(decontamination.MIN_WORDS, decontamination.SPAN + 1):
        allowed = int(n * (1 - decontamination.MIN_SHARE) + 1e-9)
        for bad in itertools.combinations(range(n), allowed):
            assert any(all(at + k not in bad for k, on in enumerate(m) if on == "1")
                       for m in decontamination.MASKS for at in range(n - len(m) + 1)), (n, bad)


# ------------------------------------------------------------------ 7

def test_rollup_follows_signed_events(spark):
    schema = "doc_id bigint, op string, tokenizer string, source string, lang string, n_tokens bigint, seq int, extra int"

    def events(*rows):
        return spark.createDataFrame([(*r, 0) for r in rows], schema)

    rollup = token_rollup.TokenRollup(spark, new_state_path(spark, "rollup"))
    assert rollup.totals().count() == 0
    first = events((1, "insert", "t1", "a", "en", 10, 1), (2, "insert", "t1", "a", "en", 5, 1), (2, "insert", "t1", "a", "en", 6, 2),
                   (3, "insert", "t1", None, None, None, 1), (None, "insert", "t1", "a", "en", 99, 1), (4, "delete", "t1", "a", "en", 0, 1))
    assert rollup.commit("1", first) and not rollup.commit("1", first)
    assert rollup.commit("2", events((1, "revise", "t1", "b", "fr", 12, 1), (2, "delete", "t1", None, None, None, 1), (2, "insert", "t2", "a", "en", 3, 1)))
    assert rollup.commit("3", events()) and not rollup.commit("2", first)
    got = {tuple(r) for r in rollup.totals().collect()}
    assert got == {("b", "fr", "t1", 1, 12), (None, None, "t1", 1, 0), ("a", "en", "t2", 1, 3)}
    assert {r["doc_id"] for r in rollup.current().collect()} == {1, 2, 3}


def test_document_rollup_equals_brute_force(spark, docs, none, rows):
    """Every document counts, short ones too; of rows that share an id the one with most tokens."""
    odd = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise(F.col("source")))
    got = {tuple(r) for r in token_rollup.document_rollup(odd, new_state_path(spark, "rollup")).collect()}
    want: dict[tuple, list[int]] = defaultdict(lambda: [0, 0])
    texts = {i: t for i, t in rows if i is not None}
    for i, t in texts.items():
        for name, pattern in (("words-1", r"[^\x20\x09-\x0D]+"), ("pieces-1", r"[A-Za-z]+|[0-9]|[^\x00-\x7F]+")):
            cell = want[None if i % 3 == 0 else "s", "en", name]
            cell[0] += 1
            cell[1] += len(re.findall(pattern, t or ""))
    assert got == {(*k, *v) for k, v in want.items()} and any(len(t or "") < 200 for t in texts.values())
    assert token_rollup.document_rollup(none, new_state_path(spark, "rollup")).count() == 0


def test_an_interrupted_batch_is_written_anew(spark):
    path = new_state_path(spark, "rollup")
    rollup = token_rollup.TokenRollup(spark, path)
    row = spark.createDataFrame([(1, "insert", "t", "a", "en", 4, 1)], "doc_id bigint, op string, tokenizer string, source string, lang string, n_tokens bigint, seq int")
    row.selectExpr("doc_id", "tokenizer", "source", "lang", "n_tokens", "1 as sign", "'1' as batch").write.parquet(f"{path}/ledger/1")
    assert rollup.totals().count() == 0 and rollup.commit("1", row)
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "t", 1, 4)]


# ------------------------------------------------------------------ 8

def plain_links(rows) -> dict:
    """(n_shingles, component, links) per id, of rows with distinct ids."""
    sets = {}
    for i, t in rows:
        w = words_of(lowered(t))
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent, links = {i: i for i in sets}, Counter()

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i), links[i]) for i in sets}


@pytest.mark.parametrize("seed", [5, 8])
def test_near_duplicates(spark, seed, monkeypatch):
    rows = [(i, t) for i, t in make_texts(seed) if i is not None and i != 5] + [(900 + k, t) for k, t in enumerate(
        " ".join(f"z{j if j % 7 or j // 7 != k else 'q'}" for j in range(60)) for k in range(9))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = plain_links(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard_join.near_duplicates(df).collect()}
    assert got == want


@pytest.mark.parametrize("postings", [2_000_000, 300])
def test_only_pairs_of_a_group_are_counted(spark, tmp_path, monkeypatch, postings):
    """Twenty pairs of copies share a passage: a pair's two are counted, once or once per fragment of their group, and no two others."""
    rng, passage = random.Random(4), [f"p{k}" for k in range(60)]
    rows = []
    for k in range(20):
        own = [f"d{k}x{j}" for j in range(60)]
        for i in (2 * k, 2 * k + 1):
            words = own[:]
            words[rng.randrange(60)] = f"e{i}"
            rows.append((i, " ".join(passage + words)))
    monkeypatch.setattr(jaccard_join, "PAIR_POSTINGS", postings)
    monkeypatch.setattr(jaccard_join, "new_state_path", lambda _, name: f"{tmp_path}/{name}")
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in got} == plain_links(rows)
    parts = spark.read.parquet(f"{tmp_path}/jaccard/parts").selectExpr("count_if(i >= 0)", "sum(pairs)").first()
    assert parts[0] == 0 and 20 <= parts[1] <= (20 if postings > 1000 else 40)


def test_repeated_rows_count_their_shingles_once(spark):
    words = [f"w{k}" for k in range(40)]
    rows = [(1, words), (1, words), (2, words[:28] + [f"x{k}" for k in range(12)]), (3, [*words, "z"]), (5, words)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id bigint, text string").repartition(1)
    got = sorted((r["doc_id"], r["component_id"], r["n_links"]) for r in jaccard_join.near_duplicates(df).collect())
    assert got == [(1, 1, 3), (1, 1, 3), (2, 2, 0), (3, 1, 3), (5, 1, 3)]


def test_pairs_in_tiles_equal_pairs_in_lists(monkeypatch):
    rng = np.random.default_rng(3)
    sizes = rng.integers(20, 30, 40)
    owner = np.repeat(np.arange(40), 12)
    codes = rng.integers(0, 25, len(owner)).astype(np.uint64)
    one = np.unique(np.stack([codes.astype(np.int64), owner], 1), axis=0)
    want = jaccard_join.count_pairs(one[:, 1], one[:, 0].astype(np.uint64), sizes)
    monkeypatch.setattr(jaccard_join, "LONG_LIST", 1)
    monkeypatch.setattr(jaccard_join, "TILE", 7)
    monkeypatch.setattr(jaccard_join, "BUFFER", 50)
    got = jaccard_join.count_pairs(one[:, 1], one[:, 0].astype(np.uint64), sizes)
    assert all((a == b).all() for a, b in zip(want, got, strict=True)) and len(want[0])


def test_near_duplicates_of_odd_rows(docs, none):
    out = jaccard_join.near_duplicates(docs)
    assert out.count() == docs.count() and jaccard_join.near_duplicates(none).count() == 0
    assert out.where("doc_id IS NULL AND (component_id IS NOT NULL OR n_links > 0)").count() == 0
    assert {r["component_id"] for r in out.where("doc_id IN (5, 6)").collect()} == {5}
    assert out.where("doc_id IN (1, 2, 3) AND (n_shingles > 0 OR component_id <> doc_id)").count() == 0


def test_components_of_large_ids(spark):
    """Hashes as ids: their sum passes 64 bits."""
    top = 2**63 - 1
    edges = spark.createDataFrame([(top, top - 1), (top - 1, top - 2), (top - 3, top - 4)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in components.connected_components(edges).collect()}
    assert got == {top: top - 2, top - 1: top - 2, top - 2: top - 2, top - 3: top - 4, top - 4: top - 4}


def test_components(spark):
    rng = random.Random(7)
    edges = [(k, k + 1) for k in range(30)] + [(100, 100 + k) for k in range(1, 40)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(45)]
    edges += [(5, 5), (300, 300), (7, 6), (None, 3)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: top(x) for x in parent}


# ------------------------------------------------------------------ 9

def test_matrix_has_exact_margins():
    sizes = sharding.shard_sizes(103, 8)
    drawn = sharding.communication_matrix([40, 0, 63], sizes, 1)
    assert drawn.sum(axis=0).tolist() == sizes.tolist() and drawn.sum(axis=1).tolist() == [40, 0, 63]
    assert sizes.max() - sizes.min() <= 1 and sizes.sum() == 103


def test_matrix_of_a_trillion_rows_has_exact_margins():
    counts, sizes = [250_000_000_000, 300_000_000_007, 449_999_999_990, 3], sharding.shard_sizes(10**12, 16)
    matrix = sharding.communication_matrix(counts, sizes, 5)
    assert (matrix >= 0).all() and matrix.sum(axis=1).tolist() == counts and (matrix.sum(axis=0) == sizes).all()
    expected = np.outer(counts, sizes / 10**12)
    assert (np.abs(matrix - expected) <= 7 * np.sqrt(expected) + 3).all() and (matrix[:3] != expected[:3].round()).any()


def test_large_draws_follow_the_law(monkeypatch):
    """The inversion, used for small totals too, against exact probabilities."""
    from math import comb

    monkeypatch.setattr(sharding, "NUMPY_TOTAL", 0)
    rng = np.random.default_rng(8)
    for good, bad, sample in ((7, 5, 6), (30, 70, 20), (2, 90, 60), (50, 3, 40)):
        n = 20_000
        seen = Counter(sharding.hypergeometric(rng, good, bad, sample) for _ in range(n))
        for x in range(max(0, sample - bad), min(sample, good) + 1):
            p = comb(good, x) * comb(bad, sample - x) / comb(good + bad, sample)
            assert abs(seen[x] / n - p) <= 5 * (p * (1 - p) / n) ** 0.5 + 1e-4, (good, bad, sample, x)


def test_rows_of_one_id_part(spark):
    rows = [(None if k % 2 else 7, f"text {k}") for k in range(4_000)]
    out = sharding.shuffle_into_shards(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", 4, rows_per_partition=100)
    found = out.collect()
    assert Counter(r["shard"] for r in found) == {k: 1_000 for k in range(4)}
    assert sorted(r["text"] for r in found) == sorted(t for _, t in rows)
    assert all(sorted(r["slot"] for r in found if r["shard"] == k) == list(range(1_000)) for k in range(4))


def test_shards(spark, docs, none, rows):
    got = sharding.document_shards(docs).collect()
    assert len(got) == len(rows)
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    sizes = [len(by_shard[k]) for k in range(16)]
    assert max(sizes) - min(sizes) <= 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sharding.document_shards(none).count() == 0
    out = sharding.shuffle_into_shards(docs, "doc_id", 4, rows_per_partition=5)
    assert set(out.columns) == set(docs.columns) and out.groupBy("shard").count().agg(F.max("count") - F.min("count")).first()[0] <= 1


def test_the_shuffle_is_uniform(spark):
    """Over many seeds every row is in every shard about equally often."""
    counts = np.zeros((24, 4))
    df = spark.range(24).coalesce(1)
    for seed in range(25):
        for r in sharding.shuffle_into_shards(df, "id", 4, seed, rows_per_partition=8).collect():
            counts[r["id"], r["shard"]] += 1
    expected = counts.sum() / counts.size
    assert ((counts - expected) ** 2 / expected).sum() < 130  # 69 degrees of freedom


# ------------------------------------------------------------------ 10

def plain_quality(text: str | None) -> tuple:
    text = text or ""
    words = words_of(text)
    lines, seen, dup = [x for x in text.split("\n") if words_of(x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = Counter(tuple(words[k:k + 8]) for k in range(len(words) - 7))
    gone = set()
    for k in range(len(words) - 7):
        if windows[tuple(words[k:k + 8])] > 1:
            gone.update(range(k, k + 8))
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(gone), n < 20 or 100 * len(gone) > 30 * n)


def test_quality(spark, docs, none, rows):
    texts = rows + [(500, "a b\n\na b\n a b\n#$ x|y\n" * 9), (501, " ".join(f"q{k}" for k in range(30)))]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(10, 30)] + [(10, 0, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = quality_llr.quality_verdicts(df, labels, buckets=256).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter((r["doc_id"], *(r[c] for c in names)) for r in got) == Counter((i, *plain_quality(t)) for i, t in texts)
    assert all(r["kept"] == (not r["base_failed"] and r["llr"] >= r["llr_threshold"]) for r in got)
    assert quality_llr.quality_verdicts(docs, labels.limit(0)).where("llr <> 0 OR llr_threshold <> 0").count() == 0
    assert quality_llr.quality_verdicts(none, labels).count() == 0
    assert quality_llr.judged(docs, labels, buckets=256).columns == [*docs.columns, "_quality"]


def test_weights_stand_in_no_plan(spark, docs):
    """The driver keeps plans and texts of them for every query and update, so none may hold the weights or a sieve."""
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id bigint, quality int, toxic int")
    plan = quality_llr.judged(docs, labels)._jdf.queryExecution().toString()
    assert len(plan) < 200_000


def test_scores_equal_the_formula(spark):
    """Weights and scores by hand, with the same bucket hash computed in plain Python."""
    import xxhash

    texts = [(k, " ".join(random.Random(k).choices("a b c d e f".split(), k=12))) for k in range(12)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    trusted = spark.createDataFrame([(k, True) for k in range(4)], "doc_id bigint, _ql_fit boolean")
    n = 16

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    def grams(t):
        h = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in t.split()]
        two = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), seed=xxhash.xxh64_intdigest(a.to_bytes(8, "little"), seed=42)) for a, b in itertools.pairwise(h)]
        return [signed(x) & (n - 1) for x in h + two]

    raw = Counter(g for _, t in texts for g in grams(t))
    target = Counter(g for k, t in texts if k < 4 for g in grams(t))

    def share(c, g):
        return np.log((c[g] + quality_llr.SMOOTHING) / (sum(c.values()) + quality_llr.SMOOTHING * n))

    want = [share(target, g) - share(raw, g) for g in range(n)]
    assert np.allclose(quality_llr.bucket_weights(df, trusted, n).first()["weights"], want)


def test_words_with_punctuation_are_looked_up_whole_when_seen_again():
    from pairlens.llm.tokens import PieceEncoder

    enc = PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"), byte_level=True, max_entries=5)
    for text in ("a house, a house, a mouse. x9; x9;", "the house, the mouse. mouse. house"):
        assert enc.encode(text) == enc._whole(text)
    assert "house," in enc.words and "x9;" not in enc.words and len(enc.words) <= 5


def test_best_cuts_take_windows_of_a_power_of_two():
    rng = random.Random(3)
    for _ in range(40):
        positions = [0, *sorted(rng.sample(range(1, 400), 60))]
        penalties = [rng.choice((0, 4, 64)) for _ in positions]
        if max(b - a for a, b in itertools.pairwise(positions)) > 128:
            continue
        best = [0] + [None] * 60
        for j in range(1, 61):
            best[j] = penalties[j] + min(best[i] + (0 if n in (64, 128) else 128 - n) for i in range(j)
                                         if (n := positions[j] - positions[i]) <= 128)
        at, cost = 0, 0
        for j in packing.best_cuts(positions, penalties, 128):
            n = positions[j] - positions[at]
            cost, at = cost + penalties[j] + (0 if n in (64, 128) else 128 - n), j
        assert at == 60 and cost == best[60]


def test_window_hashes_are_equal_where_windows_are(spark):
    """Hashes of windows of any size are joined from shorter ones: no window is hashed element by element."""
    rng = random.Random(5)
    rows = [(i, [rng.randrange(3) for _ in range(n)]) for i, n in enumerate([0, 1, 2, 7, 8, 9, 40, 90])]
    df = spark.createDataFrame(rows, "i int, h array<bigint>")
    for window in (2, 3, 5, 8):
        for r in df.select("h", quality_llr.window_hashes(F.col("h"), window).alias("w")).collect():
            windows = [tuple(r["h"][k:k + window]) for k in range(len(r["h"]) - window + 1)]
            assert len(r["w"]) == len(windows)
            assert len(set(zip(windows, r["w"], strict=True))) == len(set(windows)) == len(set(r["w"]))
