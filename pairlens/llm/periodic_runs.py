"""Runs of words with a period, found by a sparse programme over lag diagonals, and texts without their later periods.

A run of period q is a diagonal at lag q: words that equal the word q places before. Reading a text from left to right,
every word looks up its nearest earlier occurrence that goes on equally for a whole window of words; that occurrence
activates its lag, or adds one to the length of the match on that lag's diagonal if the word before did the same. A
diagonal whose next word does not add to it has ended; if its match is long enough, the run is emitted there and then.

Windows make the diagonals sparse without losing any. A run of period q and length >= max(24, 3 q) matches
max(24 - q, 2 q) words on its diagonal, so for q <= 16 every word of it goes on equally for 16 words, and for
q in (W / 2, W] for W words. A window of W >= q words that lies in the run with its copy q places before has no nearer
copy inside the run (two periods p < q over p + W words would give the run the period gcd(p, q) < q), so each word of the
diagonal finds lag q and nothing else: diagonals of multiples of the smallest period never come up, lengths are exact,
and one lookup a word and scale (16, 32, 64, ...) is all there is. Only texts that repeat a window go to the next scale.

Memory and time: a task holds a chunk of texts (half a megabyte, or one longer text); n words cost n log n a scale.
Windows are compared by 64-bit codes made by doubling (a chance of about 2^-64 a pair).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.functions.columns import bind
from pairlens.llm.postings import slices
from pairlens.llm.quality_llr import word_array
from pairlens.llm.textcodes import chunks, mix, word_codes

MIN_LENGTH = 24
MIN_PERIODS = 3
RUN = "struct<start:bigint,length:bigint,period:bigint>"
_HALF = np.uint64(0x9E3779B97F4A7C15)


def _doubled(codes: np.ndarray, width: int) -> np.ndarray:
    """From codes of ``width`` words, those of twice as many."""
    return mix(codes[:-width] * _HALF + mix(codes[width:] ^ _HALF)) if len(codes) > width else codes[:0]


def _lags(windows: np.ndarray, width: int, doc: np.ndarray) -> np.ndarray:
    """Of each window that lies in one text, the way back to its nearest earlier copy in that text; else 0."""
    lag = np.zeros(len(doc), dtype=np.int64)
    inside = np.flatnonzero(doc[:len(doc) - width + 1] == doc[width - 1:]) if len(doc) >= width else lag[:0]
    key = mix(windows[inside] + doc[inside].astype(np.uint64) * _HALF)
    order = np.argsort(key, kind="stable")
    ranked, at = key[order], inside[order]
    copy = np.flatnonzero(ranked[1:] == ranked[:-1]) + 1
    lag[at[copy]] = at[copy] - at[copy - 1]
    return lag


def _diagonals(lag: np.ndarray, width: int, least_lag: int, min_length: int, min_periods: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of the diagonals at lags ``least_lag`` to ``width`` that end long enough."""
    at = np.flatnonzero((lag >= least_lag) & (lag <= width))
    if not len(at):
        return
    q = lag[at]
    begin = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (q[1:] != q[:-1])]))
    period = q[begin]
    match = np.diff(np.append(begin, len(at))) + width - 1
    long = match + period >= np.maximum(min_length, min_periods * period)
    yield from zip((at[begin] - period)[long].tolist(), (match + period)[long].tolist(), period[long].tolist(), strict=True)


def find_runs(codes: np.ndarray, begin: np.ndarray, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> list[list[tuple[int, int, int]]]:
    """Per text the (start, length, period) of its runs, by start, then period. ``begin``: where each text's words begin in
    ``codes``, and the end. ``min_length`` is 24 or more, ``min_periods`` 3 or more."""
    if min_length < 24 or min_periods < 3:
        raise ValueError("windows of 16 words are in every run only from 24 words and 3 periods on")
    size = np.diff(begin)
    found: list[list[tuple[int, int, int]]] = [[] for _ in size]
    doc, place, width = np.repeat(np.arange(len(size)), size), np.arange(len(codes)), 1
    windows = codes
    while width < 16:
        windows, width = _doubled(windows, width), 2 * width
    least = 1
    while len(windows):
        lag = _lags(windows, width, doc)
        for start, length, period in _diagonals(lag, width, least, min_length, min_periods):
            d = doc[start]
            found[d].append((int(place[start] - begin[d]), length, period))
        repeats = np.zeros(len(size), dtype=bool)
        repeats[doc[lag > 0]] = True
        stay = (repeats & (size >= min_periods * (width + 1)))[doc]  # lags of the next scale are above this width
        windows = np.concatenate([windows, np.zeros(len(doc) - len(windows), np.uint64)])[stay]
        doc, place = doc[stay], place[stay]
        windows, least, width = _doubled(windows, width), width + 1, 2 * width
        # A window that reaches into the next text has a code without meaning; ``_lags`` leaves it out.
    return [sorted(runs) for runs in found]


def collapsed_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """``words`` without those that a run has after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]


def _collapse(min_length: int, min_periods: int):
    def run(batches) -> Iterator:
        import pyarrow as pa

        def array(values, kind=None):
            return pa.array(values, kind or pa.int64())

        for batch in slices(batches):
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            counts, runs, kept = [], [], []
            for a, b in chunks(texts):
                codes, begin = word_codes(texts[a:b])
                counts.extend(np.diff(begin).tolist())
                for text, own in zip(texts[a:b], find_runs(codes, begin, min_length, min_periods), strict=True):
                    runs.append(own)
                    kept.append(b" ".join(collapsed_words(text.split(), own)))
            flat = [r for own in runs for r in own]
            columns = list(zip(*flat, strict=True)) or [(), (), ()]
            structs = pa.StructArray.from_arrays([array(c) for c in columns], ["start", "length", "period"])
            offsets = array(np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), array(counts), pa.ListArray.from_arrays(offsets, structs), array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"])

    return run


def collapse_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> DataFrame:
    """Per document row: doc_id, n_words, runs (array of start, length, period, by start, then period) and collapsed, the
    words that no run has after its first period, joined by blanks.

    Words stand between ASCII white space. A run is a stretch of at least ``min_length`` words and ``min_periods`` smallest
    periods that no neighbouring word extends with that period. Runs may overlap. A null text has no words, no runs and
    an empty ``collapsed``; rows with a null or repeated doc_id are treated one by one; other columns are ignored; an empty
    table gives no rows. Nothing is shuffled.
    """
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        _collapse(min_length, min_periods), f"doc_id bigint, n_words bigint, runs array<{RUN}>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where texts of documents whose crc32(doc_id) ends in 0 repeat a stretch of their words up to the end:
    with g the crc without its last digit, each word i >= a = g % n becomes word a + (i - a) % p, p = 1 + (n - a) div (3 + g % 8).
    A null doc_id has no crc; its text stays."""
    crc = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(crc / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        return bind(F.struct((g % n).cast("int").alias("a"), n.alias("n")), lambda s: bind(
            F.struct(s["a"].alias("a"), (F.floor((s["n"] - s["a"]) / (g % 8 + 3)) + 1).cast("int").alias("p")),
            lambda x: F.array_join(F.transform(words, lambda w, i: F.when(i < x["a"], w).otherwise(
                F.get(words, x["a"] + (i - x["a"]) % x["p"]))), " ")))

    text = F.when(crc % 10 == 0, bind(word_array(F.col("text")), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(
        F.col("text")))).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


def run_digests(collapsed: DataFrame) -> DataFrame:
    """Of ``collapse_runs``' rows: doc_id, n_runs, the run of most periods (ties: smallest start, then period), hashes."""
    runs = F.col("runs")
    best = F.aggregate(runs, F.try_element_at(runs, F.lit(1)), lambda a, x: F.when(
        x["length"].cast("decimal(19,0)") * a["period"] > a["length"].cast("decimal(19,0)") * x["period"], x).otherwise(a))
    lines = F.array_join(F.transform(runs, lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    digests = collapsed.select(
        "doc_id", F.size(runs).cast("bigint").alias("n_runs"), best.alias("_best"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return digests.select(
        "doc_id", "n_runs", "_best.start", "_best.length", "_best.period",
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
