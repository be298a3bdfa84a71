"""Benchmark decontamination by spaced seeds.

Fixed masks pick some positions of a run of words and ignore the others, so a substituted word spoils only the
masks that look at it. Seeds of the benchmark items are indexed, seeds of every document position are looked up,
and each hit fixes an alignment (item, shift) along which the words are compared: a document leaks an item if
some ``SPAN`` neighbouring words of the item (all of them, if it has fewer) stand in the document with at most
20 % of them replaced. An item of fewer than ``MIN_WORDS`` words has one seed, of all its words, and leaks where they stand
unchanged.

The benchmark side goes to the tasks in blocks of at most ``MAX_SEEDS`` seeds; a larger benchmark takes more
passes, each over all documents. Documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.llm.textcodes import LETTER_TABLE, chunks, mix, word_codes

# Looked-at positions are 1. Whatever words are replaced within MIN_SHARE, in a run of SPAN words or in a
# whole item of MIN_WORDS words or more, one of these fits between them (a test tries all cases).
MASKS = ("11011", "110011", "11101", "10111")
SPAN = 13
MIN_SHARE = 0.8
MIN_WORDS = 6
MAX_SEEDS = 1_000_000
_FILTER_BITS = 22
_WEIGHTS = np.random.default_rng(77).integers(0, 1 << 63, 32, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LEAKS = ("doc_id bigint, item_id bigint, doc_word bigint, item_word bigint, n_words bigint, n_equal bigint, n_seeds bigint")


def masks_of(n_words: int) -> tuple[str, ...]:
    """The masks whose seeds an item is looked up by."""
    return MASKS if n_words >= MIN_WORDS else ("1" * n_words,) if n_words else ()


def seeds(codes: np.ndarray, mask: str) -> np.ndarray:
    """Seed of ``mask`` at every position where it fits."""
    n = len(codes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for k, on in enumerate(mask):
        if on == "1":
            total += codes[k:k + n] * _WEIGHTS[k]
    return mix(total + np.uint64(int(mask, 2)))


class SeedIndex:
    """Seeds of a block of items, sorted, with a bit filter in front."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.ids = [i for i, _ in items]
        codes, begin = word_codes([t for _, t in items], LETTER_TABLE)
        self.words = [codes[a:b] for a, b in zip(begin[:-1], begin[1:], strict=True)]
        found = [(s, np.full(len(s), k), np.arange(len(s))) for k, w in enumerate(self.words)
                 for s in (seeds(w, m) for m in masks_of(len(w)))]
        self.whole = sorted({m for w in self.words for m in masks_of(len(w)) if m not in MASKS})
        seed, item, at = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), *[np.zeros(0, int)] * 2)
        order = np.argsort(seed, kind="stable")
        self.seed, self.item, self.at = seed[order], item[order], at[order]
        self.filter = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.filter[self.seed & np.uint64((1 << _FILTER_BITS) - 1)] = True

    def hits(self, codes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions in ``codes``, items and item positions of all equal seeds; of a short item's the first in each text
        (texts start at ``begin``), so that a frequent word yields no more rows than leaks."""
        out = []
        for m in (*MASKS, *self.whole):
            s = seeds(codes, m)
            at = np.flatnonzero(self.filter[s & np.uint64((1 << _FILTER_BITS) - 1)])
            low = np.searchsorted(self.seed, s[at], "left")
            count = np.searchsorted(self.seed, s[at], "right") - low
            at, low, count = at[count > 0], low[count > 0], count[count > 0]
            if m not in MASKS:
                doc = np.searchsorted(begin, at, "right") - 1
                inside = at + len(m) <= begin[doc + 1]
                first = np.flatnonzero(inside)[np.unique(np.stack([doc, low])[:, inside], axis=1, return_index=True)[1]]
                at, low, count = at[first], low[first], count[first]
            entry = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            out.append((np.repeat(at, count), self.item[entry], self.at[entry]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def compare(doc: np.ndarray, item: np.ndarray, shift: int, span: int = SPAN, min_share: float = MIN_SHARE):
    """Best run of ``span`` item words on this alignment, widened to all words compared: (equal in the run,
    run length, first item word of it), or None below the share."""
    a, b = max(0, -shift), min(len(item), len(doc) - shift)
    need = min(span, len(item))
    if b - a < need:
        return None
    equal = np.concatenate([[0], np.cumsum(doc[a + shift:b + shift] == item[a:b])])
    runs = equal[need:] - equal[:-need]
    k = int(np.argmax(runs))
    return (int(runs[k]), need, a + k) if runs[k] >= min_share * need else None


def leaks(docs: DataFrame, benchmark: DataFrame, max_seeds: int = MAX_SEEDS) -> DataFrame:
    """``LEAKS``: one row per document row and benchmark item it leaks; the best run of words on its best alignment.

    Words are runs of ASCII letters and digits and of all other characters, ASCII case aside. Null texts
    have no words. Items of fewer than ``MIN_WORDS`` words leak where all of them stand unchanged, at their first place; items
    without words leak nothing; items of equal texts are each named. Repeated document rows give a row each. Other columns are ignored; an empty side gives no rows.
    """
    docs, found = docs.select(F.col("doc_id").cast("bigint"), "text"), None
    for shared in _index_blocks(benchmark, max_seeds):
        part = docs.mapInArrow(_finder(shared), LEAKS)
        found = part if found is None else found.unionByName(part)
    return found


def _index_blocks(benchmark: DataFrame, max_seeds: int) -> Iterator:
    """Broadcast seed indexes that together hold all items, each of about ``max_seeds`` seeds at most."""
    items = benchmark.select(F.col("item_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # a word and its separator take two bytes at least
    blocks = max(1, -(-len(MASKS) * int(size) // (2 * max_seeds)))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        ordered = sorted(((r["item_id"], r["text"].encode().lower()) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        yield benchmark.sparkSession.sparkContext.broadcast(SeedIndex(ordered))


def leak_free(docs: DataFrame, benchmark: DataFrame, max_seeds: int = MAX_SEEDS) -> DataFrame:
    """The rows of ``docs``, all columns, that leak no item. Rows are judged where they are, without a shuffle."""
    for shared in _index_blocks(benchmark, max_seeds):
        docs = docs.where(F.pandas_udf(_clean(shared), "boolean")(F.col("text")))
    return docs


def _clean(shared):
    def run(texts: pd.Series) -> pd.Series:
        raw = [(t or "").encode().lower() for t in texts]
        dirty = {d for d, *_ in _found(shared.value, raw)}
        return pd.Series([d not in dirty for d in range(len(raw))], dtype=bool)

    return run


def _found(index: SeedIndex, texts: list[bytes]) -> Iterator[tuple[int, int, int, int, int, int, int]]:
    """(text, item, first word in the text, first word in the item, words, equal words, seeds) of each leak."""
    for a, b in chunks(texts):
        codes, begin = word_codes(texts[a:b], LETTER_TABLE)
        at, item, item_at = index.hits(codes, begin)
        doc = np.searchsorted(begin, at, "right") - 1
        if not len(at):
            continue
        rows, count = np.unique(np.stack([doc, item, at - begin[doc] - item_at], axis=1), axis=0, return_counts=True)
        best: dict[tuple[int, int], tuple] = {}
        for (d, i, shift), n in zip(rows.tolist(), count.tolist(), strict=True):
            got = compare(codes[begin[d]:begin[d + 1]], index.words[i], shift)
            if got and got[0] > best.get((d, i), (-1,))[0]:
                best[d, i] = (got[0], shift + got[2], got[2], got[1], n)
        for (d, i), (equal, first, item_first, need, n) in best.items():
            yield a + d, index.ids[i], first, item_first, need, equal, n


def _finder(shared):
    def find(batches) -> Iterator:
        import pyarrow as pa

        names = [c.split()[0] for c in LEAKS.split(", ")]
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            texts = [(t.as_py() or "").encode().lower() for t in batch.column("text")]
            out = [(doc_ids[d], *rest) for d, *rest in _found(shared.value, texts)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)

    return find
