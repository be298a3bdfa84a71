"""Packing of documents into token windows by order-preserving dynamic programming.

Documents are laid end to end in the order of their rows. A window may be cut at a document's end, after a
sentence, or (only inside a sentence that is longer than a window) at multiples of the window length. With
positions p, the cheapest way to end a window at cut j is

    best[j] = penalty[j] + min over i of (best[i] + padding(p[j] - p[i])),  p[j] - p[i] <= window

where padding is window - length, so the minimum of best[i] + p[i] over the sliding range of i serves all j: a
monotone queue gives it in constant time. Windows whose length is a power of two need no padding and are
tried beside it. The penalty is 0 at a document's end, ``SENTENCE_PENALTY`` after a sentence and
``BREAK_PENALTY`` inside one, in tokens.

Rows of a partition are packed in runs of about ``RUN`` tokens, so a task holds one run and one document.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

WINDOW = 1_024
SENTENCE_PENALTY = 4
BREAK_PENALTY = 64
RUN = 2_000_000
SMALLEST_POWER = 64
PIECES = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
          "offset bigint, sequence_tokens bigint, ids binary")


def best_cuts(positions: list[int], penalties: list[int], window: int = WINDOW) -> list[int]:
    """Indexes of the cuts taken, from ``positions`` (ascending, the first is 0); neighbours are at most ``window`` apart."""
    n = len(positions)
    best, back = [0] * n, [0] * n
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (best + position, index), ascending in both
    powers, p = [], SMALLEST_POWER
    while p < window:
        powers.append(p)
        p *= 2
    places, near = np.asarray(positions), {}  # of a cut, those that a power of two lies between
    for p in powers:
        k = np.searchsorted(places, places - p)
        ends = np.flatnonzero(places[k] == places - p)
        for j, i in zip(ends.tolist(), k[ends].tolist(), strict=True):
            near.setdefault(j, []).append(i)
    for j in range(1, n):
        at = positions[j]
        while positions[queue[0][1]] < at - window:
            queue.popleft()
        cost, i = queue[0]
        cost += window - at
        for k in near.get(j, ()):
            if best[k] < cost:
                cost, i = best[k], k
        cost += penalties[j]
        best[j], back[j] = cost, i
        key = cost + at
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    cuts, j = [], n - 1
    while j:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


def cut_positions(ids: np.ndarray, doc_ends: np.ndarray, ends_sentence: np.ndarray, window: int = WINDOW,
                  sentence_penalty: int = SENTENCE_PENALTY, break_penalty: int = BREAK_PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end (the first is 0) and their penalties."""
    sentences = np.flatnonzero(ends_sentence[ids]) + 1
    natural = np.unique(np.concatenate([[0], sentences, doc_ends]))
    gaps = np.diff(natural)
    extra = [np.arange(natural[k] + window, natural[k + 1], window) for k in np.flatnonzero(gaps > window)]
    positions = np.unique(np.concatenate([natural, *extra]))
    penalty = np.full(len(positions), sentence_penalty, dtype=np.int64)
    if extra:
        penalty[np.searchsorted(positions, np.concatenate(extra))] = break_penalty
    penalty[np.searchsorted(positions, doc_ends)] = 0
    return positions, penalty


def sentence_table(tokenizer) -> np.ndarray:
    """By id: the token has a full stop, question or exclamation mark or a line break (as byte-level pieces write them)."""
    size = tokenizer.get_vocab_size()
    table = np.zeros(size + 1, dtype=bool)
    for token, k in tokenizer.get_vocab().items():
        table[k] = any(c in token for c in ".!?\nĊ")
    return table


def pack_run(doc_ids: list, parts: list[bytes], ends_sentence: np.ndarray, window: int = WINDOW) -> list[tuple]:
    """(doc_id, start, length, crc, doc_tokens, sequence from 0, offset, sequence length, ids) of all pieces of a run."""
    raw = b"".join(parts)
    lengths = np.array([len(p) // 4 for p in parts], dtype=np.int64)
    ends = np.cumsum(lengths)
    positions, penalties = cut_positions(np.frombuffer(raw, dtype="<u4"), ends, ends_sentence, window)
    positions = positions.tolist()
    cuts = [positions[j] for j in best_cuts(positions, penalties.tolist(), window)]
    ends, out, begin = ends.tolist(), [], 0
    for number, end in enumerate(cuts):
        at = begin
        while at < end:
            d = bisect_left(ends, at + 1)
            stop = min(end, ends[d])
            piece = raw[4 * at:4 * stop]
            n = len(parts[d]) // 4
            out.append((doc_ids[d], at - (ends[d] - n), stop - at, zlib.crc32(piece), n, number, at - begin, end - begin, piece))
            at = stop
        begin = end
    return out


def pack_documents(docs: DataFrame, vocabulary: str, byte_level: bool = True, end_id: int = 0, window: int = WINDOW,
                   run: int = RUN, with_ids: bool = True) -> DataFrame:
    """One row per piece: ``PIECES`` (``ids`` as little-endian u32 bytes, null unless ``with_ids``).

    Every document gets ``end_id`` behind its ids; a null text is empty and packs as that id alone. Rows with null
    or repeated doc_ids are documents of their own. Other columns are ignored; an empty table gives no rows.
    Sequence ids are the task's number times 2^40 plus a running number in the task: unique, not dense.
    """
    def pack(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        from pairlens.llm.tokens import encoder

        enc, end = encoder(vocabulary, byte_level), np.array([end_id], dtype="<u4").tobytes()
        ends_sentence = sentence_table(enc.tokenizer)
        sequence = TaskContext.get().partitionId() << 40
        kinds = [pa.int64()] * 8 + [pa.binary()]
        names = [c.split()[0] for c in PIECES.split(", ")]
        doc_ids, parts, size = [], [], 0

        def packed():
            nonlocal sequence
            rows = list(zip(*pack_run(doc_ids, parts, ends_sentence, window), strict=True))
            rows[5] = [sequence + s for s in rows[5]]
            sequence = rows[5][-1] + 1
            if not with_ids:
                rows[8] = [None] * len(rows[8])
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows, kinds, strict=True)], names)

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = enc.encode(text.as_py()) + end
                doc_ids.append(doc)
                parts.append(ids)
                size += len(ids)
                if size >= 4 * run:
                    yield packed()
                    doc_ids, parts, size = [], [], 0
        if doc_ids:
            yield packed()

    from pyspark.sql import functions as F

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(pack, PIECES)
