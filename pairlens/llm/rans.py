"""Token-id files in a static range asymmetric numeral system.

A segment holds up to a few million ids of consecutive documents. It carries one frequency table that all its
blocks share, and every block (a run of ``BLOCK`` ids) is coded on its own, so blocks decode in any order and
in parallel: each has a checkpoint (state and position in the word stream) and a CRC-32 of its ids. Blocks
are coded in lockstep, one vector operation for the same position of all of them.

States are 64-bit in [2^31, 2^63), renormalised by 32-bit words; frequencies sum to 2^20. Layout of a segment,
all little-endian: magic ``PRS1``; documents, ids, symbols, words (u64); doc ids (i64), null marks (u8) and lengths
(u64) of the documents; symbols (u32) and frequencies (u32); block states (u64), word positions (u64), checksums
(u32); words (u32).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAGIC = b"PRS1"
BLOCK = 1_024
SEGMENT = 2_000_000
SCALE_BITS = 20
LOW = np.uint64(1 << 31)
CONTAINER = "first_doc bigint, segment bigint, n_docs bigint, n_tokens bigint, payload binary"
DECODED = "first_doc bigint, segment bigint, doc_id bigint, offset bigint, n_tokens bigint, ids_crc32 bigint, ids binary"


def frequencies(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Integer frequencies of at least 1 that sum to 2^bits, in proportion to ``counts``."""
    scaled = np.maximum(1, counts.astype(np.float64) * (1 << bits) / counts.sum()).astype(np.int64)
    excess, order, k = int(scaled.sum()) - (1 << bits), np.argsort(-scaled, kind="stable"), 0
    if excess < 0:
        scaled[order[0]] -= excess
    while excess > 0:
        cut = min(excess, int(scaled[order[k]]) - 1 if k else int(scaled[order[0]]) // 2)
        scaled[order[k]] -= cut
        excess, k = excess - cut, k + 1
    return scaled


def encode_blocks(symbols: np.ndarray, freq: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """States, word positions and words of all blocks of ``symbols`` (indexes into ``freq``)."""
    lanes = -(-len(symbols) // block)
    cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    freq = freq.astype(np.uint64)
    padded = np.zeros(lanes * block, dtype=np.int64)
    padded[:len(symbols)] = symbols
    grid = np.ascontiguousarray(padded.reshape(lanes, block).T)
    last = len(symbols) - (lanes - 1) * block
    state = np.full(lanes, LOW, dtype=np.uint64)
    written = np.zeros((lanes, block), dtype=np.uint32)
    at = np.zeros(lanes, dtype=np.int64)
    bits, word = np.uint64(SCALE_BITS), np.uint64(32)
    for t in range(block - 1, -1, -1):
        n = lanes if t < last else lanes - 1
        if not n:
            continue
        s = grid[t, :n]
        f, x = freq[s], state[:n]
        full = np.flatnonzero(x >= (f << np.uint64(63 - SCALE_BITS)))
        written[full, at[full]] = (x[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        at[full] += 1
        x[full] >>= word
        q = x // f
        state[:n] = (q << bits) + (x - q * f) + cum[s]
    keep = np.arange(block) < at[:, None]
    return state, np.concatenate([[0], np.cumsum(at)[:-1]]).astype(np.uint64), written[keep]


def decode_blocks(n: int, freq: np.ndarray, state: np.ndarray, position: np.ndarray, words: np.ndarray,
                  block: int = BLOCK) -> np.ndarray:
    """The symbols again; words of a block are read backwards from the next block's position."""
    lanes = len(state)
    cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    slots = np.repeat(np.arange(len(freq), dtype=np.int32), freq.astype(np.int64))
    freq = freq.astype(np.uint64)
    ends = np.append(position[1:], len(words)).astype(np.int64)
    state = state.copy()
    words = np.append(words, np.uint32(0)).astype(np.uint64)
    out = np.zeros((block, lanes), dtype=np.int32)
    last = n - (lanes - 1) * block
    mask, bits, word = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS), np.uint64(32)
    for t in range(block):
        k = lanes if t < last else lanes - 1
        if not k:
            break
        x = state[:k]
        slot = x & mask
        s = slots[slot.astype(np.int64)]
        out[t, :k] = s
        x = freq[s] * (x >> bits) + slot - cum[s]
        low = np.flatnonzero(x < LOW)
        ends[low] -= 1
        x[low] = (x[low] << word) | words[ends[low]]
        state[:k] = x
    return out.T.reshape(-1)[:n]


def _checksums(ids: np.ndarray, block: int = BLOCK) -> np.ndarray:
    raw = memoryview(ids.astype("<u4").tobytes())
    return np.array([zlib.crc32(raw[a:a + 4 * block]) for a in range(0, len(raw), 4 * block)], dtype="<u4")


def pack_segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """Documents of one segment as bytes; ``ids`` are all their ids in order, at least one."""
    symbols, index, counts = np.unique(ids, return_inverse=True, return_counts=True)
    freq = frequencies(counts)
    state, position, words = encode_blocks(index, freq)
    parts = (
        np.array([len(doc_ids), len(ids), len(symbols), len(words)], dtype="<u8"),
        np.array([0 if d is None else d for d in doc_ids], dtype="<i8"), np.array([d is None for d in doc_ids], dtype="u1"),
        np.array(lengths, dtype="<u8"), symbols.astype("<u4"), freq.astype("<u4"),
        state.astype("<u8"), position.astype("<u8"), _checksums(ids), words.astype("<u4"))
    return MAGIC + b"".join(p.tobytes() for p in parts)


def unpack_segment(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc ids, lengths and ids; raises if the magic or a block's checksum is wrong."""
    if payload[:4] != MAGIC:
        raise ValueError("not a token segment")
    at = 4

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(payload, dtype=kind, count=n, offset=at)
        at += got.nbytes
        return got

    docs, n, distinct, n_words = (int(x) for x in take("<u8", 4))
    doc_ids, null, lengths = take("<i8", docs), take("u1", docs), take("<u8", docs)
    symbols, freq = take("<u4", distinct), take("<u4", distinct)
    blocks = -(-n // BLOCK)
    state, position, sums, words = take("<u8", blocks), take("<u8", blocks), take("<u4", blocks), take("<u4", n_words)
    ids = symbols[decode_blocks(n, freq, state, position, words)]
    wrong = np.flatnonzero(_checksums(ids) != sums)
    if len(wrong):
        raise ValueError(f"{len(wrong)} blocks fail their checksum, the first is {wrong[0]}")
    return [None if m else int(d) for d, m in zip(doc_ids, null, strict=True)], lengths.astype(np.int64), ids


def write_token_files(docs: DataFrame, path: str, vocabulary: str, byte_level: bool, end_id: int,
                      segment: int = SEGMENT) -> None:
    """Encode every text, in ascending doc_id order (nulls first, then by text), into segments under ``path``.

    A null text is empty; every document ends with ``end_id``. Repeated rows are kept. Other columns are
    ignored; an empty table writes no segment. A segment is closed at the document that fills it, so a task
    holds one segment and one document beside it.
    """
    def encode(batches) -> Iterator:
        import pyarrow as pa

        from pairlens.llm.tokens import encoder

        enc, end = encoder(vocabulary, byte_level), np.array([end_id], dtype="<u4").tobytes()
        number, names, parts = 0, [], []
        size = 0

        def closed():
            row = ([names[0]], [number], [len(names)], [size // 4],
                   [pack_segment(names, [len(p) // 4 for p in parts], np.frombuffer(b"".join(parts), dtype="<u4"))])
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(row, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                ["first_doc", "segment", "n_docs", "n_tokens", "payload"])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = enc.encode(text.as_py()) + end
                names.append(doc)
                parts.append(ids)
                size += len(ids)
                if size >= 4 * segment:
                    yield closed()
                    number, names, parts, size = number + 1, [], [], 0
        if names:
            yield closed()

    ordered = (docs.select(F.col("doc_id").cast("bigint"), "text").repartitionByRange("doc_id")
               .sortWithinPartitions("doc_id", "text"))
    ordered.mapInArrow(encode, CONTAINER).write.parquet(path)


def read_token_files(spark, path: str) -> DataFrame:
    """Decode all segments: one row per document with its ids (little-endian u32 bytes), their crc32, its
    length and its offset in the segment."""
    def decode(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for first, number, payload in zip(*(batch.column(c).to_pylist() for c in ("first_doc", "segment", "payload")), strict=True):
                doc_ids, lengths, ids = unpack_segment(payload)
                starts = np.concatenate([[0], np.cumsum(lengths)])
                raw = ids.astype("<u4").tobytes()
                texts = [raw[4 * a:4 * b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([first] * n, pa.int64()), pa.array([number] * n, pa.int64()), pa.array(doc_ids, pa.int64()),
                     pa.array(starts[:-1], pa.int64()), pa.array(lengths, pa.int64()),
                     pa.array([zlib.crc32(x) for x in texts], pa.int64()), pa.array(texts, pa.binary())],
                    ["first_doc", "segment", "doc_id", "offset", "n_tokens", "ids_crc32", "ids"])

    return spark.read.schema(CONTAINER).parquet(path).select("first_doc", "segment", "payload").mapInArrow(decode, DECODED)


def segment_starts(spark, path: str) -> DataFrame:
    """first_doc, segment and ``before``: the ids in all earlier segments. One row per segment of millions of
    ids; ranges of doc ids don't overlap between tasks, so this order is the file order."""
    from pyspark.sql import Window

    order = Window.orderBy(F.col("first_doc").asc_nulls_first(), "segment").rowsBetween(Window.unboundedPreceding, -1)
    return (spark.read.schema(CONTAINER).parquet(path).select("first_doc", "segment", "n_tokens")
            .withColumn("before", F.coalesce(F.sum("n_tokens").over(order), F.lit(0))).drop("n_tokens"))


def document_token_digest(docs: DataFrame, path: str, vocabulary: str, byte_level: bool, end_id: int) -> DataFrame:
    """Write the files, read them back: doc_id, start, n_tokens, ids_crc32 per document."""
    spark = docs.sparkSession
    write_token_files(docs, path, vocabulary, byte_level, end_id)
    rows, starts = read_token_files(spark, path).drop("ids").alias("r"), segment_starts(spark, path).alias("s")
    same = F.col("r.first_doc").eqNullSafe(F.col("s.first_doc")) & (F.col("r.segment") == F.col("s.segment"))
    return rows.join(starts, same).select(
        "r.doc_id", (F.col("s.before") + F.col("r.offset")).alias("start"), "r.n_tokens", "r.ids_crc32")
