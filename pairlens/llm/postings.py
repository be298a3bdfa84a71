"""Postings packed by ranges of their codes: how operators send many small facts through a shuffle.

A row holds what one batch has for one fragment of the code order: a table of owners (documents or classes), and of
each posting the number of its owner and its code. Codes of a fragment meet in one task, so a fragment's size is
chosen by its postings; rows are as many as batches times fragments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOB = "classes binary, owners binary, codes binary"
SLICE = 2_000  # rows a map task unpacks at once


def small_batches(spark, rows: int = SLICE) -> None:
    """Texts are long, so the session sends fewer rows at once to Python than it does by default."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def slices(batches, rows: int = SLICE) -> Iterator:
    """The record batches in smaller ones, so that memory doesn't follow the session's batch size."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def fragment_of(codes: np.ndarray, fragments: int) -> np.ndarray:
    return (((codes >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)).astype(np.int64)


def record_batch(columns: dict):
    kinds = {"block": pa.int32()}
    return pa.RecordBatch.from_arrays(
        [pa.array(v, kinds.get(k, pa.binary() if v and isinstance(v[0], bytes) else pa.int64())) for k, v in columns.items()], list(columns))


def cut(codes: np.ndarray, owner: np.ndarray, fragments: int, first: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(fragment, codes, owners) of the fragments below ``first``."""
    part = fragment_of(codes, fragments)
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(first + 1))
    for k in np.flatnonzero(np.diff(edges)):
        at = order[edges[k]:edges[k + 1]]
        yield int(k), codes[at], owner[at]


def owner_bytes(local: np.ndarray, owners: int) -> bytes:
    return local.astype("<u4" if owners > 65535 else "<u2").tobytes()


def joined(table, kind: np.dtype, code: str, *keys: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct owners of a fragment's rows, and of each posting the owner and the code."""
    owners, local, codes, base = [], [], [], 0
    for a, b, c in zip(*(table.column(x).to_pylist() for x in ("classes", "owners", "codes")), strict=True):
        found, values = np.frombuffer(a, dtype=kind), np.frombuffer(c, dtype=code)
        local.append(np.frombuffer(b, dtype="<u2" if len(b) == 2 * len(values) else "<u4").astype(np.int32) + np.int32(base))
        owners.append(found)
        codes.append(values)
        base += len(found)
    distinct, index = np.unique(np.concatenate(owners), return_inverse=True)
    return distinct, index.astype(np.int32)[np.concatenate(local)], np.concatenate(codes)
