"""64-bit codes of words and of word windows for many texts at once, with numpy.

A word's code is a polynomial over its bytes (random byte values, modulo 2^64), mixed with its length; a window's
code is a polynomial over its words' codes, mixed again. Equal words and windows have equal codes; different
ones collide with a chance of about 2^-64 a pair. Codes depend on the text alone and are the same in every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SPACES = b" \t\n\x0b\x0c\r"
#: What a pass keeps in memory at once: about 40 times this many bytes.
CHUNK_BYTES = 500_000

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_R, _Q = (np.uint64(int(x) | 1) for x in _rng.integers(0, 1 << 63, 2, dtype=np.uint64))
_R_INV, _Q_INV = (np.uint64(pow(int(x), -1, 1 << 64)) for x in (_R, _Q))
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n-1)."""
    known = _POWERS.get(int(base))
    if known is None or len(known) < n:
        size = max(n, 4096)
        known = np.full(size, base, dtype=np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        _POWERS[int(base)] = known
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of at most ``limit`` bytes together, or of one longer text."""
    begin = size = 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def separators(letters_only: bool) -> np.ndarray:
    """By byte: it parts words. White space, or every ASCII character but letters and digits."""
    table = np.zeros(256, dtype=bool)
    if letters_only:
        table[:128] = [not chr(b).isalnum() for b in range(128)]
    else:
        table[list(SPACES)] = True
    return table


SPACE_TABLE, LETTER_TABLE = separators(False), separators(True)


def word_codes(texts: list[bytes], table: np.ndarray = SPACE_TABLE) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words of all texts in order, and where each text's words begin (one more entry at the end)."""
    raw = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    parts = table[raw]
    edge = np.flatnonzero(parts[1:] != parts[:-1]) + 1
    if not parts[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]  # the last byte is a separator, so every word ends
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * _powers(_R, len(raw)), out=total[1:])
    codes = (total[ends] - total[starts]) * _powers(_R_INV, len(raw))[starts]
    codes = mix(codes + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return codes, np.searchsorted(starts, offsets)


def window_codes(codes: np.ndarray, n: int) -> np.ndarray:
    """Code of the ``n`` words from each word on (of the whole sequence, across texts); shorter tails have none."""
    if len(codes) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * _powers(_Q, len(codes)), out=total[1:])
    return mix((total[n:] - total[:-n]) * _powers(_Q_INV, len(codes))[:len(codes) - n + 1] + np.uint64(n))


def sequence_code(codes: np.ndarray) -> np.ndarray:
    """One code for a whole sequence of words, as an array of one."""
    return window_codes(codes, len(codes))
