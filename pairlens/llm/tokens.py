"""Token ids of whole texts, with the tokenizer called once per unseen piece.

Both tokenizers split a text into pieces (words, numbers, punctuation) and merge inside pieces only, so the
ids of a text are the ids of its pieces in order. Pieces and blank-separated chunks are looked up in bounded
tables that live as long as the Python worker; what is missing goes to the tokenizer's merge model. Texts outside
the plain range (control characters, code points from U+0250 on, special token strings) are encoded whole.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np

# Below U+0250: letters, numbers and white space, written out because ``re`` has no Unicode categories.
_L = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_N = "0-9²³¹¼-¾"
_S = "\t\n\r  "
_SPECIAL_CASES = "'s|'t|'re|'ve|'m|'ll|'d|"
_ODD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9fİɐ-\U0010ffff]")
_BYTE_PIECES = re.compile(f"{_SPECIAL_CASES} ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_WORD_PIECES = re.compile(f"{_SPECIAL_CASES}[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
_BLANKS_MEET = ("  ", " \n", "\n ", " \t", "\t ", " \r", "\r ", "  ", "  ")
MAX_ENTRIES = 600_000


def _byte_letters() -> dict[int, int]:
    """The printable stand-in of each byte in byte-level vocabularies: bytes that print stand for themselves, the others
    for the code points from 256 on, in order."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(prints)]
    return {b: b for b in prints} | {b: 256 + k for k, b in enumerate(rest)}


_LETTERS = _byte_letters()


def _bytes_of(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class PieceEncoder:
    """Ids as little-endian unsigned 32-bit bytes. ``byte_level``: pieces keep the blank before them and case
    counts; otherwise white space is dropped and case is folded."""

    def __init__(self, path: str, byte_level: bool, max_entries: int = MAX_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.byte_level, self.max_entries = byte_level, max_entries
        self.blank = " " if byte_level else ""
        self.split = _BYTE_PIECES.findall if byte_level else _WORD_PIECES.findall
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}  # between blanks, with their punctuation if seen before

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _merged(self, piece: str) -> bytes:
        letters = piece if piece.isalpha() and piece.isascii() else piece.encode().decode("latin-1").translate(_LETTERS)
        return _bytes_of([t.id for t in self.model.tokenize(letters)])

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self._merged(piece)
            if len(self.pieces) < self.max_entries:
                self.pieces[piece] = ids
        return ids

    def _word(self, word: str) -> bytes:
        """A word of letters, with its blank."""
        ids = self.words.get(word)
        if ids is None:
            ids = self._merged(self.blank + word)
            if len(self.words) < self.max_entries:
                self.words[word] = ids
        return ids

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isalpha():
            return self._word(chunk)
        word = chunk[:-1]
        if word.isalpha() and chunk[-1] in ".,!?;:":
            seen = word in self.words
            ids = self._word(word) + self._piece(chunk[-1])
            if seen and len(self.words) < self.max_entries:  # words seen once leave the room to others
                self.words[chunk] = ids
            return ids
        return b"".join(map(self._piece, self.split(self.blank + chunk)))

    def _chunked(self, chunks: list[str]) -> bytes:
        out = list(map(self.words.get, chunks))
        k = 0
        try:
            while True:
                k = out.index(None, k)
                out[k] = self._chunk(chunks[k])
        except ValueError:
            return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text; of a null text none."""
        if not text:
            return b""
        if _ODD.search(text) or ("<|" in text and any(s in text.lower() for s in self.special)):
            return self._whole(text)
        if not self.byte_level:
            return self._chunked(text.lower().split())
        if text[0] == " " or text[-1] == " " or any(b in text for b in _BLANKS_MEET):
            return b"".join(map(self._piece, self.split(text)))
        first, _, rest = text.partition(" ")
        head = b"".join(map(self._piece, self.split(first)))
        return head + self._chunked(rest.split(" ")) if rest else head


_ENCODERS: dict[tuple[str, bool], PieceEncoder] = {}


def encoder(path: str, byte_level: bool) -> PieceEncoder:
    """The worker's encoder for this vocabulary file."""
    key = (path, byte_level)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(path, byte_level)
    return _ENCODERS[key]
