"""License scan with a positional index of rare words.

Templates are short licence notices. Their words' document frequencies are counted over the whole corpus; every
template is indexed under its ``RARE`` rarest words with their positions. A file's occurrences of such words are
looked up and each names a place where the template would begin; places named by several words at consistent
relative positions are kept, the template is laid over the file there, and its mandatory phrases must stand in place.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RARE = 4
MIN_ANCHORS = 2
MIN_SHARE = 0.8

# Phrase and label; every place of a phrase counts.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
# Label, notice, mandatory phrases.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files", ("free of charge", "associated documentation files")),
    ("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license",
     ("apache license version 2", "except in compliance with the license")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
     "the following conditions are met", ("source and binary forms", "following conditions are met")),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
     "public license as published by the free software foundation", ("gnu general public license",)),
    ("gpl", "licensed under the gnu general public license", ("gnu general public license",)),
    ("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    ("mpl-2", "licensed under the mozilla public license version 2 0", ("mozilla public license version 2 0",)),
    ("bsd", "licensed under the bsd license", ("the bsd license",)),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser "
     "general public license", ("gnu lesser general public license",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     ("with or without fee is hereby granted",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license",
     ("creative commons attribution 4 0",)),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license",
     ("attribution sharealike 4 0",)),
    ("proprietary", "all rights reserved no part of this publication may be reproduced", ("all rights reserved", "no part of this publication")),
)
FOUND = ("doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
         "labels string, score double, places array<struct<label:string,start:bigint,n_words:int,share:double>>")


class Template:
    def __init__(self, label: str, text: str, mandatory: tuple[str, ...], base: bool):
        self.label, self.words, self.base = label, text.split(), base
        self.mandatory = []
        for phrase in mandatory:
            words = phrase.split()
            at = next(i for i in range(len(self.words)) if self.words[i:i + len(words)] == words)
            self.mandatory.append((at, words))


def templates() -> list[Template]:
    return ([Template(label, phrase, (phrase,), True) for phrase, label in PHRASES]
            + [Template(label, text, mandatory, False) for label, text, mandatory in NOTICES])


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").encode().lower().decode())


def rare_index(found: list[Template], frequency: dict[str, int], n_docs: int, rare: int = RARE) -> dict[str, list[tuple[int, int]]]:
    """Word to (template, position) of each template's ``rare`` words of the highest IDF; ties by word."""
    index: dict[str, list[tuple[int, int]]] = {}
    for k, t in enumerate(found):
        idf = {w: math.log((n_docs + 1) / (frequency.get(w, 0) + 1)) for w in set(t.words)}
        chosen = set(sorted(idf, key=lambda w: (-idf[w], w))[:rare])
        for at, w in enumerate(t.words):
            if w in chosen:
                index.setdefault(w, []).append((k, at))
    return index


def scan(words: list[str], found: list[Template], index: dict[str, list[tuple[int, int]]]) -> list[tuple[Template, int, float]]:
    """(template, place, share of its words that stand there) of all verified places."""
    anchors = set(index).intersection(words)
    if not anchors:
        return []
    votes: Counter = Counter()
    for at, w in enumerate(words):
        if w in anchors:
            votes.update((k, at - rel) for k, rel in index[w])
    out = []
    for (k, start), n in sorted(votes.items()):
        t = found[k]
        if start < 0 or n < MIN_ANCHORS:
            continue
        if all(words[start + a:start + a + len(p)] == p for a, p in t.mandatory):
            share = sum(x == y for x, y in zip(words[start:], t.words, strict=False)) / len(t.words)
            if share >= MIN_SHARE:
                out.append((t, start, share))
    return out


def word_frequencies(docs: DataFrame, vocabulary: set[str]) -> tuple[dict[str, int], int]:
    """Documents that hold each word of the (small) vocabulary, and documents in all."""
    def count(batches) -> Iterator:
        import pyarrow as pa

        total: Counter = Counter()
        for batch in batches:
            for text in batch.column("text"):
                total.update(vocabulary.intersection(words_of(text.as_py())))
                total[""] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counted = {r["word"]: r["n"] for r in rows}
    return counted, counted.pop("", 0)


def license_scan(docs: DataFrame) -> DataFrame:
    """``FOUND``, one row per document row; ``places`` are all verified places of phrases and notices.

    n_base, first_word, last_word and base_labels follow the exact phrases alone; first_word and last_word are null
    without one. labels add the notices; score is the largest share of a notice's or phrase's words in place, 0
    without any. A null text counts as empty. Repeated rows and null ids are kept; other columns are ignored.
    """
    known = templates()
    frequency, n_docs = word_frequencies(docs, {w for t in known for w in t.words})
    index = rare_index(known, frequency, n_docs)

    def look(batches) -> Iterator:
        import pyarrow as pa

        kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()] + [pa.list_(pa.struct(
            [("label", pa.string()), ("start", pa.int64()), ("n_words", pa.int32()), ("share", pa.float64())]))]
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"]
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = words_of(text.as_py())
                places = scan(words, known, index)
                base = [(t.label, start) for t, start, _ in places if t.base]
                starts = [s for _, s in base]
                rows.append((doc, len(words), len(base), min(starts, default=None), max(starts, default=None),
                             ",".join(sorted({x for x, _ in base})), ",".join(sorted({t.label for t, _, _ in places})),
                             max((share for _, _, share in places), default=0.0),
                             [{"label": t.label, "start": s, "n_words": len(t.words), "share": share} for t, s, share in places]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(look, FOUND)
