"""Personal data by weak supervision.

Four exact patterns give the base spans. They and wider patterns (bracketed addresses, national numbers, grouped
digits, IPv6) propose candidates, on which five labelers vote yes, no or nothing: the pattern's own check, a gazetteer
(mail domains, country and card prefixes, reserved networks), cue words in front, the shape of the digits, and
the digits around. Vote patterns are counted over the whole corpus; expectation maximisation over these counts (at
most kinds x 3^5) estimates how reliable each labeler is; the posteriors train a logistic span classifier on
features of the span, and candidates it takes for personal data are added to the base spans.

Two passes read the texts, one to count and one to find; nothing but counts is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "gazetteer", "context", "shape", "neighbours")
CONTEXT = 48
EM_ROUNDS = 50
STRENGTH = 1.0  # pseudo-counts that hold a labeler's rates near its prior

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_AT = r"[\[({] ?(?:at|AT|At) ?[\])}]"
_BRACKETED_AT = re.compile(_AT)  # what every match of the next one holds
_BRACKETED = re.compile(r"([A-Za-z0-9._%+-]{1,64}) ?" + _AT + r" ?([A-Za-z0-9-]+(?: ?(?:\.|[\[({] ?(?:dot|DOT|Dot) ?[\])}]) ?[A-Za-z0-9-]+)+)")
_NATIONAL = re.compile(r"(?<![0-9A-Za-z.+-])\(?[0-9]{2,5}\)?(?:[ ./-][0-9]{2,5}){1,4}(?![0-9A-Za-z])")
_IPV6 = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_DIGIT = re.compile("[0-9]")
_WORD = re.compile(r"[a-z]+")

# Gazetteers and cue words.
DOMAINS = frozenset("com org net edu gov io info biz de fr es it uk nl pl eu ch at be us ca example test".split())
COUNTRY_CODES = tuple("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 351 352 353 358 420".split())
CARD_PREFIXES = tuple("4 34 37 51 52 53 54 55 60 62 65".split())
CUES = {
    "email": frozenset("email mail e contact write reach address courriel correo kontakt".split()),
    "ip": frozenset("ip host server address login client from addr adresse".split()),
    "card": frozenset("card visa mastercard credit payment pay amex carte karte tarjeta number".split()),
    "phone": frozenset("phone tel telephone call mobile cell fax contact ring telefon telefono appel".split()),
}
AGAINST = frozenset("version v isbn issn order invoice sku id ref figure fig table section page pages chapter year years build release".split())


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards: the name before it must not reach into the match before."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = floor + len(text[floor:at].rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            floor = domain.end()
        else:
            floor = at + 1
        at = text.find("@", floor)


def _ips(text: str) -> Iterator[tuple[int, int, bool]]:
    """Each four parts in turn of every run of dotted numbers, and whether all are at most 255."""
    for run in _DOTTED.finditer(text):
        parts = run.group().split(".")
        at = run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            end = at + sum(map(len, four)) + 3
            yield at, end, all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four)
            at = end + 1


def candidates(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int, bool]]]:
    """Base spans, and all candidates with whether they are base; both by kind as listed, then by start."""
    base, more = [], []
    if "@" in text:
        base += [("email", a, b) for a, b in _emails(text)]
    if _BRACKETED_AT.search(text):
        more += [("email", m.start(), m.end()) for m in _BRACKETED.finditer(text)]
    if _DIGIT.search(text):
        for a, b, ok in _ips(text):
            (base if ok else more).append(("ip", a, b))
        for m in _CARD.finditer(text):
            n = len(d := _digits(m.group()))
            if 16 <= n <= 19 and luhn(d):
                base.append(("card", *m.span()))
            elif 13 <= n <= 19 and n < m.end() - m.start():
                more.append(("card", *m.span()))
        if "+" in text:
            base += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
        more += [("phone", *m.span()) for m in _NATIONAL.finditer(text) if 8 <= len(_digits(m.group())) <= 13]
        if ":" in text:
            more += [("ip", *m.span()) for m in _IPV6.finditer(text)]
    taken = _Taken(base)
    free = [c for c in more if not taken.overlaps(c[1], c[2])]
    ranked = sorted({*((k, a, b, True) for k, a, b in base), *((k, a, b, False) for k, a, b in free)},
                    key=lambda c: (KINDS.index(c[0]), c[1], c[2]))
    return sorted(base, key=lambda c: (KINDS.index(c[0]), c[1])), ranked


class _Taken:
    """Whether a range overlaps any of the given spans."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        ordered = sorted((a, b) for _, a, b in spans)
        self.starts = [a for a, _ in ordered]
        self.reach = list(accumulate((b for _, b in ordered), max))  # the furthest end so far

    def overlaps(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b)
        return k > 0 and self.reach[k - 1] > a


def judge(text: str, kind: str, a: int, b: int, base: bool) -> tuple[str, tuple[int, ...]]:
    """Votes of the labelers (``+``, ``-``, ``0``) and the features of the final classifier."""
    span, digits = text[a:b], _digits(text[a:b])
    before = _WORD.findall(text[max(0, a - CONTEXT):a].lower())[-5:]
    cue, against = any(w in CUES[kind] for w in before), any(w in AGAINST for w in before)
    around = len(_digits(text[max(0, a - 16):a] + text[b:b + 16]))
    if kind == "email":
        tld = re.split(r"[^A-Za-z0-9-]+", span.rstrip("])}"))[-1].lower()
        gazetteer = 1 if tld in DOMAINS else -1 if tld.isdigit() else 0
        shape = -1 if ".." in span else 1 if re.match("[A-Za-z]", span) else 0
    elif kind == "ip":
        first = span.split(".")[0]
        gazetteer = -1 if first in ("0", "00", "000") or ":" not in span and len(digits) <= 4 else 1 if base else 0
        shape = 1 if ":" in span or base and len(digits) >= 7 else -1
    elif kind == "card":
        gazetteer = 1 if digits.startswith(CARD_PREFIXES) else -1
        groups = [len(g) for g in re.split("[ -]", span)]
        shape = -1 if len(set(digits)) <= 2 else 1 if len(groups) == 1 or set(groups[:-1]) <= {4, 6} else -1
    else:
        gazetteer = 1 if span[0] == "+" and digits.startswith(COUNTRY_CODES) else 1 if span[0] == "(" or digits[0] == "0" else 0 if span[0] == "+" else -1
        shape = -1 if len(set(digits)) <= 2 or len(set(re.sub("[0-9]", "", span.strip("+(")))) > 3 else 1
    pattern = 1 if base else -1 if kind in ("ip", "card") and ":" not in span else 0
    votes = (pattern, gazetteer, 1 if cue else -1 if against else 0, shape, -1 if around > 8 else 0)
    features = (KINDS.index(kind), int(base), min(len(digits), 20) // 4, min(b - a, 40) // 8, int(cue), int(against), gazetteer + 1, int(around > 4))
    return "".join("-0+"[v + 1] for v in votes), features


class SpanModel:
    """Reliabilities from EM, and the classifier trained on its posteriors."""

    def __init__(self, counts: dict[tuple[str, tuple[int, ...]], int]):
        self.prior, self.rates = {}, {}
        posterior: dict[tuple[int, str], float] = {}
        for k in range(len(KINDS)):
            votes = Counter()
            for (v, f), n in counts.items():
                if f[0] == k:
                    votes[v] += n
            if votes:
                posterior |= {(k, v): p for v, p in self._estimate(k, votes).items()}
        rows = sorted(counts.items())
        x = np.array([self.vector(f) for (_, f), _ in rows]).reshape(len(rows), self.width())
        y = np.array([posterior[f[0], v] for (v, f), _ in rows])
        self.weights = self._fit(x, y, np.array([n for _, n in rows], dtype=float))

    def _estimate(self, kind: int, votes: Counter) -> dict[str, float]:
        """Two classes, votes independent given the class; the prior of each labeler is 80 % right."""
        seen = sorted(votes)
        n = np.array([votes[v] for v in seen], dtype=float)
        index = np.array([["-0+".index(c) for c in v] for v in seen])
        start = np.array([[0.5, 0.3, 0.2], [0.1, 0.3, 0.6]])
        rate = np.repeat(start[:, None, :], len(LABELERS), axis=1)
        share = 0.5
        for _ in range(EM_ROUNDS):
            like = np.log(rate[:, np.arange(len(LABELERS)), index]).sum(axis=2)
            odds = like[1] - like[0] + np.log(share / (1 - share))
            post = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
            share = float(np.clip((n * post).sum() / n.sum(), 0.01, 0.99))
            for c, p in ((0, 1 - post), (1, post)):
                for j in range(len(LABELERS)):
                    got = np.bincount(index[:, j], weights=n * p, minlength=3) + STRENGTH * 3 * start[c]
                    rate[c, j] = got / got.sum()
        self.prior[KINDS[kind]], self.rates[KINDS[kind]] = share, rate
        return dict(zip(seen, post.tolist(), strict=True))

    @staticmethod
    def width() -> int:
        return 1 + len(KINDS) + len(KINDS) * 2 + 6 + 6 + 3 + 3

    def vector(self, f: tuple[int, ...]) -> list[float]:
        kind, base, digits, length, cue, against, gazetteer, around = f

        def one(k: int, n: int) -> list[float]:
            return [float(i == k) for i in range(n)]

        return [1.0, *one(kind, len(KINDS)), *one(kind * 2 + base, len(KINDS) * 2), *one(digits, 6), *one(length, 6),
                *one(gazetteer, 3), float(cue), float(against), float(around)]

    def _fit(self, x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0) -> np.ndarray:
        """Newton steps of a ridge logistic regression on soft labels; rows weigh by their (log) number."""
        w, weight = np.zeros(self.width()), np.log1p(n)
        for _ in range(30 if len(x) else 0):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient = x.T @ (weight * (y - p)) - ridge * w
            hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
            w = w + np.linalg.solve(hessian, gradient)
        return w

    def takes(self, f: tuple[int, ...]) -> bool:
        return float(np.dot(self.weights, self.vector(f))) >= 0.0


def train(docs: DataFrame) -> SpanModel:
    """Count (votes, features) of all candidates of all texts, then fit on the counts."""
    def count(batches) -> Iterator:
        import pyarrow as pa

        total: Counter = Counter()
        for batch in batches:
            for text in batch.column("text"):
                text = text.as_py() or ""
                for kind, a, b, base in candidates(text)[1]:
                    votes, features = judge(text, kind, a, b, base)
                    total[votes, ",".join(map(str, features))] += 1
        if total:
            votes, features = zip(*total, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(votes), pa.array(features), pa.array(list(total.values()), pa.int64())], ["votes", "features", "n"])

    rows = (docs.select("text").mapInArrow(count, "votes string, features string, n bigint")
            .groupBy("votes", "features").agg(F.sum("n").alias("n")).collect())  # bounded by votes x features
    return SpanModel({(r["votes"], tuple(map(int, r["features"].split(",")))): r["n"] for r in rows})


def find_spans(text: str | None, takes) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans: base ones and the candidates that the classifier takes, none over another of its kind."""
    base, ranked = candidates(text or "")
    spans, end, kind = [], -1, None
    taken = _Taken(base)
    for k, a, b, is_base in ranked:
        end = -1 if k != kind else end
        kind = k
        if is_base or a >= end and not taken.overlaps(a, b) and takes(judge(text, k, a, b, False)[1]):
            spans.append((k, a, b))
            end = max(end, b)
    return base, spans


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


class _Taker:
    def __init__(self, model: SpanModel):
        self.model, self.known = model, {}

    def __call__(self, f: tuple[int, ...]) -> bool:
        if f not in self.known:
            self.known[f] = self.model.takes(f)
        return self.known[f]


SPANS = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"


def personal_spans(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """``SPANS``, one row per document row: base counts and digest, all spans, and how many the method added.

    Offsets are code points, the end is exclusive. A null text counts as empty; repeated rows and null ids are kept;
    other columns are ignored. An empty table gives no rows (and an untrained model, which adds nothing).
    """
    model = model or train(docs)

    def find(batches) -> Iterator:
        import pyarrow as pa

        takes = _Taker(model)
        kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]
        names = [c.split()[0] for c in SPANS.split(", ")]
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                base, spans = find_spans(text.as_py(), takes)
                n = Counter(k for k, _, _ in base)
                rows.append((doc, *(n[k] for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), len(spans) - len(base)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(find, SPANS)


def redacted(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in brackets; overlapping spans become one, under the
    first one's kind. Null texts stay null, and all other columns stay as they are."""
    model = model or train(docs)
    return docs.withColumn("text", F.pandas_udf(_redactor(model), "string")(F.col("text")))


def redact(text: str | None, takes) -> str | None:
    if not text:
        return text
    out, at = [], 0
    for kind, a, b in sorted(find_spans(text, takes)[1], key=lambda s: (s[1], s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def _redactor(model: SpanModel):
    def run(texts: pd.Series) -> pd.Series:
        takes = _Taker(model)
        return pd.Series([redact(t, takes) for t in texts], dtype=object)

    return run
