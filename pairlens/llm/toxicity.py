"""Toxicity of texts: a support vector machine over gapped letter subsequences, on Nyström landmarks.

Kernel. A window is a word's letters and digits between two edge marks (what stands between the letters of a word is left
out, so ``i-d-i-o-t`` is one window), or a run of three and more words of one letter (``i d i o t``). Two windows are alike by their
shared subsequences of ``ORDER`` letters that span at most ``SPAN`` letters; each occurrence weighs ``DECAY`` per letter left out. The
sum of products is divided by what each window would have with itself if all its subsequences differed, which depends on its
length alone. Inserted letters make subsequences longer, hence lighter, and leave most of them there.

Machine. ``LANDMARKS`` windows span the feature space (Nyström: kernel values with the landmarks times the inverse square root
of the landmarks' own kernel matrix); a linear machine with squared hinge loss is fitted there by Newton steps. Its decision is a
weighted sum of kernels with landmarks, which is one weight per subsequence: scoring adds up weights from a table of 64^3 numbers.

Training. Labels say of documents, not of sentences, whether they are toxic. A clean document's sentences are clean; of a toxic one at
least one sentence is toxic. Windows whose counts in toxic and clean documents differ by more than chance allows (log-likelihood ratio) start; then
training alternates: score the sentences of the training documents by their strongest window, label the strongest sentence of a toxic
document (and others on the machine's positive side) toxic and the strongest ones of clean documents clean, fit again on the
labelled sentences' windows. Positive windows also train with one letter inserted. ``score`` comes from a logistic curve over a
document's two strongest sentences, fitted on values that machines of one half give the other half.

Bounds. At most about ``MAX_LABELLED`` documents of each label train, chosen by a hash of the id; counts of their windows are
summed by Spark, and a few thousand windows come to the driver. Ids of training documents, the table and three numbers are
broadcast. Every document is scored, whole; nothing else is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.llm.postings import slices

ORDER = 3
SPAN = 7
DECAY = 0.6
LANDMARKS = 320
MAX_LABELLED = 4_000
ROUNDS = 3
KEPT_SENTENCES = 3
STARTERS = 300
START_G = 18.0
INSERTED = 2.0
FALSE_ALARMS, MISSES = 0.003, 0.05
LIFT = 5  # how much more common an insult is among toxic documents than among clean ones
CLEAN_WINDOWS = 1_500
CHUNK_CHARS = 400_000
EDGE, SIZE = 63, 64
FLOOR = -2.0  # the value of a sentence that isn't there


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the class of a letter or digit (1 to 62, case folded) or 0, and whether it is white space."""
    letter, space = np.zeros(0x110000, dtype=np.uint8), np.zeros(0x110000, dtype=bool)
    for c in range(0x10000):
        x = chr(c)
        space[c] = x.isspace()
        if x.isalnum():
            low = x.lower()[0]
            letter[c] = (ord(low) - 96 if "a" <= low <= "z" else ord(low) - 21 if "0" <= low <= "9" else 37 + ord(low) % 26)
    letter[0x10000:] = 37 + np.arange(0x10000, 0x110000) % 26
    return letter, space


_TABLES: list[tuple[np.ndarray, np.ndarray]] = []


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if not _TABLES:
        _TABLES.append(_classes())
    return _TABLES[0]


@dataclass
class Windows:
    """Windows of some texts: ``symbols`` of all, edge marks included, and of each window where it begins there, its text, its
    sentence (numbered over all texts) and its first and last code point in its text."""

    symbols: np.ndarray
    begin: np.ndarray
    text: np.ndarray
    sentence: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def keys(self) -> list[bytes]:
        """The letters of each window."""
        raw, end = self.symbols.tobytes(), np.append(self.begin[1:], len(self.symbols))
        return [raw[a + 1:b - 1] for a, b in zip(self.begin.tolist(), end.tolist(), strict=True)]


def windows_of(texts: list[str]) -> Windows:
    letter, space = _tables()
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    symbol, blank = letter[points], space[points]
    stop = (points == 46) | (points == 33) | (points == 63)
    sentence = np.cumsum((points == 10) | (blank & np.concatenate([[False], stop[:-1]])))
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    at = np.flatnonzero(symbol)
    if not len(at):
        none = np.zeros(0, dtype=np.int64)
        return Windows(np.zeros(0, np.uint8), none, none, none, none, none)
    word = np.cumsum(blank)[at]
    start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    count = np.diff(np.append(start, len(at)))
    text = np.searchsorted(begin, at[start], side="right") - 1
    follows = np.concatenate([[False], (count[1:] == 1) & (count[:-1] == 1) & (text[1:] == text[:-1])])
    # a word of one letter joins the one before if the run of such words has three or more
    run = np.cumsum(~follows)
    joins = follows & (np.bincount(run)[run] >= 3)
    start, text = start[~joins], text[~joins]
    length = np.diff(np.append(start, len(at)))
    window = np.repeat(np.arange(len(start)), length)
    symbols = np.full(len(at) + 2 * len(start), EDGE, dtype=np.uint8)
    symbols[np.arange(len(at)) + 2 * window + 1] = symbol[at]
    return Windows(symbols, start + 2 * np.arange(len(start)), text, sentence[at[start]], at[start] - begin[text],
                   at[np.append(start[1:], len(at)) - 1] - begin[text] + 1)


def norms(length: np.ndarray) -> np.ndarray:
    """What windows of this length (with edge marks) have with themselves if all their subsequences differ, as a root."""
    total = np.zeros(len(length))
    for d in range(ORDER - 1, SPAN):
        total += np.maximum(length - d, 0) * (d - 1) * DECAY ** (2 * (d - 2))
    return np.sqrt(np.maximum(total, 1.0))


def subsequences(symbols: np.ndarray, begin: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, float]]:
    """For each shape (letters i, i + e, i + d): the subsequences' codes, their places i, which lie in one window, their weight."""
    wide = symbols.astype(np.int32)
    owner = np.repeat(np.arange(len(begin), dtype=np.int32), np.diff(np.append(begin, len(symbols))))
    high = wide << 12
    for d in range(ORDER - 1, min(SPAN, len(symbols))):
        n = len(symbols) - d
        inside = owner[:n] == owner[d:]
        ends = high[:n] | wide[d:]
        for e in range(1, d):
            yield ends | wide[e:e + n] << 6, n, inside, DECAY ** (d - 2)


def decisions(windows: Windows, table: np.ndarray, bias: float) -> np.ndarray:
    """The machine's value of every window."""
    if not len(windows.begin):
        return np.zeros(0)
    total = np.zeros(len(windows.symbols), dtype=np.float32)
    for codes, n, inside, weight in subsequences(windows.symbols, windows.begin):
        total[:n] += np.where(inside, table[codes], np.float32(0)) * np.float32(weight)
    length = np.diff(np.append(windows.begin, len(windows.symbols)))
    return np.add.reduceat(total, windows.begin, dtype=np.float64) / norms(length) + bias


def features(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, subsequence, weight) of windows given by their letters, normalised."""
    edge = bytes([EDGE])
    symbols = np.frombuffer(b"".join(edge + k + edge for k in keys), dtype=np.uint8)
    length = np.array([len(k) + 2 for k in keys])
    begin = np.concatenate([[0], np.cumsum(length)[:-1]]).astype(np.int64)
    owner, scale = np.repeat(np.arange(len(keys)), length), 1 / norms(length)
    rows, cells, weights = [], [], []
    for codes, n, inside, weight in subsequences(symbols, begin):
        at = np.flatnonzero(inside)
        rows.append(owner[:n][at])
        cells.append(codes[at])
        weights.append(weight * scale[owner[:n][at]])
    return np.concatenate(rows), np.concatenate(cells), np.concatenate(weights)


def kernel(keys: list[bytes], landmarks: list[bytes]) -> np.ndarray:
    """Kernel values of windows (rows) and landmarks (columns)."""
    row, cell, weight = features(landmarks)
    used, local = np.unique(cell, return_inverse=True)
    dense = np.zeros((len(landmarks), len(used)))
    np.add.at(dense, (row, local), weight)
    out = np.zeros((len(keys), len(landmarks)))
    for a in range(0, len(keys), 512):
        row, cell, weight = features(keys[a:a + 512])
        place = np.minimum(np.searchsorted(used, cell), len(used) - 1)
        known = used[place] == cell
        mine = np.zeros((len(keys[a:a + 512]), len(used)))
        np.add.at(mine, (row[known], place[known]), weight[known])
        out[a:a + 512] = mine @ dense.T
    return out


@dataclass
class Machine:
    """Weights of subsequences and a bias; ``curve`` is slope and offset of the logistic curve."""

    table: np.ndarray = field(default_factory=lambda: np.zeros(SIZE ** ORDER, dtype=np.float32))
    bias: float = -1.0
    curve: tuple[float, ...] = ()


def _newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, reg: np.ndarray, gradient) -> np.ndarray:
    """Minimise sum of weight * loss(y, x w) + reg w^2 / 2; ``gradient`` gives first and second derivatives by the value."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        first, second = gradient(x @ w, y)
        step = np.linalg.solve((x * (weight * second)[:, None]).T @ x + np.diag(reg), x.T @ (weight * first) + reg * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_machine(positive: dict[bytes, float], negative: dict[bytes, float], landmarks: list[bytes], reg: float = 3e-4) -> Machine:
    """A machine from windows with weights; both sides count the same in all."""
    keys = [*positive, *negative]
    y = np.array([1.0] * len(positive) + [-1.0] * len(negative))
    weight = np.concatenate([np.array([*side.values()]) / sum(side.values()) / 2 for side in (positive, negative)])
    values, vectors = np.linalg.eigh(kernel(landmarks, landmarks))
    strong = values > 1e-6 * values[-1]
    root = vectors[:, strong] / np.sqrt(values[strong])
    x = np.hstack([kernel(keys, landmarks) @ root, np.ones((len(keys), 1))])

    def hinge(v, y):
        active = y * v < 1
        return np.where(active, 2 * (v - y), 0.0), np.where(active, 2.0, 1e-9)

    w = _newton(x, y, weight, np.append(np.full(x.shape[1] - 1, reg), 1e-9), hinge)
    row, cell, own = features(landmarks)
    table = np.zeros(SIZE ** ORDER)
    np.add.at(table, cell, (root @ w[:-1])[row] * own)
    return Machine(table.astype(np.float32), float(w[-1]))


def strength(evidence: np.ndarray) -> np.ndarray:
    """A soft maximum of a document's two strongest sentences, see ``_evidence``."""
    return np.log(np.exp(2 * evidence[:, 0]) + np.exp(2 * evidence[:, 1])) / 2


def fit_curve(evidence: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve over ``strength``.

    Toxic documents without a sentence on the machine's positive side (wrong labels, or insults that the other half doesn't
    have) don't say where the curve rises and are left out, if others are there. Where all but a few documents of both labels
    lie apart (``FALSE_ALARMS`` of the clean, ``MISSES`` of the toxic ones), the middle moves down to a third of the gap: changed
    insults are weaker than those of the labels. Targets are drawn in a little from 0 and 1.
    """
    v = strength(evidence)
    told = ~toxic | (v > 0)
    if toxic[told].any():
        v, toxic, weight = v[told], toxic[told], weight[told]
    target = np.where(toxic, 1 - 1 / (toxic.sum() + 2), 1 / ((~toxic).sum() + 2))

    def logistic(z, y):
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return p - y, p * (1 - p) + 1e-9

    slope, offset = _newton(np.stack([v, np.ones(len(v))], axis=1), target, weight / weight.mean(), np.array([1e-2, 1e-6]), logistic)
    clean, low = np.quantile(v[~toxic], 1 - FALSE_ALARMS), np.quantile(v[toxic], MISSES)
    if slope > 0 and clean < low:
        offset = -slope * min(-offset / slope, clean + (low - clean) / 3)
    return float(slope), float(offset)


def inserted(key: bytes) -> list[bytes]:
    """A window with one other letter at each inner place; the letter follows from window and place."""
    return [key[:i] + bytes([1 + (sum(key) + 7 * i) % 26]) + key[i:] for i in range(1, len(key))]


def _sentences(windows: Windows, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The strongest window of each sentence, by text, then falling value; and the rank of its sentence in its text."""
    order = np.lexsort((np.arange(len(values)), -values, windows.sentence))
    s = windows.sentence[order]
    best = order[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else order
    best = best[np.lexsort((best, -values[best], windows.text[best]))]
    text = windows.text[best]
    edge = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(text) else text
    return best, np.arange(len(best)) - np.repeat(edge, np.diff(np.append(edge, len(best))))


def _scored(texts: list[str], machine: Machine) -> Iterator[tuple[Windows, np.ndarray, int]]:
    """Windows and values of chunks of texts, and the chunk's first text."""
    begin = size = 0
    for i, t in enumerate([*texts, None]):
        if t is None or (i > begin and size + len(t) > CHUNK_CHARS):
            if i > begin:
                windows = windows_of(texts[begin:i])
                yield windows, decisions(windows, machine.table, machine.bias), begin
            begin, size = i, 0
        size += len(t or "")


def _evidence(windows: Windows, values: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: the values of its two strongest sentences; its strongest window or -1."""
    best, rank = _sentences(windows, values)
    out, strongest = np.full((texts, 2), FLOOR), np.full(texts, -1, dtype=np.int64)
    for k in range(2):
        at = best[rank == k]
        out[windows.text[at], k] = np.maximum(values[at], FLOOR)
        if k == 0:
            strongest[windows.text[at]] = at
    return out, strongest


def _plain(batch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def _window_counts(batches) -> Iterator[pa.RecordBatch]:
    """Windows of each batch with the numbers of toxic and clean documents that have them."""
    for batch in slices(batches):
        toxic = np.array(batch.column("toxic").to_pylist(), dtype=np.int64)
        counts: dict[bytes, list[int]] = {}
        for windows, _, begin in _scored(_plain(batch), Machine()):
            for text, key in set(zip(windows.text.tolist(), windows.keys(), strict=True)):
                counts.setdefault(key, [0, 0])[toxic[begin + text]] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array([c[1] for c in counts.values()], pa.int64()),
             pa.array([c[0] for c in counts.values()], pa.int64())], ["key", "toxic", "clean"])


def _strongest_sentences(machine):
    """Of each training document the strongest windows of its strongest sentences."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            toxic, rows = batch.column("toxic").to_pylist(), []
            for windows, values, begin in _scored(_plain(batch), machine.value):
                best, rank = _sentences(windows, values)
                keys = windows.keys()
                for w, k in zip(best.tolist(), rank.tolist(), strict=True):
                    if k < KEPT_SENTENCES:
                        rows.append((toxic[begin + windows.text[w]], k, keys[w], float(values[w])))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                columns, (pa.int64(), pa.int32(), pa.binary(), pa.float64()), strict=True)], ["toxic", "rank", "key", "value"])

    return run


def _document_evidence(machine):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = _plain(batch)
            found = [np.zeros((0, 2))]
            for windows, values, begin in _scored(texts, machine.value):
                found.append(_evidence(windows, values, _chunk_texts(texts, begin))[0])
            x = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *[pa.array(x[:, k]) for k in range(2)]], ["toxic", "v0", "v1"])

    return run


def _chunk_texts(texts: list[str], begin: int) -> int:
    """How many texts the chunk that begins here has, as in ``_scored``."""
    size = 0
    for i in range(begin, len(texts)):
        if i > begin and size + len(texts[i]) > CHUNK_CHARS:
            return i - begin
        size += len(texts[i])
    return len(texts) - begin


def training_documents(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[DataFrame, float]:
    """Documents that train (text, toxic 0 or 1, half 0 or 1), about ``max_labelled`` of each label by a hash of the id, and what
    share of the toxic ones' chance to be chosen the clean ones have. Held-out ids never train; an id with several labels is
    toxic if any says so."""
    known = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~is_held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").cast("bigint").alias("toxic")).where("toxic in (0, 1)"))
    count = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = {k: min(1.0, max_labelled / max(1, count.get(k, 0))) for k in (0, 1)}
    draw = F.pmod(F.xxhash64(F.lit(21), "doc_id"), F.lit(1_000_000))
    chosen = known.where(draw < F.when(F.col("toxic") == 1, int(share[1] * 1_000_000)).otherwise(int(share[0] * 1_000_000)))
    chosen = chosen.withColumn("half", F.pmod(F.xxhash64(F.lit(22), "doc_id"), F.lit(2)))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic", "half"), share[0] / share[1]


def _starters(train: DataFrame) -> tuple[dict[bytes, float], dict[bytes, float], float]:
    """Windows that toxic documents have more often than chance allows, some of clean documents (the most common, and others by
    a hash), and how many toxic documents come on a clean one."""
    total = train.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"), F.count("*").alias("n")).first()
    toxic, clean = total["toxic"], total["n"] - total["toxic"]
    counts = (train.select("text", "toxic").mapInArrow(_window_counts, "key binary, toxic bigint, clean bigint")
              .groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).persist())
    every, has = toxic + clean, F.col("toxic") + F.col("clean")

    def term(seen, share, side: int):
        return F.when(seen > 0, seen * F.log(seen * every / (share * side))).otherwise(0.0)

    g = 2 * (term(F.col("toxic"), has, toxic) + term(F.col("clean"), has, clean)
             + term(toxic - F.col("toxic"), every - has, toxic) + term(clean - F.col("clean"), every - has, clean))
    common = F.col("toxic") * clean > LIFT * F.col("clean") * toxic
    found = counts.withColumn("g", g).where((F.col("g") >= START_G) & (F.col("toxic") > 1) & common)
    first = found.orderBy(F.desc("g"), "key").limit(STARTERS).collect()
    other = counts.where("clean > 0")
    rows = (other.orderBy(F.desc("clean"), "key").limit(CLEAN_WINDOWS // 3).collect()
            + other.orderBy(F.xxhash64("key"), "key").limit(CLEAN_WINDOWS).collect())
    counts.unpersist()
    positive = {bytes(r["key"]): float(r["toxic"]) for r in first}
    return positive, {bytes(r["key"]): 1.0 for r in rows if bytes(r["key"]) not in positive}, toxic / max(1, clean)


def _with_inserted(positive: dict[bytes, float]) -> dict[bytes, float]:
    """Positive windows, and each with a letter inserted, which together weigh ``INSERTED`` times as much."""
    out = dict(positive)
    for key, weight in positive.items():
        more = inserted(key)
        for k in more:
            if k not in positive:
                out[k] = out.get(k, 0.0) + INSERTED * weight / len(more)
    return out


def _landmarks(positive: dict[bytes, float], negative: dict[bytes, float]) -> list[bytes]:
    """Half of them positive windows by weight, the rest negative ones."""
    first = sorted(positive, key=lambda k: (-positive[k], k))[:LANDMARKS // 2]
    return [*first, *sorted(negative, key=lambda k: (-negative[k], k))[:LANDMARKS - len(first)]]


def _machine(fit: DataFrame, rounds: int) -> Machine | None:
    """A machine of these documents (text, toxic); none if no window stands out."""
    starters, background, odds = _starters(fit)
    positive, negative, machine = starters, background, None
    for k in range(rounds + 1):
        if not positive or not negative:
            return machine
        virtual = _with_inserted(positive)
        machine = fit_machine(virtual, {w: n for w, n in negative.items() if w not in virtual}, _landmarks(positive, negative))
        if k == rounds:
            break
        shared = fit.sparkSession.sparkContext.broadcast(machine)
        found = fit.select("text", "toxic").mapInArrow(_strongest_sentences(shared), "toxic bigint, rank int, key binary, value double").collect()
        labelled, hard = dict(starters), {}
        for r in found:
            window = bytes(r["key"])
            if r["toxic"] and (r["rank"] == 0 or r["value"] > 0):
                labelled[window] = labelled.get(window, 0.0) + 1
            elif not r["toxic"]:
                hard[window] = hard.get(window, 0.0) + 1
        positive = {w: n for w, n in labelled.items() if n > LIFT * odds * hard.get(w, 0.0)}
        negative = {w: n for w, n in (background | hard).items() if w not in positive}
    return machine


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS) -> Machine:
    """The machine and its curve. Without toxic or without clean training documents, or if no window stands out, every
    document scores the share of toxic labels, at most 0.49."""
    context = docs.sparkSession.sparkContext
    every, ratio = training_documents(docs, labels, max_labelled)
    every = every.persist()  # a bounded sample
    halves = [every.where(F.col("half") == k) for k in (0, 1)]
    held, machine = [], _machine(every, rounds)
    for own, other in (halves, halves[::-1]):
        if machine and (half := _machine(own, rounds)):
            held += other.select("text", "toxic").mapInArrow(
                _document_evidence(context.broadcast(half)), "toxic bigint, v0 double, v1 double").collect()
    every.unpersist()
    toxic = np.array([r["toxic"] == 1 for r in held], dtype=bool)
    if machine is None or not toxic.any() or toxic.all():
        known = labels.where("toxic in (0, 1)").where(~is_held_out(F.col("doc_id"))).agg(F.avg("toxic")).first()[0] or 0.0
        rate = min(max(float(known), 1e-6), 0.49)
        return Machine(curve=(0.0, float(np.log(rate / (1 - rate)))))
    evidence = np.array([(r["v0"], r["v1"]) for r in held])
    machine.curve = fit_curve(evidence, toxic, np.where(toxic, ratio, 1.0))
    return machine


def is_held_out(doc_id) -> F.Column:
    """Documents whose labels never train: crc32 of the id as text divisible by 5. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _verdicts(machine):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, scores, first, last = _plain(batch), [], [], []
            own = machine.value
            for windows, values, begin in _scored(texts, own):
                x, at = _evidence(windows, values, _chunk_texts(texts, begin))
                v = strength(x) * own.curve[0] + own.curve[1]
                scores.append(1 / (1 + np.exp(-np.clip(v, -30, 30))))
                first.append(np.where(at < 0, -1, np.append(windows.first, -1)[at]))
                last.append(np.where(at < 0, -1, np.append(windows.last, -1)[at]))
            score = np.concatenate([np.zeros(0), *scores])
            spans = [np.concatenate([np.zeros(0, np.int64), *x]) for x in (first, last)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score), *[pa.array(x, mask=x < 0) for x in spans]], ["doc_id", "score", "worst_start", "worst_end"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS) -> DataFrame:
    """Per document row: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5), worst_start and worst_end, the strongest
    window's place in the text (code points, end exclusive).

    The score follows from the text alone. A null or empty text, or one without letters and digits, has no window: null places, and
    the score of no evidence. Rows with a null or repeated id are scored one by one; other columns are ignored; an empty table gives no rows.
    """
    machine = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_labelled, rounds))
    scored = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        _verdicts(machine), "doc_id bigint, score double, worst_start bigint, worst_end bigint")
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                         "worst_start", "worst_end")
