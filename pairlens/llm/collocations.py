"""Phrases that stand together more often than their parts: counted in HAT-tries, scored exactly.

A word's id is a 64-bit code of its letters and language; a phrase is the path of its word ids. Phrases are counted level
by level, because a phrase with enough occurrences has only parts with enough occurrences:

1. Words: counted by task, summed by Spark; those with ``min_count`` occurrences get into a sieve.
2. Pairs whose words both pass the sieve; the frequent ones make the next sieve.
3. Phrases of three words and more whose pairs all pass.

Levels 2 and 3 count in a HAT-trie in every task (``HatTrie``): a shallow trie over word ids whose leaves are hash containers for
ranges of ids; a container that grows beyond ``BURST`` phrases bursts into two, or, if it holds one word only, into a node
over the next word. When a task holds ``HELD`` phrases, it spills its largest subtrees whole, as sorted runs. The runs of a prefix
partition meet in one task, which merges them. A partition is a hash of the first word (level 2) or the first two (level 3);
a prefix with more than 1 / ``HOT`` of all words (fewer than ``HOT`` there can be) is dealt by one word more.

Bounds. A sieve is a Bloom filter of ``SIEVE_BITS`` bits whatever the data: it may let rare phrases pass, whose counts are exact too
and fail the limit, but never stops a frequent one. A sieve and the hot prefixes (at most ``HOT`` ids) are all that is collected and
broadcast. The number of partitions follows the number of words. Phrases are compared by their words' codes (a chance of about
2^-64 a pair of words).
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlens.llm.postings import slices
from pairlens.llm.textcodes import mix, word_codes
from pairlens.session import new_state_path

MIN_COUNT = 30
MAX_WORDS = 4
TOP = 2_000
DROP_PERCENT = 80
SCALE = 2_000_000
BURST = 4_096
HELD = 600_000
HOT = 65_536
SIEVE_BITS = 1 << 26
PARTITION_WORDS = 2_000_000
CHUNK = 3_000_000  # bytes of texts that are coded at once
HELD_WORDS = 300_000

_ENDS = b".,;:!?\n\x0b\x0c\r"
#: A-Z in lower case, every piece's end a line feed, tabs blanks.
_PIECES = bytes(ord("\n") if b in _ENDS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SALTS = tuple(np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64)) for k in (1, 2, 3))


def pair_code(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _STEP + mix(b ^ _STEP))


def lang_seed(lang: str) -> np.uint64:
    raw = lang.encode()
    return np.uint64(zlib.crc32(raw) << 32 | zlib.crc32(b"#" + raw))


def word_ids(pieces: list[bytes], lang: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words of the pieces in order, and the piece of each."""
    codes, begin = word_codes(pieces)
    return mix(codes ^ lang_seed(lang)), np.repeat(np.arange(len(pieces)), np.diff(begin))


class HatTrie:
    """Counts of sorted keys (byte strings of ``words`` 8-byte word ids, most significant byte first).

    A node has containers for ranges of its word, in order: ``lows`` where they begin, ``parts`` a dict from key to count, or
    the node of the next word where a range is down to one word.
    """

    def __init__(self, words: int, depth: int = 0):
        self.words, self.end = words, 8 * (depth + 1)
        self.depth, self.size = depth, 0
        self.lows: list[bytes] = [b""]
        self.parts: list[dict | HatTrie] = [{}]

    def add(self, keys: list[bytes], counts: list[int], begin: int = 0, end: int | None = None) -> int:
        """Add counts of sorted keys; the number of keys that are new."""
        new, end = 0, len(keys) if end is None else end
        while begin < end:
            place = bisect_right(self.lows, keys[begin]) - 1
            upto = bisect_left(keys, self.lows[place + 1], begin, end) if place + 1 < len(self.lows) else end
            part = self.parts[place]
            if isinstance(part, HatTrie):
                new += part.add(keys, counts, begin, upto)
            else:
                before = len(part)
                for i in range(begin, upto):
                    key = keys[i]
                    part[key] = part.get(key, 0) + counts[i]
                new += len(part) - before
                if len(part) > BURST:
                    self._burst(place)
            begin = upto
        self.size += new
        return new

    def _burst(self, place: int) -> None:
        part, end = self.parts[place], self.end
        keys = sorted(part)
        first, last, middle = keys[0][:end], keys[-1][:end], keys[len(keys) // 2][:end]
        if first == last:
            if self.depth + 1 < self.words:
                self._deepen(place, first, keys)
            return
        if middle == first:  # cut before the first other word
            middle = keys[bisect_right(keys, first + b"\xff" * (8 * self.words))][:end]
        self.lows.insert(place + 1, middle)
        self.parts.insert(place + 1, {k: part[k] for k in keys[bisect_left(keys, middle):]})
        self.parts[place] = {k: part[k] for k in keys[:bisect_left(keys, middle)]}
        for at in (place + 1, place):
            if len(self.parts[at]) > BURST:
                self._burst(at)

    def _deepen(self, place: int, word: bytes, keys: list[bytes]) -> None:
        """A container of one word becomes a node over the next; what its range has on both sides stays a container."""
        child = HatTrie(self.words, self.depth + 1)
        child.parts, child.size = [self.parts[place]], len(keys)
        lows, parts = [word], [child]
        if self.lows[place] < word:
            lows, parts = [self.lows[place], *lows], [{}, *parts]
        after = int.from_bytes(word, "big") + 1
        if after < 1 << (8 * len(word)) and after.to_bytes(len(word), "big") not in self.lows[place + 1:place + 2]:
            lows, parts = [*lows, after.to_bytes(len(word), "big")], [*parts, {}]
        self.lows[place:place + 1], self.parts[place:place + 1] = lows, parts
        child._burst(0)

    def run(self) -> Iterator[tuple[bytes, int]]:
        """All keys in order, with their counts."""
        for part in self.parts:
            yield from part.run() if isinstance(part, HatTrie) else sorted(part.items())


RUNS = "lang string, slot bigint, words int, keys binary, counts binary"


def packed_run(found: list[tuple[bytes, int]], words: int) -> tuple[bytes, bytes]:
    """A sorted run as columns: first words, second words, ..., and counts."""
    table = np.frombuffer(b"".join(k for k, _ in found), dtype=">u8").reshape(-1, words)
    return np.ascontiguousarray(table.T).tobytes(), np.array([n for _, n in found], dtype="<u4").tobytes()


class TaskCounter:
    """The tries of a task, one per language, partition and phrase length."""

    def __init__(self, held: int):
        self.tries: dict[tuple[str, int, int], HatTrie] = {}
        self.size, self.held = 0, held

    def add(self, lang: str, columns: list[np.ndarray], slot: np.ndarray) -> None:
        """Phrases as one column of ids per word, with their partitions."""
        if not len(slot):
            return
        order = np.lexsort([*columns[::-1], slot])
        slot, columns = slot[order], [c[order] for c in columns]
        new = np.zeros(len(slot), dtype=bool)
        new[0] = True
        for c in columns:  # the partition follows from the words
            new[1:] |= c[1:] != c[:-1]
        at = np.flatnonzero(new)
        counts = np.diff(np.append(at, len(slot))).tolist()
        width = 8 * len(columns)
        raw = np.stack([c[at] for c in columns], axis=1).astype(">u8").tobytes()
        keys = [raw[i:i + width] for i in range(0, len(raw), width)]
        slot = slot[at]
        edge = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])).tolist()
        for a, b in zip(edge, [*edge[1:], len(keys)], strict=True):
            name = (lang, int(slot[a]), len(columns))
            if name not in self.tries:
                self.tries[name] = HatTrie(len(columns))
            self.size += self.tries[name].add(keys, counts, a, b)

    def spilled(self, upto: int) -> Iterator[tuple]:
        """Rows of the largest subtrees, taken out until ``upto`` phrases are left."""
        for name in sorted(self.tries, key=lambda n: -self.tries[n].size):
            if self.size <= upto:
                return
            trie = self.tries.pop(name)
            self.size -= trie.size
            yield *name, *packed_run(list(trie.run()), name[2])

    def full(self) -> bool:
        return self.size > self.held


def _by_lang(batch) -> Iterator[tuple[str, list[bytes]]]:
    """Texts by language, in chunks, cut into pieces."""
    texts = defaultdict(list)
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
        if text:
            texts[lang].append(text.encode())
    for lang, own in texts.items():
        begin = size = 0
        for i, t in enumerate([*own, None]):
            if t is None or (i > begin and size + len(t) > CHUNK):
                if i > begin:
                    yield lang, b"\n".join(own[begin:i]).translate(_PIECES).split(b"\n")
                begin, size = i, 0
            size += len(t or b"")


def _word_counts(held: int):
    def run(batches) -> Iterator:
        def rows():
            for lang, own in counts.items():
                words = list(own)
                ids = word_ids(words, lang)[0].astype(">u8").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(words)), pa.array(words, pa.binary()).cast(pa.string()),
                     pa.array([ids[i:i + 8] for i in range(0, len(ids), 8)], pa.binary()), pa.array(own.values(), pa.int64())],
                    ["lang", "word", "key", "n"])

        counts: dict[str, Counter] = defaultdict(Counter)
        for batch in slices(batches):
            for lang, pieces in _by_lang(batch):
                counts[lang].update(b" ".join(pieces).split(None))
            if sum(map(len, counts.values())) > held:
                yield from rows()
                counts.clear()
        yield from rows()

    return run


def positions(ids: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The three bits of each id."""
    for salt in _SALTS:
        yield mix(ids + salt) & np.uint64(bits - 1)


def passes(sieve: np.ndarray, ids: np.ndarray) -> np.ndarray:
    found = np.ones(len(ids), dtype=bool)
    for p in positions(ids, len(sieve) * 64):
        found &= (sieve[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found


def _unpacked(keys: list[bytes]) -> list[np.ndarray]:
    """Columns of ids of phrases of one length."""
    table = np.frombuffer(b"".join(keys), dtype=">u8").astype(np.uint64).reshape(len(keys), -1)
    return [np.ascontiguousarray(c) for c in table.T]


def phrase_code(columns: list[np.ndarray]) -> np.ndarray:
    code = columns[0]
    for c in columns[1:]:
        code = pair_code(code, c)
    return code


def _sieve_cells(bits: int):
    def run(batches) -> Iterator:
        for batch in batches:
            keys = batch.column("key").to_pylist()
            if not keys:
                continue
            p = np.concatenate(list(positions(phrase_code(_unpacked(keys)), bits)))
            cell, at = np.unique(p >> np.uint64(6), return_inverse=True)
            mask = np.zeros(len(cell), dtype=np.uint64)
            np.bitwise_or.at(mask, at, np.uint64(1) << (p & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), pa.array(mask.view(np.int64))], ["cell", "mask"])

    return run


def sieve_of(frequent: DataFrame, bits: int = SIEVE_BITS) -> np.ndarray:
    """Bloom filter of phrases of one length (column ``key``), as ``bits / 64`` numbers."""
    cells = (frequent.select("key").mapInArrow(_sieve_cells(bits), "cell bigint, mask bigint")
             .groupBy("cell").agg(F.bit_or("mask").alias("mask")).toArrow())
    sieve = np.zeros(bits // 64, dtype=np.uint64)
    sieve[cells.column("cell").to_numpy()] = cells.column("mask").to_numpy().view(np.uint64)
    return sieve


def hot_prefixes(frequent: DataFrame, total: int) -> np.ndarray:
    """Codes of the phrases with more than 1 / HOT of all words, sorted; fewer than HOT."""
    keys = [bytes(r["key"]) for r in frequent.where(F.col("f") > total / HOT).select("key").collect()]
    return np.sort(phrase_code(_unpacked(keys))) if keys else np.zeros(0, np.uint64)


def slots_of(columns: list[np.ndarray], prefix: int, hot: np.ndarray, slots: int) -> np.ndarray:
    """The partition of each phrase: a hash of its first ``prefix`` words, of one more where these are hot."""
    code = phrase_code(columns[:prefix])
    if len(hot):
        deeper = hot[np.minimum(np.searchsorted(hot, code), len(hot) - 1)] == code
        code = np.where(deeper, pair_code(code, columns[prefix]), code)
    return (mix(code) % np.uint64(slots)).astype(np.int64)


def _phrases(lengths: range, sieve, hot, slots: int, held: int):
    """Spilled runs of all phrases of these lengths whose parts of one word less than the shortest pass the sieve."""
    def run(batches) -> Iterator:
        def rows(upto: int):
            for row in counter.spilled(upto):
                yield pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True))], schema)

        names = ("lang", "slot", "words", "keys", "counts")
        schema = pa.schema(list(zip(names, (pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)))
        counter, part = TaskCounter(held), lengths[0] - 1
        for batch in slices(batches):
            for lang, pieces in _by_lang(batch):
                ids, piece = word_ids(pieces, lang)
                count = max(0, len(ids) - part + 1)
                good = passes(sieve.value, phrase_code([ids[j:j + count] for j in range(part)]))
                good &= piece[:count] == piece[part - 1:part - 1 + count]
                for words in lengths:
                    count = max(0, len(ids) - words + 1)
                    at = piece[:count] == piece[words - 1:words - 1 + count]
                    for j in range(words - part + 1):
                        at &= good[j:j + count]
                    at = np.flatnonzero(at)
                    columns = [ids[at + j] for j in range(words)]
                    counter.add(lang, columns, slots_of(columns, part, hot.value, slots))
                if counter.full():
                    yield from rows(held // 2)
        yield from rows(0)

    return run


def merged(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct phrases in order, with summed counts."""
    order = np.lexsort(columns[::-1])
    columns, counts = [c[order] for c in columns], counts[order]
    new = np.zeros(len(counts), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(new)
    return [c[at] for c in columns], np.add.reduceat(counts, at) if len(at) else counts


def _merge(min_count: int):
    """The runs of one partition merged: phrases with ``min_count`` occurrences. Runs are merged as they come, whenever
    as many phrases wait as are merged already."""
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, words = key[0].as_py(), key[2].as_py()
        done, waiting, size = None, [], 0

        def all_of():
            parts = [*([done] if done else []), *waiting]
            return merged([np.concatenate(c) for c in zip(*(p[0] for p in parts), strict=True)], np.concatenate([p[1] for p in parts]))

        for batch in batches:
            for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                table = np.frombuffer(keys, dtype=">u8").astype(np.uint64).reshape(words, -1)
                waiting.append(([*table], np.frombuffer(counts, dtype="<u4").astype(np.int64)))
                size += table.shape[1]
                if size > max(PARTITION_WORDS, len(done[1]) if done else 0):
                    done, waiting, size = all_of(), [], 0
        columns, f = all_of()
        at = np.flatnonzero(f >= min_count)
        raw, width = np.stack([c[at] for c in columns], axis=1).astype(">u8").tobytes(), 8 * words
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at), pa.string()), pa.array([raw[i:i + width] for i in range(0, len(raw), width)], pa.binary()),
             pa.array(f[at])], ["lang", "key", "f"])

    return run


COUNTED = "lang string, key binary, f bigint"


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, held: int = HELD,
                     sieve_bits: int = SIEVE_BITS) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to ``max_words`` words with at least ``min_count`` occurrences (lang, key, f, and word for single words),
    and the number of word occurrences by language (lang, n)."""
    spark, folder = docs.sparkSession, new_state_path(docs.sparkSession, "collocations")
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    words = _written(texts.mapInArrow(_word_counts(HELD_WORDS), "lang string, word string, key binary, n bigint")
                     .groupBy("lang", "word", "key").agg(F.sum("n").alias("f")), f"{folder}/words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    total = int(words.agg(F.sum("f")).first()[0] or 0)
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION_WORDS))
    levels = [words.where(F.col("f") >= min_count)]
    for lengths in (range(2, 3), range(3, max_words + 1)):
        if not lengths:
            continue
        below = levels[-1]
        sieve, hot = (spark.sparkContext.broadcast(x) for x in (sieve_of(below, sieve_bits), hot_prefixes(below, total)))
        runs = texts.mapInArrow(_phrases(lengths, sieve, hot, slots, held), RUNS)
        levels.append(_written(runs.groupBy("lang", "slot", "words").applyInArrow(_merge(min_count), COUNTED), f"{folder}/{lengths[0]}"))
    phrases = levels[0].select("lang", "key", "f", "word")
    for level in levels[1:]:
        phrases = phrases.unionByName(level, allowMissingColumns=True)
    return phrases, totals


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int | None = TOP,
                 drop_percent: int = DROP_PERCENT, **options) -> DataFrame:
    """The best phrases of 2 to ``max_words`` words of each language: lang, rank, phrase, a, l, r, n, score.

    Texts in lower case (A-Z only) are cut into pieces at ``.,;:!?`` and line ends, pieces into words at blanks and tabs; phrases lie
    in one piece, and all their occurrences count, overlapping ones too. a, l and r are the occurrences of the phrase and of its
    two parts at the cut with the lowest score floor(2000000 a / (l + r)) (ties: the earliest cut), n the words of the language.
    Phrases inside a longer one that has ``drop_percent`` of their occurrences go. ``top``: how many of each language, None for all;
    order by score, a, then phrase in byte order.

    A null language is ``und``, a null text empty; other columns are ignored; ids don't matter, so repeated rows count as often as they
    come; an empty table gives no rows.
    """
    phrases, totals = frequent_phrases(docs, min_count, max_words, **options)
    words = F.expr("octet_length(key) div 8")
    found = phrases.where(words > 1).select("lang", "key", F.col("f").alias("a"), words.cast("int").alias("words"))
    counts = phrases.select("key", "f")
    cuts = found.select("lang", "key", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).withColumns({
        "left": F.expr("substring(key, 1, 8 * k)"), "right": F.expr("substring(key, 8 * k + 1, octet_length(key))")})
    cuts = (cuts.join(counts.select(F.col("key").alias("left"), F.col("f").alias("l")), "left")
            .join(counts.select(F.col("key").alias("right"), F.col("f").alias("r")), "right"))
    score = F.expr(f"({SCALE} * CAST(a AS DECIMAL(28,0))) div (CAST(l AS DECIMAL(28,0)) + r)")
    scored = (cuts.groupBy("lang", "key", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")))
    inner = (found.where("words > 2").select("a", "key", "words", F.explode(F.expr("sequence(2, words - 1)")).alias("k"))
             .select("a", F.col("k"), "key", F.explode(F.expr("sequence(0, words - k)")).alias("at"))
             .groupBy(F.expr("substring(key, 8 * at + 1, 8 * k)").alias("key")).agg(F.max("a").alias("within")))
    stay = scored.join(inner, "key", "left").where(
        F.col("within").isNull() | (F.col("within").cast("decimal(28,0)") * 100 < F.col("a").cast("decimal(28,0)") * drop_percent))
    named = (stay.select("key", F.posexplode(F.expr("transform(sequence(0, octet_length(key) div 8 - 1), i -> substring(key, 8 * i + 1, 8))"))
                         .alias("pos", "id"))
             .join(phrases.where("word IS NOT NULL").select(F.col("key").alias("id"), "word"), "id")
             .groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("parts"))  # at most max_words
             .select("key", F.array_join(F.transform("parts", lambda p: p["word"]), " ").alias("phrase")))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = (stay.join(named, "key").select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
              .withColumn("rank", F.row_number().over(best)))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


COLLOCATIONS_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang),
grams AS (
  SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i
  FROM worded, (SELECT unnest([1, 2, 3, 4]) AS k) AS sizes WHERE len(w) >= k),
counts AS (
  SELECT lang, k, p, CAST(count(*) AS BIGINT) AS f
  FROM (SELECT lang, k, w[i:i + k - 1] AS p FROM grams) AS spelled GROUP BY lang, k, p HAVING count(*) >= 30),
found AS (SELECT lang, k AS size, p, f AS a FROM counts WHERE k > 1),
cuts AS (
  SELECT c.lang, c.size, c.p, c.a, j.k, x.f AS l, y.f AS r,
    CAST(2000000::HUGEINT * c.a // (x.f::HUGEINT + y.f) AS BIGINT) AS score
  FROM found AS c JOIN (SELECT unnest([1, 2, 3]) AS k) AS j ON j.k < c.size
  JOIN counts AS x ON x.lang = c.lang AND x.p = c.p[1:j.k]
  JOIN counts AS y ON y.lang = c.lang AND y.p = c.p[j.k + 1:c.size]),
scored AS (
  SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, k) AS nth FROM cuts),
inside AS (
  SELECT lang, p[s.b:s.b + s.k - 1] AS p, max(a) AS longer
  FROM found, (SELECT * FROM (VALUES (1, 2), (2, 2), (3, 2), (1, 3), (2, 3)) AS v(b, k)) AS s
  WHERE s.k < size AND s.b + s.k - 1 <= size GROUP BY ALL),
kept AS (
  SELECT s.lang, array_to_string(s.p, ' ') AS phrase, s.a, s.l, s.r, s.score
  FROM scored AS s LEFT JOIN inside AS i ON i.lang = s.lang AND i.p = s.p
  WHERE s.nth = 1 AND (i.longer IS NULL OR 100::HUGEINT * i.longer < 80::HUGEINT * s.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
