"""Exact n-gram Jaccard join by vertical partitioning.

Shingles are ordered by their 64-bit codes, and the order is cut into fragments. A fragment sees, of every
set, the shingles in its range, so it knows each of its shingles' posting lists whole and counts a part of every
pair's overlap; the parts are summed per pair.

1. Equal sets form a class, and only its smallest id goes on.
2. In the fragments of the first ``HEAD`` of the order, shingles that one class alone has are counted per class. A
   class with more than 20 % of such shingles cannot reach a similarity of 0.8 with anything, and is done. This is
   exact, and it also disposes of sets that merely share a common passage.
3. The classes left are told apart by their rare shingles: fragments return how frequent each shingle is, and a class of n
   shingles keeps those of its n - 0.8 n + 1 rarest that others have too. Two similar sets have one of these in common, the rarest
   of their shared ones, so what such shingles connect (classes whose sizes fit) are groups beyond which nothing is similar. Chains
   of classes stand for the pairs of a shingle, and classes without a group are done. This is exact, too.
4. From here on the order of codes is that of each group on its own: a group of up to ``PAIR_POSTINGS`` postings lies in one
   fragment, larger ones in as many as they need, so a pair's count leaves once, or once per fragment of its group.
   Pairs of short posting lists are counted inside the fragment. Classes of
   long lists are cut into ranges of ``TILE``; each two ranges are a tile, and where there is more than one, a tile is a
   Spark group of its own. Counts leave packed, in rows of at most ``ROW_PAIRS`` pairs, whenever about ``BUFFER`` have gathered.
5. Blocks, as many as the counted pairs ask for, sum the parts, keep the pairs at or over the threshold, and return a spanning
   forest and link counts.

Work on one group of k different near copies grows with k^2, and so do the packed counts on disk: all their pairs are
compared. What a task holds of them does not: a buffer, a tile, or a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.llm.components import connected_components
from pairlens.llm.postings import BLOB, cut, joined, owner_bytes, record_batch, slices, small_batches
from pairlens.llm.textcodes import chunks, mix, sequence_code, window_codes, word_codes
from pairlens.operators.leakage import may_hold, sieve_row
from pairlens.session import new_state_path

SHINGLE = 5
PERCENT = 80
HEAD = 0.5
HEAD_POSTINGS = 2_000_000  # of a fragment of step 2
PAIR_POSTINGS = 2_000_000  # of a fragment of steps 3 and 4
LONG_LIST = 64
TILE = 2_048
BUFFER = 1_000_000  # pairs a task gathers before it sends them on
ROW_PAIRS = 10_000  # of a row of counted pairs
ROW_POSTINGS = 50_000  # of a row of a tile's work, but for a single list's
ROW_BATCH = 50  # such rows sent to Python at once
# Rows of packed pairs are long: pages and row groups that a task holds are cut by bytes after every few of them.
ROW_FILES = {"parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "4", "parquet.block.size.row.check.max": "16",
             "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "4"}
BLOCK_PAIRS = 2_000_000  # counted pairs of a block


def shingle_sets(texts: list[str | None], n: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle codes of each text: words between white space, ASCII case aside; a text of fewer words
    than ``n`` is one shingle, without words none."""
    raw = [(t or "").encode().lower() for t in texts]
    for a, b in chunks(raw):
        codes, begin = word_codes(raw[a:b])
        windows = window_codes(codes, n)
        for s, e in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
            yield np.unique(windows[s:e - n + 1]) if e - s >= n else sequence_code(codes[s:e]) if e > s else windows[:0]


def fingerprint(codes: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed longs."""
    a = np.array([codes.sum(dtype=np.uint64), mix(codes + np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)])
    return tuple(int(x) for x in mix(a + np.uint64(len(codes))).view(np.int64))


def _members(batches) -> Iterator:
    """doc_id, n and fingerprint of each text; a column ``row_key`` goes along."""
    for batch in slices(batches):
        ids, n, one, two = [], [], [], []
        for doc, s in zip(batch.column("doc_id").to_pylist(), shingle_sets(batch.column("text").to_pylist()), strict=True):
            a, b = fingerprint(s)
            ids.append(doc), n.append(len(s)), one.append(a), two.append(b)
        keys = {"row_key": batch.column("row_key").to_pylist()} if "row_key" in batch.schema.names else {}
        yield record_batch({"doc_id": ids, "n": n, "f1": one, "f2": two, **keys})


CLASS = np.dtype([("f1", "<i8"), ("f2", "<i8"), ("n", "<u4")])
REP = np.dtype([("id", "<i8"), ("n", "<u4"), ("m", "<u8")])


def _head_postings(fragments: int, first: int):
    """Of each slice of rows: by fragment, the low 32 bits of its sets' codes and whose they are (numbers in the slice);
    and once, under a negative fragment of its own, the table of its classes. Codes cut short may meet in a fragment, which only
    makes a shingle seem shared and keeps a class that could go.

    A slice's id is a hash of its classes in order, of the task and of its place there: should a repeated task see its rows
    in another order, its slices are other slices, and what is left of the first ones counts for less."""
    def run(batches) -> Iterator:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId() << 32
        for place, batch in enumerate(slices(batches)):
            seen, sets = {}, []
            for s in shingle_sets(batch.column("text").to_pylist()):
                if len(s) and (f := fingerprint(s)) not in seen:
                    seen[f] = len(s)
                    sets.append(s[:np.searchsorted(s, np.uint64(min(first / fragments, 1.0) * 2.0**64 - 2048)) + 1])
            if not sets:
                continue
            classes = np.array([(*f, n) for f, n in seen.items()], dtype=CLASS)
            order = mix(np.arange(len(sets), dtype=np.uint64) + np.uint64(task + place))
            slice_id = int(mix(classes["f1"].astype(np.uint64) ^ order).sum(dtype=np.uint64) >> np.uint64(2))
            owner = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets])
            out = {"fragment": [-1 - slice_id], "slice": [slice_id], "owners": [classes.tobytes()], "codes": [b""]}
            for k, codes, own in cut(np.concatenate(sets), owner, fragments, first):
                out["fragment"].append(k)
                out["slice"].append(slice_id)
                out["owners"].append(own.astype("<u2").tobytes())
                out["codes"].append(codes.astype("<u4").tobytes())  # the low half
            yield record_batch(out)

    return run


def _alone(table):
    """Of each slice, how many shingles of this fragment each class has alone; class tables pass. A class that several
    slices have counts as several, so nothing of it is alone: it is kept."""
    import pyarrow as pa

    if table.column("fragment")[0].as_py() < 0:
        return table.drop_columns(["fragment"]).append_column("table", pa.array([True] * len(table)))
    slice_ids, owners, codes = (table.column(c).to_pylist() for c in ("slice", "owners", "codes"))
    row = np.repeat(np.arange(len(codes), dtype=np.int32), [len(c) // 4 for c in codes])
    code = np.frombuffer(b"".join(codes), dtype="<u4")
    order = np.argsort(code, kind="stable")
    c = code[order]
    same = np.concatenate([[False], c[1:] == c[:-1]])
    alone = order[~(same | np.concatenate([same[1:], [False]]))]
    pair = row[alone].astype(np.int64) << 16 | np.frombuffer(b"".join(owners), dtype="<u2")[alone]
    pair, count = np.unique(pair, return_counts=True)
    edge = np.searchsorted(pair >> 16, np.arange(len(codes) + 1))
    used = [k for k in range(len(codes)) if edge[k] < edge[k + 1]]
    return pa.table({
        "slice": pa.array([slice_ids[k] for k in used], pa.int64()),
        "owners": pa.array([(pair[edge[k]:edge[k + 1]] & 0xFFFF).astype("<u2").tobytes() for k in used], pa.binary()),
        "codes": pa.array([count[edge[k]:edge[k + 1]].astype("<u4").tobytes() for k in used], pa.binary()),
        "table": pa.array([False] * len(used), pa.bool_())})


def _hopeless(percent: int):
    """The classes of a slice that have too many shingles alone."""
    def run(table):
        import pyarrow as pa

        rows = list(zip(*(table.column(c).to_pylist() for c in ("table", "owners", "codes")), strict=True))
        classes = np.frombuffer(next((o for t, o, _ in rows if t), b""), dtype=CLASS)
        if not len(classes):
            rows = []  # of an earlier attempt at this task
        alone = np.zeros(len(classes), dtype=np.int64)
        for t, o, c in rows:
            if not t:
                np.add.at(alone, np.frombuffer(o, dtype="<u2"), np.frombuffer(c, dtype="<u4"))
        gone = classes[100 * alone > (100 - percent) * classes["n"].astype(np.int64)]
        return pa.table({"f1": pa.array(gone["f1"]), "f2": pa.array(gone["f2"])})

    return run


def _set_rows(batches) -> Iterator:
    """The sets of the classes left; rows of the same id whose text is another class's are dropped."""
    for batch in slices(batches):
        out = {"id": [], "n": [], "m": [], "key": [], "codes": []}
        wanted = zip(*(batch.column(c).to_pylist() for c in ("rep", "m", "f1", "f2")), strict=True)
        for (rep, m, a, b), s in zip(wanted, shingle_sets(batch.column("text").to_pylist()), strict=True):
            if fingerprint(s) == (a, b):
                out["id"].append(rep), out["n"].append(len(s)), out["m"].append(m), out["key"].append(a), out["codes"].append(s.astype("<u8").tobytes())
        if out["id"]:
            yield record_batch(out)


RARE = np.dtype([("key", "<i8"), ("n", "<u4")])


def _sets_of(column) -> tuple[list[np.ndarray], np.ndarray]:
    sets = [np.frombuffer(x, dtype="<u8") for x in column.to_pylist()]
    return sets, np.array([len(s) for s in sets], dtype=np.int64)


def _class_codes(fragments: int):
    """Of each slice of sets, by fragment: keys of its classes, how many codes each has there, and the low halves of the codes.
    Codes whose halves agree count as one, which only makes them seem more frequent, and so to every class."""
    def run(batches) -> Iterator:
        for batch in slices(batches):
            sets, n = _sets_of(batch.column("codes"))
            if not sets:
                continue
            keys, out = batch.column("key").to_numpy(), {"fragment": [], "classes": [], "owners": [], "codes": []}
            for k, codes, own in cut(np.concatenate(sets), np.repeat(np.arange(len(n)), n), fragments, fragments):
                used, count = np.unique(own, return_counts=True)
                out["fragment"].append(k)
                out["classes"].append(keys[used].tobytes())
                out["owners"].append(count.astype("<u4").tobytes())
                out["codes"].append(codes.astype("<u4").tobytes())
            yield record_batch(out)

    return run


def _class_levels(buckets: int):
    """Of a fragment, by bucket of classes: the binary logarithm of how many classes have it, for each code in the order of ``_class_codes``."""
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keys, count, codes = (np.frombuffer(b"".join(table.column(c).to_pylist()), dtype=kind) for c, kind in zip(
            BLOB_COLUMNS, ("<i8", "<u4", "<u4"), strict=True))
        _, index, classes = np.unique(codes, return_inverse=True, return_counts=True)
        level = np.ceil(np.log2(classes)).astype(np.uint8)[index]
        once = np.zeros(len(keys), dtype=bool)  # rows may be repeated
        once[np.unique(keys, return_index=True)[1]] = True
        of_once = np.repeat(once, count)
        keys, count, level = keys[once], count[once], level[of_once]
        bucket = keys % buckets
        order, posting_order = np.argsort(bucket, kind="stable"), np.argsort(np.repeat(bucket, count), kind="stable")
        keys, count, level = keys[order], count[order], level[posting_order]
        edge = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) > 0, [True]]))
        through = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
        return pa.table({
            "bucket": pa.array(bucket[order][edge[:-1]]), "fragment": pa.array([key[0].as_py()] * (len(edge) - 1), pa.int64()),
            **{c: pa.array([v[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()) for c, v, at in (
                ("classes", keys.astype("<i8"), edge), ("owners", count.astype("<u4"), edge), ("codes", level, through[edge]))}})

    return run


def _rare_postings(fragments: int, percent: int):
    """Of a bucket's sets and the levels of their codes, by fragment: the rarest codes of each class that others have too, of which
    two similar classes share one."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"fragment": [], "classes": [], "owners": [], "codes": []}
        keys, at = np.unique(left.column("key").to_numpy(), return_index=True)  # a repeated row is the same class
        if len(keys):
            sets, n = _sets_of(left.column("codes").take(pa.array(at)))
            found, count, level = (np.frombuffer(b"".join(right.column(c).to_pylist()), dtype=kind) for c, kind in zip(
                BLOB_COLUMNS, ("<i8", "<u4", "u1"), strict=True))
            part = np.repeat(right.column("fragment").to_numpy(), [len(x) // 8 for x in right.column("classes").to_pylist()])
            order = np.lexsort((part, found))  # a class's codes are in order through the fragments
            count = count.astype(np.int64)
            begin, size = (np.cumsum(count) - count)[order], count[order]
            level = level[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
            codes, owner = np.concatenate(sets), np.repeat(np.arange(len(n)), n)
            rank = np.argsort(owner << 8 | level, kind="stable")
            place = np.arange(len(codes)) - np.repeat(np.cumsum(n) - n, n)
            rank = rank[(place < np.repeat(n + 1 + -percent * n // 100, n)) & (level[rank] > 0)]
            reps = np.array(list(zip(keys.tolist(), n.tolist(), strict=True)), dtype=RARE)
            for k, some, own in cut(codes[rank], owner[rank], fragments, fragments):
                used, local = np.unique(own, return_inverse=True)
                out["fragment"].append(k)
                out["classes"].append(reps[used].tobytes())
                out["owners"].append(owner_bytes(local, len(used)))
                out["codes"].append(some.astype("<u8").tobytes())
        return pa.table([pa.array(v, pa.binary() if k in BLOB_COLUMNS else pa.int64()) for k, v in out.items()], list(out))

    return run


def _chains(percent: int):
    """Of a fragment of rare codes, a forest over the classes that they connect: neighbours by size in a code's list stand for all its
    pairs whose sizes fit, as the sizes between fit as well."""
    def run(table: pa.Table) -> pa.Table:
        reps, owner, codes = joined(table, RARE, "<u8")
        n = reps["n"].astype(np.int64)
        order = np.lexsort((n[owner], codes))
        c, o = codes[order], owner[order]
        near = (c[1:] == c[:-1]) & (100 * n[o[:-1]] >= percent * n[o[1:]])
        root = _roots(len(reps), o[:-1][near], o[1:][near])
        at = np.flatnonzero(root != np.arange(len(reps)))
        return pa.table({"a": pa.array(reps["key"][at]), "b": pa.array(reps["key"][root[at]])})

    return run


def _pair_postings(fragments: int):
    """Postings of the classes of a group, whose codes are those of the group alone: ``parts`` of 0 shares a fragment with other small
    groups, others have so many fragments of their own."""
    def run(batches) -> Iterator:
        for batch in slices(batches):
            sets, n = _sets_of(batch.column("codes"))
            if not sets:
                continue
            reps = np.array(list(zip(*(batch.column(c).to_pylist() for c in ("id", "n", "m")), strict=True)), dtype=REP)
            salt, parts = mix(batch.column("component").to_numpy().view(np.uint64)), batch.column("parts").to_numpy().astype(np.uint64)
            codes, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint32), n)
            part = ((codes >> np.uint64(32)) * parts[owner]) >> np.uint64(32)
            own = -1 - (mix(salt[owner] + part) >> np.uint64(2)).astype(np.int64)
            fragment = np.where(parts[owner] > 0, own, (salt % np.uint64(fragments)).astype(np.int64)[owner])
            codes, order = mix(codes ^ salt[owner]), np.argsort(fragment, kind="stable")
            edge = np.flatnonzero(np.concatenate([[True], np.diff(fragment[order]) > 0, [True]]))
            out = {"fragment": [], "classes": [], "owners": [], "codes": []}
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                at = order[a:b]
                used, local = np.unique(owner[at], return_inverse=True)
                out["fragment"].append(int(fragment[at[0]]))
                out["classes"].append(reps[used].tobytes())
                out["owners"].append(owner_bytes(local, len(used)))
                out["codes"].append(codes[at].astype("<u8").tobytes())
            yield record_batch(out)

    return run


def _summed(code: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, index = np.unique(code, return_inverse=True)
    return distinct, np.bincount(index, weights=count, minlength=len(distinct)).astype(np.int64)


class _Counts:
    """Sums of pairs, in a buffer of bounded size; what passes it leaves through ``full``, as partial sums."""

    def __init__(self, width: int):
        self.width, self.parts, self.size = np.int64(width), [], 0

    def add(self, x: np.ndarray, y: np.ndarray, count: np.ndarray | None = None) -> None:
        self.parts.append((x * self.width + y, np.ones(len(x), np.int64) if count is None else count))
        self.size += len(x)

    def full(self, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Once over ``limit`` entries are gathered, sum them; if more than half of it are distinct, send them on."""
        if self.size > limit:
            self.parts = [_summed(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))]
            self.size = len(self.parts[0][0])
            if 2 * self.size > limit:
                code, count = self.parts[0]
                self.parts, self.size = [], 0
                yield code // self.width, code % self.width, count


def _ordered(owner: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes and owners by code, each once, where the posting lists begin (and the last ends), and their lengths."""
    order = np.lexsort((owner, codes))
    c, o = codes[order], owner[order]
    once = np.concatenate([[True], (c[1:] != c[:-1]) | (o[1:] != o[:-1])])[:len(c)]
    c, o = c[once], o[once]
    edge = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1], [True]])) if len(c) else np.zeros(1, np.int64)
    return c, o, edge, np.diff(edge)


def _fits(sizes: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    a, b = sizes[x], sizes[y]
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def _short_pairs(c, o, length, sizes, percent) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Partial sums of the pairs of lists of at most ``LONG_LIST``."""
    counts = _Counts(len(sizes))
    short = np.repeat((length > 1) & (length <= LONG_LIST), length)
    c1, o1 = c[short], o[short]
    at, k = np.arange(len(c1)), 1
    while len(at):
        at = at[at + k < len(c1)]
        at = at[c1[at] == c1[at + k]]
        for some in range(0, len(at), BUFFER):
            x, y = o1[at[some:some + BUFFER]], o1[at[some:some + BUFFER] + k]
            keep = _fits(sizes, x, y, percent)
            counts.add(x[keep], y[keep])
            yield from counts.full(BUFFER)
        k += 1
    yield from counts.full(0)


def _tile_pairs(left, right, same: bool, a_ids, b_ids, sizes, percent) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of one tile; lists hold numbers in ``a_ids`` and ``b_ids``, which number ``sizes``."""
    tile = np.zeros((len(a_ids), len(b_ids)), dtype=np.int32)
    for a, b in zip(left, right, strict=True):
        if len(a) and len(b):
            tile[np.ix_(a, b)] += 1
    a, b = np.nonzero(np.triu(tile, 1) if same else tile)
    x, y = a_ids[a], b_ids[b]
    keep = _fits(sizes, x, y, percent)
    return x[keep], y[keep], tile[a, b][keep].astype(np.int64)


def _long_lists(o, edge, length) -> tuple[np.ndarray, list[np.ndarray]]:
    """Owners of long lists, and the lists as numbers of them."""
    lists = [o[edge[i]:edge[i + 1]] for i in np.flatnonzero(length > LONG_LIST)]
    hot = np.unique(np.concatenate(lists)) if lists else o[:0]
    return hot, [np.searchsorted(hot, x) for x in lists]


def _range_of(lists: list[np.ndarray], i: int) -> list[np.ndarray]:
    return [x[np.searchsorted(x, i):np.searchsorted(x, i + TILE)] - i for x in lists]


def pair_parts(owner: np.ndarray, codes: np.ndarray, sizes: np.ndarray, percent: int = PERCENT) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Partial sums of ``count_pairs``, a pair perhaps in several; each of about ``BUFFER`` pairs or one tile's."""
    c, o, edge, length = _ordered(owner, codes)
    yield from _short_pairs(c, o, length, sizes, percent)
    hot, lists = _long_lists(o, edge, length)
    for i in range(0, len(hot), TILE):
        left = _range_of(lists, i)
        for j in range(i, len(hot), TILE):
            yield _tile_pairs(left, _range_of(lists, j), i == j, hot[i:i + TILE], hot[j:j + TILE], sizes, percent)


def count_pairs(owner: np.ndarray, codes: np.ndarray, sizes: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, shared codes) of all pairs x < y of owners that share a code and whose sizes allow a link, at once."""
    counts = _Counts(len(sizes))
    for part in pair_parts(owner, codes, sizes, percent):
        counts.add(*part)
    code, count = _summed(*(np.concatenate(x) for x in zip(*counts.parts, strict=True))) if counts.parts else (np.zeros(0, np.int64),) * 2
    return code // counts.width, code % counts.width, count


BLOB_COLUMNS = ("classes", "owners", "codes")
PARTS = f"fragment bigint, i int, j int, pairs bigint, {BLOB}"


def _part(reps: np.ndarray, x: np.ndarray, y: np.ndarray, count: np.ndarray, fragment: int = 0, i: int = -1, j: int = -1, pairs: int | None = None):
    """A row of ``PARTS``: counted pairs, or (``i`` from 0 on) of a tile's work: then x are owners, y numbers of lists, count the sides."""
    both = np.concatenate([x, y]) if i < 0 else x
    used, local = np.unique(both, return_inverse=True)
    owners = local.astype("<u4").tobytes() if i < 0 else local.astype("<u4").tobytes() + y.astype("<u4").tobytes()
    row = (fragment, i, j, len(x) if pairs is None else pairs, reps[used].tobytes(), owners, count.astype("<u4").tobytes())
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 3)
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [c.split()[0] for c in PARTS.split(", ")])


def _part_rows(reps: np.ndarray, x: np.ndarray, y: np.ndarray, count: np.ndarray) -> Iterator:
    for at in range(0, len(x), ROW_PAIRS):
        yield _part(reps, x[at:at + ROW_PAIRS], y[at:at + ROW_PAIRS], count[at:at + ROW_PAIRS])


def _list_steps(at: np.ndarray, to: np.ndarray, lists: int) -> Iterator[tuple[int, int]]:
    """Ranges of list numbers with about ``ROW_POSTINGS`` postings of both sides each: counts of a pair are summed later, so a
    tile's lists can be counted apart."""
    through = np.cumsum(np.bincount(at, minlength=lists) + np.bincount(to, minlength=lists))
    begin = 0
    while begin < lists:
        done = int(through[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(through, done + ROW_POSTINGS, side="right")))
        yield begin, end
        begin = end


def _fragment_parts(percent: int):
    """Of a fragment, rows of counted pairs; and where long lists make more than one tile, the work of each tile as a row."""
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reps, owner, codes = joined(pa.Table.from_batches(list(batches)), REP, "<u8")
        sizes, fragment = reps["n"].astype(np.int64), key[0].as_py()
        c, o, edge, length = _ordered(owner, codes)
        for x, y, count in _short_pairs(c, o, length, sizes, percent):
            yield from _part_rows(reps, x, y, count)
        hot, lists = _long_lists(o, edge, length)
        if len(hot) <= TILE:
            if len(hot):
                yield from _part_rows(reps, *_tile_pairs(lists, lists, True, hot, hot, sizes, percent))
            return
        ranges = []
        for i in range(0, len(hot), TILE):
            cut_lists = _range_of(lists, i)
            ranges.append((hot[i + np.concatenate(cut_lists)], np.repeat(np.arange(len(lists)), [len(x) for x in cut_lists])))
        for i in range(len(ranges)):
            for j in range(i, len(ranges)):
                (x, at), (y, to) = ranges[i], ranges[j]
                if i == j:
                    y, to = y[:0], to[:0]
                for k in _list_steps(at, to, len(lists)):
                    a, b = (slice(*np.searchsorted(z, k)) for z in (at, to))
                    side = np.repeat([0, 1], [a.stop - a.start, b.stop - b.start])
                    # without a second side in these lists there are no pairs
                    if i == j or side.any() and not side.all():
                        yield _part(reps, np.concatenate([x[a], y[b]]), np.concatenate([at[a], to[b]]), side, fragment, i, j, 0)

    return run


def _tile_parts(percent: int):
    """The counted pairs of each tile's work, whose rows follow each other: a pair leaves a tile once."""
    def counted(rows: list[tuple[bytes, bytes, bytes]]) -> Iterator:
        reps, owner, number, side, base = [], [], [], [], 0
        for classes, owners, codes in rows:
            both = np.frombuffer(owners, dtype="<u4")
            reps.append(np.frombuffer(classes, dtype=REP))
            owner.append(both[:len(both) // 2].astype(np.int64) + base), number.append(both[len(both) // 2:]), side.append(np.frombuffer(codes, dtype="<u4"))
            base += len(reps[-1])
        reps, index = np.unique(np.concatenate(reps), return_inverse=True)
        owner, number, side = index[np.concatenate(owner)], np.concatenate(number), np.concatenate(side)

        def lists(k: int) -> tuple[np.ndarray, list[np.ndarray]]:
            order = np.flatnonzero(side == k)
            order = order[np.argsort(number[order], kind="stable")]
            ids, local = np.unique(owner[order], return_inverse=True)
            edge = np.searchsorted(number[order], np.arange(int(number.max()) + 2))
            return ids, [local[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]

        a_ids, left = lists(0)
        b_ids, right = lists(1) if side.any() else (a_ids, left)
        return _part_rows(reps, *_tile_pairs(left, right, not side.any(), a_ids, b_ids, reps["n"].astype(np.int64), percent))

    def run(batches) -> Iterator:
        tile, rows = None, []
        for batch in batches:
            for f, i, j, *row in zip(*(batch.column(c).to_pylist() for c in ("fragment", "i", "j", *BLOB_COLUMNS)), strict=True):
                if rows and (f, i, j) != tile:
                    yield from counted(rows)
                    rows = []
                tile = f, i, j
                rows.append(row)
        if rows:
            yield from counted(rows)

    return run


def _of_group(run):
    def of(_: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(batches)

    return of


def _unpacked(rows: list[tuple[bytes, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct classes of rows of counted pairs, x < y and counts, summed per pair."""
    reps, xs, ys, counts, base = [], [], [], [], 0
    for a, b, c in rows:
        found, both = np.frombuffer(a, dtype=REP), np.frombuffer(b, dtype="<u4").astype(np.int64) + base
        xs.append(both[:len(both) // 2]), ys.append(both[len(both) // 2:]), counts.append(np.frombuffer(c, dtype="<u4"))
        reps.append(found)
        base += len(found)
    distinct, index = np.unique(np.concatenate(reps), return_inverse=True)
    x, y, width = index[np.concatenate(xs)], index[np.concatenate(ys)], np.int64(len(distinct))
    code, count = _summed(np.minimum(x, y) * width + np.maximum(x, y), np.concatenate(counts))
    return distinct, code // width, code % width, count


def block_side(partitions: int, pairs: int) -> int:
    """Blocks are pairs of so many sides: as many as there are partitions, or as hold ``BLOCK_PAIRS`` counted pairs each."""
    return int(np.ceil(np.sqrt(2 * max(partitions, -(-pairs // BLOCK_PAIRS)))))


def _blocks(sides: int):
    """Counted pairs, about ``BUFFER`` at once, dealt to blocks: a row per block."""
    def dealt(rows):
        reps, x, y, count = _unpacked(rows)
        side = (mix(reps["id"].astype(np.uint64)) % np.uint64(sides)).astype(np.int64)
        block = np.minimum(side[x], side[y]) * sides + np.maximum(side[x], side[y])
        order = np.argsort(block, kind="stable")
        edge = np.flatnonzero(np.concatenate([[True], np.diff(block[order]) > 0, [True]]))
        out = {"block": [], "classes": [], "owners": [], "codes": []}
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            at = order[a:b]
            used, local = np.unique(np.concatenate([x[at], y[at]]), return_inverse=True)
            out["block"].append(int(block[at[0]]))
            out["classes"].append(reps[used].tobytes())
            out["owners"].append(local.astype("<u4").tobytes())
            out["codes"].append(count[at].astype("<u4").tobytes())
        return record_batch(out)

    def run(batches) -> Iterator:
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("classes", "owners", "codes")), strict=True):
                rows.append(row)
                size += len(row[2]) // 4
                if size > BUFFER:
                    yield dealt(rows)
                    rows, size = [], 0
        if rows:
            yield dealt(rows)

    return run


def _roots(size: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each number, the least one that links connect it to."""
    root = np.arange(size)
    while True:  # hook to the smaller root and shorten, until every link is inside a tree
        a, b = root[x], root[y]
        if (a == b).all():
            return root
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != root[root]).any():
            root = root[root]


def _links(percent: int):
    """Sum the parts of a block's pairs; of each class with links: the root of its tree in the block and how many
    documents it is linked with."""
    def run(table):
        import pyarrow as pa

        distinct, x, y, shared = _unpacked(list(zip(*(table.column(c).to_pylist() for c in ("classes", "owners", "codes")), strict=True)))
        n = distinct["n"].astype(np.int64)
        ok = 100 * shared >= percent * (n[x] + n[y] - shared)
        x, y = x[ok], y[ok]
        root = _roots(len(distinct), x, y)
        m = distinct["m"].astype(np.int64)
        linked = np.zeros(len(distinct), dtype=np.int64)
        np.add.at(linked, x, m[y])
        np.add.at(linked, y, m[x])
        at = np.flatnonzero(linked)
        return pa.table({"a": pa.array(distinct["id"][at]), "b": pa.array(distinct["id"][root[at]]), "links": pa.array(linked[at])})

    return run


def _groups(sets: DataFrame, fragments: int, percent: int) -> DataFrame:
    """(key, component, parts) of the classes that may be similar to another: similar ones have the same component. ``parts``: fragments of its
    own that a large component needs, 0 for a small one."""
    rare = max(1, fragments * (100 - percent) // 100)
    levels = (sets.select("key", "codes").mapInArrow(_class_codes(fragments), f"fragment bigint, {BLOB}")
              .groupBy("fragment").applyInArrow(_class_levels(fragments), f"bucket bigint, fragment bigint, {BLOB}"))
    bucketed = sets.select("key", "codes", F.pmod("key", F.lit(fragments).cast("bigint")).alias("bucket"))
    edges = (bucketed.groupBy("bucket").cogroup(levels.groupBy("bucket")).applyInArrow(_rare_postings(rare, percent), f"fragment bigint, {BLOB}")
             .groupBy("fragment").applyInArrow(_chains(percent), "a bigint, b bigint"))
    grouped = connected_components(edges).withColumnRenamed("node", "key")
    sizes = grouped.join(sets.select("key", "n"), "key").groupBy("component").agg(F.sum("n").alias("postings"))
    own = F.when(4 * F.col("postings") > PAIR_POSTINGS, F.ceil(F.col("postings") / PAIR_POSTINGS)).otherwise(0).cast("bigint")
    return grouped.join(sizes.select("component", own.alias("parts")), "component")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, row_key: Column | None = None) -> DataFrame:
    """Per document row: doc_id, n_shingles (long), component_id (smallest doc_id reachable by links), n_links (documents
    whose shingle sets have a Jaccard similarity of at least ``percent`` % with this one, equal ones included).

    A null or blank text has no shingles and no links. Rows with a null doc_id are not compared: component_id is null,
    n_links 0. Repeated rows are equal documents; rows that share an id are each compared, and count as one node
    of the graph. Other columns are ignored. An empty table gives no rows. With ``row_key``, a long over the columns of ``docs``, rows
    also have that and the fingerprint of their set (f1, f2), which tell rows of one id apart.
    """
    spark = docs.sparkSession
    folder = new_state_path(spark, "jaccard")
    keyed = [] if row_key is None else [row_key.alias("row_key")]
    rows = docs.select(F.col("doc_id").cast("bigint"), "text", *keyed)
    docs = rows.select("doc_id", "text")
    rows.mapInArrow(_members, "doc_id bigint, n bigint, f1 bigint, f2 bigint" + ", row_key bigint" * len(keyed)).write.parquet(f"{folder}/members")
    members = spark.read.parquet(f"{folder}/members")
    classes = members.where("n > 0 AND doc_id IS NOT NULL").groupBy("f1", "f2").agg(
        F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.count("*").alias("m"))
    total = int(members.agg(F.sum("n")).first()[0] or 0)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))

    first = max(1, -(-int(total * HEAD) // HEAD_POSTINGS))
    packed = "owners binary, codes binary"
    gone = (docs.select("text").mapInArrow(_head_postings(round(first / HEAD), first), f"fragment bigint, slice bigint, {packed}")
            .groupBy("fragment").applyInArrow(_alone, f"slice bigint, {packed}, table boolean")
            .groupBy("slice").applyInArrow(_hopeless(percent), "f1 bigint, f2 bigint").distinct())
    classes.join(gone, ["f1", "f2"], "left_anti").select("rep", "m", "f1", "f2").write.parquet(f"{folder}/left")
    left = spark.read.parquet(f"{folder}/left")
    sieve_row(left.select(F.xxhash64("rep").alias("key"))).write.parquet(f"{folder}/sieve")
    held = may_hold(spark.read.parquet(f"{folder}/sieve").scalar(), F.xxhash64("doc_id"))  # other texts don't leave the scan
    (docs.where(held).join(left, F.col("doc_id") == left.rep).select("rep", "m", "f1", "f2", "text")
     .mapInArrow(_set_rows, "id bigint, n bigint, m bigint, key bigint, codes binary").write.parquet(f"{folder}/sets"))
    sets = spark.read.parquet(f"{folder}/sets")
    fragments = max(1, -(-int(sets.agg(F.sum("n")).first()[0] or 0) // PAIR_POSTINGS))

    (sets.join(_groups(sets, fragments, percent), "key").mapInArrow(_pair_postings(fragments), f"fragment bigint, {BLOB}")
     .groupBy("fragment").applyInArrow(_fragment_parts(percent), PARTS)
     .write.options(**ROW_FILES).parquet(f"{folder}/parts"))
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    small_batches(spark, ROW_BATCH)  # rows of counted pairs are long
    parts = spark.read.parquet(f"{folder}/parts")
    (parts.where("i >= 0").groupBy("fragment", "i", "j").applyInArrow(_of_group(_tile_parts(percent)), PARTS)
     .write.options(**ROW_FILES).parquet(f"{folder}/tiles"))
    counted = parts.where("i < 0").unionByName(spark.read.schema(PARTS).parquet(f"{folder}/tiles")).select(*BLOB_COLUMNS, "pairs")
    sides = block_side(partitions, int(counted.agg(F.sum("pairs")).first()[0] or 0))
    (counted.select(*BLOB_COLUMNS).mapInArrow(_blocks(sides), f"block int, {BLOB}")
     .groupBy("block").applyInArrow(_links(percent), "a bigint, b bigint, links bigint")
     .write.parquet(f"{folder}/links"))
    small_batches(spark, int(batch))
    links = spark.read.parquet(f"{folder}/links")
    component = connected_components(links.select("a", "b"))
    linked = links.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("others"))
    of_class = (classes.select("f1", "f2", "rep", "m").join(component, F.col("rep") == F.col("node"), "left").drop("node")
                .join(linked, "rep", "left"))
    found = members.alias("d").join(
        of_class.alias("c"), (F.col("d.f1") == F.col("c.f1")) & (F.col("d.f2") == F.col("c.f2")) & (F.col("d.n") > 0)
        & F.col("d.doc_id").isNotNull(), "left")
    return found.select(
        F.col("d.doc_id"), F.col("d.n").alias("n_shingles"),
        F.coalesce("c.component", "c.rep", "d.doc_id").alias("component_id"),
        F.coalesce(F.col("c.m") - 1 + F.coalesce("c.others", F.lit(0)), F.lit(0)).alias("n_links"),
        *[F.col(f"d.{c}") for c in ("row_key", "f1", "f2") if keyed])
