"""Removal of repeated spans by compaction of the token de Bruijn graph.

Edges are the ``K``-word windows of the texts, nodes their (K-1)-word ends. A path whose inner nodes have one way in and
one way out always occurs whole, so it is stored once per occurrence, by its first edge, its length and its source
coordinates; the earliest occurrence stays and the words of all others go.

1. Equal texts form a class; only the one with the smallest id enters the graph, the others go altogether.
2. A window's anchor is its smallest ``ANCHOR``-word code. Equal windows have equal anchors, so windows whose anchor
   stands at one place only are not repeated. Anchors are counted in fragments of their order, packed.
3. Nodes at windows with repeated anchors are grouped by code, with a tag of the words' windows before and behind. Nodes
   with several ways in or out, or at the end of a text, are where paths begin and end.
4. Spark chains each text's branching nodes to path occurrences, groups paths of the same first edge, last node and
   length, and joins every occurrence with the earliest one's coordinates. Paths that very many texts have are dealt over
   ``SALTS`` tasks each; at most ``HOT`` paths can be that frequent, and only they are broadcast.
5. Verification: a node carries the running code of all words before it, so the source coordinates of an occurrence give the code
   of its words between the ends. Paths whose occurrences all have the same one are equal word for word. Where they differ
   (two tags or node codes agreed by chance and hid a branch), the words of every occurrence are fetched from its source and
   compared with the earlier ones', and only words in windows that stand there too are removed.

Codes of words, windows and tags have 64 bits each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlens.llm.postings import BLOB, cut, joined, owner_bytes, record_batch, slices
from pairlens.llm.textcodes import _Q, _Q_INV, _powers, chunks, mix, sequence_code, window_codes, word_codes
from pairlens.session import new_state_path

K = 20
ANCHOR = 8
ANCHOR_POSTINGS = 2_000_000
NODE_POSTINGS = 1_000_000
HOT = 1_000  # a path with more than this share of all occurrences is dealt over SALTS tasks
SALTS = 64
TAG_BITS = 64
CLASS = np.dtype([("f1", "<i8"), ("f2", "<i8")])
DOC = np.dtype([("id", "<i8"), ("f1", "<i8")])
NODE = np.dtype([("code", "<u8"), ("at", "<u4"), ("before", "<u8"), ("behind", "<u8"), ("words", "<u8")])
_STEP = np.uint64(0x9E3779B97F4A7C15)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    if len(x) < width:
        return x[:0]
    low, span = x, 1
    while 2 * span <= width:
        low = np.minimum(low[:len(low) - span], low[span:])
        span *= 2
    rest = width - span
    return np.minimum(low[:len(low) - rest], low[rest:]) if rest else low


def _texts(batch) -> list[bytes]:
    return [(t or "").encode() for t in batch.column("text").to_pylist()]


def _coded(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Word codes of each text."""
    for a, b in chunks(texts):
        codes, begin = word_codes(texts[a:b])
        for s, e in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
            yield codes[s:e]


def fingerprint(codes: np.ndarray) -> tuple[int, int]:
    """128 bits of a word sequence, as two signed longs."""
    if not len(codes):
        return 0, 0
    pair = sequence_code(codes)[0], sequence_code(mix(codes + np.uint64(0x2545F4914F6CDD1D)))[0]
    return tuple(int(np.uint64(x).astype(np.int64)) for x in pair)


def _sha(text: bytes) -> str:
    return hashlib.sha256(b" ".join(text.split())).hexdigest()


def _members(batches) -> Iterator:
    import pyarrow as pa

    for batch in slices(batches):
        texts, rows = _texts(batch), []
        for doc, text, codes in zip(batch.column("doc_id").to_pylist(), texts, _coded(texts), strict=True):
            rows.append((doc, len(codes), *fingerprint(codes), _sha(text)))
        if rows:
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                             ["doc_id", "n_words", "f1", "f2", "sha"])


def running_code(codes: np.ndarray) -> np.ndarray:
    """Code of all words before each place, the end included; see ``between``."""
    total = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(mix(codes ^ _STEP) * _powers(_Q, len(codes)), out=total[1:])
    return total


def between(first: np.ndarray, last: np.ndarray, at: np.ndarray) -> np.ndarray:
    """From running codes at both ends, the code of the words from ``at`` on, wherever they stand."""
    return mix((last - first) * _powers(_Q_INV, int(at.max()) + 1 if len(at) else 0)[at])


def _anchors(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the anchor-sized windows, and the anchor of each ``k``-word window."""
    grams = window_codes(codes, ANCHOR)
    return grams, sliding_min(grams, k - ANCHOR + 1)


def _anchor_postings(fragments: int, k: int):
    """Distinct anchors of each class; the lowest bit of a posting's code says that the class has the words twice."""
    def run(batches) -> Iterator:
        for batch in slices(batches):
            seen, found = {}, []
            for codes in _coded(_texts(batch)):
                if len(codes) >= k and (f := fingerprint(codes)) not in seen:
                    seen[f] = True
                    grams, low = _anchors(codes, k)
                    distinct, count = np.unique(grams, return_counts=True)
                    low = np.unique(low)
                    twice = count[np.searchsorted(distinct, low)] > 1
                    found.append((low & ~np.uint64(1)) | twice.astype(np.uint64))
            if not found:
                continue
            classes = np.array(list(seen), dtype=CLASS)
            owner = np.repeat(np.arange(len(found), dtype=np.uint32), [len(x) for x in found])
            out = {"fragment": [], "classes": [], "owners": [], "codes": []}
            for part, codes, own in cut(np.concatenate(found), owner, fragments, fragments):
                used, local = np.unique(own, return_inverse=True)
                out["fragment"].append(part)
                out["classes"].append(classes[used].tobytes())
                out["owners"].append(owner_bytes(local, len(used)))
                out["codes"].append(codes.astype("<u4").tobytes())  # the low half
            yield record_batch(out)

    return run


def _empty(**kinds: str):
    import pyarrow as pa

    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.table({name: pa.array([], types[kind]) for name, kind in kinds.items()})


def _repeated_anchors(buckets: int):
    """Anchors that stand at two places or more, back to their classes, by buckets of classes."""
    def run(table):
        import pyarrow as pa

        classes, owner, codes = joined(table, CLASS, "<u4")
        order = np.lexsort((owner, codes))
        c, o = codes[order], owner[order]
        first = np.concatenate([[True], (c[1:] != c[:-1]) | (o[1:] != o[:-1])])
        c, o = c[first], o[first]
        words = c >> np.uint32(1)
        same = np.concatenate([[False], words[1:] == words[:-1]])
        keep = same | np.concatenate([same[1:], [False]]) | (c & np.uint32(1)).astype(bool)
        words, o = words[keep], o[keep]
        bucket = (classes["f1"].astype(np.uint64) % np.uint64(buckets)).astype(np.int64)[o]
        out = {"fragment": [], "block": [], "classes": [], "owners": [], "codes": []}
        part = table.column("fragment")[0].as_py()
        for b in np.unique(bucket):
            at = np.flatnonzero(bucket == b)
            used, local = np.unique(o[at], return_inverse=True)
            out["fragment"].append(part), out["block"].append(int(b)), out["classes"].append(classes[used].tobytes())
            out["owners"].append(owner_bytes(local, len(used))), out["codes"].append(words[at].astype("<u4").tobytes())
        return pa.Table.from_batches([record_batch(out)]) if out["block"] else _empty(
            fragment="long", block="int", classes="binary", owners="binary", codes="binary")

    return run


def _anchor_key(fragment: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (fragment.astype(np.uint64) << np.uint64(32)) | low.astype(np.uint64)


def _by_class(table):
    """One row per class: the keys of its repeated anchors."""
    import pyarrow as pa

    found, keys = [], []
    for part, a, b, c in zip(*(table.column(x).to_pylist() for x in ("fragment", "classes", "owners", "codes")), strict=True):
        classes, low = np.frombuffer(a, dtype=CLASS), np.frombuffer(c, dtype="<u4")
        found.append(classes[np.frombuffer(b, dtype="<u2" if len(b) == 2 * len(low) else "<u4")])
        keys.append(_anchor_key(np.full(len(low), part), low))
    distinct, index = np.unique(np.concatenate(found), return_inverse=True)
    keys = np.concatenate(keys)
    order = np.lexsort((keys, index))
    edge = np.searchsorted(index[order], np.arange(len(distinct) + 1))
    keys = keys[order].astype("<u8")
    return pa.table({"f1": pa.array(distinct["f1"]), "f2": pa.array(distinct["f2"]), "anchors": pa.array(
        [keys[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())})


def _node_postings(anchor_fragments: int, fragments: int, k: int):
    """Nodes at both ends of the windows whose anchor is repeated."""
    def run(batches) -> Iterator:
        from pairlens.llm.postings import fragment_of

        for batch in slices(batches):
            docs, postings = [], []
            for doc, f1, f2, anchors, codes in zip(*(batch.column(c).to_pylist() for c in ("rep", "f1", "f2", "anchors")), _coded(_texts(batch)), strict=True):
                if fingerprint(codes) != (f1, f2):
                    continue  # another text under the same id
                _, low = _anchors(codes, k)
                known = np.frombuffer(anchors, dtype="<u8")
                key = _anchor_key(fragment_of(low, anchor_fragments), (low & np.uint64(0xFFFFFFFF)) >> np.uint64(1))
                edge = known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key
                if not edge.any():
                    continue
                nodes, windows = window_codes(codes, k - 1), window_codes(codes, k)
                tags = np.maximum(windows >> np.uint64(64 - TAG_BITS), np.uint64(1))  # 0: no window
                at = np.flatnonzero(np.concatenate([edge, [False]]) | np.concatenate([[False], edge]))
                p = np.zeros(len(at), dtype=NODE)
                p["code"], p["at"] = nodes[at], at
                none = np.zeros(1, np.uint64)
                p["before"], p["behind"] = np.concatenate([none, tags])[at], np.concatenate([tags, none])[at]
                p["words"] = running_code(codes)[at]
                docs.append((doc, f1))
                postings.append(p)
            if not docs:
                continue
            table, every = np.array(docs, dtype=DOC), np.concatenate(postings)
            owner = np.repeat(np.arange(len(docs), dtype=np.uint32), [len(p) for p in postings])
            out = {"fragment": [], "classes": [], "owners": [], "codes": []}
            for part, index, own in _cut_nodes(every, owner, fragments):
                used, local = np.unique(own, return_inverse=True)
                out["fragment"].append(part)
                out["classes"].append(table[used].tobytes())
                out["owners"].append(owner_bytes(local, len(used)))
                out["codes"].append(index.tobytes())
            yield record_batch(out)

    return run


def _cut_nodes(nodes: np.ndarray, owner: np.ndarray, fragments: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    place = np.arange(len(nodes))
    for part, _, at in cut(nodes["code"].astype(np.uint64), place, fragments, fragments):
        yield part, nodes[at], owner[at]


def _branching(table):
    """Occurrences of nodes that come twice or more and have several ways in or out, or an end of a text beside them."""
    import pyarrow as pa

    docs, owner, nodes = joined(table, DOC, NODE)
    order = np.argsort(nodes["code"], kind="stable")
    nodes, owner = nodes[order], owner[order]
    edge = np.flatnonzero(np.concatenate([[True], nodes["code"][1:] != nodes["code"][:-1]]))
    length = np.diff(np.append(edge, len(nodes)))
    single = np.ones(len(edge), dtype=bool)
    for tag in ("before", "behind"):
        low, high = np.minimum.reduceat(nodes[tag], edge), np.maximum.reduceat(nodes[tag], edge)
        single &= (low == high) & (low > 0)
    at = np.flatnonzero(np.repeat((length > 1) & ~single, length))
    if not len(at):
        return _empty(doc="long", f1="long", at="long", node="long", behind="long", words="long")
    n = nodes[at]
    return pa.table({"doc": pa.array(docs["id"][owner[at]]), "f1": pa.array(docs["f1"][owner[at]]), "at": pa.array(n["at"].astype(np.int64)),
                     **{name: pa.array(n[c].astype(np.uint64).view(np.int64)) for name, c in (("node", "code"), ("behind", "behind"), ("words", "words"))}})


def _cleaned(k: int):
    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches):
            rows = []
            for doc, spans, text in zip(batch.column("doc").to_pylist(), batch.column("spans").to_pylist(), _texts(batch), strict=True):
                words = text.split()
                gone = np.zeros(len(words) + 1, dtype=np.int64)
                for s in spans:
                    gone[s["at"]] += 1
                    gone[s["at"] + s["edges"] + k - 1] -= 1
                kept = [w for w, g in zip(words, np.cumsum(gone[:-1]).tolist(), strict=True) if not g]
                rows.append((doc, batch.column("f1")[len(rows)].as_py(), len(words) - len(kept), b" ".join(kept).decode()))
            if rows:
                kinds = [pa.int64()] * 3 + [pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                                                 ["doc", "f1", "n_removed", "kept"])

    return run


def repeated_paths(docs: DataFrame, members: DataFrame, k: int = K) -> DataFrame:
    """Occurrences of repeated paths: doc, f1, at (first word), edges (windows), path and end (with edges, the path's key), first (the
    earliest occurrence's doc and at) and equal (all occurrences have the same words)."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    long = members.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= k))
    classes = long.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"))
    total = int(long.agg(F.sum("n_words")).first()[0] or 0)
    anchor_fragments = max(1, -(-total // (7 * ANCHOR_POSTINGS)))  # an anchor in about seven words
    anchors = (docs.select("text").mapInArrow(_anchor_postings(anchor_fragments, k), f"fragment bigint, {BLOB}")
               .groupBy("fragment").applyInArrow(_repeated_anchors(partitions), f"fragment bigint, block int, {BLOB}")
               .groupBy("block").applyInArrow(_by_class, "f1 bigint, f2 bigint, anchors binary"))
    wanted = classes.join(anchors, ["f1", "f2"])
    fragments = max(1, -(-total // (3 * NODE_POSTINGS)))
    nodes = (docs.join(wanted, docs.doc_id == wanted.rep).select("rep", "f1", "f2", "anchors", "text")
             .mapInArrow(_node_postings(anchor_fragments, fragments, k), f"fragment bigint, {BLOB}")
             .groupBy("fragment").applyInArrow(_branching, "doc bigint, f1 bigint, at bigint, node bigint, behind bigint, words bigint"))
    chain = Window.partitionBy("doc", "f1").orderBy("at")
    runs = (nodes.withColumns({"edges": F.lead("at").over(chain) - F.col("at"), "end": F.lead("node").over(chain),
                               "after": F.lead("words").over(chain)})
            .where("edges IS NOT NULL").withColumn("path", F.xxhash64("node", "behind"))
            .select("doc", "f1", "at", "edges", "path", "end", "words", "after")
            .mapInArrow(_verified, "doc bigint, f1 bigint, at bigint, edges bigint, path bigint, end bigint, words bigint"))
    folder = new_state_path(spark, "paths")
    runs.write.parquet(f"{folder}/runs")
    runs, same = spark.read.parquet(f"{folder}/runs"), ["path", "end", "edges"]
    (runs.groupBy(*same).agg(F.count("*").alias("n"), F.min(F.struct("doc", "at")).alias("first"),
                             (F.min("words") == F.max("words")).alias("equal"))
     .where("n > 1").write.parquet(f"{folder}/paths"))
    paths = spark.read.parquet(f"{folder}/paths")
    often = max(SALTS, runs.count() // HOT)
    hot = paths.where(F.col("n") > often).select(*same, F.lit(True).alias("hot"))  # at most HOT rows
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc", "at"), F.lit(SALTS))).otherwise(0).cast("int").alias("salt")
    salts = F.explode(F.when(F.col("n") > often, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt")
    return (runs.join(F.broadcast(hot), same, "left").select("doc", "f1", "at", "edges", "path", "end", salt)
            .join(paths.select(*same, "first", "equal", salts), [*same, "salt"]).select("doc", "f1", "at", "edges", "path", "end", "first", "equal"))


def _verified(batches) -> Iterator:
    """The code of a path's words before its last node, from the running codes at its ends."""
    import pyarrow as pa

    for batch in batches:
        at, first, last = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("at", "words", "after"))
        code = between(first.view(np.uint64), last.view(np.uint64), at)
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc", "f1", "at", "edges", "path", "end")], pa.array(code.view(np.int64))],
                                         ["doc", "f1", "at", "edges", "path", "end", "words"])


def _window_rows(k: int):
    """Of every occurrence of an unequal path the codes of its windows: doc, f1, at (the window's), code."""
    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches):
            rows: list[tuple] = []
            for doc, f1, spans, codes in zip(*(batch.column(c).to_pylist() for c in ("doc", "f1", "spans")), _coded(_texts(batch)), strict=True):
                windows = window_codes(codes, k).view(np.int64).tolist()
                rows += [(doc, f1, i, windows[i]) for s in spans for i in range(s["at"], s["at"] + s["edges"])]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 4,
                                             ["doc", "f1", "at", "code"])

    return run


def _compared(docs: DataFrame, unequal: DataFrame, k: int) -> DataFrame:
    """Spans (doc, f1, at, edges) of the windows of unequal paths' occurrences that an earlier occurrence has too, each one
    window: words are compared at their source coordinates."""
    spans = unequal.groupBy("doc", "f1").agg(F.collect_list(F.struct("at", "edges")).alias("spans"))  # of one document
    windows = (docs.join(spans, docs.doc_id == spans.doc).select("doc", "f1", "spans", "text")
               .mapInArrow(_window_rows(k), "doc bigint, f1 bigint, at bigint, code bigint").distinct())
    earliest = windows.groupBy("code").agg(F.min(F.struct("doc", "at")).alias("first"))
    return (windows.join(earliest, "code").where("doc <> first.doc OR at <> first.at")
            .select("doc", "f1", "at", F.lit(1).cast("bigint").alias("edges")))


def without_repeats(docs: DataFrame, k: int = K) -> DataFrame:
    """Per document row: doc_id, n_words, n_removed (long), kept (string: what is left, joined by blanks) where words were
    removed, else null, and kept_sha256.

    A null text has no words. Rows with a null doc_id are left as they are and are no source for others. Of equal
    texts the smallest id is the source; repeated rows with that id all stay. Rows that share an id but not the text
    count as one document's. Other columns are ignored; an empty table gives no rows.
    """
    spark, folder = docs.sparkSession, new_state_path(docs.sparkSession, "debruijn")
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    docs.mapInArrow(_members, "doc_id bigint, n_words bigint, f1 bigint, f2 bigint, sha string").write.parquet(folder)
    members = spark.read.parquet(folder)
    paths = repeated_paths(docs, members, k)
    later = (paths.where("equal AND (doc <> first.doc OR at <> first.at)").select("doc", "f1", "at", "edges")
             .unionByName(_compared(docs, paths.where("NOT equal"), k)))
    spans = later.groupBy("doc", "f1").agg(F.collect_list(F.struct("at", "edges")).alias("spans"))  # of one document
    changed = (docs.join(spans, docs.doc_id == spans.doc).select("doc", "f1", "spans", "text")
               .mapInArrow(_cleaned(k), "doc bigint, f1 bigint, n_removed bigint, kept string"))
    first = members.where("doc_id IS NOT NULL").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"))
    rows = (members.alias("m").join(first.alias("c"), (F.col("m.f1") == F.col("c.f1")) & (F.col("m.f2") == F.col("c.f2")), "left")
            .join(changed.distinct().alias("x"), (F.col("m.doc_id") == F.col("x.doc")) & (F.col("m.f1") == F.col("x.f1")), "left"))
    copy = F.coalesce((F.col("m.doc_id") > F.col("c.rep")) & (F.col("m.n_words") >= k), F.lit(False))
    kept = F.when(copy, F.lit("")).otherwise(F.col("x.kept"))
    return rows.select(
        F.col("m.doc_id"), F.col("m.n_words"),
        F.when(copy, F.col("m.n_words")).otherwise(F.coalesce("x.n_removed", F.lit(0))).alias("n_removed"),
        kept.alias("kept"), F.when(kept.isNull(), F.col("m.sha")).otherwise(F.sha2(kept, 256)).alias("kept_sha256"))
