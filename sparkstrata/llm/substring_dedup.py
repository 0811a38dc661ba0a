"""Substring deduplication over prefix-partitioned suffix trees.

A suffix starts at every word. Only suffixes that can repeat take part: the
anchor of a suffix is the five-word gram with the least hash among its first
``WINDOW`` words, so suffixes that agree on ``WINDOW`` words agree on it. A first
pass counts the documents of each anchor and keeps the anchors of two or more; a
bit table of them, of bounded size, lets the second pass drop every other suffix
(a false positive only keeps a suffix longer than needed).

The remaining suffixes are split by a prefix of variable length. It is taken from
the anchor's hash rather than from the first word, so that suffixes that start
at neighbouring words mostly stay together and share one copy of their words
(a segment). As many leading bits count as the first pass's counts need to make
a group fit in ``GROUP_BYTES``, whatever the number of partitions; an anchor that
alone would fill a large part of a group has its prefix extended by the whole
window, of which a task sends one copy only. A group's suffix tree is its sorted
suffix array with the lengths of common prefixes: its nodes of depth ``WINDOW``
or more are the runs of suffixes whose neighbours share that many words, and a
node gives the least document below it. A longer maximal repeat has a node for
each of its windows; a document joins them again, as it drops what they cover.

Words are compared by their 64-bit hashes, windows word by word.

Rows that are shuffled hold packed arrays, one row for a task and group, in which
a task has already reduced every repeat to its smallest document, so a passage
that a third of the documents share adds no more to its group than any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkstrata.llm.common import arrow_schema, id_text, materialize, mix, n_partitions, record_batch, runs, sliced, texts, unpacked

WINDOW = 13
GRAM = 5
#: Most bits of the anchor table that is broadcast (64 MB).
MOST_BITS = 1 << 29
#: A task packs what it has gathered after so many words.
FLUSH_WORDS = 2_000_000
#: Bytes of a group of anchors or of suffixes, which one task holds in memory at a time.
GROUP_BYTES = 16 << 20
#: An anchor of more documents than this share of an average group has its prefix extended, from so many documents on.
HOT_SHARE, HOT_LEAST = 8, 64

SUFFIXES = "part long, place long, owner binary, text_hash binary, at binary, size binary, words binary"
PLACES = "place long, owner binary, text_hash binary, at binary"

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), U, len(words))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words."""
    n = len(h) - k + 1
    out = h[:n].copy()
    for j in range(1, k):
        out *= BASE
        out += h[j : j + n]
    return mix(out)


def anchors_of(h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """Anchor of each window of a document's word hashes, mixed again: least hashes alone would crowd the groups of low bits."""
    grams = gram_hashes(h, gram)
    n = len(h) - window + 1
    anchor = grams[:n].copy()
    for j in range(1, window - gram + 1):
        np.minimum(anchor, grams[j : j + n], out=anchor)
    return mix(anchor)


def _part(anchor: np.ndarray, bits: int) -> np.ndarray:
    return (anchor >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(anchor), np.int64)


def _documents(batches: Iterator[pa.RecordBatch], window: int):
    """(doc_id, words) of each row that has an id and a whole window."""
    for b in sliced(batches):
        for d, t in zip(b.column("doc_id").to_pylist(), texts(b)):
            if d is not None and len(words := t.split()) >= window:
                yield d, t, words


def _slots(anchor: np.ndarray, bits: int, per: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bit positions of an anchor within its group's slice of ``per`` bits."""
    low = anchor & U((1 << (64 - bits)) - 1) if bits else anchor
    return (low & U(per - 1)).astype(np.int64), (mix(low) & U(per - 1)).astype(np.int64)


def _bits(spark, n_bytes: int) -> int:
    """Leading bits that make groups of ``GROUP_BYTES`` of so many bytes, and one or more for each partition."""
    return max(4, (n_partitions(spark) - 1).bit_length() + 1, (-(-n_bytes // GROUP_BYTES) - 1).bit_length())


class _Bloom:
    """A bit table of anchors, two bits each, filled by groups of their leading bits."""

    def __init__(self, spark, rows: DataFrame, bits: int, n: int, most: int):
        """``rows``: (part, anchor), packed anchors by group; ``n`` of them; ``most`` bits."""
        per = self.per = max(1024, min(most, 1 << (16 * max(n, 1)).bit_length()) >> bits)
        self.bits = bits

        def table(batches):
            for b in batches:
                for p, blob in zip(b.column("part").to_pylist(), b.column("anchor").to_pylist()):
                    own = np.zeros(per, bool)
                    for slot in _slots(np.frombuffer(blob, U), bits, per):
                        own[slot] = True
                    yield record_batch({"part": [p], "bits": [np.packbits(own).tobytes()]}, arrow_schema("part long, bits binary"))

        filled = bytearray((per << bits) // 8)
        for row in rows.select("part", "anchor").mapInArrow(table, "part long, bits binary").toLocalIterator():
            filled[row.part * per // 8 : (row.part + 1) * per // 8] = row.bits
        self.held = spark.sparkContext.broadcast(bytes(filled))  # at most ``most`` bits, 1,024 for each group at least

    def has(self, anchor: np.ndarray) -> np.ndarray:
        bitset = np.frombuffer(self.held.value, np.uint8)
        part = _part(anchor, self.bits) * self.per
        out = np.ones(len(anchor), bool)
        for slot in _slots(anchor, self.bits, self.per):
            slot += part
            out &= (bitset[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 > 0
        return out


def shared_anchors(docs: DataFrame, bits: int, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(part, n, documents, anchor, times): of each group, the anchors that two or more documents of (doc_id, text) have, and of how many."""
    n = n_partitions(docs.sparkSession)
    schema = arrow_schema("part long, anchor binary, doc binary, times binary")

    def anchors(batches):
        found, owners, n_words = [], [], 0

        def flush():
            a, d = np.concatenate(found), np.concatenate(owners)
            found.clear(), owners.clear()
            order = np.lexsort((d, a))
            a, d = a[order], d[order]
            at = runs(a)
            first, last = at[:-1], at[1:] - 1
            times = np.minimum(np.diff(at), 65535).astype(np.uint16)
            two = np.flatnonzero(d[last] != d[first])  # the smallest and the largest document tell whether there are two
            place, kept = np.concatenate([first, last[two]]), np.concatenate([times, np.zeros(len(two), np.uint16)])
            order = np.argsort(place, kind="stable")
            a, d, times = a[place[order]], d[place[order]], kept[order]
            cut = np.searchsorted(_part(a, bits), np.arange((1 << bits) + 1))
            on = np.flatnonzero(np.diff(cut)).tolist()
            cols = {k: [v[cut[p] : cut[p + 1]].tobytes() for p in on] for k, v in (("anchor", a), ("doc", d), ("times", times))}
            return record_batch({"part": on} | cols, schema)

        for d, _, words in _documents(batches, window):
            a = np.unique(anchors_of(word_hashes(words), window, gram))
            found.append(a)
            owners.append(np.full(len(a), d, np.int64))
            n_words += len(words)
            if n_words >= FLUSH_WORDS:
                yield flush()
                n_words = 0
        if found:
            yield flush()

    out_schema = "part long, n long, documents long, anchor binary, times binary"

    def shared(batches):
        for p, cols in _groups(batches, 3):
            a, d, times = cols[0].view(U), cols[1].view(np.int64), cols[2].view(np.uint16)
            order = np.lexsort((d, a))
            a, d = a[order], d[order]
            at = runs(a)
            sums = np.add.reduceat(times[order].astype(np.int64), at[:-1])
            two = d[at[:-1]] != d[at[1:] - 1]
            keep, sums = a[at[:-1]][two], np.minimum(sums[two], (1 << 32) - 1)
            yield record_batch({"part": [p], "n": [len(keep)], "documents": [int(sums.sum())], "anchor": [keep.tobytes()], "times": [sums.astype(np.uint32).tobytes()]}, arrow_schema(out_schema))

    first = docs.mapInArrow(anchors, "part long, anchor binary, doc binary, times binary")
    return first.repartition(n, "part").sortWithinPartitions("part").mapInArrow(shared, out_schema)


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of spans of the given sizes, laid end to end."""
    upto = np.cumsum(size)
    return np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(start - (upto - size), size)


def suffix_nodes(words: np.ndarray, start: np.ndarray, owner: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, least): the suffix array of ``words`` at ``start``, and of each its node's least owner.

    Suffixes are sorted by their first ``window`` words, then by owner; a node of
    depth ``window`` is a run whose neighbours' common prefix has that length.
    """
    order = np.lexsort((owner, *(words[start + j] for j in range(window - 1, -1, -1))))
    at = start[order]
    common = np.zeros(max(len(at) - 1, 0), np.int64)  # length of the common prefix with the suffix before
    open_ = np.ones(len(common), bool)
    for j in range(window):
        w = words[at + j]
        open_ &= w[1:] == w[:-1]
        common += open_
    first = np.append(True, common < window) if len(at) else np.zeros(0, bool)
    nodes = np.flatnonzero(first)
    least = np.repeat(owner[order][nodes], np.diff(np.append(nodes, len(at))))
    return order, least


def repeated_words(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, th, at): positions of windows that also start in a document with a smaller id, a row for a document.

    th is the text's hash, so that rows that share a doc_id stay apart; such rows
    count as one document. at is a packed array of 32-bit word positions. Rows
    without id or with fewer words than a window give no rows.
    """
    spark = docs.sparkSession
    n = n_partitions(spark)
    docs = id_text(docs)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    bits = _bits(spark, size)  # an anchor takes 18 bytes and comes for every fifth word or so
    kept = materialize(shared_anchors(docs, bits, window, gram), "anchors")
    total = kept.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("documents"), F.lit(0)).alias("documents")).first()
    repeat = _Bloom(spark, kept, bits, total.n, MOST_BITS)
    fine = _bits(spark, total.documents * (window - gram + window) * 8)  # a segment's words
    hot_from = max(HOT_LEAST, total.documents // ((1 << fine) * HOT_SHARE))

    def hot_ones(batches):
        schema = arrow_schema("part long, n long, anchor binary")
        for b in batches:
            for p, a, times in zip(*(b.column(c).to_pylist() for c in ("part", "anchor", "times"))):
                a = np.frombuffer(a, U)[np.frombuffer(times, np.uint32) > hot_from]
                if len(a):
                    yield record_batch({"part": [p], "n": [len(a)], "anchor": [a.tobytes()]}, schema)

    hot_rows = materialize(kept.select("part", "anchor", "times").mapInArrow(hot_ones, "part long, n long, anchor binary"), "hot")
    hot = _Bloom(spark, hot_rows, bits, hot_rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n, MOST_BITS >> 3)

    def candidates(batches):
        schema = arrow_schema(SUFFIXES)
        found: list[tuple] = []
        n_words = 0

        def flush():
            """Each repeat's smallest document goes to its group; this task's others are known to repeat."""
            doc, th, words, a, on = (list(x) for x in zip(*found))
            base = np.cumsum([0, *map(len, words)])[:-1]
            words, size = np.concatenate(words), [len(x) for x in a]
            at, a = np.concatenate(on), np.concatenate(a)
            start = at + np.repeat(base, size)
            d, t = np.repeat(np.array(doc, np.int64), size), np.repeat(np.array(th, np.int64), size)
            whole = gram_hashes(words, window)[start]
            order = np.lexsort((d, whole, a))
            p = start[order]
            new = (np.diff(a[order]) != 0) | (np.diff(whole[order]) != 0)
            for j in range(window):
                w = words[p + j]
                new |= w[1:] != w[:-1]
            nodes = np.append(0, np.flatnonzero(new) + 1)
            later = np.zeros(len(p), bool)
            later[order] = d[order] > np.repeat(d[order][nodes], np.diff(np.append(nodes, len(p))))
            yield from _by_place(d[later], t[later], at[later], fine, schema)
            start, at, a, d, t, whole = (x[~later] for x in (start, at, a, d, t, whole))
            much = hot.has(a)
            prefix = np.where(much, mix(a ^ whole), a)
            # segments: neighbouring suffixes of one prefix that a document has
            new = np.append(True, (np.diff(start) != 1) | (np.diff(prefix) != 0) | (d[1:] != d[:-1]) | (t[1:] != t[:-1]))
            first = np.flatnonzero(new)
            n_starts = np.diff(np.append(first, len(start)))
            part = _part(prefix[first], fine)
            order = np.argsort(part, kind="stable")
            first, n_starts, part = first[order], n_starts[order], part[order]
            length = n_starts + window - 1
            packed = words[_spans(start[first], length)]
            ends = np.append(0, np.cumsum(length))
            cut = np.append(np.flatnonzero(np.append(True, np.diff(part) != 0)), len(part))
            rows = {k: [] for k in schema.names}
            for i, j in zip(cut[:-1], cut[1:]):
                s = first[i:j]
                own = {"owner": d[s], "text_hash": t[s], "at": at[s], "size": n_starts[i:j].astype(np.int32), "words": packed[ends[i] : ends[j]]}
                for k in rows:
                    rows[k].append(int(part[i]) if k == "part" else own[k].tobytes() if k in own else None)
            yield record_batch(rows, schema)

        for d, text, own in _documents(batches, window):
            h = word_hashes(own)
            a = anchors_of(h, window, gram)
            on = np.flatnonzero(repeat.has(a))
            n_words += len(h)
            if len(on):
                th = xxhash.xxh64_intdigest(text, 42)
                found.append((d, th - (1 << 64) if th >> 63 else th, h, a[on], on.astype(np.int32)))
            if n_words >= FLUSH_WORDS and found:
                yield from flush()
                found, n_words = [], 0
        if found:
            yield from flush()

    def trees(batches):
        """Places that tasks know already, which stand first, and those that the groups' trees give."""
        batches, names = iter(batches), ["part", "owner", "text_hash", "at", "size", "words"]
        rest: list[pa.RecordBatch] = []
        for b in batches:
            known = b.column("part").null_count
            if known:
                yield b.slice(0, known).select([f.name for f in arrow_schema(PLACES)])
            if known < b.num_rows:
                rest.append(b.slice(known))
                break
        for _, (d, t, at, size, words) in _groups((b.select(names) for b in chain(rest, batches)), 5):
            d, t, at, size, words = d.view(np.int64), t.view(np.int64), at.view(np.int32), size.view(np.int32), words.view(U)
            ends = np.cumsum(size.astype(np.int64) + window - 1)
            start = _spans(ends - size - window + 1, size)
            inside = start - np.repeat(ends - size - window + 1, size)
            d, t, at = np.repeat(d, size), np.repeat(t, size), np.repeat(at, size) + inside.astype(np.int32)
            order, least = suffix_nodes(words, start, d, window)
            later = order[d[order] > least]
            yield from _by_place(d[later], t[later], at[later], fine, arrow_schema(PLACES))

    def documents(batches):
        schema = arrow_schema("doc_id long, th long, at binary")
        for _, (d, t, at) in _groups(batches, 3):
            d, t, at = d.view(np.int64), t.view(np.int64), at.view(np.int32)
            order = np.lexsort((at, t, d))
            d, t, at = d[order], t[order], at[order]
            starts = runs(d, t)
            yield record_batch({"doc_id": d[starts[:-1]], "th": t[starts[:-1]], "at": [at[i:j].tobytes() for i, j in zip(starts[:-1], starts[1:])]}, schema)

    second = docs.mapInArrow(candidates, SUFFIXES).repartition(n, F.coalesce("part", "place"))
    found = second.sortWithinPartitions(F.col("part").isNotNull(), "part").mapInArrow(trees, PLACES)
    return found.repartition(n, "place").sortWithinPartitions("place").mapInArrow(documents, "doc_id long, th long, at binary")


def _groups(batches: Iterator[pa.RecordBatch], n: int):
    """(key, concatenated packed columns) of rows sorted by their first column."""
    part, cols = None, None
    for b in batches:
        keys = b.column(0).to_pylist()
        blobs = [b.column(k + 1).to_pylist() for k in range(n)]
        for k, p in enumerate(keys):
            if p != part:
                if part is not None:
                    yield part, [np.frombuffer(b"".join(c), np.uint8) for c in cols]
                part, cols = p, [[] for _ in range(n)]
            for c, x in zip(cols, blobs):
                c.append(x[k])
    if part is not None:
        yield part, [np.frombuffer(b"".join(c), np.uint8) for c in cols]


def _by_place(d: np.ndarray, t: np.ndarray, at: np.ndarray, bits: int, schema: pa.Schema):
    """Packed rows of documents' positions for each of 2^bits groups of documents."""
    if not len(d):
        return
    place = (mix(d.view(U) ^ t.view(U)) >> U(64 - bits)).astype(np.int64)
    order = np.argsort(place, kind="stable")
    d, t, at = d[order], t[order], at[order]
    cut = np.searchsorted(place[order], np.arange((1 << bits) + 1))
    rows = {k: [] for k in schema.names}
    for p in range(1 << bits):
        if cut[p] < cut[p + 1]:
            s = slice(cut[p], cut[p + 1])
            own = {"place": p, "owner": d[s].tobytes(), "text_hash": t[s].tobytes(), "at": at[s].tobytes()}
            for k in rows:
                rows[k].append(own.get(k))
    yield record_batch(rows, schema)


def covered(n_words: int, at: bytes, window: int = WINDOW) -> np.ndarray:
    """Which of a document's words lie in a window that starts at one of the packed positions."""
    p = np.frombuffer(at, np.int32)
    edge = np.bincount(p, minlength=n_words + 1) - np.bincount(p + window, minlength=n_words + 1)
    return np.cumsum(edge[:n_words]) > 0


def with_repeats(docs: DataFrame, columns: list[str] | None = None, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The documents (doc_id, text, other ``columns`` in rest) with ``at``, the packed positions of their repeated windows, or null."""
    found = repeated_words(docs, window, gram)
    own = id_text(docs, columns).withColumn("th", F.xxhash64("text"))
    n = n_partitions(docs.sparkSession)
    return own.repartition(n, "doc_id", "th").join(found, ["doc_id", "th"], "left").drop("th")


def dedup_digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document after its repeated words went.

    A word goes if a window of ``window`` words of its document covers it whose
    words also start in a document with a smaller doc_id; windows are judged on
    the input. Null text has no words; a row without doc_id neither loses words
    nor takes any from others; rows that share a doc_id do not remove each
    other's words. The order of rows has no influence.
    """
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    arrow = arrow_schema(schema)

    def run(batches):
        for b in sliced(batches):
            rows = []
            for d, text, at in zip(b.column("doc_id").to_pylist(), texts(b), b.column("at").to_pylist()):
                words = text.split()
                n = len(words)
                gone = 0
                if at:
                    hit = covered(n, at, window)
                    gone = int(hit.sum())
                    words = [w for w, x in zip(words, hit.tolist()) if not x]
                rows.append((d, n, gone, hashlib.sha256(b" ".join(words)).hexdigest()))
            if rows:
                yield record_batch(dict(zip(arrow.names, zip(*rows))), arrow)

    return with_repeats(docs, window=window).select("doc_id", "text", "at").mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the words that repeat from documents with a smaller doc_id.

    A removed word takes the white space after it along; all else stays as it
    is. n_chars is counted anew. Documents that had words and keep none go;
    documents without words stay.
    """
    import re

    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = with_repeats(docs, others, window)
    own = ["doc_id", "text", *(["rest"] if others else [])]
    schema = out.select(*own).schema
    word = re.compile(rb"[^\x20\x09-\x0D]+")

    def run(batches):
        for b in sliced(batches):
            new, keep = [], []
            for text, at in zip(texts(b), b.column("at").to_pylist()):
                if at:
                    starts = [m.start() for m in word.finditer(text)]
                    hit = covered(len(starts), at, window)
                    starts.append(len(text))
                    left = [text[starts[k] : starts[k + 1]] for k in np.flatnonzero(~hit)]
                    keep.append(bool(left))
                    new.append((text[: starts[0]] + b"".join(left)).decode())
                else:
                    keep.append(True)
                    new.append(text.decode())
            cols = {c: b.column(c) for c in own} | {"text": pa.array(new, pa.string())}
            yield pa.RecordBatch.from_pydict(cols).filter(pa.array(keep))

    out = out.select(*own, "at").mapInArrow(run, schema)
    out = out.select("doc_id", "text", *unpacked(out, others))
    if "n_chars" in others:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
