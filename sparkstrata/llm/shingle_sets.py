"""Near copies by the exact Jaccard similarity of shingle sets.

Candidates come from ``TABLES`` independent fingerprints of a set, each the
combined minima of ``ROWS`` random orders of its shingles: two sets of similarity
s have one in common with probability 1 - (1 - s^5)^32, at 0.8 all but 3 in a
million pairs, above it fewer miss. A caller adds the candidates of its own
fingerprints. Documents that either join, directly or by others, are brought
together, and there every pair is decided by the exact similarity of the whole
sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkstrata.llm.common import arrow_schema, group_labels, id_text, map_batches, materialize, mix, n_partitions, record_batch, runs, texts
from sparkstrata.llm.components import connected_components

SEED = 42
TABLES = 32
ROWS = 5
#: Shingles that one task compares with each other at once; a larger group is dealt out by pairs of blocks.
BLOCK = 1 << 21
#: Most bits of the table of candidates that is broadcast (64 MB).
MOST_BITS = 1 << 29

_random = np.random.default_rng(SEED)
ODD = _random.integers(0, 1 << 64, TABLES * ROWS, np.uint64) | np.uint64(1)
FLIP = _random.integers(0, 1 << 64, TABLES * ROWS, np.uint64)


def shingle_hashes(text: bytes, k: int = 5) -> np.ndarray:
    """64-bit hashes of the lower-cased ``k``-word shingles of a UTF-8 text, each as often as it occurs; a text of fewer words is one shingle, one without words has none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    n = len(words) - k + 1
    if n <= 1:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: n - 1] + 1])
    return np.fromiter((digest(joined[i:j], SEED) for i, j in zip(starts.tolist(), ends[k - 1 :].tolist())), np.uint64, n)


def set_print(shingles: np.ndarray) -> int:
    """One number for a whole set, as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), SEED)).view(np.int64))


def table_keys(shingles: np.ndarray) -> np.ndarray:
    """The set's key in each table."""
    least = np.full(TABLES * ROWS, np.uint64((1 << 64) - 1))
    for at in range(0, len(shingles), 512):
        np.minimum(least, ((shingles[None, at : at + 512] ^ FLIP[:, None]) * ODD[:, None]).min(axis=1), out=least)
    key = np.arange(TABLES, dtype=np.uint64)
    for part in least.reshape(TABLES, ROWS).T:
        key = mix(key + part)
    return key.view(np.int64)


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each row with the one before where both have one key; rows (key, print) are sorted by key."""
    schema = arrow_schema("u long, v long")
    key, own = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for b in batches:
        key = np.append(key[-1:], b.column(0).to_numpy())
        own = np.append(own[-1:], b.column(1).to_numpy())
        on = np.flatnonzero(key[1:] == key[:-1])
        if len(on):
            yield record_batch({"u": own[on], "v": own[on + 1]}, schema)


def similar(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that join all sets linked by a similarity of 0.8 or more: a forest, not all pairs."""
    n = len(sets)
    size = np.fromiter(map(len, sets), np.int64, n)
    order = np.argsort(size, kind="stable")
    size = size[order]
    at = np.append(0, np.cumsum(size))
    kinds, codes = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)
    mark = np.zeros(len(kinds), np.int32)
    label = np.arange(n)
    for i in range(n - 1):
        end = int(np.searchsorted(size, size[i] * 5 // 4, "right"))
        far = label[i + 1 : end] != label[i]
        if not size[i] or not far.any():
            continue
        own = codes[at[i] : at[i + 1]]
        mark[own] = 1
        both = np.add.reduceat(mark[codes[at[i + 1] : at[end]]], at[i + 1 : end] - at[i + 1])
        mark[own] = 0
        for x in set(label[i + 1 : end][far & (9 * both >= 4 * (size[i] + size[i + 1 : end]))].tolist()):
            label[label == x] = label[i]
    # the last index of a label's members stands for it
    root = np.arange(n)
    root[label] = np.arange(n)
    child = np.flatnonzero(root[label] != np.arange(n))
    return order[child], order[root[label[child]]]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside each group of rows (component, a, b, print, shingles) that are sorted by the first three."""
    schema = arrow_schema("u long, v long")
    key, prints, sets = None, [], []

    def solve() -> pa.RecordBatch | None:
        child, root = similar(sets)
        own = np.array(prints, np.int64)
        return record_batch({"u": own[root], "v": own[child]}, schema) if len(child) else None

    for batch in batches:
        for c, a, b, own, shingles in zip(*(x.to_pylist() for x in batch.columns)):
            if (c, a, b) != key:
                if len(sets) > 1 and (out := solve()) is not None:
                    yield out
                key, prints, sets = (c, a, b), [], []
            prints.append(own)
            sets.append(np.frombuffer(shingles, np.uint64))
    if len(sets) > 1 and (out := solve()) is not None:
        yield out


def _slots(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.view(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def _bit_table(near: DataFrame) -> bytes:
    """A bit table of the ids of ``near``, of at most ``MOST_BITS``, that tells which texts need not be read again: beyond some ten million ids it passes more."""
    bits = max(1 << 16, min(MOST_BITS, 1 << (16 * near.count()).bit_length()))
    per = min(bits, 1 << 22)
    schema = arrow_schema("part long, slot long")

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slot = np.unique(_slots(b.column(0).to_numpy(), bits))
            yield record_batch({"part": slot // per, "slot": slot % per}, schema)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for b in batches:
            part, slot = (c.to_numpy() for c in b.columns)
            for p in np.unique(part).tolist():
                own.setdefault(p, np.zeros(per, bool))[slot[part == p]] = True
        for p, on in own.items():
            yield record_batch({"part": [p], "bits": [np.packbits(on).tobytes()]}, arrow_schema("part long, bits binary"))

    out = bytearray(bits // 8)
    rows = near.select("id").mapInArrow(slots, "part long, slot long").repartition(n_partitions(near.sparkSession), "part")
    for row in rows.mapInArrow(packed, "part long, bits binary").toLocalIterator():
        out[row.part * per // 8 : (row.part + 1) * per // 8] = row.bits
    return bytes(out)


def _one_print(hashes: np.ndarray) -> int:
    return 0


def copy_groups(docs: DataFrame, k: int = 5, block: int = BLOCK, sketch: Callable[[np.ndarray], int] = _one_print, close: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(doc_id, component_id): groups of whole texts whose ``k``-word shingle sets have a Jaccard similarity of 0.8 or more.

    component_id is the smallest doc_id that links reach, the document's own
    included. ``sketch`` makes an unsigned 64-bit fingerprint of a text's shingle
    hashes and ``close`` links (u, v) of distinct ones (fp, id); sets that they
    join are compared like those that the tables join. Texts without words (null,
    empty) have equal sets and are one group. Equal sets count once in the search, so exact copies cost no pairs. A
    row without doc_id takes the component of its set's other documents and never
    names one. No rows give no rows.
    """
    n = n_partitions(docs.sparkSession)
    plain = id_text(docs)

    def fingerprints(batch: pa.RecordBatch) -> dict:
        hashes = [shingle_hashes(t, k) for t in texts(batch)]
        sets = [np.unique(h) for h in hashes]
        fp = np.array([sketch(h) for h in hashes], np.uint64).view(np.int64)
        return {"doc_id": batch.column("doc_id"), "print": [set_print(s) for s in sets], "fp": fp, "keys": [table_keys(s).tobytes() for s in sets]}

    def keyed(batch: pa.RecordBatch) -> dict:
        keys = np.frombuffer(b"".join(batch.column("keys").to_pylist()), np.int64)
        return {"key": keys, "print": np.repeat(batch.column("print").to_numpy(), TABLES)}

    prints = materialize(map_batches(plain, fingerprints, "doc_id long, print long, fp long, keys binary"), "prints")
    distinct = materialize(prints.groupBy("print").agg(F.min("doc_id").alias("id")).where("id is not null"), "distinct")
    first = prints.join(distinct.withColumnRenamed("id", "doc_id"), ["print", "doc_id"]).select("print", "keys")
    tables = map_batches(first, keyed, "key long, print long").repartition(n, "key").sortWithinPartitions("key", "print")
    candidates = tables.mapInArrow(_chains, "u long, v long")
    if close is not None:
        sketched = prints.where("doc_id is not null").select("fp", "print").distinct()
        heads = materialize(sketched.groupBy("fp").agg(F.min("print").alias("id")), "heads")
        alike = sketched.join(heads, "fp").where("print <> id").select(F.col("id").alias("u"), F.col("print").alias("v"))
        candidates = candidates.unionByName(alike).unionByName(close(heads))
    near = connected_components(candidates)
    near = materialize(near.withColumnRenamed("node", "print").join(distinct, "print"), "near")
    held = docs.sparkSession.sparkContext.broadcast(_bit_table(near))

    def whole(batch: pa.RecordBatch) -> dict:
        """Sets of the documents that the bit table passes."""
        table = np.frombuffer(held.value, np.uint8)
        batch = batch.filter(pa.array(batch.column("doc_id").is_valid()))
        slot = _slots(batch.column("doc_id").to_numpy(), 8 * len(table))
        batch = batch.filter(pa.array((table[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).astype(bool)))
        sets = [np.unique(shingle_hashes(t, k)) for t in texts(batch)]
        return {"doc_id": batch.column("doc_id"), "print": [set_print(s) for s in sets], "n": [len(s) for s in sets], "shingles": [s.tobytes() for s in sets]}

    sets = map_batches(plain, whole, "doc_id long, print long, n long, shingles binary")
    # by both, as a repeated doc_id may have another text
    sets = sets.join(near.withColumnRenamed("id", "doc_id"), ["doc_id", "print"]).select("component", "print", "n", "shingles")
    sets = materialize(sets, "sets")
    blocks = sets.groupBy("component").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("print"), F.greatest("blocks", F.lit(1))).cast("int")
    dealt = sets.join(blocks, "component").withColumn("own", own)
    # each block meets each other one; a lone block meets itself
    others = F.expr("if(blocks > 1, filter(sequence(0, blocks - 1), x -> x <> own), array(own))")
    dealt = dealt.withColumn("other", F.explode(others)).select("component", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "print", "shingles")
    links = dealt.repartition(n, "component", "a", "b").sortWithinPartitions("component", "a", "b", "print").mapInArrow(_links, "u long, v long")
    found = materialize(connected_components(links), "found").withColumnRenamed("node", "print").withColumnRenamed("component", "root")
    least = distinct.join(found, "print").groupBy("root").agg(F.min("id").alias("least"))
    named = distinct.join(found.join(least, "root"), "print", "left").select("print", F.coalesce("least", "id").alias("component_id"))
    return prints.join(named, "print", "left").select("doc_id", "component_id")
