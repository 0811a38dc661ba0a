"""SimHash near-duplicate groups by covering locality-sensitive hashing.

Two fingerprints that differ in at most ``RADIUS`` bits agree on all bits of at
least one of 15 masks: give each bit position a vector of F_2^4; the (at most
three) positions that differ span at most three dimensions, so some non-zero
vector v is orthogonal to them all, and the mask of v, which holds the positions
whose vector is not orthogonal to v, leaves them out. Pairs meet in the table of
that mask for certain, not just with high probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkstrata.llm import shingle_sets
from sparkstrata.llm.common import arrow_schema, group_labels, id_text, map_batches, materialize, n_partitions, record_batch, runs, texts
from sparkstrata.llm.components import connected_components

RADIUS = 3
#: A bucket of more fingerprints is dealt out again by masks over its free bits.
BUCKET = 1024


def _masks(free: list[int]) -> list[int]:
    """The 15 covering masks over the given bit positions."""
    out = []
    for v in range(1, 1 << (RADIUS + 1)):
        out.append(sum(1 << bit for k, bit in enumerate(free) if (v & (k % 15 + 1)).bit_count() & 1))
    return out


MASKS = _masks(list(range(64)))
#: For each mask, itself joined with each covering mask of the bits it leaves free.
FINER = [[m | x for x in _masks([b for b in range(64) if not m >> b & 1])] for m in MASKS]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes, k: int = 3) -> int:
    """64-bit SimHash of the lower-cased ``k``-word shingles of a UTF-8 text, each as often as it occurs."""
    return sketch(shingle_sets.shingle_hashes(text, k))


def sketch(h: np.ndarray) -> int:
    """64-bit SimHash of hashes: the bits that more than half of them have."""
    n = len(h)
    if n == 1:
        return int(h[0])
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text as a signed long; null text is empty and gives 0."""

    def run(batch: pa.RecordBatch) -> dict:
        h = np.array([fingerprint(t, k) for t in texts(batch)], np.uint64).view(np.int64)
        return {"doc_id": batch.column("doc_id"), "fp": h}

    return map_batches(id_text(docs), run, "doc_id long, fp long")


def _near(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that join all fingerprints linked inside one bucket: a forest, not all pairs."""
    n = len(fp)
    label = np.arange(n)
    step = max(1, (1 << 20) // n)
    for at in range(0, n, step):
        a, b = np.nonzero(np.bitwise_count(fp[at : at + step, None] ^ fp[None, :]) <= RADIUS)
        keep = a + at < b
        if keep.any():
            x, y = label[a[keep] + at], label[b[keep]]
            label = group_labels(n, x, y)[label]
    child = np.flatnonzero(label != np.arange(n))
    return child, label[child]


def _bucket_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of rows (table, key, fp, id) that are sorted by table and key."""
    schema = arrow_schema("u long, v long")
    left: list[np.ndarray] | None = None

    def solve(cols: list[np.ndarray]) -> pa.RecordBatch | None:
        table, key, fp, ident = cols
        fp = fp.view(np.uint64)
        at = runs(table, key)
        size = np.diff(at)
        us, vs = [], []
        two = at[:-1][size == 2]
        two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= RADIUS]
        us.append(ident[two])
        vs.append(ident[two + 1])
        for k in np.flatnonzero(size > 2):
            own = ident[at[k] : at[k + 1]]
            child, root = _near(fp[at[k] : at[k + 1]])
            us.append(own[root])
            vs.append(own[child])
        u, v = np.concatenate(us), np.concatenate(vs)
        return record_batch({"u": u, "v": v}, schema) if len(u) else None

    for batch in batches:
        cols = [batch.column(k).to_numpy() for k in range(4)]
        if not len(cols[0]):
            continue
        if left is not None:
            cols = [np.concatenate(x) for x in zip(left, cols)]
        last = int(runs(cols[0], cols[1])[-2])
        left = [c[last:] for c in cols]
        if last and (out := solve([c[:last] for c in cols])) is not None:
            yield out
    if left is not None and (out := solve(left)) is not None:
        yield out


def near_edges(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(u, v): links that join all ids whose fingerprints are within the radius.

    ``distinct`` has (fp, id), each fingerprint once. A bucket of a table with
    more than ``bucket`` fingerprints is dealt out once more by covering masks of
    the bits that it leaves free, after which a bucket holds at most 2^16
    fingerprints whatever the input. Inside a bucket a spanning forest of the
    links is kept.
    """
    spark = distinct.sparkSession
    n = n_partitions(spark)
    tables = materialize(
        distinct.select(
            F.explode(F.array(*[F.struct(F.lit(k).alias("tab"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(MASKS)])).alias("t"),
            "fp", "id",
        ).select("t.tab", "t.key", "fp", "id"),
        "tables",
    )
    big = tables.groupBy("tab", "key").count().where(F.col("count") > bucket).select("tab", "key", F.lit(True).alias("big"))
    rows = tables.join(big, ["tab", "key"], "left")
    finer = F.array(*[F.array(*[F.lit(_signed(x)) for x in row]) for row in FINER])
    fine = rows.where("big").select(
        F.posexplode(F.element_at(finer, F.col("tab") + 1)).alias("j", "mask"), "tab", "fp", "id"
    ).select((F.col("tab") * 15 + F.col("j") + 15).cast("int").alias("tab"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp", "id")
    dealt = rows.where("big is null").select("tab", "key", "fp", "id").unionByName(fine)
    return dealt.repartition(n, "tab", "key").sortWithinPartitions("tab", "key").mapInArrow(_bucket_edges, "u long, v long")


def near_groups(docs: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): SimHash near-duplicate groups of whole texts.

    Documents link when their fingerprints differ in at most three bits;
    component_id is the smallest doc_id reachable, the document's own included.
    Texts without words (null, empty) have fingerprint 0 and link as any other.
    Equal fingerprints count once in the search, so copies cost no pairs. A row
    without doc_id keeps its fingerprint, takes the component of its
    fingerprint's other documents and never names one. No rows give no rows.
    """
    prints = materialize(fingerprints(docs, k), "prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("id")), "distinct")
    labels = connected_components(near_edges(distinct.where("id is not null")))
    found = distinct.join(labels, distinct.id == labels.node, "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return prints.join(found, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, k: int = 5) -> DataFrame:
    """``docs`` with one document of each group of near copies, that of the smallest doc_id.

    Near copies are texts whose ``k``-word shingle sets have a Jaccard similarity
    of 0.8 or more. Texts whose SimHash of these shingles differs in at most
    ``RADIUS`` bits are found by the covering tables; pairs at 0.8 differ in some
    ten bits, which no covering of use reaches, so tables of minima find the rest.
    The whole sets decide on both. Rows without doc_id can't be told apart and
    stay, as do rows that repeat the kept document's doc_id.
    """
    groups = shingle_sets.copy_groups(docs, k, sketch=sketch, close=near_edges)
    gone = materialize(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    return docs.join(gone, docs.doc_id.cast("long") == gone.gone, "left_anti")
