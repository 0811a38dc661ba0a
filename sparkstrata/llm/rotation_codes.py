"""Embedding near-duplicates by randomised-rotation binary codes.

Each unit vector o is rotated and kept as its signs; x is the unit vector of the
signs and f = <x, o> its correction factor. For any unit q, <x, q> / f is
an unbiased estimate of <o, q> over the rotations. With c = <o, q> it lies within
sqrt(1 - c^2) sqrt(1 - f^2) / f of c for certain, because x differs from f o only
at right angles to o. Only pairs whose upper bound reaches the threshold are
computed again in double precision, so no link can be lost.

Equal vectors count once. A label's distinct vectors are dealt into blocks of
equal size and each pair of blocks is one unit of work, so a label with a third
of all rows is many small units. A unit gives the sum of its partners for each
vector and a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkstrata.llm.common import arrow_schema, group_labels, materialize, n_partitions, record_batch
from sparkstrata.llm.components import connected_components

THRESHOLD = 0.98
#: Vectors in a block.
BLOCK = 2048
#: Room for the rounding of single-precision estimates.
SLACK = 1e-4


def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same for each call."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed signs, correction factors) of unit vectors."""
    turned = unit @ rotation(unit.shape[1]).T
    return np.packbits(turned > 0, axis=1, bitorder="little"), np.abs(turned).sum(axis=1) / np.sqrt(unit.shape[1])


def estimates(codes: np.ndarray, factors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Estimated inner products of encoded rows with unit query vectors."""
    dim = query.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dim, bitorder="little").astype(np.float32) * 2 - 1
    turned = (query @ rotation(dim).T).astype(np.float32)
    return (signs @ turned.T) / (np.sqrt(dim) * factors[:, None])


def least_estimate(factors: np.ndarray, threshold: float) -> np.ndarray:
    """The smallest estimate that a pair at or over the threshold can have."""
    return threshold - np.sqrt(1 - threshold**2) * np.sqrt(np.maximum(0, 1 - factors**2)) / factors - SLACK


def links(a: np.ndarray, b: np.ndarray, codes: np.ndarray, factors: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of ``a`` (encoded) and ``b`` with cosine at or over the threshold."""
    found = []
    for at in range(0, len(b), 512):
        part = b[at : at + 512]
        i, j = np.nonzero(estimates(codes, factors, part) >= least_estimate(factors, threshold)[:, None])
        for k in range(0, len(i), 1 << 16):
            x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            near = np.einsum("ij,ij->i", a[x], part[y]) >= threshold
            found.append((x[near], y[near] + at))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def near_links(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding, label).

    Vectors link when their labels are equal and their cosine, in double
    precision, is at or over ``threshold``. n_links counts the other rows linked
    directly, component_id is the smallest vec_id reachable, kept is true where
    that is the row's own. Null, empty and zero vectors, those with null or
    non-finite components, and rows without label link with nothing, and so do
    vectors of different lengths. Equal vectors link; rows that share a vec_id
    count as rows of their own. A row without vec_id counts as a partner, never
    names a component, and is kept only if it has no other to go to. No rows
    give no rows.
    """
    spark = vectors.sparkSession
    n = n_partitions(spark)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    schema = "vec_id long, label string, dim int, blob binary"
    arrow = arrow_schema(schema)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: dict = {"vec_id": b.column("vec_id"), "label": b.column("label"), "dim": [], "blob": []}
            for v, label in zip(b.column("embedding"), b.column("label").to_pylist()):
                x = v.values.to_numpy(zero_copy_only=False) if v.is_valid and label is not None else np.zeros(0)
                scale = np.abs(x).max(initial=0.0)
                fine = np.isfinite(scale) and scale > 0
                cols["dim"].append(len(x) if fine else None)
                cols["blob"].append((x / scale + 0.0).tobytes() if fine else None)
            if b.num_rows:
                yield record_batch(cols, arrow)

    rows = materialize(rows.mapInArrow(clean, schema), "vectors")
    distinct = materialize(
        rows.where("blob is not null").groupBy("label", "dim", "blob").agg(F.count("*").alias("n"), F.min("vec_id").alias("least")).withColumn("key", F.expr("uuid()")),
        "distinct",
    )
    keyed = distinct.select("label", "dim", "blob", "n", F.xxhash64("key").alias("id"))
    blocks = keyed.groupBy("label", "dim").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = materialize(keyed.join(blocks, ["label", "dim"]).withColumn("own", F.pmod("id", "blocks").cast("int")), "dealt")
    pairs = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        F.xxhash64("label", "dim").alias("group"), F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id", "n", "blob"
    )
    schema2 = "id long, other long, partners long"
    arrow2 = arrow_schema(schema2)

    def solve(key: tuple, own: np.ndarray, ids: np.ndarray, count: np.ndarray, blobs: list[bytes]) -> pa.RecordBatch | None:
        x = _unit(np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1))
        left = np.flatnonzero(own == key[1])
        right = np.flatnonzero(own == key[2])
        if not len(left) or not len(right):
            return None
        codes, factors = encode(x[left])
        i, j = links(x[left], x[right], codes, factors, threshold)
        i, j = left[i], right[j]
        far = i < j if key[1] == key[2] else np.ones(len(i), bool)
        i, j = i[far], j[far]
        if not len(i):
            return None
        partners = np.bincount(i, count[j], len(ids)) + np.bincount(j, count[i], len(ids))
        label = group_labels(len(ids), i, j)
        on = np.flatnonzero(partners)
        return record_batch({"id": ids[on], "other": ids[label[on]], "partners": partners[on].astype(np.int64)}, arrow2)

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []

        def done():
            own, ids, count = (np.concatenate([p[k] for p in parts]) for k in range(3))
            return solve(key, own, ids, count, [x for p in parts for x in p[3]])

        for b in batches:
            g, lo, hi, own, ids, count = (b.column(k).to_numpy() for k in range(6))
            blobs = b.column(6).to_pylist()
            edge = np.flatnonzero((np.diff(g) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0)) + 1
            for s, t in zip([0, *edge], [*edge, len(g)]):
                if s == t:
                    continue
                here = (g[s], lo[s], hi[s])
                if key is not None and here != key:
                    if (out := done()) is not None:
                        yield out
                    parts = []
                key = here
                parts.append((own[s:t], ids[s:t], count[s:t], blobs[s:t]))
        if parts and (out := done()) is not None:
            yield out

    found = materialize(pairs.repartition(n, "group", "lo", "hi").sortWithinPartitions("group", "lo", "hi").mapInArrow(units, schema2), "links")
    partners = found.groupBy("id").agg(F.sum("partners").alias("partners"))
    labels = connected_components(found.select("id", "other"))
    named = distinct.select("label", "dim", "blob", "n", "least", F.xxhash64("key").alias("id"))
    named = named.join(partners, "id", "left").join(labels, named.id == labels.node, "left").select(
        "label", "dim", "blob", "least", (F.coalesce("partners", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")
    )
    named = materialize(named, "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("label", "dim", "blob", "n_links", "component_id")
    linked = rows.where("blob is not null").join(named, ["label", "dim", "blob"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("blob is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
