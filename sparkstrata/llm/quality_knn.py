"""Quality scores by nearest-neighbour voting over latent-semantic vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkstrata.llm.common import arrow_schema, id_text, record_batch, sliced, texts

#: Most labelled rows of each class whose vectors are broadcast. They are those
#: with the least hash of doc_id, so the choice doesn't depend on the partitions.
ROWS_PER_CLASS = 2048
#: Dimensions of the latent space.
DIMENSIONS = 64
#: Neighbours that vote.
NEIGHBOURS = 31
#: A neighbour's vote falls by e for each 1/SHARPNESS of cosine.
SHARPNESS = 25.0

#: Classes of bytes, in which terms are runs of three: letters (0), capitals (1),
#: digits (2), blanks (3), line ends (4), and kinds of marks; all else is 15.
KINDS = {1: b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2: b"0123456789", 3: b" \t", 4: b"\r\n", 5: b".", 6: b",", 7: b"!", 8: b"?", 9: b"|",
         10: b"%$&#*~^", 11: b"@", 12: b"\"'()[]{}<>", 13: b"/\\-_+=", 14: b":;"}
KIND = np.full(256, 15, np.uint16)
KIND[ord("a") : ord("z") + 1] = 0
KIND[128:] = 0
for _k, _b in KINDS.items():
    KIND[np.frombuffer(_b, np.uint8)] = _k

#: Weight of the counts of repetition and shape against the terms.
SHAPE = 1.5
N_TERMS = 4096
N_SHAPES = 8
FEATURES = N_TERMS + N_SHAPES


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, weights) of a text: frequencies of byte-class trigrams, and of repetition and shape."""
    kinds = KIND[np.frombuffer(text, np.uint8)]
    counts = np.bincount(kinds[:-2] * 256 + kinds[1:-1] * 16 + kinds[2:], minlength=N_TERMS) if len(kinds) > 2 else np.zeros(N_TERMS)
    ids = np.flatnonzero(counts)
    weights = np.sqrt(counts[ids])
    weights /= max(np.linalg.norm(weights), 1e-9)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    n, n_kinds = max(len(words), 1), np.bincount(kinds, minlength=16) / max(len(text), 1)
    again = sum(a == b for a, b in zip(words, words[1:])) / n
    shape = [
        again,
        1 - len(set(words)) / n if words else 0.0,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        min(len(text) / n / 20, 2.0) if words else 0.0,
        n_kinds[1],
        n_kinds[5:].sum(),
        n_kinds[2],
        1.0 if not words else 0.0,
    ]
    return np.append(ids, np.arange(N_TERMS, FEATURES)), np.append(weights, SHAPE * np.array(shape))


class Model:
    """Latent space, labelled vectors and their votes; everything a task needs to score."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, mass: tuple[float, float], dims: int = DIMENSIONS):
        x = np.zeros((len(rows), FEATURES), np.float32)
        for k, (ids, w) in enumerate(rows):
            x[k, ids] = w
        seen = (x > 0).sum(axis=0)
        self.idf = np.log((1 + len(rows)) / (1 + seen)).astype(np.float32) + 1
        self.idf[N_TERMS:] = 1
        x *= self.idf
        dims = min(dims, *x.shape)
        rng = np.random.default_rng(7)
        basis = rng.standard_normal((x.shape[1], dims + 8)).astype(np.float32)
        for _ in range(5):
            basis, _ = np.linalg.qr(x.T @ (x @ basis))
        _, _, vt = np.linalg.svd(x @ basis, full_matrices=False)
        self.axes = (basis @ vt[:dims].T).astype(np.float32)
        self.vectors = _unit(x @ self.axes)
        self.labels = labels.astype(np.float32)
        per = [mass[c] / max((labels == c).sum(), 1) for c in (0, 1)]
        self.mass = np.where(labels == 1, per[1], per[0]).astype(np.float32)
        self.mass /= self.mass.mean()

    def project(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return _unit(np.array([(w * self.idf[ids]).astype(np.float32) @ self.axes[ids] for ids, w in rows]))

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS) -> np.ndarray:
        """Share of the votes for label 1, by exact cosines with all labelled vectors, in blocks."""
        out = np.empty(len(rows))
        k = min(k, len(self.labels))
        for at in range(0, len(rows), 512):
            sims = self.project(rows[at : at + 512]) @ self.vectors.T
            near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            s = np.take_along_axis(sims, near, axis=1).astype(float)
            vote = np.exp(SHARPNESS * (s - s.max(axis=1, keepdims=True))) * self.mass[near]
            out[at : at + 512] = ((vote * self.labels[near]).sum(axis=1) + 1e-6) / (vote.sum(axis=1) + 2e-6)
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def held_out():
    """Rows whose labels are never used: crc32 of doc_id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = ROWS_PER_CLASS) -> Model | None:
    """The model of a bounded sample of the labelled rows that aren't held out; None if there are none."""
    own = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1) and doc_id is not null")
    own = own.where(~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    mass = {r.quality: float(r.n) for r in own.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if not mass:
        return None
    order = F.xxhash64("doc_id")
    chosen = {r.doc_id: r.quality for c in mass for r in own.where(F.col("quality") == c).orderBy(order, "doc_id").limit(per_class).collect()}
    ids = docs.sparkSession.createDataFrame([(d,) for d in sorted(chosen)], "doc_id long")
    schema = "doc_id long, ids binary, weights binary"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found = [features(t) for t in texts(b)]
            cols = {"doc_id": b.column("doc_id"), "ids": [x.astype(np.int32).tobytes() for x, _ in found], "weights": [w.astype(np.float32).tobytes() for _, w in found]}
            yield record_batch(cols, arrow)

    found = id_text(docs).join(F.broadcast(ids), "doc_id").mapInArrow(run, schema)  # at most 2 * per_class ids
    rows = {r.doc_id: (np.frombuffer(r.ids, np.int32), np.frombuffer(r.weights, np.float32)) for r in found.collect()}
    known = sorted(rows)
    if not known:
        return None
    return Model([rows[d] for d in known], np.array([chosen[d] for d in known]), (mass.get(0, 0.0), mass.get(1, 0.0)))


def quality_scores(docs: DataFrame, labels: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(doc_id, text, held_out, score, predicted) of every document, from its whole text alone, and any other ``columns`` in the struct rest.

    The score is the share of label 1 among the votes of the nearest labelled
    documents, 0.5 if no label can be learned from. Null text is empty and is
    scored like any text without words; a row without doc_id is scored too and
    counts as not held out. Labels other than 0 and 1 are ignored; of a
    document's repeated labels the greatest counts. Equal texts have scores that
    are equal up to rounding, as blocks of documents are multiplied together.
    """
    model = fit(docs, labels)
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2 * ROWS_PER_CLASS vectors and the axes: 3 MB
    own = id_text(docs, columns).withColumn("held_out", held_out())
    schema = own.withColumn("score", F.lit(0.5)).withColumn("predicted", F.lit(1)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found = [features(t) for t in texts(b)]
            score = held.value.score(found) if held.value else np.full(len(found), 0.5)
            cols = {c: b.column(c) for c in b.schema.names}
            yield pa.RecordBatch.from_pydict(cols | {"score": score, "predicted": (score >= 0.5).astype(np.int32)})

    return own.mapInArrow(run, schema)
