"""SimHash document fingerprints and their search in permuted block tables.

Each term of a text votes with its weight on every bit of the fingerprint: for
the bit where the term's hash has it, against it elsewhere. For the search the
bits are split into RADIUS + 2 blocks. Two fingerprints within the radius agree
on at least two blocks, so each table puts two blocks first, and the pairs
within the radius stand together in at least one table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkstrata.llm.common import arrow_schema, group_labels, id_text, materialize, mix, n_partitions, record_batch, runs, sliced
from sparkstrata.llm.components import connected_components
from sparkstrata.llm.ordered import in_one_task, in_ranges

#: Bits of a fingerprint.
BITS = 128
#: Most differing bits that the search finds.
RADIUS = 3
#: A bucket of more fingerprints is dealt out again by a further block.
BUCKET = 1024


def fingerprint(text: str) -> tuple[int, int]:
    """The two halves of a text's fingerprint; a text without words has 0.

    Terms are the words, lower-cased, and the pairs of neighbouring words; a
    term's weight is that of its words times 1 + log of its count.
    """
    words = text.lower().encode().split()
    if not words:
        return 0, 0
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    # longer words say more about a text than short ones, which are often function words
    weight = np.minimum(np.fromiter(map(len, words), np.float64, len(words)), 16) ** 1.5
    pairs = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    terms, first, count = np.unique(np.concatenate([h, pairs]), return_index=True, return_counts=True)
    w = np.concatenate([weight, (weight[:-1] + weight[1:]) / 2])[first] * (1 + np.log(count))
    out = []
    for salt in (0x2545F4914F6CDD1D, 0xA0761D6478BD642F):
        bits = np.unpackbits(mix(terms ^ np.uint64(salt)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes = w.astype(np.float32) @ bits.astype(np.float32)
        out.append(int(np.packbits(votes * 2 > w.sum(), bitorder="little").view(np.uint64)[0]))
    return out[0], out[1]


def likeness(a: tuple[int, int], b: tuple[int, int]) -> float:
    """Estimated cosine of the term vectors, 0 at least: the cosine of the angle that the share of differing bits measures."""
    far = (a[0] ^ b[0]).bit_count() + (a[1] ^ b[1]).bit_count()
    return max(0.0, math.cos(math.pi * far / BITS))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, hi, lo): the fingerprint of every whole text as two signed longs; null text is empty."""
    schema = "doc_id long, hi long, lo long"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprint(t) for t in b.column("text").to_pylist()]
            if found:
                yield record_batch({"doc_id": b.column("doc_id"), "hi": [_signed(x) for x, _ in found], "lo": [_signed(x) for _, x in found]}, arrow)

    return id_text(docs).mapInArrow(run, schema)


def with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, in which the next document's start replaces the latter half.

    Rows: doc_id, n_chars, edited_sha256, hi, lo, edited_hi, edited_lo,
    near_edited, near_next. The next document is the next in ascending doc_id,
    after the last the first; the edit puts as many code points of it (or all)
    in place of the last floor(n_chars / 2). Null text is empty; empty texts
    have fingerprint 0. Rows without doc_id come before all others; rows that
    share a doc_id are ordered by the text's first 64 characters, its hash and
    the text. A lone row is its own next.
    """
    columns = "doc_id long, n_chars long, edited_sha256 string, hi long, lo long, edited_hi long, edited_lo long, near_edited double, near_next double"
    schema = f"{columns}, part int, side int, text string"
    arrow, plain = arrow_schema(schema), arrow_schema(columns)
    keyed = id_text(docs).select("doc_id", F.substring("text", 1, 64).alias("start"), F.xxhash64("text").alias("hash"), "text")

    def edit(doc_id: int | None, text: str, print_: tuple[int, int], after: str, next_print: tuple[int, int]) -> tuple:
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        e = fingerprint(edited)
        return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), *map(_signed, print_), *map(_signed, e), likeness(print_, e), likeness(print_, next_print)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All rows but a range's last; its first (side 0) and last (side 1) with their texts."""
        held = None  # (doc_id, text, fingerprint)
        part = 0
        border = lambda side: (held[0], *[None] * 8, part, side, held[1])
        for b in sliced(batches):
            rows = []
            for part, d, text in zip(*(b.column(c).to_pylist() for c in ("part", "doc_id", "text"))):
                own = fingerprint(text)
                if held:
                    rows.append((*edit(*held, text, own), None, None, None))
                held, first = (d, text, own), held is None
                if first:
                    rows.append(border(0))
            if rows:
                yield record_batch(dict(zip(arrow.names, zip(*rows))), arrow)
        if held:
            yield record_batch(dict(zip(arrow.names, ([x] for x in border(1)))), arrow)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The last row of each range with the first of the next, of the last range with the very first."""
        held = start = None
        one = lambda row: record_batch(dict(zip(plain.names, ([x] for x in row))), plain)
        for b in batches:
            for d, side, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "side", "text"))):
                if side:
                    held = d, text, fingerprint(text)
                    continue
                start = start or (text, fingerprint(text))
                if held:
                    yield one(edit(*held, text, fingerprint(text)))
        if held and start:
            yield one(edit(*held, *start))

    done = materialize(in_ranges(keyed, ["doc_id", "start", "hash"], ["text"]).select("part", "doc_id", "text").mapInArrow(run, schema), "edits")
    ends = in_one_task(done.where("side is not null").select("doc_id", "part", "side", "text"), "part", "side").mapInArrow(close, columns)
    return done.where("side is null").select(*plain.names).unionByName(ends)


def blocks(bits: int, n: int) -> list[tuple[int, int]]:
    """(start, end) of ``n`` blocks of nearly equal size."""
    return [(bits * k // n, bits * (k + 1) // n) for k in range(n)]


def _mask(parts: list[tuple[int, int]]) -> int:
    return sum(((1 << (b - a)) - 1) << a for a, b in parts)


def near_groups(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(hi, lo, near_id): for each distinct fingerprint the smallest doc_id reachable over links within ``radius`` bits.

    Equal fingerprints count once. A bucket of more than ``bucket`` fingerprints
    is dealt out again by pieces of the bits that its table leaves free, one more
    than the radius, of which one agrees. One that is still larger is split into
    blocks, each pair of which is a unit of work of its own, so no task compares
    more than two blocks at a time; only there work grows with the square of a
    bucket. A unit gives a spanning forest of its links. Fingerprints that only
    rows without doc_id have are left out.
    """
    n = n_partitions(prints.sparkSession)
    distinct = materialize(prints.where("doc_id is not null").groupBy("hi", "lo").agg(F.min("doc_id").alias("id")), "prints")

    def structs(masks: dict[int, int]):
        both = lambda m: F.struct(F.lit(_signed(m >> 64)).alias("h"), F.lit(_signed(m & ((1 << 64) - 1))).alias("l"))
        return F.array(*[F.struct(F.lit(t).alias("tab"), both(m).alias("m")) for t, m in masks.items()])

    def dealt(rows: DataFrame, masks) -> DataFrame:
        keyed = rows.select(F.explode(masks).alias("t"), "hi", "lo", "id")
        keys = F.col("hi").bitwiseAND(F.col("t.m.h")).alias("k1"), F.col("lo").bitwiseAND(F.col("t.m.l")).alias("k2")
        return materialize(keyed.select("t.tab", *keys, "hi", "lo", "id"), "tables")

    masks = {k: _mask(list(two)) for k, two in enumerate(combinations(blocks(BITS, radius + 2), 2))}
    key = ["tab", "k1", "k2"]

    def large(rows: DataFrame) -> tuple[DataFrame, list[int]]:
        counts = rows.groupBy(*key).count().where(F.col("count") > bucket)
        big = materialize(counts.select(*key, F.ceil(F.col("count") / bucket).alias("n_blocks")), "big")
        return big, sorted(r.tab for r in big.select("tab").distinct().collect())  # tables, a fixed number

    rows = dealt(distinct, structs(masks))
    big, tabs = large(rows)
    small = rows
    if tabs:
        finer: dict[int, dict[int, int]] = {t: {} for t in tabs}
        for t in tabs:
            free = [b for b in range(BITS) if not masks[t] >> b & 1]
            for j in range(radius + 1):
                finer[t][len(masks) + t * (radius + 1) + j] = masks[t] | sum(1 << b for b in free[j :: radius + 1])
        of_tab = F.create_map(*[x for t in tabs for x in (F.lit(t), structs(finer[t]))])
        fine = dealt(rows.join(big, key, "left_semi"), F.element_at(of_tab, F.col("tab")))
        dense, still = large(fine)
        small = rows.join(big, key, "left_anti").unionByName(fine.join(dense, key, "left_anti") if still else fine)
        if still:
            own = F.pmod(F.xxhash64("hi", "lo"), F.col("n_blocks"))
            paired = fine.join(dense, key).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
            unit = F.least("own", "other") * (1 << 31) + F.greatest("own", "other")
            small = small.unionByName(paired.select("tab", F.xxhash64("k1", "k2").alias("k1"), unit.alias("k2"), "hi", "lo", "id"))
    edges = small.repartition(n, "tab", "k1", "k2").sortWithinPartitions("tab", "k1", "k2").mapInArrow(lambda it: _bucket_edges(it, radius), "u long, v long")
    labels = connected_components(edges)
    return distinct.join(labels, distinct.id == labels.node, "left").select("hi", "lo", F.coalesce("component", "id").alias("near_id"))


def _bucket_edges(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Spanning edges of each bucket of rows (tab, k1, k2, hi, lo, id) sorted by bucket."""
    schema = arrow_schema("u long, v long")
    left: list[np.ndarray] | None = None

    def solve(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        hi, lo, ident = cols[3].view(np.uint64), cols[4].view(np.uint64), cols[5]
        at = runs(*cols[:3])
        us, vs = [], []
        for k in np.flatnonzero(np.diff(at) > 1):
            s = slice(at[k], at[k + 1])
            h, m, own = hi[s], lo[s], ident[s]
            label = np.arange(len(own))
            step = max(1, (1 << 20) // len(own))
            for j in range(0, len(own), step):
                far = np.bitwise_count(h[j : j + step, None] ^ h[None]) + np.bitwise_count(m[j : j + step, None] ^ m[None])
                a, b = np.nonzero(far <= radius)
                keep = a + j < b
                if keep.any():
                    label = group_labels(len(own), label[a[keep] + j], label[b[keep]])[label]
            child = np.flatnonzero(label != np.arange(len(own)))
            us.append(own[label[child]])
            vs.append(own[child])
        if us and sum(map(len, us)):
            yield record_batch({"u": np.concatenate(us), "v": np.concatenate(vs)}, schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy() for k in range(6)]
        if left is not None:
            cols = [np.concatenate(x) for x in zip(left, cols)]
        last = int(runs(*cols[:3])[-2])
        left = [c[last:] for c in cols]
        if last:
            yield from solve([c[:last] for c in cols])
    if left is not None:
        yield from solve(left)
