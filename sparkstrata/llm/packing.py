"""Packing of token sequences by non-negative least squares on the length histogram."""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkstrata.llm.common import arrow_schema, id_text, materialize, record_batch, sliced, texts

#: Tokens in a sequence.
MAX_TOKENS = 4096
#: Token lengths are rounded up to multiples of this for the histogram.
STEP = 8
#: Most pieces in the combinations that the least squares choose from.
DEPTH = 3
#: A worker keeps the ids of so many words (about 110 MB).
CACHE_WORDS = 500_000


#: A word that ends in a letter, and marks after it other than apostrophes: their tokens are apart.
LETTERS_AND_MARKS = re.compile(rb"([A-Za-z\x80-\xff]*[A-Za-z])([!-&(-/:-@\[-`{-~]+)")


class WordIds(dict):
    """Ids of words by a `tokenizers` vocabulary that lower-cases and whose tokens never cross white space.

    Maps UTF-8 words to their ids as little-endian unsigned 32-bit numbers. Words
    that aren't there yet are put together from their letters, lower-cased if
    they are ASCII, and the marks after them, which recur more often.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def __missing__(self, word: bytes) -> bytes:
        if m := LETTERS_AND_MARKS.fullmatch(word):
            ids = self[m[1]] + self[m[2]]
        elif word.isascii() and (low := word.lower()) != word:
            ids = self[low]
        else:
            own = self.tokenizer.encode(word.decode(), add_special_tokens=False).ids
            ids = struct.pack(f"<{len(own)}I", *own)
        if len(self) < CACHE_WORDS and len(word) <= 48:
            self[word] = ids
        return ids

    def many(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text."""
        for t in texts:
            yield b"".join(map(self.__getitem__, t.split()))


ENCODERS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The encoder of a vocabulary file, one for each worker process."""
    if path not in ENCODERS:
        ENCODERS[path] = WordIds(path)
    return ENCODERS[path]


def combinations(bins: int, depth: int = DEPTH) -> np.ndarray:
    """All non-increasing rows of up to ``depth`` lengths (3 at most) that add up to ``bins``; unused places are 0."""
    rows = [(bins, 0, 0)]
    if depth >= 2:
        rows += [(a, bins - a, 0) for a in range((bins + 1) // 2, bins)]
    if depth >= 3:
        rows += [(a, b, bins - a - b) for a in range((bins + 2) // 3, bins - 1) for b in range((bins - a + 1) // 2, min(a, bins - a - 1) + 1)]
    return np.array(rows)


def solve_repeats(combos: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that minimise ||A x - histogram||, by accelerated projected gradients.

    A has a column for each combination: how often it holds each length.
    """
    bins = len(histogram) - 1
    scale = max(float(histogram.max()), 1.0)
    b = histogram / scale
    b[0] = 0

    def times(x):
        y = sum(np.bincount(c, x, bins + 1) for c in combos.T)
        y[0] = 0
        return y

    power = np.random.default_rng(0).random(len(combos))
    for _ in range(20):
        power = times(power)[combos].sum(axis=1)
        norm = np.linalg.norm(power)
        power /= norm
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        residual = times(y) - b
        residual[0] = 0
        new = np.maximum(0, y - residual[combos].sum(axis=1) / (norm * 1.01))
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / u * (new - x)
        x, t = new, u
    return x * scale


def plan(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) that use up a histogram of lengths, indexed by length, in windows of the longest length.

    Combinations that fill the window get the rounded least-squares counts, as
    far as the histogram has the pieces. What is left is packed greedily: a
    sequence takes the longest lengths that fit until none does, and is repeated
    while the histogram lasts, so the plan is short whatever the counts.
    """
    bins = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[tuple[int, ...], int]] = []
    if not left.any():
        return out
    combos = combinations(bins)
    repeats = np.rint(solve_repeats(combos, left.astype(float))).astype(np.int64)
    for k in np.argsort(-repeats, kind="stable"):
        if repeats[k] <= 0:
            break
        own = combos[k][combos[k] > 0]
        lengths, times = np.unique(own, return_counts=True)
        n = int(min(repeats[k], (left[lengths] // times).min()))
        if n > 0:
            left[lengths] -= n * times
            out.append((tuple(int(x) for x in own), n))
    while left.any():
        own, space = [], bins
        used = np.zeros(bins + 1, np.int64)
        while space:
            fits = np.flatnonzero(left[: space + 1] > used[: space + 1])
            if not len(fits):
                break
            length = int(fits[-1])
            n = int(min(space // length, left[length] - used[length]))
            own += [length] * n
            used[length] += n
            space -= n * length
        on = np.flatnonzero(used)
        n = int((left[on] // used[on]).min())
        left[on] -= n * used[on]
        out.append((tuple(own), n))
    return out


def token_pieces(docs: DataFrame, encoder: Callable[[], WordIds], end_id: int, size: int = MAX_TOKENS, step: int = STEP) -> DataFrame:
    """The pieces of every document: whole windows first, then the rest.

    Besides the piece's own columns, ``bin`` is its rounded length and
    (``task``, ``nth``) its place among the pieces of that bin.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bin int, task int, nth long"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seen = np.zeros(-(-size // step) + 1, np.int64)
        encode = encoder().many
        end = np.array([end_id], "<u4").tobytes()
        for b in sliced(batches):
            rows = []
            for d, ids in zip(b.column("doc_id").to_pylist(), encode(texts(b))):
                data = ids + end
                n = len(data) // 4
                for start in range(0, n, size):
                    length = min(size, n - start)
                    k = -(-length // step)
                    rows.append((d, start, length, zlib.crc32(data[start * 4 : (start + length) * 4]), n, k, task, int(seen[k])))
                    seen[k] += 1
            if rows:
                yield record_batch(dict(zip(arrow.names, zip(*rows))), arrow)

    return id_text(docs).mapInArrow(run, schema)


def pack(pieces: DataFrame, size: int = MAX_TOKENS, step: int = STEP) -> DataFrame:
    """``pieces`` with the sequence and the offset of each: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    The histogram of rounded lengths (at most size / step counts) is solved on
    the driver; the plan is short too, and each piece finds its place in it by
    its rank among the pieces of its length.
    """
    bins = -(-size // step)
    pieces = materialize(pieces, "pieces")
    counts = materialize(pieces.groupBy("bin", "task").agg(F.count("*").alias("n")), "counts")
    histogram = np.zeros(bins + 1, np.int64)
    for row in counts.groupBy("bin").agg(F.sum("n").alias("n")).collect():
        histogram[row.bin] = row.n
    slots: list[list[tuple[int, int, int]]] = [[] for _ in range(bins + 1)]
    taken, first = np.zeros(bins + 1, np.int64), 0
    for own, n in plan(histogram):
        for pos, length in enumerate(own):
            slots[length].append((int(taken[length]), first, pos))
            taken[length] += n
        first += n
    table = [tuple(np.array(x, np.int64).reshape(-1, 3).T) for x in slots]
    before = F.sum("n").over(Window.partitionBy("bin").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("bin", "task", F.coalesce(before, F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["bin", "task"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "bin", (F.col("base") + F.col("nth")).alias("rank"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, pos long"
    arrow = arrow_schema(schema)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bin_, rank = b.column("bin").to_numpy(), b.column("rank").to_numpy()
            sequence, pos = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for k in np.unique(bin_):
                own = bin_ == k
                start, at, place = table[k]
                slot = np.searchsorted(start, rank[own], "right") - 1
                sequence[own] = at[slot] + rank[own] - start[slot]
                pos[own] = place[slot]
            yield record_batch({c: b.column(c) for c in arrow.names[:5]} | {"sequence_id": sequence, "pos": pos}, arrow)

    placed = ranked.mapInArrow(place, schema)
    ahead = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(ahead, F.lit(0)).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, size: int = MAX_TOKENS, step: int = STEP) -> DataFrame:
    """Pieces of all documents packed into sequences of at most ``size`` tokens.

    A document is the ids of its text and ``end_id``; null text is empty, so its
    only id is ``end_id``. Documents longer than ``size`` are cut at its
    multiples. A row without doc_id is packed as any other, as are repeated
    rows. No rows give no pieces.
    """
    return pack(token_pieces(docs, lambda: word_ids(tokenizer), end_id, size, step), size, step)
