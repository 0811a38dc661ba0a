"""Phrase collocation mining with count tries of limited depth.

A trie holds the word sequences that start at each place of a text, up to DEPTH
words; a node's count is how often the words on its path follow each other. Each
task builds the tries of its texts shard by shard, and serialises them sorted:
level by level, children in the order of their words. A shard is cut by ranges
of prefixes; a range's parts of all shards are merged and added up in one task.
A prefix too common for one task is cut again by the words after it; counts of
the nodes above the cut are then partial and added up last. On the merged trie a
phrase's left parts are its ancestors, and its right parts are found by suffix
links, the path without its first word.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkstrata.llm.common import arrow_schema, materialize, mix, n_partitions, record_batch, sliced, texts

#: Words of the longest phrases.
DEPTH = 4
#: A phrase is rarer than this or a candidate.
LEAST = 30
#: A phrase inside a longer candidate goes if that has so many hundredths of its occurrences.
COVERED = 80
#: A score is this times a / (l + r).
SCALE = 2_000_000
#: Phrases for each language.
TOP = 2000
#: Words of a shard, and paths of a range that a task merges at a time.
SHARD_WORDS, RANGE_PATHS = 2_000_000, 1_500_000
#: One path in so many tells how common the prefixes are, so that those too common for a range are cut.
SAMPLE = 1024
#: A worker keeps the numbers of so many words.
CACHE_WORDS = 400_000
#: Ends a piece; never part of UTF-8.
END = b"\xff"
#: Marks and line ends that end a piece, and tabs, which part words as blanks do.
ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", END * 10 + b" ")
PATH = [f"h{k}" for k in range(1, DEPTH + 1)]


class Words(dict):
    """Numbers words from 1 as they come; number 0 is the end of a piece."""

    def __init__(self):
        super().__init__({END: 0})
        self.spelled, self.hashes = [END], [0]

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.spelled)
        self.spelled.append(word)
        self.hashes.append(xxhash.xxh64_intdigest(word) or 1)
        return n

    def numbers(self, text: bytes) -> np.ndarray:
        """A text's words, lower-cased, with an end after each piece and after the text."""
        found = text.lower().translate(ENDS).replace(END, b" \xff ").split()
        found.append(END)
        return np.fromiter(map(self.__getitem__, found), np.int64, len(found))


def paths(numbers: np.ndarray, places: int) -> np.ndarray:
    """The path of each word in the first ``places``: it and the words that follow it in its piece, 0 where the piece has ended."""
    n = len(numbers)
    out = np.zeros((DEPTH, n), np.int64)
    out[0] = numbers
    for k in range(1, DEPTH):
        out[k, : max(n - k, 0)] = numbers[k:]
        out[k, out[k - 1] == 0] = 0
    out = out[:, :places]
    return out[:, out[0] > 0]


def sorted_paths(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct paths in order, and how often each is there; the words' numbers are under 2^31."""
    first, levels = columns[0], []
    for c in columns[1:]:  # two columns become one, the rank of their pairs
        pair, first = np.unique(first << 31 | c, return_inverse=True)
        levels.append(pair)
    counts = np.bincount(first)
    at, rows = np.arange(len(levels[-1])), []
    for pair in levels[::-1]:
        rows.append(pair[at] & 0x7FFFFFFF)
        at = pair[at] >> 31
    return np.array([at, *rows[::-1]]), counts


def packed(x: np.ndarray) -> bytes:
    """Numbers of 0 and more, in as few bytes each as the largest needs."""
    kind = np.min_scalar_type(int(x.max()) if len(x) else 0)
    data = x.astype(kind).tobytes()
    return struct.pack("<BI", kind.itemsize, len(data)) + data


def serialised(columns: np.ndarray, counts: np.ndarray, hashes: np.ndarray, names: list[bytes]) -> bytes:
    """A sorted trie: the hashes of its words, for each level the words of its nodes and their numbers of children, the counts of the leaves, and the first level's words.

    ``columns`` are places in ``hashes`` and ``names``.
    """
    if columns.size * 8 > len(hashes):
        there = np.zeros(len(hashes), bool)
        there[columns] = True
        used, local = np.flatnonzero(there), (np.cumsum(there) - 1)[columns]
    else:
        used, local = np.unique(columns, return_inverse=True)
        local = local.reshape(columns.shape)
    new = np.zeros(columns.shape[1], bool)
    new[:1] = True
    starts = []
    for c in local:
        new[1:] |= c[1:] != c[:-1]
        starts.append(np.flatnonzero(new))
    parts = [packed(hashes[used])]
    for k, c in enumerate(local):
        parts.append(packed(c[starts[k]]))
        if k + 1 < DEPTH:
            parts.append(packed(np.diff(np.append(np.searchsorted(starts[k + 1], starts[k]), len(starts[k + 1])))))
    own = [names[w] for w in columns[0][starts[0]].tolist()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([*parts, packed(counts), b" ".join(own)]))


def read_trie(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(paths as places in the hashes, counts, hashes, words of the first level) of a serialised trie."""
    data = zstandard.ZstdDecompressor().decompress(data)
    at = 0

    def array() -> np.ndarray:
        nonlocal at
        size, n = struct.unpack_from("<BI", data, at)
        at += 5 + n
        return np.frombuffer(data, f"<u{size}", n // size, at - n)

    hashes = array().astype(np.uint64)
    columns: list[np.ndarray] = []
    for k in range(DEPTH):
        columns.append(array().astype(np.int64))
        if k + 1 < DEPTH:
            children = array()
            columns = [np.repeat(c, children) for c in columns]
    return np.array(columns), array().astype(np.int64), hashes, data[at:].split(b" ")


#: The prefixes of 1, 2 ... words that are cut: their codes in order, and in how many ranges each.
Cuts = list[tuple[np.ndarray, np.ndarray]]


def prefix_codes(lang: str, columns: list[np.ndarray]) -> Iterator[np.ndarray]:
    """A 64-bit code for the first word of each path of hashes, for its first two words, and so on."""
    code = np.full(len(columns[0]), xxhash.xxh64_intdigest(lang.encode()), np.uint64)
    for c in columns:
        code = mix(code * np.uint64(0x9E3779B97F4A7C15) + c)
        yield code


def ranges_of(codes: Iterator[np.ndarray], n_ranges: int, cuts: Cuts) -> tuple[np.ndarray, np.ndarray]:
    """The range of each path, and how many of its words decide on it.

    Ranges part the codes of first words evenly; the paths of a first word that
    is cut go by the codes of two words, and so on.
    """
    code = next(codes)
    out, decides = ((code >> np.uint64(32)) * np.uint64(n_ranges) >> np.uint64(32)).astype(np.int64), np.ones(len(code), np.int64)
    for k, (hot, n) in enumerate(cuts):
        if not len(hot):
            break
        at = np.minimum(np.searchsorted(hot, code), len(hot) - 1)
        cut = (hot[at] == code) & (decides == k + 1)
        after = next(codes)
        out[cut] = mix(code[cut] + after[cut] % n[at[cut]]).view(np.int64)
        decides[cut] = k + 2
        code = after
    return out, decides


def shards(docs: DataFrame) -> DataFrame:
    """(lang, n, n_paths, trie, sample): the sorted count trie of each shard, its words and distinct paths, and the prefix codes of some paths."""
    schema = "lang string, n long, n_paths long, trie binary, sample binary"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        words, size = Words(), 0

        def flush() -> Iterator[pa.RecordBatch]:
            hashes = np.array(words.hashes, np.uint64)
            for lang, parts in held.items():
                numbers = np.concatenate(parts)
                for at in range(0, len(numbers), SHARD_WORDS):
                    own = numbers[at : at + SHARD_WORDS + DEPTH - 1]
                    used = np.unique(own[own > 0])
                    if not len(used):
                        continue
                    # words stand in the order of their codes, in all shards alike; the end comes first
                    order = np.append(0, used[np.argsort(next(prefix_codes(lang, [hashes[used]])), kind="stable")])
                    rank = np.zeros(len(hashes), np.int64)
                    rank[order] = np.arange(len(order))
                    columns, counts = sorted_paths(paths(rank[own], SHARD_WORDS))
                    by_rank = hashes[order]
                    sample = list(prefix_codes(lang, [by_rank[c[SAMPLE // 2 :: SAMPLE]] for c in columns]))
                    trie = serialised(columns, counts, by_rank, [words.spelled[i] for i in order.tolist()])
                    yield record_batch({"lang": [lang], "n": [int(counts.sum())], "n_paths": [len(counts)], "trie": [trie], "sample": [np.concatenate(sample).tobytes()]}, arrow)

        for b in sliced(batches, 64):
            for lang, text in zip(b.column("lang").to_pylist(), texts(b)):
                numbers = words.numbers(text)
                held.setdefault(lang, []).append(numbers)
                size += len(numbers)
                if size >= SHARD_WORDS:
                    yield from flush()
                    held, size = {}, 0
                    if len(words) > CACHE_WORDS:
                        words = Words()
        yield from flush()

    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    return docs.select(lang, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def common_prefixes(tries: DataFrame) -> Cuts:
    """The prefixes with more than half a range's paths, by the samples of all shards; their number is under twice that of the ranges."""
    schema = "depth int, code long, n long"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.frombuffer(x, np.int64).reshape(DEPTH, -1) for x in b.column("sample").to_pylist()]
            for k in range(DEPTH - 1 if rows else 0):
                code, n = np.unique(np.concatenate([x[k] for x in rows]), return_counts=True)
                yield record_batch({"depth": np.full(len(code), k), "code": code, "n": n}, arrow)

    found = tries.select("sample").mapInArrow(run, schema).groupBy("depth", "code").agg((F.sum("n") * SAMPLE).alias("n")).where(F.col("n") > RANGE_PATHS // 2).collect()
    cuts: Cuts = []
    for k in range(DEPTH - 1):
        own = sorted((r.code % (1 << 64), -(-r.n // (RANGE_PATHS // 2))) for r in found if r.depth == k)
        cuts.append((np.array([c for c, _ in own], np.uint64), np.array([n for _, n in own], np.uint64)))
    return cuts


def dealt(tries: DataFrame, n_ranges: int, cuts: Cuts) -> DataFrame:
    """(range, decides, lang, trie): the parts of each shard's trie that belong to each range of prefixes."""
    schema = "range long, decides long, lang string, trie binary"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            for lang, data in zip(b.column("lang").to_pylist(), b.column("trie").to_pylist()):
                columns, counts, hashes, first = read_trie(data)
                names = dict(zip(np.unique(columns[0]).tolist(), first))
                range_, decides = ranges_of(prefix_codes(lang, [hashes[c] for c in columns] if any(len(x) for x, _ in cuts) else [hashes[columns[0]]]), n_ranges, cuts)
                order = np.argsort(range_, kind="stable")
                ends = np.append(np.flatnonzero(np.diff(range_[order])) + 1, len(order))
                start = 0
                for end in ends.tolist():
                    own = order[start:end]
                    start = end
                    yield record_batch({"range": range_[own[:1]], "decides": decides[own[:1]], "lang": [lang], "trie": [serialised(columns[:, own], counts[own], hashes, names)]}, arrow)

    return tries.select("lang", "trie").mapInArrow(run, schema)


NODES = f"lang string, depth int, {', '.join(f'{h} long' for h in PATH)}, f long, word string"


def merged(parts: DataFrame, least: int) -> DataFrame:
    """The nodes of the merged tries of each range: counts of ``least`` and more, and all counts above a cut, which are partial.

    A level's nodes are added up only under nodes of the level above that have
    enough, as no phrase is more frequent than its parts. Nodes of one word have it.
    """
    arrow = arrow_schema(NODES)

    def solve(lang: str, decides: int, tries: list[bytes]) -> Iterator[pa.RecordBatch]:
        read = [read_trie(x) for x in tries]
        hashes = np.unique(np.concatenate([np.zeros(1, np.uint64), *(h for _, _, h, _ in read)]))  # the end comes first
        local = [np.searchsorted(hashes, h) for _, _, h, _ in read]
        columns = np.concatenate([place[c] for place, (c, *_) in zip(local, read)], axis=1)
        counts = np.concatenate([n for _, n, _, _ in read])
        node, above = columns[0], np.zeros((0, len(hashes)), np.int64)
        distinct = np.arange(len(hashes))
        for k in range(DEPTH):
            if k:
                pair, node = np.unique(node << 31 | columns[k], return_inverse=True)
                above, distinct = above[:, pair >> 31], pair & 0x7FFFFFFF
            f = np.bincount(node, counts, len(distinct)).astype(np.int64)
            enough = (f >= (least if k + 1 >= decides else 1)) & (distinct > 0)
            above = np.concatenate([above, distinct[None]])
            at = np.flatnonzero(enough)
            if not len(at):
                return
            words = [None] * len(at)
            if not k:
                spelled: dict[int, bytes] = {}
                for place, (c, _, _, first) in zip(local, read):
                    own = place[c[0][np.append(True, c[0][1:] != c[0][:-1])]]
                    spelled.update((x, w) for x, w, ok in zip(own.tolist(), first, enough[own].tolist()) if ok)
                words = [spelled[x].decode(errors="replace") for x in at.tolist()]
            path = {h: hashes[above[j][at]].view(np.int64) if j <= k else np.zeros(len(at), np.int64) for j, h in enumerate(PATH)}
            yield record_batch({"lang": [lang] * len(at), "depth": np.full(len(at), k + 1), **path, "f": f[at], "word": words}, arrow)
            keep = enough[node]
            columns, counts, node = columns[:, keep], counts[keep], node[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for b in batches:
            for range_, decides, lang, data in zip(*(b.column(c).to_pylist() for c in ("range", "decides", "lang", "trie"))):
                if (range_, decides, lang) != key and held:
                    yield from solve(key[2], key[1], held)
                    held = []
                key = range_, decides, lang
                held.append(data)
        if held:
            yield from solve(key[2], key[1], held)

    keys = ["range", "decides", "lang"]
    return parts.repartition(n_partitions(parts.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(run, NODES)


def phrase_counts(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """All phrases of up to DEPTH words with ``least`` occurrences or more in their language, as nodes of the merged trie; and (lang, n), its words."""
    tries = materialize(shards(docs), "tries")
    n_paths = tries.agg(F.sum("n_paths")).first()[0] or 0
    parts = dealt(tries, max(2 * n_partitions(docs.sparkSession), 2 * n_paths // RANGE_PATHS), common_prefixes(tries))
    partial = materialize(merged(parts, least), "nodes")
    nodes = partial.groupBy("lang", "depth", *PATH).agg(F.sum("f").alias("f"), F.min("word").alias("word")).where(F.col("f") >= least)
    return materialize(nodes, "nodes"), tries.groupBy("lang").agg(F.sum("n").alias("n"))


def collocations(docs: DataFrame, least: int = LEAST, covered: int = COVERED, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of two to DEPTH words.

    Texts are lower-cased (A-Z) and split into pieces at marks and line ends;
    words are parted by blanks and tabs. Candidates occur ``least`` times or
    more (a). A cut after the first k words has l and r, the occurrences of both
    parts, and the score SCALE * a / (l + r), rounded down; a candidate has that
    of its lowest cut, of equal ones the smallest k. It is dropped if a longer
    candidate that contains it has ``covered`` hundredths of its occurrences or
    more. Order: score and a from the highest, then phrase in the order of its
    UTF-8 bytes. n counts the language's words. Null text is empty, null lang is
    ``und``; each row counts, repeated or not; doc_id and other columns play no
    part; no rows or no candidates give no rows.
    """
    nodes, totals = phrase_counts(docs, least)
    level = nodes.where("depth = 1").select("lang", "h1", F.col("word").alias("phrase"), "f", F.array().cast("array<long>").alias("left"), F.array().cast("array<long>").alias("right"))
    candidates, longer = [], []
    for d in range(2, DEPTH + 1):
        path = PATH[:d]
        # the trie walk: the parent is the path without its last word; the suffix link: the path without its first
        parent = level.select("lang", *path[:-1], F.col("phrase").alias("start"), F.array_append("left", F.col("f")).alias("left"))
        suffix = level.select("lang", *[F.col(a).alias(b) for a, b in zip(path, path[1:])], F.substring_index("phrase", " ", -1).alias("last"), F.array_append("right", F.col("f")).alias("right"))
        own = nodes.where(F.col("depth") == d).select("lang", *path, "f").join(parent, ["lang", *path[:-1]]).join(suffix, ["lang", *path[1:]])
        level = materialize(own.select("lang", *path, F.concat_ws(" ", "start", "last").alias("phrase"), "f", "left", "right"), "level")
        candidates.append(level)
        if d > 2:
            longer.append(level.select("lang", *path[:-1], "f").unionByName(level.select("lang", *[F.col(a).alias(b) for a, b in zip(path[1:], path)], "f")).groupBy("lang", *path[:-1]).agg(F.max("f").alias("longer")))
    kept = None
    for d, own in enumerate(candidates, 2):
        if d < DEPTH:
            own = own.join(longer[d - 2], ["lang", *PATH[:d]], "left").where(F.expr(f"longer is null or cast(longer as decimal(20)) * 100 < cast(f as decimal(20)) * {covered}"))
        own = own.select("lang", "phrase", "f", "left", "right")
        kept = own if kept is None else kept.unionByName(own)
    # left has 1 to d - 1 words in order, right too: the cut after k words has left k and right d - k
    cut = F.expr(
        f"array_min(transform(left, (l, k) -> named_struct('score', cast(f as decimal(20)) * {SCALE} div (l + right[size(right) - 1 - k]), 'k', k, 'l', l, 'r', right[size(right) - 1 - k])))"
    )
    scored = kept.select("lang", "phrase", F.col("f").alias("a"), cut.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # a language's phrases meet in one task only after each of its parts has been cut to the first ones
    some = F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order))
    first = scored.withColumn("rank", some).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
