"""Alignment of two tokenizers: which of their tokens end together, and how often in the corpus.

Both tokenizers cut the same bytes. Byte offsets where a token of each ends cut
them into groups, and the two tokens that end there are linked. A link's pair of
ids is packed into one integer, B's id above A's, so that the pairs of one B id
are neighbours in sorted order. Tasks count their pairs with partial sums; ranges
of the packed keys are sorted and equal keys summed run by run into shards, two
flat files each, which the lookup maps into memory and searches.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkstrata.llm.common import arrow_schema, file_system, id_text, materialize, n_partitions, new_folder, record_batch, runs, sliced, texts
from sparkstrata.llm.piece_bpe import piece_encoder

#: The mark that stands for a blank in B's pieces (fixed value of the library).
BLANK = "▁"
#: Neither tokenizer has tokens from the end of a chunk into the next, as a chunk starts at white space.
CHUNK = re.compile(rb"[ \t\n]*[^ \t\n]+|[ \t\n]+")
#: Texts with other white space than blanks, tabs and line ends are encoded whole.
OTHER_SPACE = re.compile(rb"[\x0b-\x0d\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: A chunk that ends in letters, and marks after them: A's tokens never reach over, B's only where pieces merge.
LETTERS_AND_MARKS = re.compile(rb"( ?[A-Za-z\x80-\xff]*[A-Za-z])([!-/:-@\[-`{-~]+)")
#: A worker keeps the alignments of so many chunks, of so many bytes at most.
CACHE_CHUNKS, CACHE_BYTES = 450_000, 48
#: Pairs that a task holds before it adds equal ones up, and distinct ones that it passes on.
HELD_PAIRS, PASSED_PAIRS = 4_000_000, 2_000_000
NOTHING = np.zeros(0, np.int64)


class Aligner(dict):
    """Maps a chunk to its alignment: (A's tokens, B's tokens, groups, ids of the groups as text, packed pairs, B's first id); None if the bytes differ."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings in a text are then ordinary text
        as_byte = byte_letters()
        self.a_bytes = {i: bytes(as_byte[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items() if all(c in as_byte for c in t)}
        self.b = SentencePieceProcessor(model_file=b_path)
        n = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(n)]
        if any(BLANK in p.lstrip(BLANK) or "\n" in p or "\t" in p for p in pieces):
            raise ValueError("pieces with inner blanks, tabs or line ends need other chunks")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.a_size = np.array([len(self.a_bytes.get(i, b"")) for i in range(max(self.a_bytes) + 1)])
        self.b_size = np.array([len(x) for x in self.b_bytes])
        self.digits = np.array([str(i).encode() for i in range(max(len(self.a_size), n))])
        self.digits = self.digits.view(np.uint8).reshape(len(self.digits), -1)
        self.blank = self.b.piece_to_id(BLANK)
        self.merges = piece_encoder(b_path)

    def ids(self, chunks: list[bytes]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of both tokenizers; B puts a blank before what it is given, which is a chunk's own first if it has one."""
        plain = [c.decode(errors="replace") for c in chunks]
        blank = [c.startswith(" ") for c in plain]
        a = [x.ids for x in self.a.encode_batch_fast(plain, add_special_tokens=False)]
        b = self.b.encode([c[1:] if own else c for c, own in zip(plain, blank)], num_threads=1)
        return a, [(x or [self.blank]) if own else x[1:] if x[0] == self.blank else [] for x, own in zip(b, blank)]

    def aligned(self, chunks: list[bytes]) -> dict[bytes, tuple | None]:
        """The alignments of chunks, encoded as they are."""
        out: dict[bytes, tuple | None] = {}
        a, b = self.ids(chunks)
        if b"".join([self.a_bytes[i] for x in a for i in x]) != (whole := b"".join(chunks)) or b"".join([self.b_bytes[i] for x in b for i in x]) != whole:
            same = [b"".join([self.a_bytes[i] for i in x]) == c == b"".join([self.b_bytes[i] for i in y]) for c, x, y in zip(chunks, a, b)]
            out = {c: None for c, ok in zip(chunks, same) if not ok}
            chunks, a, b = ([x for x, ok in zip(xs, same) if ok] for xs in (chunks, a, b))
        if not chunks:
            return out
        n_a, n_b = [len(x) for x in a], [len(x) for x in b]
        a, b = np.array(list(chain.from_iterable(a)), np.int64), np.array(list(chain.from_iterable(b)), np.int64)
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])  # in all chunks, one after the other
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)
        last_a, last_b = np.searchsorted(a_ends, common), np.searchsorted(b_ends, common)
        keys = (b[last_b] << 32 | a[last_a]).tobytes()
        first_b = b[np.append(0, np.cumsum(n_b)[:-1])].tolist()
        # the groups as text: each id's digits and what follows it in a row of its own, A's ids before B's in each group
        a_row = np.arange(len(a)) + np.append(0, last_b + 1)[np.searchsorted(common, a_ends)]
        b_row = np.arange(len(b)) + (last_a + 1)[np.searchsorted(common, b_ends)]
        rows = np.full((len(a) + len(b), self.digits.shape[1] + 1), ord(","), np.uint8)
        rows[a_row, :-1], rows[b_row, :-1] = self.digits[a], self.digits[b]
        rows[a_row[last_a], -1], rows[b_row[last_b], -1] = ord("|"), ord(";")
        text = rows[rows > 0].tobytes()
        group = np.append(0, np.searchsorted(common, np.cumsum([len(c) for c in chunks]), "right"))
        place = np.append(0, np.cumsum((rows > 0).sum(axis=1))[b_row[last_b]])[group].tolist()
        group = group.tolist()
        for k, c in enumerate(chunks):
            i, j = group[k], group[k + 1]
            out[c] = n_a[k], n_b[k], j - i, text[place[k] : place[k + 1] - 1], keys[8 * i : 8 * j], first_b[k]
        return out

    def learned(self, chunks: list[bytes]) -> dict[bytes, tuple | None]:
        """The alignments of chunks that aren't kept yet.

        Letters and the marks after them are looked up apart, as they recur more
        often, and put together where B's pieces could not merge.
        """
        halves = {c: m.groups() for c in chunks if (m := LETTERS_AND_MARKS.fullmatch(c))}
        new = {x for c in chunks for x in halves.get(c, (c,)) if x not in self}
        out = self.aligned(list(new))
        left = []
        for c, (x, y) in halves.items():
            x, y = out[x] if x in out else self[x], out[y] if y in out else self[y]
            if x and y and self.merges.compatible(int.from_bytes(x[4][-8:], "little") >> 32, y[5]):
                out[c] = x[0] + y[0], x[1] + y[1], x[2] + y[2], x[3] + b";" + y[3], x[4] + y[4], x[5]
            else:
                left.append(c)
        return out | self.aligned(left)

    def texts(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, str, np.ndarray]]:
        """(A's tokens, B's tokens, groups, their digest, packed pair of each link) of blank and each text; nothing if it is empty or the bytes differ."""
        chunks = [() if not t else (b" " + t,) if OTHER_SPACE.search(t) else CHUNK.findall(b" " + t) for t in texts]
        distinct = set().union(*chunks)
        found = self.learned([c for c in distinct if c not in self])
        if len(self) < CACHE_CHUNKS:
            self |= {c: x for c, x in found.items() if len(c) <= CACHE_BYTES}
        found |= {c: self[c] for c in distinct if c in self}
        for own in chunks:
            parts = list(map(found.__getitem__, own))
            if not parts or None in parts:
                yield 0, 0, 0, "", NOTHING
                continue
            n_a, n_b, n_groups, groups, keys, _ = zip(*parts)
            yield sum(n_a), sum(n_b), sum(n_groups), hashlib.sha256(b";".join(groups)).hexdigest(), np.frombuffer(b"".join(keys), np.int64)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stand for themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in plain]
    return {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(rest)}


ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """The aligner of two vocabulary files, one for each worker process."""
    key = a_path, b_path
    if key not in ALIGNERS:
        ALIGNERS[key] = Aligner(a_path, b_path)
    return ALIGNERS[key]


def document_links(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups_sha256, keys, counts): each document's tokens, and its distinct linked pairs with their counts as packed arrays."""
    schema = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, keys binary, counts binary"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        for b in sliced(batches):
            rows = []
            for d, (*numbers, links) in zip(b.column("doc_id").to_pylist(), own.texts(texts(b))):
                keys, counts = np.unique(links, return_counts=True)
                rows.append((d, *numbers, keys.tobytes(), counts.astype(np.int64).tobytes()))
            if rows:
                yield record_batch(dict(zip(arrow.names, zip(*rows))), arrow)

    return id_text(docs).mapInArrow(run, schema)


def packed(column: pa.Array) -> np.ndarray:
    """The numbers of a column of packed arrays, one array after the other."""
    return np.frombuffer(b"".join(column.to_pylist()), np.int64)


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = runs(keys)[:-1]
    return keys[at], np.add.reduceat(counts[order], at)


def partial_counts(links: DataFrame) -> DataFrame:
    """(key, n): each task's pairs, equal ones added up as far as its memory bound allows."""
    schema = "key long, n long"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def passed() -> Iterator[pa.RecordBatch]:
            keys, n = held[0]
            for at in range(0, len(keys), 100_000):
                yield record_batch({"key": keys[at : at + 100_000], "n": n[at : at + 100_000]}, arrow)

        for b in sliced(batches, 2048):
            held.append((packed(b.column("keys")), packed(b.column("counts"))))
            size += len(held[-1][0])
            if size > HELD_PAIRS:
                held = [added(*map(np.concatenate, zip(*held)))]
                size = len(held[0][0])
                if size > PASSED_PAIRS:
                    yield from passed()
                    held, size = [], 0
        if held:
            held = [added(*map(np.concatenate, zip(*held)))]
            yield from passed()

    return links.select("keys", "counts").mapInArrow(run, schema)


class CountShards:
    """Pair counts in sorted shards: the files' names, the first key of each, and the highest count of each B id.

    Shards in a folder that all machines mount are mapped where they lie; those
    of another store are handed out by Spark, once to each executor, and mapped
    there.
    """

    def __init__(self, stems: list[str], firsts: list[int], best: np.ndarray, handed: bool):
        self.stems, self.firsts, self.best, self.handed = stems, np.array(firsts, np.int64), best, handed

    def opened(self) -> list[tuple[np.ndarray, np.ndarray]]:
        place = (lambda x: SparkFiles.get(os.path.basename(x))) if self.handed else (lambda x: file_system(x)[1])
        return [tuple(np.memmap(place(f"{s}.{kind}"), "<i8", "r") for kind in ("keys", "counts")) for s in self.stems]

    def counts(self, shards: list, keys: np.ndarray) -> np.ndarray:
        """The counts of sorted distinct keys, all of which are in the shards."""
        out = np.zeros(len(keys), np.int64)
        cut = np.append(np.searchsorted(keys, self.firsts), len(keys))
        for k in np.flatnonzero(np.diff(cut)):
            s = slice(cut[k], cut[k + 1])
            own, n = shards[k]
            out[s] = n[np.searchsorted(own, keys[s])]
        return out


def count_shards(links: DataFrame, b_size: int, hand_out: bool | None = None) -> CountShards:
    """Counts of all pairs of the corpus: ranges of partial counts, sorted, equal keys summed run by run, one shard for each range.

    The driver gets the name and first key of each range and one number for each
    B id, of which there are ``b_size``: neither grows with the corpus.
    """
    spark = links.sparkSession
    folder = new_folder(spark, "pair-counts")
    schema = "stem string, first long, b long, best long"
    arrow = arrow_schema(schema)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = file_system(folder)
        stem, first = uuid.uuid4().hex, None
        files, last_key, last_n = [], NOTHING, NOTHING
        for b in batches:
            keys, n = np.concatenate([last_key, b.column("key").to_numpy()]), np.concatenate([last_n, b.column("n").to_numpy()])
            if not len(keys):
                continue
            if first is None:
                first = int(keys[0])
                files = [fs.open_output_stream(f"{at}/{stem}.{kind}") for kind in ("keys", "counts")]
            keys, n = added(keys, n)
            files[0].write(keys[:-1].astype("<i8").tobytes())
            files[1].write(n[:-1].astype("<i8").tobytes())
            last_key, last_n = keys[-1:], n[-1:]  # its run may go on
            yield from highest(keys[:-1], n[:-1])
        if first is not None:
            files[0].write(last_key.astype("<i8").tobytes())
            files[1].write(last_n.astype("<i8").tobytes())
            for f in files:
                f.close()
            yield from highest(last_key, last_n)
            yield record_batch({"stem": [f"{folder}/{stem}"], "first": [first], "b": [None], "best": [None]}, arrow)

    def highest(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(keys):
            at = runs(keys >> 32)[:-1]
            none = [None] * len(at)
            yield record_batch({"stem": none, "first": none, "b": keys[at] >> 32, "best": np.maximum.reduceat(n, at)}, arrow)

    partial = materialize(partial_counts(links), "pairs")
    ranges = partial.repartitionByRange(n_partitions(spark), "key").sortWithinPartitions("key")
    shards = materialize(ranges.mapInArrow(write, schema), "shards")
    listed = shards.where("stem is not null").orderBy("first").collect()
    best = np.zeros(b_size, np.int64)
    for r in shards.where("b is not null").groupBy("b").agg(F.max("best").alias("best")).collect():
        best[r.b] = r.best
    if hand_out is None:
        hand_out = file_system(folder)[0].type_name != "local"
    if hand_out:
        for r in listed:
            for kind in ("keys", "counts"):
                spark.sparkContext.addFile(f"{r.stem}.{kind}")
    return CountShards([r.stem for r in listed], [r.first for r in listed], best, hand_out)


def align_documents(docs: DataFrame, a_path: str, b_path: str, hand_out: bool | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every whole text.

    A is a byte-level vocabulary of `tokenizers`, B a BPE model of
    `sentencepiece` with byte fallback; strings of special tokens are plain text.
    A link's count is that of its pair in the corpus; n_best counts the links
    whose count is the highest of their B id, count_sum adds the counts of all
    links. A text that is null or empty, or whose tokens' bytes differ from
    blank and text, has no tokens: zeros and an empty digest. Rows without
    doc_id and repeated rows count as any other, other columns are left out, no
    rows give no rows. ``hand_out`` forces or forbids that Spark hands the
    shards to the executors; by default the folder decides.
    """
    links = materialize(document_links(docs, a_path, b_path), "links")
    shards = count_shards(links, aligner(a_path, b_path).b.get_piece_size(), hand_out)
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    arrow = arrow_schema(schema)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = shards.opened()
        for b in sliced(batches):
            if not b.num_rows:
                continue
            keys, times = packed(b.column("keys")), packed(b.column("counts"))
            row = np.repeat(np.arange(b.num_rows), [len(x) // 8 for x in b.column("keys").to_pylist()])
            distinct, at = np.unique(keys, return_inverse=True)
            count = shards.counts(opened, distinct)
            highest = count == shards.best[distinct >> 32]
            sums = np.zeros((3, b.num_rows), np.int64)
            for out, value in zip(sums, (times, times * highest[at], times * count[at])):
                np.add.at(out, row, value)
            columns = {c: b.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256")}
            yield record_batch(columns | dict(zip(("n_links", "n_best", "count_sum"), sums)), arrow)

    return links.mapInArrow(look_up, schema)
