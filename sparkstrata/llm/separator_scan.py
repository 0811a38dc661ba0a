"""Token counts of documents in flat token files that have no index.

A token file is one run of identifiers in which an end-of-document identifier
follows each document. It is read in blocks of fixed size that know nothing of
documents. Each block finds its separators in one vectorised comparison; a prefix
scan over the blocks then gives each block the position of its first identifier
and of the last separator before it, which stitches the documents that cross
block boundaries.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkstrata.llm.common import arrow_schema, id_text, materialize, record_batch

#: Identifiers in a block.
BLOCK = 65_536
#: Blocks that one step of the prefix scan takes together.
STRIDE = 1024
BLOCKS = "file string, block long, ids binary"


def token_files(spark: SparkSession, path: str, dtype: str, block: int = BLOCK) -> DataFrame:
    """Blocks (file, block, ids) of raw token files: little-endian numbers of ``dtype``, nothing else.

    A file must fit Spark's limit for one binary value (2 GB).
    """
    size = np.dtype(dtype).itemsize * block
    arrow = arrow_schema(BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f, data in zip(b.column(0).to_pylist(), b.column(1)):
                view = memoryview(data.as_buffer())
                for k, at in enumerate(range(0, len(view), size)):
                    yield record_batch({"file": [f], "block": [k], "ids": [bytes(view[at : at + size])]}, arrow)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, BLOCKS)


def scan(blocks: DataFrame, separator: int, dtype: str) -> DataFrame:
    """(file, block, nth, start, n_tokens): the documents that end in each block.

    nth counts the separators of a block from 0, start is the position in the
    file of the document's first identifier, n_tokens counts its identifiers
    without the separator. Identifiers after a file's last separator are no
    document. Empty blocks and files give no rows; documents may be empty and
    may reach over any number of blocks.
    """
    found_schema = "file string, block long, n long, last long, ends binary"
    arrow = arrow_schema(found_schema)

    def separators(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: dict = {"file": b.column("file"), "block": b.column("block"), "n": [], "last": [], "ends": []}
            for blob in b.column("ids"):
                ids = np.frombuffer(blob.as_buffer(), dtype) if blob.is_valid else np.zeros(0, dtype)
                ends = np.flatnonzero(ids == separator).astype(np.int32)
                cols["n"].append(len(ids))
                cols["last"].append(int(ends[-1]) if len(ends) else None)
                cols["ends"].append(ends.tobytes())
            if b.num_rows:
                yield record_batch(cols, arrow)

    found = materialize(blocks.select("file", "block", "ids").mapInArrow(separators, found_schema), "separators")
    # The scan has two levels, so that no task gets all blocks of a long file.
    slim = found.select("file", "block", "n", "last", F.floor(F.col("block") / STRIDE).alias("stride"))
    inside = Window.partitionBy("file", "stride").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    local = slim.withColumn("base", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    local = local.withColumn("end", F.col("base") + F.col("last")).withColumn("before", F.max("end").over(inside))
    across = Window.partitionBy("file").orderBy("stride").rowsBetween(Window.unboundedPreceding, -1)
    strides = local.groupBy("file", "stride").agg(F.sum("n").alias("n"), F.max("end").alias("end"))
    strides = strides.withColumn("first", F.coalesce(F.sum("n").over(across), F.lit(0)))
    strides = strides.withColumn("earlier", F.max(F.col("first") + F.col("end")).over(across)).select("file", "stride", "first", "earlier")
    placed = local.join(strides, ["file", "stride"]).select(
        "file", "block", (F.col("first") + F.col("base")).alias("at"), F.coalesce(F.col("first") + F.col("before"), "earlier", F.lit(-1)).alias("before")
    )
    out_schema = "file string, block long, nth long, start long, n_tokens long"
    out = arrow_schema(out_schema)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f, k, at, before, ends in zip(*(b.column(c).to_pylist() for c in ("file", "block", "at", "before", "ends"))):
                end = np.frombuffer(ends, np.int32).astype(np.int64) + at
                if len(end):
                    start = np.append(before, end[:-1]) + 1
                    yield record_batch({"file": [f] * len(end), "block": [k] * len(end), "nth": np.arange(len(end)), "start": start, "n_tokens": end - start}, out)

    return found.select("file", "block", "ends").where("last is not null").join(placed, ["file", "block"]).mapInArrow(documents, out_schema)


ENCODERS: dict = {}


def rank_encoder(path: str, pattern: str):
    """A byte-level encoder of a file of ranks, one for each worker process."""
    if path not in ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        ENCODERS[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return ENCODERS[path]


def write_stream(docs: DataFrame, vocabulary: str, pattern: str, separator: int, block: int = BLOCK) -> DataFrame:
    """(file, block, ids, doc_ids): the documents' ids as flat files of 16-bit numbers, a file for each task.

    doc_ids lists the documents that end in a block, in order; the scan doesn't
    use it.
    """
    schema = "file string, block long, ids binary, doc_ids array<long>"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = rank_encoder(vocabulary, pattern).encode_to_numpy
        file = f"part-{TaskContext.get().partitionId():06d}"
        held: list[np.ndarray] = []
        n = k = 0
        ended: list[tuple[int, int | None]] = []  # (end in the file, doc_id)

        def rows(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal held, n, k
            data = np.concatenate(held)
            at = 0
            while len(data) - at >= least and at < len(data):
                stop = (k + 1) * block
                own = [d for e, d in ended if e < stop]
                del ended[: len(own)]
                yield record_batch({"file": [file], "block": [k], "ids": [data[at : at + block].tobytes()], "doc_ids": [own]}, arrow)
                at += block
                k += 1
            held, n = [data[at:]], max(0, len(data) - at)

        end = np.array([separator], np.uint16)
        for b in batches:
            for d, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = encode(text, allowed_special=set(), disallowed_special=()).astype(np.uint16)
                held += [ids, end]
                n += len(ids) + 1
                ended.append((k * block + n - 1, d))
                if n >= block * 8:
                    yield from rows(block)
        if held and n:
            yield from rows(1)

    return id_text(docs).mapInArrow(run, schema)


def count_documents(docs: DataFrame, vocabulary: str, pattern: str, separator: int, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_tokens) of every whole text, counted in flat token files that are written for it.

    Null text is empty and counts 0 tokens; rows without doc_id and repeated rows
    are counted as any other; no rows give no rows.
    """
    stream = materialize(write_stream(docs, vocabulary, pattern, separator, block), "tokens")
    counts = scan(stream.select("file", "block", "ids"), separator, "<u2")
    names = stream.select("file", "block", F.posexplode("doc_ids").alias("nth", "doc_id"))
    return names.join(counts, ["file", "block", "nth"]).select("doc_id", "n_tokens")
