"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, from ``spark.checkpoint.dir``.

    A temporary folder is used only where the session names none and all tasks
    run on this machine, as in tests; on a cluster that would lose rows, so it
    is an error there.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = getattr(shared_dir, "own", None)
    if own is None:
        own = shared_dir.own = tempfile.mkdtemp(prefix="strata-")
    return own


def delete_at_end(spark: SparkSession, path: str) -> None:
    """The file system deletes ``path`` when the application ends."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    The files survive the loss of any executor; the file system deletes them
    when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    delete_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession, name: str) -> str:
    """URI of a new folder in the shared folder, for files that tasks write themselves; it is deleted at the end.

    Tasks give each attempt's files names of their own and return the names as
    rows, so that only the files of attempts that Spark committed are read.
    """
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, at = file_system(path)
    fs.create_dir(at, recursive=True)
    delete_at_end(spark, path)
    return path


def file_system(uri: str) -> tuple:
    """The pyarrow file system of a URI or path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches of few rows each, so that a task holds the derived data of few texts at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """Apply ``fn`` (record batch to columns) to every Arrow batch of ``df``."""
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield record_batch(fn(batch), arrow)

    return df.mapInArrow(run, schema)


TYPES = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
    "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()),
    "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()),
    "array<float>": pa.list_(pa.float32()),
}


def arrow_schema(schema: str) -> pa.Schema:
    return pa.schema([(n, TYPES[t]) for n, t in (c.split() for c in schema.split(", "))])


def record_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def id_text(docs: DataFrame, others: list[str] | None = None) -> DataFrame:
    """doc_id as long and text as string with null made empty; ``others`` go into one struct, rest, so that their names can't clash."""
    rest = [F.struct(*[F.col(f"`{c}`") for c in others]).alias("rest")] if others else []
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *rest)


def unpacked(df: DataFrame, others: list[str]) -> list:
    """The columns that `id_text` put into rest."""
    return [df["rest"].getField(c).alias(c) for c in others]


def lower_ascii(column):
    """A-Z to a-z; other letters stay."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values over all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def runs(*keys: np.ndarray) -> np.ndarray:
    """Start of each run of equal keys in sorted arrays, and the end of the last."""
    n = len(keys[0])
    if not n:
        return np.zeros(1, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(new), n)


def group_labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest index that each of ``n`` nodes reaches over the edges (u, v)."""
    p = np.arange(n)
    while True:
        a, b = p[u], p[v]
        far = a != b
        if not far.any():
            return p
        np.minimum.at(p, np.maximum(a, b)[far], np.minimum(a, b)[far])
        while True:
            q = p[p]
            if (q == p).all():
                break
            p = q
