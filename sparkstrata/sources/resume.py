"""Builds that go on where they were stopped: files in chunks, each chunk's rows put in place by one rename."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build_in_chunks(contents: DataFrame, folder: str, step: Callable[[DataFrame], DataFrame], schema: str, n_chunks: int = 64, at_once: int = 8) -> DataFrame:
    """Rows that ``step`` makes of files (path, content), with the chunks that ``folder`` already holds left alone.

    ``step`` takes files and returns rows of ``schema``, each with the file it
    comes from in ``file``. A chunk's name tells its number and a digest of its
    files, so a chunk whose files changed is made anew and one that another
    commit shares is found again. A chunk is there as a whole or not at all: its
    rows are written aside and then renamed. ``at_once`` chunks are one job; a
    build that is stopped loses these alone. Rows of chunks that the files at
    hand don't have aren't read. Null paths are empty. No files give no rows.
    """
    spark = contents.sparkSession
    chunk = lambda c: F.pmod(F.xxhash64(F.coalesce(c, F.lit(""))), F.lit(n_chunks)).cast("int")
    marked = contents.withColumn("path", F.coalesce("path", F.lit(""))).withColumn("chunk", chunk(F.col("path")))
    own = F.xxhash64("path", "content")
    prints = marked.groupBy("chunk").agg(F.bit_xor(own).alias("x"), F.sum(own.cast("decimal(38)")).cast("string").alias("s"), F.count("*").alias("n")).collect()  # a row for each chunk
    names = {r.chunk: f"{r.chunk}-{n_chunks}-{r.n}-{r.x & (1 << 64) - 1:016x}-{r.s}" for r in prints}
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = lambda x: hadoop.Path(f"{folder}/{x}")
    fs = at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at("chunks"))
    done = {x.getPath().getName() for x in fs.listStatus(at("chunks"))}
    left = sorted(k for k, name in names.items() if name not in done)
    for k in range(0, len(left), at_once):
        group = left[k : k + at_once]
        aside = f"aside-{uuid.uuid4().hex}"
        rows = step(marked.where(F.col("chunk").isin(group)).drop("chunk"))
        rows.withColumn("chunk", chunk(F.col("file"))).write.partitionBy("chunk").parquet(f"{folder}/{aside}")
        for c in group:
            if not fs.exists(at(f"{aside}/chunk={c}")):  # files without rows
                fs.mkdirs(at(f"{aside}/chunk={c}"))
            fs.rename(at(f"{aside}/chunk={c}"), at(f"chunks/{names[c]}"))
        fs.delete(at(aside), True)
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{folder}/chunks/{name}" for _, name in sorted(names.items())])
