"""Neighbours in a total order without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkstrata.llm.common import n_partitions


def in_ranges(df: DataFrame, keys: list[str], ties: list[str]) -> DataFrame:
    """``df`` dealt by ranges of ``keys``, sorted in them by ``keys`` and ``ties``, with the range's number in ``part``.

    Ranges follow each other in the order of ``part``, null keys first. Rows
    that agree on all ``keys`` share a range, so ``keys`` should hold something
    that tells rows with a common first key apart. A row's neighbours are in its
    range but for the first and last row, which the caller passes on: two rows
    for each range, whatever the input.
    """
    dealt = df.repartitionByRange(n_partitions(df.sparkSession), *keys).sortWithinPartitions(*keys, *ties)
    return dealt.withColumn("part", F.spark_partition_id())


def in_one_task(borders: DataFrame, *keys: str) -> DataFrame:
    """The rows that ranges pass on, sorted in one partition: their number is bounded by that of the ranges."""
    return borders.repartition(1).sortWithinPartitions(*keys)
