"""Connected components of a graph whose edges are rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkstrata.llm.common import arrow_schema, group_labels, materialize, record_batch

#: Most edges that one task solves in memory (16 bytes each).
TASK_EDGES = 1_000_000

SCHEMA = "node long, root long"


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of the edges in this partition: each node with its smallest node."""
    u, v = [], []
    for b in batches:
        u.append(b.column(0).to_numpy())
        v.append(b.column(1).to_numpy())
    if not u:
        return
    nodes, at = np.unique(np.concatenate(u + v), return_inverse=True)
    n = len(at) // 2
    label = nodes[group_labels(len(nodes), at[:n], at[n:])]
    yield record_batch({"node": nodes, "root": label}, arrow_schema(SCHEMA))


def connected_components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, component): the smallest node reachable from each node of ``edges``.

    ``edges`` has two long columns; self-links and nulls are ignored, repeated
    edges do no harm. No edges give no rows.

    Each round solves the parts of a partitioned edge list in memory, then links
    the local roots that a node got from several parts; only these go into the
    next round, so a hub of any degree never meets in one task. A round of at
    most ``task_edges`` edges fits one task and is the last. The labels of the
    rounds are then chained from the first to the last.
    """
    a, b = edges.columns[:2]
    todo = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where(F.col("u") < F.col("v"))
    rounds: list[DataFrame] = []
    todo = materialize(todo, "edges")
    while True:
        n = todo.count()
        if n <= task_edges:
            rounds.append(todo.repartition(1).mapInArrow(_stars, SCHEMA).select("node", F.col("root").alias("least")))
            break
        parts = -(-n // task_edges) if len(rounds) < 6 else max(2, -(-n // (task_edges * 4)))
        stars = materialize(todo.repartition(parts, "v").mapInArrow(_stars, SCHEMA), "stars")
        labels = materialize(stars.groupBy("node").agg(F.min("root").alias("least")), "labels")
        todo = materialize(
            stars.join(labels, "node").where("root <> least").select(F.col("least").alias("u"), F.col("root").alias("v")).distinct(),
            "edges",
        )
        rounds.append(labels)
    out = rounds[0].select("node", F.col("least").alias("component"))
    for labels in rounds[1:]:
        step = labels.select(F.col("node").alias("component"), "least")
        out = out.join(step, "component", "left").select("node", F.coalesce("least", "component").alias("component"))
    return out
