"""Counters over streams that need more than windows: the last rows of each key, and limits of several kinds at once.

What a stream must remember is a table of its own, one version for each batch,
beside the batch's rows in a folder that all machines share. A batch that runs
again, after a restart too, reads the version before it and gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Requests a day of one device, one address and all together, and tokens a day of one client.
PER_DEVICE, PER_ADDRESS, ALL, TOKENS = 20, 80, 2000, 120_000
#: Rows that are kept of each key.
RECENT = 1000
DECISIONS = "request_id long, is_allowed boolean, reason string, day string, bucket string, n long"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def run_with_state(stream: DataFrame, step: Callable[[DataFrame, DataFrame | None], tuple[DataFrame, DataFrame]], folder: str, rows: str, state: str) -> DataFrame:
    """Runs ``step`` on the input at hand, batch by batch; all rows so far, of earlier runs with the same ``folder`` too.

    ``step`` takes a batch and the state after the batch before (None at first)
    and returns rows and the new state; ``rows`` and ``state`` are their schemas.
    Two versions of the state are kept. No input gives no rows.
    """
    spark = stream.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        before = f"{folder}/state/{number - 1}"
        old = spark.read.schema(state).parquet(before) if number and _exists(spark, before) else None
        out, new = step(batch, old)
        new.write.mode("overwrite").parquet(f"{folder}/state/{number}")
        out.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        if number > 1:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/state/{number - 2}")
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    schema = StructType.fromDDL(rows)
    if not _exists(spark, f"{folder}/rows"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema.add("batch", "long")).parquet(f"{folder}/rows").drop("batch")


def last_rows(events: DataFrame, keys: list[str], order: list[str], most: int = RECENT, kept: DataFrame | None = None, newest: str | None = None, keep_seconds: int | None = None) -> DataFrame:
    """The last ``most`` rows of each key by ``order``, of ``events`` and of those kept before.

    Equal rows count each. Null keys are a key of their own. With a time column
    ``newest``, rows more than ``keep_seconds`` older than their key's newest go.
    Rows past the first ``most`` of a part of a key go before the key's parts
    meet, so a hot key is not ordered by one task.
    """
    every = events if kept is None else kept.unionByName(events.select(*kept.columns))
    turned = [F.desc(c) for c in order]
    if newest and keep_seconds is not None:
        age = F.max(newest).over(Window.partitionBy(*keys)).cast("long") - F.col(newest).cast("long")
        every = every.withColumn("_age", age).where(F.col("_age").isNull() | (F.col("_age") <= keep_seconds)).drop("_age")
    part = F.pmod(F.xxhash64(*order), F.lit(32))
    some = every.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, part).orderBy(*turned))).where(F.col("_n") <= most)
    return some.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*turned))).where(F.col("_n") <= most).drop("_n")


def decided(requests: DataFrame, limits: tuple[int, int, int, int], kept: DataFrame | None = None) -> DataFrame:
    """Decisions on requests, and the counts of each day's buckets after them (rows with a bucket), which ``kept`` gives back."""
    per_device, per_address, all_, tokens = limits
    address = F.coalesce(F.col("address").cast("string"), F.lit("unknown-ip"))
    own = requests.select(F.to_date("at").cast("string").alias("day"), F.lit(1).alias("kind"), F.col("at").cast("timestamp").alias("at"), F.col("request_id").cast("long"), F.col("device").cast("string"), address.alias("address"), F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens"), F.lit(None).cast("string").alias("bucket"), F.lit(None).cast("long").alias("n"))
    if kept is not None:
        none = lambda t: F.lit(None).cast(t)
        own = own.unionByName(kept.select("day", F.lit(0).alias("kind"), none("timestamp").alias("at"), none("long").alias("request_id"), none("string").alias("device"), none("string").alias("address"), F.lit(0).cast("long").alias("tokens"), "bucket", "n"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        day, counts = None, {}
        columns = ["request_id", "is_allowed", "reason", "day", "bucket", "n"]
        for part in parts:
            rows = []
            for d, kind, id_, device, place, used, bucket, n in zip(*(part[c] for c in ("day", "kind", "request_id", "device", "address", "tokens", "bucket", "n"))):
                if d != day:
                    rows += [(None, None, None, day, b, c) for b, c in counts.items()]
                    day, counts = d, {}
                if kind == 0:
                    counts[bucket] = int(n)
                    continue
                device = device if isinstance(device, str) and device else None
                buckets = ([(f"device:{device}", per_device)] if device else []) + [(f"ip:{place}", per_address), ("global", all_)]
                spent = f"tokens:{buckets[0][0]}"
                reason = next((b.partition(":")[0] for b, most in buckets if counts.get(b, 0) >= most), None)
                if reason is None and counts.get(spent, 0) >= tokens:
                    reason = "tokens"
                if reason is None:
                    for b, _ in buckets:
                        counts[b] = counts.get(b, 0) + 1
                    counts[spent] = counts.get(spent, 0) + int(used)
                rows.append((int(id_), reason is None, reason, d, None, None))
            yield pd.DataFrame(rows, columns=columns).astype({"request_id": "Int64", "is_allowed": "boolean", "n": "Int64"})
        if counts:
            yield pd.DataFrame([(None, None, None, day, b, c) for b, c in counts.items()], columns=columns).astype({"request_id": "Int64", "is_allowed": "boolean", "n": "Int64"})

    order = ["day", "kind", "at", "request_id"]
    return own.repartition("day").sortWithinPartitions(*order).mapInPandas(run, DECISIONS)


def request_limits(requests: DataFrame, limits: tuple[int, int, int, int] = (PER_DEVICE, PER_ADDRESS, ALL, TOKENS)) -> DataFrame:
    """(request_id, is_allowed, reason) of requests (request_id, at, device, address, tokens), in their order by time and id.

    A request is refused if its device, its address or all together have had
    their requests of the day, or its client (device, else address) its tokens;
    refused requests count for nothing, and the first reason in this order is
    given. Without a device only address and total count; null tokens are none,
    a null address is one address, a null time is a day of its own. Days are
    those of the session's time zone. The ceiling on all makes each decision
    depend on all earlier ones of the day, so a day's rows stream through one
    task in their order; what it holds is bounded by the requests it admits.
    """
    return decided(requests, limits).where("bucket is null").select("request_id", "is_allowed", "reason")


def limit_stream(requests: DataFrame, folder: str, limits: tuple[int, int, int, int] = (PER_DEVICE, PER_ADDRESS, ALL, TOKENS), keep_days: int = 1) -> DataFrame:
    """`request_limits` of a stream: each batch goes on from the counts that the batch before left.

    Requests are decided in the order of the batches, and in each by time and
    id. Counts of days more than ``keep_days`` before the latest are forgotten.
    """

    def step(batch: DataFrame, kept: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        from sparkstrata.operators.graph import cut_lineage

        out = cut_lineage(decided(batch, limits, kept), "decided")
        counts = out.where("bucket is not null").select("day", "bucket", "n")
        latest = counts.agg(F.max("day").alias("latest"))
        fresh = counts.join(F.broadcast(latest), F.datediff(F.col("latest").cast("date"), F.col("day").cast("date")) <= keep_days)  # one row
        return out.where("bucket is null").select("request_id", "is_allowed", "reason"), fresh.select("day", "bucket", "n")

    return run_with_state(requests, step, folder, "request_id long, is_allowed boolean, reason string", "day string, bucket string, n long")


def last_rows_of_stream(events: DataFrame, folder: str, keys: list[str], order: list[str], most: int = RECENT) -> DataFrame:
    """`last_rows` of a stream: the rows that are kept after the last batch."""
    schema = ", ".join(f"`{n}` {t}" for n, t in events.dtypes)

    def step(batch: DataFrame, kept: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        return batch.limit(0), last_rows(batch, keys, order, most, kept)

    run_with_state(events, step, folder, schema, schema)
    spark = events.sparkSession
    return spark.read.schema(schema).parquet(latest_state(spark, folder)) if _exists(spark, f"{folder}/state") else spark.createDataFrame([], events.schema)


def latest_state(spark: SparkSession, folder: str) -> str:
    """The path of the last version of a stream's state."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/state")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    return f"{folder}/state/{max(int(x.getPath().getName()) for x in found)}"
