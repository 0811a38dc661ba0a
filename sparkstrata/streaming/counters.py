"""Usage counters over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkstrata.operators.graph import new_folder


def windowed_usage(events: DataFrame, ts: str, keys: list[str], length: str = "1 day", late: str = "1 hour", value: str | None = None) -> DataFrame:
    """(keys, window_start, n, total) of tumbling windows; rows later than ``late`` are dropped when ``events`` is a stream."""
    own = events.withColumn("event_time", F.col(ts).cast("timestamp"))
    if own.isStreaming:
        own = own.withWatermark("event_time", late)
    sums = [F.count("*").alias("n"), *([F.sum(value).alias("total")] if value else [])]
    out = own.groupBy(F.window("event_time", length).alias("w"), *keys).agg(*sums)
    return out.select(*keys, F.col("w.start").alias("window_start"), "n", *(["total"] if value else []))


def over_limit(usage: DataFrame, most: int) -> DataFrame:
    """Windows whose count reaches the limit."""
    return usage.where(F.col("n") >= most)


def distinct_jobs(jobs: DataFrame, ts: str, late: str = "1 hour") -> DataFrame:
    """Jobs (owner, repo) without those that are already under way, told by owner and repository regardless of case."""
    own = jobs.withColumn("event_time", F.col(ts).cast("timestamp")).withColumn("job_id", F.lower(F.concat_ws("--", "owner", "repo")))
    if own.isStreaming:
        return own.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["job_id"])
    return own.dropDuplicates(["job_id"])


def run_available(stream: DataFrame, name: str = "stream", mode: str = "complete") -> DataFrame:
    """What a stream gives for the input at hand, as a table in the folder of `new_folder`.

    Each batch is its own folder, written over if it runs again. In complete mode
    the last batch is the result, in append mode all are; no input gives no rows.
    The progress and state of the stream lie beside the batches.
    """
    if mode not in ("complete", "append"):
        raise ValueError(f"mode must be complete or append, not {mode}")
    spark = stream.sparkSession
    base = new_folder(spark, name)
    done: set[int] = set()

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows-{number}")
        done.add(number)

    stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start().awaitTermination()
    if not done:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*[f"{base}/rows-{n}" for n in (sorted(done) if mode == "append" else [max(done)])])
