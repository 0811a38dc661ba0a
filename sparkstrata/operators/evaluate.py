"""Retrieval metrics, usage totals and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KS = (1, 3, 5, 10)


def retrieval_metrics(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(query, p_at_1 ... p_at_10, r_at_1 ... r_at_10, reciprocal_rank) of each query that has a truth.

    ``predicted`` has (query, id, rank), ``truth`` (query, id); ids match
    regardless of case. Precision divides by what was returned, k at most.
    """
    wanted = truth.select("query", F.lower("id").alias("id")).distinct()
    got = predicted.select("query", F.lower("id").alias("id"), "rank")
    hits = got.join(wanted.withColumn("hit", F.lit(1)), ["query", "id"], "left")
    per = hits.groupBy("query").agg(
        *[F.count_if((F.col("rank") <= k) & F.col("hit").isNotNull()).alias(f"h{k}") for k in KS], *[F.count_if(F.col("rank") <= k).alias(f"n{k}") for k in KS],
        F.min(F.when(F.col("hit").isNotNull(), F.col("rank"))).alias("first"),
    )
    x = wanted.groupBy("query").agg(F.count("*").alias("t")).join(per, "query", "left")
    share = lambda a, b: F.coalesce(a / F.when(b > 0, b), F.lit(0.0))
    return x.select(
        "query", *[share(F.col(f"h{k}"), F.col(f"n{k}")).alias(f"p_at_{k}") for k in KS], *[share(F.col(f"h{k}"), F.col("t")).alias(f"r_at_{k}") for k in KS],
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
    )


def truth_of_pulls(pulls: DataFrame) -> DataFrame:
    """(query, id): the files that an issue's merged pulls change, or its closed ones' where none is merged.

    ``pulls`` has (query, is_merged, state, changed_files); paths get forward
    slashes and lose a leading ./, each comes once. Null flags count as not
    merged, null lists as empty; issues with open pulls alone have no rows.
    """
    merged = F.coalesce("is_merged", F.lit(False))
    own = pulls.withColumn("merged", merged).withColumn("any", F.bool_or("merged").over(Window.partitionBy("query")))
    own = own.where(F.col("merged") | (~F.col("any") & (F.col("state") == "closed")))
    path = F.regexp_replace(F.translate("file", "\\", "/"), r"^\./", "")
    return own.select("query", F.explode("changed_files").alias("file")).select("query", path.alias("id")).where("id is not null").distinct()


def mean_metrics(metrics: DataFrame) -> DataFrame:
    """One row with the means of all metrics over the queries."""
    return metrics.agg(F.count("*").alias("n_queries"), *[F.avg(c).alias(c) for c in metrics.columns if c != "query"])


def usage_totals(calls: DataFrame) -> DataFrame:
    """One row of totals of calls (operation, prompt_tokens, completion_tokens, cost), with the calls of each operation as a map."""
    per = calls.groupBy("operation").agg(F.count("*").alias("n"), F.sum("prompt_tokens").alias("p"), F.sum("completion_tokens").alias("c"), F.sum("cost").alias("cost"))
    return per.agg(
        F.sum("n").alias("n_calls"), F.sum("p").alias("prompt_tokens"), F.sum("c").alias("completion_tokens"), F.sum("cost").alias("cost"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("operation", "n")))).alias("by_operation"),
    )


def within_limit(requests: DataFrame, key: str, ts: str, order: list, most: int) -> DataFrame:
    """Requests with their number among the key's of the day, and whether the limit lets them through."""
    day = F.to_date(ts)
    n = F.row_number().over(Window.partitionBy(key, day).orderBy(*order))
    return requests.withColumn("day", F.date_format(ts, "yyyy-MM-dd")).withColumn("nth", n.cast("long")).withColumn("is_allowed", F.col("nth") <= most)


def newest(rows: DataFrame, order: list, most: int = 1000) -> DataFrame:
    """The ``most`` first rows in the given order, as a bounded list keeps them."""
    return rows.orderBy(*order).limit(most)
