import random
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkstrata.streaming import counters, stateful

REQUESTS = "request_id long, at timestamp, device string, address string, tokens long"


def requests(spark, seed, n):
    r = random.Random(seed)
    rows = [(k, f"2024-01-0{r.randrange(1, 4)} {r.randrange(24):02d}:{r.randrange(60):02d}:00", r.choice(["hot", "hot", "hot", "a", "b", None, ""]), r.choice(["x", "x", "y", "z", None]), r.choice([None, 0, 10, 40])) for k in range(n)]
    return rows, spark.createDataFrame(rows, REQUESTS.replace("timestamp", "string")).withColumn("at", F.col("at").cast("timestamp"))


def plain_limits(rows, limits):
    per_device, per_address, all_, most = limits
    n, used, out = Counter(), Counter(), {}
    for k, at, device, address, tokens in sorted(rows, key=lambda x: (x[1], x[0])):
        day = at[:10]
        buckets = ([(day, "device", device)] if device else []) + [(day, "ip", address), (day, "global", "")]
        over = [b[1] for b, m in zip(buckets, ([per_device] if device else []) + [per_address, all_]) if n[b] >= m]
        reason = over[0] if over else "tokens" if used[buckets[0]] >= most else None
        if not reason:
            n.update(buckets)
            used[buckets[0]] += tokens or 0
        out[k] = (reason is None, reason)
    return out


@pytest.mark.parametrize("limits", [(5, 9, 20, 100), (3, 100, 100, 60), (100, 100, 7, 1000)])
def test_request_limits_against_brute_force(spark, limits):
    rows, df = requests(spark, 5, 150)
    got = {x.request_id: (x.is_allowed, x.reason) for x in stateful.request_limits(df, limits).collect()}
    assert got == plain_limits(rows, limits)
    assert {x for _, x in got.values()} - {None}
    assert stateful.request_limits(df.limit(0), limits).count() == 0


def test_request_limits_of_a_stream_after_a_restart(spark, tmp_path):
    """Runs of one query over files that come in order of time decide as one run over all."""
    limits = (5, 9, 20, 100)
    rows, df = requests(spark, 9, 120)
    parts = df.withColumn("part", F.ntile(4).over(Window.orderBy("at", "request_id")))
    parts.write.partitionBy("part").parquet(str(tmp_path / "all"))
    for part in (1, 2, 3, 4):
        spark.read.parquet(str(tmp_path / "all")).where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(REQUESTS).parquet(str(tmp_path / "in"))
        out = stateful.limit_stream(stream, str(tmp_path / "kept"), limits, 9)
    assert {x.request_id: (x.is_allowed, x.reason) for x in out.collect()} == plain_limits(rows, limits)
    assert len(list((tmp_path / "kept" / "state").iterdir())) == 2  # older versions are gone


def test_last_rows_of_a_stream(spark, tmp_path):
    r = random.Random(3)
    rows = [(k, r.choice(["a", "a", "b", None]), r.randrange(1000)) for k in range(200)]
    schema = "n long, k string, v long"
    want = {}
    for n, k, v in rows:
        want.setdefault(k, []).append((v, n))
    want = sorted((v, n) for x in want.values() for v, n in sorted(x)[-7:])
    assert sorted((x.v, x.n) for x in stateful.last_rows(spark.createDataFrame(rows, schema), ["k"], ["v", "n"], 7).collect()) == want
    for part in range(3):
        spark.createDataFrame(rows[part * 70 : part * 70 + 70], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        out = stateful.last_rows_of_stream(stream, str(tmp_path / "kept"), ["k"], ["v", "n"], 7)
    assert sorted((x.v, x.n) for x in out.collect()) == want


def test_last_rows_grow_old(spark):
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:01:00"), ("b", "2024-01-01 00:00:00"), ("b", None)]
    df = spark.createDataFrame(rows, "k string, at string").withColumn("at", F.col("at").cast("timestamp"))
    got = stateful.last_rows(df, ["k"], ["at"], 5, newest="at", keep_seconds=30).collect()
    assert sorted((x.k, str(x.at)[-5:]) for x in got) == [("a", "01:00"), ("b", "00:00"), ("b", "None")]


def test_distinct_jobs(spark, tmp_path):
    rows = [("Ann", "Repo", "2024-01-01 01:00:00"), ("ann", "repo", "2024-01-01 01:10:00"), ("bob", "repo", "2024-01-01 01:00:00"), (None, "repo", "2024-01-01 01:00:00")]
    df = spark.createDataFrame(rows, "owner string, repo string, at string")
    assert sorted(x.job_id for x in counters.distinct_jobs(df, "at").collect()) == ["ann--repo", "bob--repo", "repo"]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    assert sorted(x.job_id for x in counters.run_available(counters.distinct_jobs(stream, "at"), mode="append").collect()) == ["ann--repo", "bob--repo", "repo"]
