"""Fuzzy search over a search index, and the legacy issue mapping built on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkstrata.functions.text import half_up, keyword_tokens, query_tokens, token_similarity


def search(entries: DataFrame, queries: DataFrame, limit: int | None = 50, threshold: float = 0.0, type: str | None = None, kind: str | None = None, package: str | None = None) -> DataFrame:
    """(query, id, score, n_matched, matched) of the entries that match each query.

    ``entries`` has (id, type, name, file, kind, package, tokens, usage_count,
    is_entry_point, hub_score, is_dead_code), ``queries`` (query), few rows that
    are broadcast. Distinct pairs of a query token and an entry token are
    compared once each, so the edit distance isn't computed again for every
    entry; entries then join their best similarity. Of up to three query tokens
    half must match, of more one; ``matched`` lists those that do in the query's
    order. ``limit`` None gives all matches.
    """
    own = entries
    for column, value in (("type", type), ("kind", kind), ("package", package)):
        if value is not None:
            own = own.where(F.col(column) == value)
    q = queries.select("query", query_tokens(F.col("query")).alias("qts"))
    q = q.where(F.size("qts") > 0)
    asked = q.select("query", F.size("qts").alias("n_tokens"), F.posexplode("qts").alias("pos", "qt"))
    tokens = own.select("id", F.explode(F.array_distinct("tokens")).alias("token"))
    kinds = tokens.select("token").distinct()
    near = kinds.crossJoin(F.broadcast(asked.select("qt").distinct())).select("token", "qt", token_similarity(F.col("qt"), F.col("token")).alias("sim")).where("sim > 0")  # query tokens are few
    best = tokens.join(near, "token").groupBy("id", "qt").agg(F.max("sim").alias("sim"))
    hits = best.join(asked, "qt").groupBy("query", "id").agg(F.max("n_tokens").alias("n_tokens"), F.sum(F.round(F.col("sim") * 10).cast("long")).alias("tenths"), F.countDistinct("qt").alias("n_matched"), F.array_sort(F.collect_set(F.struct("pos", "qt"))).alias("m"))
    x = hits.join(own.drop("tokens"), "id")
    ratio = F.col("n_matched") / F.col("n_tokens")
    name, query = F.lower("name"), F.lower(F.trim("query"))
    usage = F.coalesce("usage_count", F.lit(0))
    hub = F.coalesce("hub_score", F.lit(0.0))
    score = (
        F.col("tenths") * 6.0 / F.col("n_tokens")
        + F.when(name == query, 30).when(name.startswith(query) | name.endswith(query), 15).when(name.contains(query), 10).otherwise(0)
        + F.when(query.contains("/") & F.lower("file").contains(query), 20).otherwise(0)
        + F.when(usage > 0, F.least(F.lit(10.0), F.log1p(usage) * 2)).otherwise(0.0)
        + F.when(((F.col("type") == "test") | F.coalesce(F.col("kind") == "test", F.lit(False))) & (ratio == 1), 5).otherwise(0)
        + F.when(F.coalesce("is_entry_point", F.lit(False)), 3).otherwise(0)
        + F.when(hub > 0, F.least(F.lit(5.0), hub / 100 * 5)).otherwise(0.0)
        - F.when(F.coalesce("is_dead_code", F.lit(False)), 15).otherwise(0)
    )
    enough = F.when(F.col("n_tokens") <= 3, ratio >= 0.5).otherwise(F.col("n_matched") >= 1)
    out = x.where(enough).select("query", "id", "name", "file", "type", "kind", F.least(F.lit(100.0), half_up(score, 1)).alias("score"), F.col("n_matched").cast("long").alias("n_matched"), F.array_distinct(F.transform("m", lambda x: x["qt"])).alias("matched"))
    out = out.where((F.col("score") >= threshold) & (F.col("score") > 0))
    if limit is None:
        return out
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "name", "id"))
    return out.withColumn("rank", rank.cast("long")).where(F.col("rank") <= limit)


def _mapped(parts: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Sums of scores with their reasons, the best ``most`` of each issue."""
    from pyspark.sql import Window

    sums = parts.groupBy("query", *keys).agg(F.sum("part").alias("s"), F.array_sort(F.collect_list("reason")).alias("r"))
    scored = sums.select("query", *keys, F.least(F.lit(100.0), half_up(F.col("s"))).cast("long").alias("score"), F.transform("r", lambda x: x["text"]).alias("reasons"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), *keys)).cast("long")).where(F.col("rank") <= most)


def _issue_matches(entries: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """(query, type, id, name, file, score, matched, rank): what three searches find for the keywords of issue texts."""
    spoken = queries.select("query", F.array_join(keyword_tokens(F.col("query")), " ").alias("words")).where("words <> ''")
    names = spoken.select(F.col("words").alias("query"), F.col("query").alias("issue")).distinct()
    every = None
    for t, limit in (("file", 2 * most), ("export", 2 * most), ("test", most)):
        found = search(entries, spoken.select(F.col("words").alias("query")).distinct(), limit=limit, threshold=20, type=t)
        every = found if every is None else every.unionByName(found)
    return every.join(names, "query").select(F.col("issue").alias("query"), "type", "id", "name", "file", "score", "matched", "rank")


def _reason(ord_: int, what, score):
    return F.struct(F.lit(ord_).alias("ord"), "rank", F.concat(what, F.lit(" (+"), half_up(score).cast("long").cast("string"), F.lit(")")).alias("text")).alias("reason")


def map_issue(entries: DataFrame, queries: DataFrame, most: int = 10) -> DataFrame:
    """(query, file, score, reasons, rank): files for issue texts by three searches.

    A file gets the score of its own match, 0.8 of its exports' and half of its
    tests' matches. The reason of a file's match lists the words that matched.
    """
    x = _issue_matches(entries, queries, most)
    quoted = lambda before, c: F.concat(F.lit(f'{before} "'), c, F.lit('"'))
    name = F.col("name")
    parts = None
    for ord_, (t, weight, what) in enumerate(
        (("file", 1.0, quoted("file match:", F.array_join("matched", ", "))), ("export", 0.8, quoted("contains matching export", name)), ("test", 0.5, quoted("test coverage match:", name)))
    ):
        part = F.col("score") * weight
        got = x.where(F.col("type") == t).select("query", "file", part.alias("part"), _reason(ord_, what, part))
        parts = got if parts is None else parts.unionByName(got)
    return _mapped(parts, ["file"], most)


def map_issue_functions(entries: DataFrame, queries: DataFrame, most: int = 10) -> DataFrame:
    """(query, id, file, score, reasons, rank): exported functions for issue texts."""
    x = _issue_matches(entries, queries, most).where("type = 'export'")
    what = F.concat(F.lit('export match: "'), "name", F.lit('"'))
    return _mapped(x.select("query", "id", "file", F.col("score").alias("part"), _reason(0, what, F.col("score"))), ["id", "file"], most)


def issue_confidence(files: DataFrame, functions: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, matched_keywords, confidence): the words of issue texts and the best score of their files (`map_issue`) and functions."""
    best = files.select("query", "score").unionByName(functions.select("query", "score")).groupBy("query").agg(F.max("score").alias("best"))
    words = queries.select("query", keyword_tokens(F.col("query")).alias("matched_keywords")).distinct()
    return words.join(best, "query", "left").select("query", "matched_keywords", F.coalesce("best", F.lit(0)).cast("long").alias("confidence"))


def suggestions(entries: DataFrame, text: str, most: int = 25) -> DataFrame:
    """(id, label, tier) of entries (id, label, path) for a typed text: equal, prefix, contained in the label, contained in the path."""
    label, path = F.lower("label"), F.lower("path")
    low = text.lower()
    tier = F.when(label == low, 0).when(label.startswith(low), 1).when(label.contains(low), 2).when(path.contains(low), 3)
    return entries.withColumn("tier", tier).where("tier is not null").orderBy("tier", F.length("label"), "id").limit(most).select("id", "label", "tier")
