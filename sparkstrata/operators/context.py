"""Contexts of files and snippets for questions and issues: the deterministic steps around a language model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkstrata.functions.classify import is_low_signal, is_noise, is_test
from sparkstrata.functions.text import STOPWORDS, line_slice, strip_boilerplate, strings
from sparkstrata.operators import budget, rank
from sparkstrata.operators.graph import cut_lineage

#: Words of a chat message that name nothing.
CHAT_STOPWORDS = (
    "tell show how why what give me you fix issue code file explain describe understand where who when does do can help please find get write "
    "make create change update delete remove add view read about here there this that"
).split()
#: Score of the file that is open, of fallback files, and how many of these there are.
CURRENT, FALLBACK, FALLBACKS = 10_000.0, 30, 5


def compact_map(index: DataFrame, functions: DataFrame, most: int = 8) -> DataFrame:
    """(id, line): each plain source file (id, is_barrel) with its first functions (file, name, ord)."""
    own = index.where(~F.col("is_barrel") & ~is_noise(F.col("id")) & ~is_test(F.col("id")) & ~is_low_signal(F.col("id"))).select("id")
    first = budget.first_per_group(functions, ["file"], ["ord", "name"], most)
    names = first.groupBy(F.col("file").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]), ", ").alias("names"))
    return own.join(names, "id", "left").select("id", F.concat_ws(": ", "id", "names").alias("line"))


def fallback_files(candidates: DataFrame) -> DataFrame:
    """(query, id, confidence): the five best candidates (query, id, score), tests last."""
    order = F.row_number().over(Window.partitionBy("query").orderBy(is_test(F.col("id")), F.desc("score"), "id"))
    return candidates.withColumn("n", order).where(F.col("n") <= FALLBACKS).select("query", "id", F.lit(FALLBACK).alias("confidence"))


def map_issues(intents: DataFrame, files: DataFrame, neighbours: DataFrame, barrels: DataFrame, navigate: Callable[[DataFrame], DataFrame] | None = None, judge: Callable[[DataFrame], DataFrame] | None = None, few: int = 5) -> DataFrame:
    """(query, id, confidence): files of issues by traversal, navigation and judgement.

    ``navigate`` (query to (query, id, score)) is asked for issues that are vague
    or have under ``few`` candidates; ``judge`` (candidates to (query, id,
    confidence)) decides. Both stand for a language model and may be left out;
    issues that nothing was found for fall back to their best candidates.
    """
    found = rank.traverse(files, intents, neighbours, barrels).select("query", "id", "source", "score")
    if navigate is not None:
        counts = intents.select("query", "is_vague").join(found.groupBy("query").agg(F.count("*").alias("n")), "query", "left")
        asked = counts.where("is_vague or coalesce(n, 0) < " + str(few)).select("query")
        found = rank.priority_merge(found.unionByName(navigate(asked).withColumn("source", F.lit("gemini")).select("query", "id", "source", "score")))
    if judge is None:
        return fallback_files(found)
    judged = judge(found)
    return judged.unionByName(fallback_files(found.join(judged.select("query").distinct(), "query", "left_anti")))


def useful_entities(entities: Column) -> Column:
    stop = strings([*CHAT_STOPWORDS])
    return F.filter(entities, lambda x: ~F.array_contains(stop, F.lower(x)))


def chat_context(intents: DataFrame, files: DataFrame, neighbours: DataFrame, barrels: DataFrame, functions: DataFrame, contents: DataFrame, current: str, most: int = 25_000) -> DataFrame:
    """(query, id, function_id, body, score, acc): snippets for chat messages within a budget of characters.

    The open file scores above all others. ``functions`` has (file, function_id,
    name, is_exported, ord, start_line, end_line), ``contents`` (file, content).
    """
    own = intents.withColumn("entities", useful_entities(F.col("entities")))
    found = rank.traverse(files, own, neighbours, barrels).select("query", "id", "score")
    open_file = own.select("query", F.lit(current).alias("id"), F.lit(CURRENT).alias("score"))
    # both are few rows of many; written, they have their true size where they are joined with all functions and contents
    ranked = cut_lineage(found.unionByName(open_file).groupBy("query", "id").agg(F.max("score").alias("score")), "ranked")
    chosen = budget.select_functions(ranked.select(F.col("id").alias("file")).distinct().withColumn("source", F.lit("keyword")), functions.select("file", "function_id", "name", "is_exported", "ord"), [])
    spans = functions.select("file", "function_id", "start_line", "end_line")
    bodies = cut_lineage(chosen, "chosen").join(spans, ["file", "function_id"]).join(contents, "file")
    body = line_slice(F.col("content"), F.col("start_line"), F.least("end_line", F.col("start_line") + 699))
    x = bodies.select(F.col("file").alias("id"), "function_id", "nth", body.alias("body")).join(ranked, "id")
    return budget.char_budget(x, ["query"], [F.desc("score"), "id", "nth"], F.length("body"), most).select("query", "id", "function_id", "body", "score", "acc")


def previews(candidates: DataFrame, contents: DataFrame) -> DataFrame:
    """(id, mode, body): how files without functions (id, is_barrel, role, source) are shown."""
    mode = budget.preview_mode(F.col("is_barrel"), F.col("role"), F.col("source"))
    x = candidates.withColumn("m", mode).join(contents.select(F.col("file").alias("id"), "content"), "id")
    return x.select("id", F.col("m.mode").alias("mode"), line_slice(strip_boilerplate(F.col("content")), F.lit(1), F.col("m.most")).alias("body"))


def callers_and_callees(call_edges: DataFrame, functions: DataFrame, function_id: str) -> DataFrame:
    """(id, relation, file) of what calls a function and what it calls."""
    into = call_edges.where(F.col("target") == function_id).select(F.col("source").alias("id"), F.lit("caller").alias("relation"))
    out = call_edges.where(F.col("source") == function_id).select(F.col("target").alias("id"), F.lit("callee").alias("relation"))
    return into.unionByName(out).distinct().join(functions.select("id", "file"), "id")


def structure_users(structures: DataFrame, functions: DataFrame) -> DataFrame:
    """(structure, function): functions (id, calls) whose calls name a structure (name)."""
    calls = functions.select(F.col("id").alias("function"), F.explode("calls").alias("structure"))
    return calls.join(structures.select(F.col("name").alias("structure")).distinct(), "structure", "left_semi").distinct()


def highlighted(nodes: DataFrame, text: str) -> DataFrame:
    """Nodes (id, label) whose label or path contains a text."""
    low = text.lower()
    return nodes.where(F.lower("label").contains(low) | F.lower("id").contains(low))


def with_confidence(nodes: DataFrame, mapped: DataFrame) -> DataFrame:
    """Nodes (id) with the confidence of the mapped files (id, confidence), null for others."""
    return nodes.join(mapped.groupBy("id").agg(F.max("confidence").alias("confidence")), "id", "left")


def limited_side(side: DataFrame, order: list, most: int = 12) -> DataFrame:
    """(id, nth, n_more): the first rows of a side of a focus, and how many more there are."""
    n = F.row_number().over(Window.orderBy(*order))  # a side is what one node's walk meets
    total = side.agg(F.count("*").alias("total"))
    return side.orderBy(*order).limit(most).withColumn("nth", n.cast("long")).crossJoin(F.broadcast(total)).select("id", "nth", F.greatest(F.col("total") - most, F.lit(0)).alias("n_more"))  # one row


def search_terms_of(message: Column) -> Column:
    """Words of a message that are neither stopwords nor chat words."""
    words = F.filter(F.split(F.lower(message), "[^a-z0-9]+"), lambda x: x != "")
    return F.filter(words, lambda x: ~F.array_contains(strings([*STOPWORDS, *CHAT_STOPWORDS]), x))
