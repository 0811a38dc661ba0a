"""BM25 ranking of files for issues, and the scored expansion along the import graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkstrata.functions.classify import is_low_signal, is_noise, is_test, schema_hit
from sparkstrata.functions.text import base_name, ranker_tokens
from sparkstrata.operators.graph import cut_lineage, dealt, merged

#: Fixed values of the ranking.
K1, B, STRONG, WEAK, NAME_TIMES, TEST_FACTOR, PATH_BONUS, NAME_BONUS = 1.2, 0.75, 3.0, 1.0, 3, 0.55, 50.0, 25.0
#: Fixed values of the expansion: scores of seeds, decay, least score, expanding seeds and most results.
SEED_PR, SEED_EXACT, SEED_KEYWORD, SEED_KEYWORD_SPAN, SEED_BARREL = 140.0, 135.0, 90.0, 40.0, 70.0
DECAY, TEST_DECAY, LEAST, EXPANDING, MOST, KEYWORD_SEEDS, RANKED = 0.6, 0.5, 15.0, 5, 12, 15, 45


def file_terms(files: DataFrame) -> DataFrame:
    """(id, term) of each file: its path, three times its name, and its functions' and structures' names; repeats stay.

    ``files`` has (id, function_names, structure_names).
    """
    stem = F.regexp_replace(base_name(F.col("id")), r"\.[^.]+$", "")
    named = lambda c: F.flatten(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), ranker_tokens))
    terms = F.concat(ranker_tokens(F.col("id")), *[ranker_tokens(stem)] * NAME_TIMES, named("function_names"), named("structure_names"))
    return files.select("id", F.explode(terms).alias("term"))


def query_terms(intents: DataFrame) -> DataFrame:
    """(query, term, weight) of intents (query, strong_identifiers, weak_terms, entities): the greatest weight of each term."""
    pieces = lambda c, w: intents.select("query", F.explode(F.flatten(F.transform(c, ranker_tokens))).alias("term"), F.lit(w).alias("weight"))
    own = pieces("strong_identifiers", STRONG).unionByName(pieces("weak_terms", WEAK))
    rest = pieces("entities", WEAK).join(own.select("query").distinct(), "query", "left_anti")
    return own.unionByName(rest).groupBy("query", "term").agg(F.max("weight").alias("weight"))


def bm25(terms: DataFrame, wanted: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query, id, bm25) of documents' terms (id, term) for weighted query terms (query, term, weight).

    Term counts are written once, so that texts are split once; lengths and
    document counts come from them, and the join keeps the query terms alone.
    """
    counts = cut_lineage(terms.groupBy("id", "term").agg(F.count("*").alias("tf")), "terms")
    mine = counts.join(wanted.select("term").distinct(), "term", "left_semi")
    return _scores(mine, counts.groupBy("id").agg(F.sum("tf").alias("dl")), wanted, k1, b)


def bm25_of_texts(texts: DataFrame, wanted: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """`bm25` of texts whose terms are arrays (id, terms): a length is the size of an array, and terms that no query has are dropped before any are counted.

    Texts without terms count as no documents; those of one id are one document.
    """
    own = cut_lineage(texts.select("id", "terms"), "terms")
    lengths = own.groupBy("id").agg(F.sum(F.size("terms")).alias("dl")).where("dl > 0")
    asked = F.broadcast(wanted.select("term").distinct())  # the words of the queries at hand
    mine = own.select("id", F.explode("terms").alias("term")).join(asked, "term", "left_semi").groupBy("id", "term").agg(F.count("*").alias("tf"))
    return _scores(mine, lengths, wanted, k1, b)


def _scores(mine: DataFrame, lengths: DataFrame, wanted: DataFrame, k1: float, b: float) -> DataFrame:
    """Scores by counts of the query terms (id, term, tf) and all documents' lengths (id, dl)."""
    whole = lengths.agg(F.count("*").alias("n"), F.sum("dl").alias("total"))
    df = mine.groupBy("term").agg(F.count("*").alias("df"))
    n, avg = F.greatest(F.col("n"), F.lit(1)), F.col("total") / F.greatest(F.col("n"), F.lit(1))
    x = mine.join(df, "term").join(merged(lengths), "id").crossJoin(F.broadcast(whole))  # one row
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avg))
    scored = x.select("id", "term", part.alias("part")).join(wanted, "term")
    return scored.groupBy("query", "id").agg(F.sum(F.col("weight") * F.col("part")).alias("bm25"))


def path_bonus(id: Column, paths: Column) -> Column:
    """50 if a file's path ends with a path of the issue, 25 if its name is one's name, else 0."""
    low = F.lower(id)
    base = base_name(low)
    each = F.transform(paths, lambda p: F.when(low.endswith(p), PATH_BONUS).when((base == p) | (base == base_name(p)), NAME_BONUS).otherwise(0.0))
    return F.coalesce(F.array_max(each), F.lit(0.0))


def exact_matches(files: DataFrame, intents: DataFrame) -> DataFrame:
    """(query, id, bonus) of the files that an issue's paths name, with the best bonus.

    A path that a file's path ends with, or whose name is the file's, ends the
    file's name with its own, so both sides join on the ends of names.
    """
    paths = intents.select("query", F.explode(F.array_distinct("exact_paths")).alias("p")).withColumn("end", base_name(F.col("p"))).where("end <> ''")
    base = base_name(F.lower("id"))
    ends = F.transform(F.sequence(F.lit(1), F.length(base)), lambda n: F.substr(base, n))
    own = files.select("id").where(F.length(base) > 0).distinct().withColumn("end", F.explode(ends))
    bonus = path_bonus(F.col("id"), F.array("p"))
    # a file has a row for each character of its name, which no estimate knows; the paths are words of the queries at hand
    return own.join(F.broadcast(paths), "end").groupBy("query", "id").agg(F.max(bonus).alias("bonus")).where("bonus > 0")


def rank_files(files: DataFrame, intents: DataFrame, limit: int = 40) -> DataFrame:
    """(query, id, score, rank) of files for intents (query and the fields of `search_intent`).

    Noise and low-signal files are left out; tests count 0.55 before the bonus
    for paths that the issue names.
    """
    own = files.where(~is_noise(F.col("id")) & ~is_low_signal(F.col("id")))
    scores = bm25(file_terms(own), query_terms(intents))
    named = exact_matches(own, intents)
    x = scores.join(named, ["query", "id"], "full")
    score = F.coalesce("bm25", F.lit(0.0)) * F.when(is_test(F.col("id")), TEST_FACTOR).otherwise(1.0) + F.coalesce("bonus", F.lit(0.0))
    x = x.select("query", "id", score.alias("score"), F.coalesce("bm25", F.lit(0.0)).alias("bm25"), F.coalesce("bonus", F.lit(0.0)).alias("bonus")).where("score > 0")
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id")).cast("long")).where(F.col("rank") <= limit)


def both_ways(edges: DataFrame) -> DataFrame:
    """(id, to): distinct neighbours in either direction."""
    both = edges.select(F.col("source").alias("id"), F.col("target").alias("to")).unionByName(edges.select(F.col("target").alias("id"), F.col("source").alias("to")))
    return dealt(both, "id", "to").distinct()


def graph_neighbours(edges: DataFrame, calls: DataFrame) -> DataFrame:
    """(id, to): distinct neighbours by imports in either direction, and the files of the functions that a file's functions call.

    ``calls`` has (file, call) with called functions as file::name.
    """
    called = calls.select(F.col("file").alias("id"), F.substring_index("call", "::", 1).alias("to")).where("`to` <> ''")
    return both_ways(edges).unionByName(called).distinct()


def expand(seeds: DataFrame, neighbours: DataFrame, known: DataFrame, most: int = MOST, expanding: int = EXPANDING) -> DataFrame:
    """(query, id, score, rank): seeds (query, id, score) and what the five best of each query add to their neighbours.

    A neighbour (id, to) that is known, no noise and no low-signal file gets 0.6
    of the seed's score, half of that if it is a test; a link that gives less
    than 15 is too weak and gives nothing. Scores add up.
    """
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    first = seeds.withColumn("n", F.row_number().over(w)).where(F.col("n") <= expanding)
    step = F.col("score") * DECAY * F.when(is_test(F.col("to")), TEST_DECAY).otherwise(1.0)
    near = first.join(neighbours, "id").where("id <> to").where(~is_noise(F.col("to")) & ~is_low_signal(F.col("to")))
    near = near.join(merged(known.select(F.col("id").alias("to")).distinct()), "to", "left_semi").select("query", F.col("to").alias("id"), step.alias("score")).where(F.col("score") >= LEAST)
    total = seeds.select("query", "id", "score").unionByName(near).groupBy("query", "id").agg(F.sum("score").alias("score"))
    return total.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= most)


def priority_merge(candidates: DataFrame) -> DataFrame:
    """One row of each (query, id) of candidates (query, id, source, score): the source of the highest priority, of it the best score."""
    order = {"pr": 5, "keyword": 4, "barrel": 3, "neighborhood": 2, "gemini": 1}
    p = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("source")), F.lit(0))
    return candidates.groupBy("query", "id").agg(F.max_by(F.struct("source", "score"), F.struct(p, "score")).alias("r")).select("query", "id", "r.source", "r.score")


def expand_barrels(files: DataFrame, barrels: DataFrame) -> DataFrame:
    """Files (query, id) with each barrel (id, target) replaced by its targets, if it has any; each once."""
    return files.join(barrels, "id", "left").select("query", F.coalesce("target", "id").alias("id")).distinct()


def traverse(files: DataFrame, intents: DataFrame, neighbours: DataFrame, barrels: DataFrame, pr_files: DataFrame | None = None, most: int = MOST) -> DataFrame:
    """(query, id, source, score, rank): candidate files of issues.

    Seeds are a pull request's files (140), every file whose path the issue names
    (135), the other files among the 15 best ranked (90 to 130 by their score
    against the best), and the targets of the barrels among these (70; a barrel
    without targets is its own). Barrels are no other seeds. A file takes its
    best source. Seeds are expanded along the graph. ``barrels`` has (id,
    target), a null target for a barrel without any.
    """
    ranked = cut_lineage(rank_files(files, intents, RANKED), "ranked")
    exact = cut_lineage(exact_matches(files.where(~is_noise(F.col("id"))), intents).select("query", "id", F.lit(True).alias("exact")), "exact")
    best = ranked.groupBy("query").agg(F.max("score").alias("best"))
    first = ranked.where(F.col("rank") <= KEYWORD_SEEDS).join(best, "query").select("query", "id", (SEED_KEYWORD + SEED_KEYWORD_SPAN * F.col("score") / F.col("best")).alias("score"))
    pool = first.join(exact, ["query", "id"], "full").select("query", "id", F.when(F.col("exact"), SEED_EXACT).otherwise(F.col("score")).alias("score"))
    keyword = pool.join(merged(barrels.select("id").distinct()), "id", "left_anti").select("query", "id", F.lit("keyword").alias("source"), "score")
    barrel = pool.join(barrels, "id").select("query", F.coalesce("target", "id").alias("id"), F.lit("barrel").alias("source"), F.lit(SEED_BARREL).alias("score")).distinct()
    seeds = keyword.unionByName(barrel)
    if pr_files is not None:
        pulled = pr_files.join(files.select("id").distinct(), "id", "left_semi")
        seeds = seeds.unionByName(pulled.select("query", "id", F.lit("pr").alias("source"), F.lit(SEED_PR).alias("score")))
    seeds = cut_lineage(priority_merge(seeds), "seeds")
    cap = exact.groupBy("query").agg(F.greatest(F.lit(most), F.count("*") + 5).alias("cap"))
    out = expand(seeds.select("query", "id", "score"), neighbours, files, most=1 << 30).join(cap, "query", "left").where(F.col("rank") <= F.coalesce("cap", F.lit(most))).drop("cap")
    return out.join(seeds.select("query", "id", "source"), ["query", "id"], "left").select("query", "id", F.coalesce("source", F.lit("neighborhood")).alias("source"), "score", "rank")


#: Scores of the categories that a context can ask for, and of files that no neighbour gave.
CATEGORY_SCORES = {"usages": 90.0, "callers": 90.0, "callees": 90.0, "implementations": 90.0, "imports": 90.0, "exports": 85.0, "schemas": 85.0,
                   "configuration": 85.0, "tests": 85.0, "related modules": 80.0, "neighboring graph nodes": 80.0}
CATEGORY_ELSEWHERE = 80.0
CATEGORY_TEST = r"(?i)\.(test|spec)\.(ts|js|tsx|jsx)$|/__(tests?|mocks?)__/"


def expand_categories(seeds: DataFrame, index: DataFrame, categories: list[str], calls: DataFrame | None = None) -> DataFrame:
    """(id, score, category): files that the categories add to seeds (id), later categories overwriting earlier ones.

    ``index`` is a retrieval index, ``calls`` has (file, call) with called
    functions as file::name, or (file, to) with their files: callers of a seed's
    functions are usages, the files of what its functions call are callees.
    Schemas and tests are looked for among all files at score 80 if nothing at
    all has been found so far. Only known files that are no noise are given.
    Unknown categories give nothing. Where the index has ``path``, ids may be
    numbers and paths are given.

    Lists are kept of seeds alone, and calls are looked up by seeds before
    anything is made of them; what is written then has a row for each file.
    """
    wanted = [x.lower().strip() for x in categories]
    own = cut_lineage(seeds.select("id").distinct(), "seeds")
    path = F.col("path" if "path" in index.columns else "id")
    hit = schema_hit(path, F.col("semantic_role"), F.col("is_barrel"), F.col("n_structures"), F.col("n_functions"), F.size("imported_by"), F.size("imports"))
    files = index.join(merged(own.withColumn("is_seed", F.lit(True))), "id", "left").select(
        "id", path.alias("path"), hit.isNotNull().alias("is_schema"), path.rlike(CATEGORY_TEST).alias("is_test"), is_noise(path).alias("is_noise"),
        *[F.when(F.col("is_seed"), F.col(c)).alias(c) for c in ("imports", "imported_by")],
    )
    files = cut_lineage(files, "index")
    near = lambda c: cut_lineage(files.select(F.explode(c).alias("id")).distinct(), c)
    imports, importers = near("imports"), near("imported_by")
    callers = callees = files.select("id").where(F.lit(False))
    if calls is not None:
        named = "call" in calls.columns
        pairs = calls.select("file", F.substring_index("call", "::", 1).alias("to") if named else "to").where("file <> `to`")
        if {"usages", "callers"} & {*wanted}:
            callers = cut_lineage(pairs.join(merged(own.select(F.col("id").alias("to"))), "to", "left_semi").select(F.col("file").alias("id")).distinct(), "callers")
        if {"callees", "implementations", "imports"} & {*wanted}:
            pairs = pairs.where("`to` <> ''") if named else pairs
            callees = cut_lineage(pairs.join(merged(own.select(F.col("id").alias("file"))), "file", "left_semi").select(F.col("to").alias("id")).distinct(), "callees")
    around = imports.unionByName(importers).distinct()
    schemas, tests = files.where("is_schema").select("id"), files.where("is_test").select("id")
    known = files.where("not is_noise").select("id").distinct()
    every: DataFrame | None = None
    for n, c in enumerate(wanted):
        pool = schemas if c in ("schemas", "configuration") else tests
        if c in ("usages", "callers"):
            found = importers.unionByName(callers).distinct()
        elif c == "exports":
            found = importers
        elif c in ("callees", "implementations", "imports"):
            found = imports.unionByName(callees).distinct()
        elif c in ("schemas", "configuration", "tests"):
            found = around.join(merged(pool), "id", "left_semi")
        elif c in CATEGORY_SCORES:
            found = around
        else:
            continue
        got = found.join(merged(known), "id", "left_semi").select("id", F.lit(CATEGORY_SCORES[c]).alias("score"), F.lit(c).alias("category"), F.lit(n).alias("n"))
        every = got if every is None else every.unionByName(got)
        if c in ("schemas", "configuration", "tests"):
            none_yet = every.agg((F.count("*") == 0).alias("none_yet"))
            other = pool.join(merged(known), "id", "left_semi").crossJoin(F.broadcast(none_yet)).where("none_yet")  # one row
            every = every.unionByName(other.select("id", F.lit(CATEGORY_ELSEWHERE).alias("score"), F.lit(c).alias("category"), F.lit(n).alias("n")))
    if every is None:
        return files.select(F.col("path").alias("id"), F.lit(0.0).alias("score"), F.lit("").alias("category")).where(F.lit(False))
    best = every.groupBy("id").agg(F.max_by(F.struct("score", "category"), "n").alias("r"))
    return best.join(merged(files.select("id", "path").distinct()), "id").select(F.col("path").alias("id"), "r.score", "r.category")
