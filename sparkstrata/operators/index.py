"""Search and retrieval indexes over files, functions and import edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkstrata.functions.classify import semantic_role
from sparkstrata.functions.text import index_tokens, strings
from sparkstrata.operators.graph import dealt, merged

#: Parts of a path that add a token.
HINTS = {"route": ["route"], "middleware": ["middleware"], "service": ["service"], "controller": ["controller"], "auth": ["auth"],
         "hook": ["hook"], "use": ["hook"], "store": ["state", "reducer", "store"], "slice": ["state", "reducer", "store"], "reducer": ["state", "reducer", "store"]}


def import_lists(edges: DataFrame) -> DataFrame:
    """(id, imports, imported_by): sorted sets of both directions."""
    out = edges.groupBy(F.col("source").alias("id")).agg(F.array_sort(F.collect_set("target")).alias("imports"))
    into = edges.groupBy(F.col("target").alias("id")).agg(F.array_sort(F.collect_set("source")).alias("imported_by"))
    none = F.array().cast("array<string>")
    return out.join(into, "id", "full").select("id", F.coalesce("imports", none).alias("imports"), F.coalesce("imported_by", none).alias("imported_by"))


def retrieval_index(files: DataFrame, edges: DataFrame, functions: DataFrame, structures: DataFrame, rows: int = 0) -> DataFrame:
    """A row for each file: is_barrel, barrel_targets, semantic_role, imports, imported_by, n_functions, n_structures.

    A barrel is marked by the parser or has neither functions nor structures but
    a re-export. Edges are taken as they are, also those to unknown files. Ids
    may be numbers; then ``files`` has their ``path`` too, and so has the index.
    ``rows`` is about how many edges there are. An edge is shuffled by each of
    its ends once, and not by its source where edges are dealt out by it.
    """
    named = [c for c in ["path"] if c in files.columns]
    n_f = functions.groupBy(F.col("file").alias("id")).agg(F.count("*").alias("n_functions"))
    n_s = structures.groupBy(F.col("file").alias("id")).agg(F.count("*").alias("n_structures"))
    again = F.col("kind") == "re-export"
    out = edges.groupBy(F.col("source").alias("id")).agg(
        F.array_sort(F.collect_set("target")).alias("imports"), F.array_sort(F.collect_set(F.when(again, F.col("target")))).alias("targets"), F.max(again).alias("re_exports")
    )
    into = dealt(edges.select("source", "target"), "target", rows=rows).groupBy(F.col("target").alias("id")).agg(F.array_sort(F.collect_set("source")).alias("imported_by"))
    x = files.select("id", *named, "is_barrel")
    for other in (out, into, n_f, n_s):
        x = x.join(merged(other), "id", "left")
    none = F.array().cast(out.schema["imports"].dataType)
    nf, ns = F.coalesce("n_functions", F.lit(0)), F.coalesce("n_structures", F.lit(0))
    barrel = F.coalesce("is_barrel", F.lit(False)) | ((nf == 0) & (ns == 0) & F.coalesce("re_exports", F.lit(False)))
    return x.select(
        "id", *named, barrel.alias("is_barrel"), F.when(barrel, F.coalesce("targets", none)).otherwise(none).alias("barrel_targets"),
        semantic_role(F.col(*named or ["id"]), barrel).alias("semantic_role"), F.coalesce("imports", none).alias("imports"),
        F.coalesce("imported_by", none).alias("imported_by"), nf.cast("long").alias("n_functions"), ns.cast("long").alias("n_structures"),
    )


def search_index(files: DataFrame, functions: DataFrame, edges: DataFrame) -> DataFrame:
    """Entries of files, exported functions, and test suites and cases, with their tokens.

    ``files`` has (id, label, language, kind, is_entry_point, is_dead_code,
    package, hub_score, test_suites, test_cases); ``functions`` (id, name, file,
    kind, is_exported, is_async, n_callers).
    """
    none = F.array().cast("array<string>")
    degree = edges.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n"))
    low = F.lower("id")
    hints = [F.when(low.contains(k), strings(v)).otherwise(none) for k, v in HINTS.items()]
    flags = [F.when(F.col("is_entry_point"), strings(["entry", "entrypoint"])).otherwise(none), F.when(F.col("is_dead_code"), strings(["dead", "deadcode", "unused"])).otherwise(none),
             F.when(F.col("package").isNotNull(), index_tokens(F.col("package"))).otherwise(none)]
    own = files.join(degree, "id", "left")
    columns = ["id", "type", "name", "file", "language", "kind", "is_entry_point", "is_dead_code", "package", "tokens", "usage_count", "hub_score"]
    null = lambda t: F.lit(None).cast(t)
    a = own.select(
        "id", F.when(F.col("kind") == "test", "test").otherwise("file").alias("type"), F.col("label").alias("name"), F.col("id").alias("file"), "language", "kind",
        "is_entry_point", F.coalesce("is_dead_code", F.lit(False)).alias("is_dead_code"), "package",
        F.array_distinct(F.array_compact(F.concat(index_tokens(F.col("id")), index_tokens(F.col("label")), F.array("language", "kind"), *flags, *hints))).alias("tokens"),
        F.coalesce("n", F.lit(0)).cast("long").alias("usage_count"), F.coalesce("hub_score", F.lit(0.0)).alias("hub_score"),
    )
    is_async = F.when(F.col("is_async"), strings(["async"])).otherwise(none)
    b = functions.where("is_exported").select(
        "id", F.lit("export").alias("type"), "name", "file", null("string").alias("language"), "kind", null("boolean").alias("is_entry_point"),
        null("boolean").alias("is_dead_code"), null("string").alias("package"),
        F.array_distinct(F.array_compact(F.concat(index_tokens(F.col("name")), index_tokens(F.col("file")), F.array("kind"), is_async))).alias("tokens"),
        F.col("n_callers").cast("long").alias("usage_count"), null("double").alias("hub_score"),
    )
    tests = files.where("kind = 'test'")
    out = a.unionByName(b)
    for column, what, words in (("test_suites", "suite", ["test", "suite", "describe"]), ("test_cases", "case", ["test", "case", "it"])):
        c = tests.select(F.col("id").alias("file"), F.explode(column).alias("name")).select(
            F.concat("file", F.lit(f"::{what}::"), "name").alias("id"), F.lit("test").alias("type"), "name", "file", null("string").alias("language"),
            F.lit(f"test-{what}").alias("kind"), null("boolean").alias("is_entry_point"), null("boolean").alias("is_dead_code"), null("string").alias("package"),
            F.concat(index_tokens(F.col("name")), strings(words)).alias("tokens"), null("long").alias("usage_count"), null("double").alias("hub_score"),
        )
        out = out.unionByName(c)
    return out.select(*columns)


def inline_index(files: DataFrame) -> DataFrame:
    """Entries of files with tokens from path and label alone."""
    parts = lambda c: F.filter(F.split(F.lower(F.col(c)), "[^a-z0-9]+"), lambda x: F.length(x) > 1)
    return files.select("id", F.lit("file").alias("type"), F.col("label").alias("name"), F.col("id").alias("file"), F.array_distinct(F.concat(parts("id"), parts("label"))).alias("tokens"))
