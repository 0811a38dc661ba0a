"""Unused exports, orphan symbols and dead-code scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkstrata.functions.classify import in_penalty_folder, in_utility_folder, is_framework_file
from sparkstrata.operators.graph import dealt, degrees, merged

#: Weight of each sign, and the score from which a file counts as dead.
WEIGHTS = {
    "zero_in": 25, "exports_unused": 20, "zero_out": 10, "not_entry": 10, "not_test": 5, "not_config": 5, "no_functions": 5, "penalty_folder": 10,
    "low_importance": 5, "stub": 5,
}
THRESHOLD = 65


def unused_exports(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """(file, name): exported functions that no importing file names.

    ``functions`` has (file, name, is_exported), ``edges`` (source, target,
    symbols). A file with an importer that takes everything (no symbols, ``*``
    or ``default``) has none.
    """
    wild = F.coalesce(F.size("symbols") <= 0, F.lit(True)) | F.arrays_overlap("symbols", F.array(F.lit("*"), F.lit("default")))
    taken = edges.groupBy(F.col("target").alias("file")).agg(F.bool_or(wild).alias("wild"))
    named = dealt(edges.select(F.col("target").alias("file"), F.explode("symbols").alias("name")), "file", "name").distinct()
    exported = functions.where("is_exported").select("file", "name").distinct()
    open_ = exported.join(merged(taken.where("wild")), "file", "left_anti")
    return open_.join(merged(named), ["file", "name"], "left_anti")


def orphan_symbols(functions: DataFrame, call_edges: DataFrame, before_calls: bool = False) -> DataFrame:
    """Functions that aren't exported, that nothing calls and that no runtime calls either.

    With ``before_calls`` callers aren't looked at, as if none were known yet.
    """
    own = functions.where("not is_exported").where(~F.col("kind").isin("test", "constructor", "middleware", "route-handler"))
    return own if before_calls else own.join(merged(call_edges.select(F.col("target").alias("id")).distinct()), "id", "left_anti")


def dead_code(files: DataFrame, edges: DataFrame, functions: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(id, in_degree, out_degree, n_unused, dead_code_score, is_dead_code) of every file.

    ``files`` has (id, kind, language, line_count, is_entry_point, importance,
    has_startup); ``functions`` (file, name, is_exported). Framework files,
    shared folders, programs with a start of their own, tests, configuration and
    declarations score 0, and so do C-family sources one of whose headers others
    include too.
    """
    d = degrees(edges)
    headers = edges.where(F.lower("target").rlike(r"\.(h|hpp|hh|hxx)$")).join(d.where("in_degree > 1").select(F.col("id").alias("target")), "target", "left_semi")
    alive = headers.select(F.col("source").alias("id"), F.lit(True).alias("alive")).distinct()
    unused = unused_exports(functions, edges).where("name <> 'main'").groupBy(F.col("file").alias("id")).agg(F.count("*").alias("n_unused"))
    own = functions.groupBy(F.col("file").alias("id")).agg(F.count("*").alias("n_functions"), F.count_if("is_exported").alias("n_exported"))
    x = files
    for other in (d, alive, unused, own):
        x = x.join(merged(other), "id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    c_family = F.coalesce(F.col("language").isin("c", "cpp"), F.lit(False))
    c_source = c_family & (F.col("kind") != "declaration")
    framework, utility = is_framework_file(F.col("id"), F.col("is_entry_point")), in_utility_folder(F.col("id"))
    n_unused = F.when(framework | utility | c_family, 0).otherwise(zero("n_unused"))
    signs = {
        "zero_in": (zero("in_degree") == 0) & ~c_source,
        "exports_unused": (n_unused > 0) & (n_unused >= zero("n_exported")),
        "zero_out": zero("out_degree") == 0,
        "not_entry": ~F.coalesce("is_entry_point", F.lit(False)),
        "not_test": F.col("kind") != "test",
        "not_config": ~F.col("kind").isin("config", "declaration"),
        "no_functions": zero("n_functions") == 0,
        "penalty_folder": in_penalty_folder(F.col("id")),
        "low_importance": F.coalesce("importance", F.lit(0.0)) < 5,
        "stub": F.col("line_count") < 10,
    }
    score = sum((F.when(on, WEIGHTS[k]).otherwise(0) for k, on in signs.items()), F.lit(0))
    never = framework | utility | F.coalesce("has_startup", F.lit(False)) | (c_source & F.coalesce("alive", F.lit(False))) | F.col("kind").isin("test", "config", "declaration")
    score = F.when(never, 0).otherwise(F.least(F.lit(100), score)).cast("long")
    return x.select("id", zero("in_degree").cast("long").alias("in_degree"), zero("out_degree").cast("long").alias("out_degree"), n_unused.cast("long").alias("n_unused"), score.alias("dead_code_score"), (score >= threshold).alias("is_dead_code"))
