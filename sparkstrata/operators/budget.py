"""Selection of rows under budgets of characters, lines and rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(size: Column, by: list[str], order: list) -> Column:
    """Sum of ``size`` of a row and those before it in its group."""
    return F.sum(size).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def history_budget(turns: DataFrame, most: int = 12_000) -> DataFrame:
    """The newest turns of each conversation (conv_id, turn, text) up to ``most`` characters; the newest always stays."""
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    own = turns.withColumn("n", n).withColumn("acc", running(F.coalesce(F.length("text"), F.lit(0)), ["conv_id"], [F.desc("turn")]))
    return own.where((F.col("n") == 1) | (F.col("acc") <= most)).select(*turns.columns, F.col("acc").cast("long").alias("chars_used"))


def char_budget(snippets: DataFrame, by: list[str], order: list, size: Column, most: int = 25_000) -> DataFrame:
    """The leading rows of each group whose sizes together don't exceed ``most``."""
    return snippets.withColumn("acc", running(size, by, order)).where(F.col("acc") <= most).withColumn("acc", F.col("acc").cast("long"))


#: Most lines of a file and of a snippet, most snippets; lines over which a body is shortened, and what is left of it.
FILE_LINES, SNIPPET_LINES, SNIPPETS, LONG_BODY, SHORTENED = 220, 700, 20, 80, 81


def line_budget(snippets: DataFrame, by: list[str], order: list, n_lines: Column, over: list[str], per_group: int = FILE_LINES, per_snippet: int = SNIPPET_LINES, most: int = SNIPPETS) -> DataFrame:
    """Snippets with ``kept_lines``, the lines that are shown of each within its file's budget, markers counted.

    A body over ``per_snippet`` lines is cut there and gets a marker line; one
    still over 80 is shortened to its first 60 and last 20 with a marker
    between. The snippet that reaches over what is left of its file (``by``) is
    cut to that, one line at least, and gets a marker (``is_clamped``); those
    after it are dropped. Of each group ``over`` the first ``most`` snippets in
    the order of files and of ``order`` stay.
    """
    cut = F.when(n_lines > per_snippet, per_snippet + 1).otherwise(n_lines)
    own = F.when(cut > LONG_BODY, SHORTENED).otherwise(cut)
    before = running(own, by, order) - own
    left = F.lit(per_group) - before
    x = snippets.withColumn("kept_lines", F.when(own > left, left + 1).otherwise(own).cast("long")).withColumn("is_clamped", own > left).withColumn("left_lines", left)
    x = x.where("left_lines > 0").drop("left_lines")
    return x.withColumn("n", F.row_number().over(Window.partitionBy(*over).orderBy(*by, *order))).where(F.col("n") <= most).drop("n")


def first_per_group(rows: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("n", n).where(F.col("n") <= most).drop("n")


def dedup_snippets(snippets: DataFrame) -> DataFrame:
    """Snippets (function_id, body, ord) without later ones of the same function, and then of the same trimmed body."""
    from sparkstrata.operators.graph import first_of

    lone = snippets.where("function_id is null")
    own = first_of(snippets.where("function_id is not null"), ["function_id"], ["ord"]).unionByName(lone)
    return first_of(own.withColumn("trimmed", F.trim("body")), ["trimmed"], ["ord"]).drop("trimmed")


def page(rows: DataFrame, order: list, number: int, size: int = 20) -> DataFrame:
    """Page ``number`` (from 1) of ordered rows."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def queue_positions(jobs: DataFrame) -> DataFrame:
    """(job_id, position) of waiting jobs (job_id, queue, enqueued_at) within their queue."""
    return jobs.select("job_id", F.row_number().over(Window.partitionBy("queue").orderBy("enqueued_at", "job_id")).cast("long").alias("position"))


def select_functions(candidates: DataFrame, functions: DataFrame, tokens: list[str]) -> DataFrame:
    """(file, function_id, name, nth): the functions shown of each candidate file (file, source).

    A pull request's files show up to four exported functions; keyword and
    navigated files up to four whose names contain a token, else three exported;
    others three exported. Where none is exported any will do. ``functions`` has
    (file, function_id, name, is_exported, ord).
    """
    has = F.exists(F.array(*[F.lit(t) for t in tokens]), lambda t: F.lower("name").contains(t)) if tokens else F.lit(False)
    x = candidates.join(functions, "file").withColumn("hit", has)
    w = Window.partitionBy("file")
    any_exported, any_hit = F.bool_or("is_exported").over(w), F.bool_or("hit").over(w)
    wanted = F.col("source").isin("keyword", "gemini")
    ok = F.when(wanted & any_hit, F.col("hit")).otherwise(F.col("is_exported") | ~any_exported)
    most = F.when((F.col("source") == "pr") | (wanted & any_hit), 4).otherwise(3)
    x = x.withColumn("ok", ok).withColumn("most", most).where("ok")
    nth = F.row_number().over(w.orderBy("ord", "function_id"))
    return x.withColumn("nth", nth.cast("long")).where("nth <= most").select("file", "function_id", "name", "nth")


def preview_mode(is_barrel: Column, role: Column, source: Column) -> Column:
    """struct(mode, most): how a file without functions is shown."""
    mode = F.when(is_barrel, "barrel").when(role == "test", "test").when(source.isin("pr", "keyword"), "preview").otherwise("short")
    most = F.when(mode == "barrel", 12).when(mode == "test", 120).when(mode == "preview", 100).otherwise(80)
    return F.struct(mode.alias("mode"), most.alias("most"))
