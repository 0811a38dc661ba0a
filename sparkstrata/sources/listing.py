"""Sources and sinks: file listings, issue tables, artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkstrata.functions.classify import is_processable, parse_mode
from sparkstrata.functions.text import sanitised_key


def file_listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, size_bytes, modified) of all files under ``root``; their contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    plain = F.regexp_replace("path", "^[a-z]+:/+", "/")
    base = root.split(":", 1)[-1].rstrip("/")
    relative = F.regexp_replace(plain, "^.*?" + "".join(f"\\{c}" if not c.isalnum() and c not in "/_" else c for c in base.lstrip("/")) + "/", "")
    return files.select(relative.alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))


def file_contents(spark: SparkSession, root: str, wanted: DataFrame | None = None) -> DataFrame:
    """(path, content) of text files under ``root``, of ``wanted`` (path) only where given."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.split(":", 1)[-1].rstrip("/")
    plain = F.regexp_replace("path", "^[a-z]+:/+", "/")
    out = files.select(F.substr(plain, F.lit(len(base) + 2)).alias("path"), F.decode("content", "UTF-8").alias("content"))
    return out if wanted is None else out.join(wanted.select("path").distinct(), "path", "left_semi")


def parse_decisions(files: DataFrame) -> DataFrame:
    """Files (path, size_bytes) that are source code, with the mode they are parsed in and why."""
    own = files.where(is_processable(F.col("path"))).withColumn("d", parse_mode(F.col("path"), F.col("size_bytes")))
    return own.select(*files.columns, "d.mode", "d.reason")


def decision_summary(files: DataFrame, most: int = 10_000) -> DataFrame:
    """One row: how many files are read in full, for their imports, skipped or filtered, and whether the number is admissible."""
    mode = F.when(is_processable(F.col("path")), parse_mode(F.col("path"), F.col("size_bytes"))["mode"]).otherwise("filtered")
    x = files.select(mode.alias("mode")).agg(
        F.count("*").alias("n_total"), *[F.count_if(F.col("mode") == m).alias(f"n_{m.replace('-', '_')}") for m in ("full", "imports-only", "skip", "filtered")]
    )
    n = F.col("n_full") + F.col("n_imports_only")
    return x.withColumn("is_admissible", (n > 0) & (n <= most))


def admissible_repositories(repositories: DataFrame, most_kb: int = 500 * 1024) -> DataFrame:
    """Repositories (repo_id, is_private, size_kb) that may be read."""
    return repositories.where(~F.coalesce("is_private", F.lit(False)) & (F.col("size_kb") <= most_kb))


def open_issues(issues: DataFrame, most: int = 100) -> DataFrame:
    """Open issues (number, state, is_pull_request, updated_at), the last updated first."""
    return issues.where((F.col("state") == "open") & ~F.coalesce("is_pull_request", F.lit(False))).orderBy(F.desc("updated_at"), "number").limit(most)


def issue_comments(comments: DataFrame, most: int = 30) -> DataFrame:
    """The first comments (issue, created_at, comment_id) of each issue."""
    n = F.row_number().over(Window.partitionBy("issue").orderBy("created_at", "comment_id"))
    return comments.withColumn("n", n).where(F.col("n") <= most).drop("n")


def linked_pull_files(events: DataFrame, pull_files: DataFrame, pulls: int = 5, files: int = 30) -> DataFrame:
    """(issue, pull, file): files of the first pull requests that an issue's timeline (issue, event, source_kind, pull, ord) refers to."""
    own = events.where("event = 'cross-referenced' and source_kind = 'pull_request'").groupBy("issue", "pull").agg(F.min("ord").alias("ord"))
    own = own.withColumn("n", F.row_number().over(Window.partitionBy("issue").orderBy("ord", "pull"))).where(F.col("n") <= pulls)
    f = pull_files.withColumn("k", F.row_number().over(Window.partitionBy("pull").orderBy("ord", "file"))).where(F.col("k") <= files)
    return own.select("issue", "pull").join(f.select("pull", "file"), "pull")


def write_artifact(df: DataFrame, path: str) -> None:
    """Write rows with (repo_id, commit_sha) as a table partitioned by them; the partitions at hand are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_id", "commit_sha").parquet(path)


def read_artifact(spark: SparkSession, path: str, repo_id: str, commit_sha: str | None = None) -> DataFrame:
    """A repository's rows of a commit, of the latest by ``analyzed_at`` if none is named; only its partitions are read."""
    own = spark.read.parquet(path).where(F.col("repo_id") == repo_id)
    if commit_sha is None:
        latest = own.agg(F.max_by("commit_sha", "analyzed_at").alias("sha")).first().sha
        return own.where(F.col("commit_sha").eqNullSafe(F.lit(latest)))
    return own.where(F.col("commit_sha") == commit_sha)


def latest_commits(analyses: DataFrame) -> DataFrame:
    """(repo_id, commit_sha): the commit last analysed (repo_id, commit_sha, analyzed_at) of each repository."""
    return analyses.groupBy("repo_id").agg(F.max_by("commit_sha", F.struct("analyzed_at", "commit_sha")).alias("commit_sha"))


def with_fallback(current: DataFrame, legacy: DataFrame, key: str) -> DataFrame:
    """Rows by key, those of ``legacy`` where ``current`` has none."""
    return current.unionByName(legacy.join(current.select(key).distinct(), key, "left_anti"))


def key_collisions(files: DataFrame) -> DataFrame:
    """(key, n_ids) of storage keys that several file ids (id) share."""
    return files.select("id").distinct().groupBy(sanitised_key(F.col("id")).alias("key")).agg(F.count("*").alias("n_ids")).where("n_ids > 1")


def delete_partition(spark: SparkSession, path: str, repo_id: str, commit_sha: str | None = None, dry_run: bool = True) -> list[str]:
    """Folders of a repository's (commit's) artifacts under ``path``, deleted unless it is a dry run."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/repo_id={repo_id}" + (f"/commit_sha={commit_sha}" if commit_sha else ""))
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [at.toString()] if fs.exists(at) else []
    if found and not dry_run:
        fs.delete(at, True)
    return found


def chat_sessions(sessions: DataFrame, most: int = 50) -> DataFrame:
    """The last updated sessions (session_id, messages, updated_at) that have messages, with their titles."""
    from sparkstrata.functions.text import chat_title

    first = F.try_element_at(F.filter("messages", lambda m: m["role"] == "user"), F.lit(1))["text"]
    return sessions.where(F.size("messages") > 0).orderBy(F.desc("updated_at"), "session_id").limit(most).withColumn("title", chat_title(first))
