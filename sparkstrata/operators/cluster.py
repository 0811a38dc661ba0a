"""Clusters of files by folder, their merging, and dependencies between them."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkstrata.functions.classify import is_infrastructure
from sparkstrata.functions.text import base_name, entity_noun, folder
from sparkstrata.operators.resolve import ancestors

#: Fixed values of the clustering.
MONOLITH, MONOLITH_SHARE, SPLIT_OVER, LEAST_ENTITY, TARGET, TARGET_WITH_INFRA, SIZE = 40, 0.15, 25, 3, 15, 14, 40


def initial_groups(files: DataFrame, by: Column | None = None, repo: list[str] = []) -> DataFrame:  # noqa: B006
    """(repo, id, cluster): source files (id, kind) by folder; large folders of a monolith are split by the entity that file names name.

    A monolith has over 40 files with those below it, or over 15 % of all. Its
    entities with under three files share one cluster. ``repo`` names the
    columns that tell repositories apart, each of which is grouped alone.
    """
    own = files.select(*repo, "id", (by if by is not None else folder(F.col("id"))).alias("dir"))
    counts = own.groupBy(*repo, "dir").agg(F.count("*").alias("n"))
    total = counts.groupBy(*repo).agg(F.sum("n").alias("total"))
    below = counts.select(*repo, F.explode(F.concat(F.when(F.col("dir").contains("/"), ancestors(F.col("dir"))).otherwise(F.array().cast("array<string>")), F.array("dir"))).alias("dir"), "n")
    recursive = below.groupBy(*repo, "dir").agg(F.sum("n").alias("r"))
    marks = counts.join(recursive, [*repo, "dir"])
    marks = marks.join(total, repo) if repo else marks.crossJoin(F.broadcast(total))  # one row
    marks = marks.select(*repo, "dir", (((F.col("r") > MONOLITH) | (F.col("r") > F.col("total") * MONOLITH_SHARE)) & (F.col("n") > SPLIT_OVER)).alias("split"))
    x = own.join(marks, [*repo, "dir"]).withColumn("entity", entity_noun(base_name(F.col("id"))))
    sizes = x.where("split").groupBy(*repo, "dir", "entity").agg(F.count("*").alias("m"))
    x = x.join(sizes, [*repo, "dir", "entity"], "left")
    under = F.when(F.col("m") >= LEAST_ENTITY, F.col("entity")).otherwise("Shared")
    name = F.when(F.col("split"), F.when(F.col("dir") == "", under).otherwise(F.concat("dir", F.lit("/"), under))).otherwise(F.col("dir"))
    return x.select(*repo, "id", name.alias("cluster"))


def coupling(clusters: DataFrame, edges: DataFrame, repo: list[str] = []) -> DataFrame:  # noqa: B006
    """(repo, a, b, n_edges, score) of pairs of clusters: undirected edges between them over the sum of their sizes."""
    sizes = clusters.groupBy(*repo, "cluster").agg(F.count("*").alias("size"))
    end = lambda c, to: clusters.select(*repo, F.col("id").alias(c), F.col("cluster").alias(to))
    x = edges.join(end("source", "cs"), [*repo, "source"]).join(end("target", "ct"), [*repo, "target"])
    pairs = x.where("cs <> ct").groupBy(*repo, F.least("cs", "ct").alias("a"), F.greatest("cs", "ct").alias("b")).agg(F.count("*").alias("n_edges"))
    size = lambda c, to: sizes.select(*repo, F.col("cluster").alias(c), F.col("size").alias(to))
    out = pairs.join(size("a", "sa"), [*repo, "a"]).join(size("b", "sb"), [*repo, "b"])
    return out.select(*repo, "a", "b", "n_edges", (F.col("n_edges") / (F.col("sa") + F.col("sb"))).alias("score"))


def _common(a: str, b: str) -> str:
    out = []
    for x, y in zip(a.split("/"), b.split("/")):
        if x != y:
            break
        out.append(x)
    return "/".join(out) if a and b else a if a == b else ""


def merge_greedily(sizes: dict[str, int], links: dict[tuple[str, str], int], target: int, most: int) -> dict[str, str]:
    """Cluster to merged name: joins clusters until ``target`` are left.

    The pair with the greatest coupling whose size stays within ``most`` goes
    first; if there is none, the smallest cluster joins the smallest one it is
    linked to, else the smallest other. The result depends on the sums alone:
    ties go by position in order of name, and a merged cluster keeps the first
    of its two positions. A heap holds the pairs, those of clusters that have
    grown since are passed over, and sizes only grow, so a pair that is too large
    never comes back.
    """
    names = sorted(sizes)
    where = {n: k for k, n in enumerate(names)}
    title, members, size = list(names), [[n] for n in names], [sizes[n] for n in names]
    near: list[dict[int, int]] = [{} for _ in names]
    for (a, b), n in links.items():
        i, j = where[a], where[b]
        if i != j:
            near[i][j] = near[j][i] = near[i].get(j, 0) + n
    pair = lambda i, j: (-near[i][j] / (size[i] + size[j]), min(i, j), max(i, j), size[i] + size[j])
    heap = [pair(i, j) for i in range(len(names)) for j in near[i] if i < j]
    heapq.heapify(heap)
    alive = set(range(len(names)))
    while len(alive) > target:
        best = None
        while heap and best is None:
            score, i, j, both = heapq.heappop(heap)
            if i in alive and j in alive and both <= most and j in near[i] and (score, i, j, both) == pair(i, j):
                best = i, j
        if best is None:
            i = min(alive, key=lambda k: (size[k], k))
            other = min(near[i] or alive - {i}, key=lambda k: (size[k], k))
            best = min(i, other), max(i, other)
        i, j = best
        prefix = _common(title[i], title[j])
        title[i] = prefix if prefix.count("/") else title[i] if size[i] >= size[j] else title[j]
        members[i] += members[j]
        size[i] += size[j]
        alive.discard(j)
        for k, n in near[j].items():
            del near[k][j]
            if k != i:
                near[i][k] = near[k][i] = near[i].get(k, 0) + n
        for k in near[i]:
            heapq.heappush(heap, pair(i, k))
    return {m: f"{k:03d}:{title[g] or 'Root/Core'}" for k, g in enumerate(sorted(alive)) for m in members[g]}


def merge_clusters(clusters: DataFrame, edges: DataFrame, has_infra: bool | DataFrame = False, target: int | None = None, repo: list[str] = []) -> DataFrame:  # noqa: B006
    """(repo, id, module_id, name): clusters (id, cluster) merged to 15 modules (14 with infrastructure) of bounded size.

    The merging of one repository is sequential, as every merge changes the
    coupling of those that follow; it works on sums per cluster alone, in one
    task for each repository, which has as many of these as folders. ``repo``
    names the columns that tell repositories apart; ``has_infra`` then is a
    table of the repositories that have infrastructure.
    """
    sums = clusters.groupBy(*repo, "cluster").agg(F.count("*").alias("n")).select(*repo, F.col("cluster").alias("a"), F.lit(None).cast("string").alias("b"), "n")
    pairs = coupling(clusters, edges, repo).select(*repo, "a", "b", F.col("n_edges").alias("n"))
    table = sums.unionByName(pairs)
    if isinstance(has_infra, DataFrame):
        table = table.join(has_infra.select(*repo, F.lit(True).alias("infra")).distinct(), repo, "left").withColumn("infra", F.coalesce("infra", F.lit(False)))
    else:
        table = table.withColumn("infra", F.lit(has_infra))

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        alone = pdf.b.isna()
        own = dict(zip(pdf.a[alone], pdf.n[alone]))
        goal = target or (TARGET_WITH_INFRA if pdf.infra.iloc[0] else TARGET)
        out = merge_greedily(own, {(a, b): n for a, b, n in zip(pdf.a[~alone], pdf.b[~alone], pdf.n[~alone])}, goal, max(SIZE, sum(own.values()) // 4))
        rows = pd.DataFrame([(c, f"module_{int(x[:3])}", x[4:]) for c, x in out.items()], columns=["cluster", "module_id", "name"])
        for c in repo:
            rows[c] = pdf[c].iloc[0]
        return rows

    types = dict(clusters.dtypes)
    schema = ", ".join(["cluster string, module_id string, name string", *[f"`{c}` {types[c]}" for c in repo]])
    groups = table.groupBy(*repo) if repo else table.withColumn("whole", F.lit(0)).groupBy("whole")
    return clusters.join(groups.applyInPandas(merged, schema), [*repo, "cluster"]).select(*repo, "id", "module_id", "name")


def modules(files: DataFrame, edges: DataFrame, repo: list[str] = []) -> DataFrame:  # noqa: B006
    """(repo, id, module_id, name) of all files (id, kind): merged clusters of sources, and one module of infrastructure.

    ``repo`` names the columns of files and edges that tell repositories apart,
    so that all are clustered by one job; a null there matches no other.
    """
    x = files.withColumn("infra", is_infrastructure(F.col("id"), F.col("kind")))
    infra = x.where("infra")
    has = infra.select(*repo).distinct() if repo else bool(infra.limit(1).count())
    own = merge_clusters(initial_groups(x.where("not infra"), repo=repo), edges, has, repo=repo)
    return own.unionByName(infra.select(*repo, "id", F.lit("module_infra").alias("module_id"), F.lit("Project Infrastructure & Docs").alias("name")))


def module_dependencies(module_files: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, target, n_edges) between different modules of (id, module_id)."""
    a, b = (module_files.select(F.col("id").alias(e), F.col("module_id").alias(m)) for e, m in (("source", "ms"), ("target", "mt")))
    return edges.join(a, "source").join(b, "target").where("ms <> mt").groupBy(F.col("ms").alias("source"), F.col("mt").alias("target")).agg(F.count("*").alias("n_edges"))


def top_files(module_files: DataFrame, most: int = 20) -> DataFrame:
    """(module_id, id, importance, nth): each module's most important files (id, module_id, importance)."""
    n = F.row_number().over(Window.partitionBy("module_id").orderBy(F.desc("importance"), "id"))
    return module_files.select("module_id", "id", "importance", n.cast("long").alias("nth")).where(F.col("nth") <= most)


def cluster_summary(module_files: DataFrame, externals: DataFrame) -> DataFrame:
    """(module_id, n_files, top, libraries, folders): the eight best files, eight commonest libraries (id, name) and five commonest folders."""
    counts = module_files.groupBy("module_id").agg(F.count("*").alias("n_files"))

    def top(df: DataFrame, column: str, most: int) -> DataFrame:
        c = df.groupBy("module_id", column).agg(F.count("*").alias("n"))
        c = c.withColumn("k", F.row_number().over(Window.partitionBy("module_id").orderBy(F.desc("n"), column))).where(F.col("k") <= most)
        return c.groupBy("module_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", column, "n"))), lambda x: F.struct(x[column].alias("name"), x["n"].alias("n"))).alias(f"{column}_list"))

    best = top_files(module_files, 8).groupBy("module_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "id"))), lambda x: x["id"]).alias("top"))
    libraries = top(externals.join(module_files.select("id", "module_id"), "id"), "name", 8).withColumnRenamed("name_list", "libraries")
    folders = top(module_files.withColumn("folder", folder(F.col("id"), "/")), "folder", 5).withColumnRenamed("folder_list", "folders")
    return counts.join(best, "module_id", "left").join(libraries, "module_id", "left").join(folders, "module_id", "left")


#: Files that stand for a repository's infrastructure.
KEY_FILES = "readme.md package.json docker-compose.yml dockerfile tsconfig.json drizzle.config.ts drizzle.config.js eslint.config.js .eslintrc.js next.config.js".split()


def representatives(module_files: DataFrame, proposed: DataFrame) -> DataFrame:
    """(module_id, id) of the files that stand for each module (id, module_id, importance).

    Infrastructure shows up to four key files, else its first two; others the
    proposed files (module_id, id) that are in the module, else the two first.
    """
    w = Window.partitionBy("module_id").orderBy(F.desc("importance"), "id")
    key = F.when(F.col("module_id") == "module_infra", F.lower(base_name(F.col("id"))).isin(KEY_FILES)).otherwise(F.coalesce("p", F.lit(False)))
    x = module_files.join(proposed.select("module_id", "id", F.lit(True).alias("p")).distinct(), ["module_id", "id"], "left").withColumn("key", key)
    x = x.withColumn("any", F.bool_or("key").over(Window.partitionBy("module_id"))).withColumn("n", F.row_number().over(w))
    x = x.withColumn("nk", F.sum(F.col("key").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ok = F.when(F.col("any"), F.col("key") & (F.when(F.col("module_id") == "module_infra", F.col("nk") <= 4).otherwise(True))).otherwise(F.col("n") <= 2)
    return x.where(ok).select("module_id", "id")


def by_importance(modules: DataFrame) -> DataFrame:
    """Modules (module_id, importance) with their place (nth) by falling importance, ties by module_id; null importance comes last.

    A repository has as many modules as its clustering allows, so one task orders them.
    """
    return modules.withColumn("nth", F.row_number().over(Window.orderBy(F.desc_nulls_last("importance"), "module_id")).cast("long"))


def representatives_first(module_files: DataFrame, representative: DataFrame, most: int | None = 30) -> DataFrame:
    """(module_id, id, is_representative, nth): a module's files (module_id, id, ord), those that stand for it before the others.

    Both keep their order; ``most`` are shown of each module, None shows all.
    """
    marked = representative.select("module_id", "id", F.lit(True).alias("r")).distinct()
    x = module_files.join(marked, ["module_id", "id"], "left").withColumn("is_representative", F.coalesce("r", F.lit(False)))
    n = F.row_number().over(Window.partitionBy("module_id").orderBy(F.desc("is_representative"), "ord", "id")).cast("long")
    x = x.select("module_id", "id", "is_representative", n.alias("nth"))
    return x if most is None else x.where(F.col("nth") <= most)
