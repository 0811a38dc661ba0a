"""Workspaces and import aliases of a repository, from its configuration files and its list of paths.

Nothing is looked up on a disk: folders are the ancestors of the paths, a
pattern's folders are a join of parents, and the alias that decides is the first
of an ordered table, found by joining all beginnings of an import with its
prefixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkstrata.functions.text import base_name, folder, normalised_path, parse_commented_json
from sparkstrata.operators.graph import cut_lineage, dealt, merged
from sparkstrata.operators.resolve import SCRIPT_ENDS, ancestors, package_name

#: Folders that hold packages where no tool says so, and where one of the tools does.
COMMON = ["packages", "apps", "libs", "modules", "services"]
NX = ["packages", "apps", "libs"]
#: Prefixes of source folders, folders that imports name bare, and folders that hold no sources.
MARKS = ["@/", "~/", "#/", "@"]
BARE = [
    "components", "lib", "utils", "redux", "store", "services", "models", "context", "hooks", "config", "features", "pages", "layouts", "middleware", "helpers", "api", "actions", "reducers", "slices",
]
NO_SOURCES = ["node_modules", "dist", "build"]
NONE = "array<string>"


def folders_of(paths: DataFrame) -> DataFrame:
    """(dir, parent, name) of all folders above the paths; the parent of a top folder is empty."""
    dirs = paths.where(F.col("path").contains("/")).select(F.explode(F.concat(ancestors(folder(F.col("path"))), F.array(folder(F.col("path"))))).alias("dir")).distinct().where("dir <> ''")
    return dirs.select("dir", folder(F.col("dir")).alias("parent"), base_name(F.col("dir")).alias("name"))


def listed_packages(text: Column) -> Column:
    """Patterns below ``packages:`` of a workspace file, line by line, up to the first line that is no item, comment or blank."""
    made = lambda on, out: F.struct(on.alias("on"), out.alias("out"))

    def step(s, line):
        x = F.trim(line)
        item = F.trim(F.translate(F.substr(x, F.lit(3)), "'\"", ""))
        over = s["on"] & ~x.startswith("-") & ~x.startswith("#") & (x != "")
        return F.when(x == "packages:", made(F.lit(True), s["out"])).when(s["on"] & x.startswith("- "), made(F.lit(True), F.array_append(s["out"], item))).when(over, made(F.lit(False), s["out"])).otherwise(s)

    return F.aggregate(F.split(text, "\n"), made(F.lit(False), F.array().cast(NONE)), step)["out"]


def detect_workspaces(paths: DataFrame, configs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tool, is_monorepo, n_packages) in one row, and the packages (name, root, version, is_private, dependencies).

    ``configs`` are the texts (path, content) of configuration files. The first
    of these that names folders decides on the members: pnpm's file, nx, lerna,
    the workspaces of the manifest, then common folders. A pattern is expanded
    one level; hidden folders and node_modules are none. The tool is the last one
    met before members were found, so turbo keeps its name where the manifest
    names the members. Folders without a named manifest are no packages.
    Broken and null files count as missing.
    """
    dirs = cut_lineage(folders_of(paths), "folders")
    text = lambda name: configs.where(F.col("path") == name).select(F.col("content").alias("text_")).where("text_ is not null")
    as_json = lambda name, schema: text(name).select(parse_commented_json(F.col("text_"), schema).alias("j"), parse_commented_json(F.col("text_"), "map<string,string>").alias("any")).where("any is not null")
    stage = lambda df, n: df.select(F.lit(n).alias("stage"), F.explode("patterns").alias("pattern"))
    pnpm = text("pnpm-workspace.yaml").where("text_ <> ''").select(listed_packages(F.col("text_")).alias("patterns"))
    nx = as_json("nx.json", "x string").select(F.array(*[F.lit(f"{d}/*") for d in NX]).alias("patterns"))
    lerna = as_json("lerna.json", f"packages {NONE}").select(F.coalesce("j.packages", F.array(F.lit("packages/*"))).alias("patterns"))
    flat, held = as_json("package.json", f"workspaces {NONE}").select("j.workspaces"), as_json("package.json", f"workspaces struct<packages:{NONE}>").select("j.workspaces.packages")
    manifest = flat.toDF("patterns").where("patterns is not null").unionByName(held.toDF("patterns").where("patterns is not null"))
    common = paths.sparkSession.createDataFrame([([f"{d}/*" for d in COMMON],)], f"patterns {NONE}")
    patterns = stage(pnpm, 1).unionByName(stage(nx, 3)).unionByName(stage(lerna, 4)).unionByName(stage(manifest, 5)).unionByName(stage(common, 6))
    bare = normalised_path(F.regexp_replace(F.regexp_replace("pattern", r"/\*\*?$", ""), r"\*$", ""))
    patterns = patterns.withColumn("base", bare).withColumn("is_open", F.col("pattern").contains("*"))
    below = patterns.where("is_open").join(dirs.where("name not like '.%' and name <> 'node_modules'"), patterns.base == F.col("parent")).select("stage", "dir")
    exact = patterns.where("not is_open").join(dirs, patterns.base == F.col("dir")).select("stage", "dir")
    members = cut_lineage(below.unionByName(exact).distinct(), "members")
    decides = members.agg(F.min("stage").alias("stage"))
    there = lambda df: df.agg((F.count("*") > 0).alias("x")).first().x
    found = decides.first().stage
    met = lambda n: found is None or found >= n  # noqa: E731  every stage before it found nothing
    tool = "none"
    if there(text("pnpm-workspace.yaml").where("text_ <> ''")):
        tool = "pnpm"
    for name, n, file in (("turbo", 2, "turbo.json"), ("nx", 3, "nx.json"), ("lerna", 4, "lerna.json")):
        if met(n) and there(as_json(file, "x string")):
            tool = name
    if met(5) and tool == "none" and there(stage(manifest, 5)):
        tool = "yarn" if there(paths.where("path = 'yarn.lock'")) else "npm"
    schema = "name string, version string, private boolean, dependencies map<string,string>, devDependencies map<string,string>"
    named = configs.where(base_name(F.col("path")) == "package.json").select(folder(F.col("path")).alias("dir"), parse_commented_json(F.col("content"), schema).alias("m")).where("m.name is not null")
    own = named.join(members.join(decides, "stage").select("dir").distinct(), "dir")
    names = own.select(F.col("m.name").alias("dep")).unionByName(named.where("dir = ''").select(F.col("m.name").alias("dep"))).distinct()
    none = F.array().cast(NONE)
    wanted = own.select("dir", F.posexplode(F.array_distinct(F.concat(F.coalesce(F.map_keys("m.dependencies"), none), F.coalesce(F.map_keys("m.devDependencies"), none)))).alias("k", "dep"))
    inside = wanted.join(names, "dep").groupBy("dir").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "dep"))), lambda x: x["dep"]).alias("dependencies"))
    packages = own.join(inside, "dir", "left").select(F.col("m.name").alias("name"), F.col("dir").alias("root"), F.col("m.version").alias("version"), F.coalesce("m.private", F.lit(False)).alias("is_private"), F.coalesce("dependencies", none).alias("dependencies"))
    summary = packages.agg(F.lit(tool).alias("tool"), (F.count("*") > 1).alias("is_monorepo"), F.count("*").alias("n_packages"))
    return summary, packages


def alias_entries(paths: DataFrame, configs: DataFrame) -> DataFrame:
    """(nth, prefix, targets, is_wildcard, is_explicit): the whole alias table, in the order in which entries are tried.

    Sources: tsconfig.json and jsconfig.json at the top, then in each top folder
    in order of name, each with its baseUrl (an empty prefix) and its paths; the
    manifest's ``imports``; and guesses, which are not explicit. Longer prefixes
    go first, of equal ones those of earlier sources. ``/*`` at the end of an
    alias makes it open and is cut off, so ``@/*`` has the prefix ``@``.
    """
    dirs = cut_lineage(folders_of(paths), "folders")
    tops = dirs.where("parent = ''").select("dir", "name")
    at = configs.select("content", folder(F.col("path")).alias("dir"), base_name(F.col("path")).alias("name"))
    sources = at.where("name in ('tsconfig.json', 'jsconfig.json') and dir not like '%/%'")
    sources = sources.where(~F.col("dir").startswith(".") & ~F.col("dir").isin(NO_SOURCES))
    parsed = sources.select("dir", "name", parse_commented_json(F.col("content"), f"compilerOptions struct<baseUrl:string,paths:map<string,{NONE}>>")["compilerOptions"].alias("o"))
    place = lambda d, x: normalised_path(F.concat_ws("/", d, x))
    order = lambda *c: F.struct(*c).alias("source")
    rank = F.when(F.col("dir") == "", F.when(F.col("name") == "tsconfig.json", 1).otherwise(2)).otherwise(3)
    key = lambda k: (rank.alias("a"), F.col("dir").alias("b"), F.col("name").substr(1, 1).isin("j").cast("int").alias("c"), k.alias("d"))
    base = parsed.where("o.baseUrl <> ''").select(order(*key(F.lit(0))), F.lit("").alias("prefix"), F.array(place("dir", F.col("o.baseUrl"))).alias("targets"), F.lit(True).alias("is_wildcard"), F.lit(True).alias("is_explicit"))
    bare = lambda c: F.regexp_replace(c, r"/\*$", "")
    named = parsed.select("dir", "name", F.posexplode(F.map_entries("o.paths")).alias("k", "e"))
    own = named.select(order(*key(F.col("k") + 1)), bare("e.key").alias("prefix"), F.transform("e.value", lambda t: place(F.col("dir"), bare(t))).alias("targets"), F.col("e.key").endswith("/*").alias("is_wildcard"), F.lit(True).alias("is_explicit"))
    packed = at.where("dir = '' and name = 'package.json'").select(parse_commented_json(F.col("content"), "imports map<string,string>")["imports"].alias("m")).select(F.posexplode(F.map_entries("m")).alias("k", "e"))
    chosen = F.when(F.col("e.value").startswith("{"), F.coalesce(F.get_json_object("e.value", "$.default"), F.get_json_object("e.value", "$.require"))).otherwise(F.col("e.value"))
    inner = packed.withColumn("t", chosen).where("t <> ''").select(order(F.lit(4).alias("a"), F.lit("").alias("b"), F.lit(0).alias("c"), F.col("k").alias("d")), bare("e.key").alias("prefix"), F.array(place(F.lit(""), bare(F.col("t")))).alias("targets"), F.col("e.key").endswith("/*").alias("is_wildcard"), F.lit(True).alias("is_explicit"))
    # guesses: the sources' own folder, then each top folder's src and the folder itself
    usable = tops.where(~F.col("name").startswith(".") & ~F.col("name").isin(NO_SOURCES)).join(dirs.where("name = 'src'").select(F.col("parent").alias("dir"), F.lit(True).alias("src")), "dir", "left")
    places = usable.select("dir", F.when(F.col("src"), F.array(F.concat("dir", F.lit("/src")), "dir")).otherwise(F.array("dir")).alias("p"))
    tail = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("dir", "p"))), lambda x: x["p"]))
    first = F.when(F.coalesce(F.bool_or(F.col("dir") == "src"), F.lit(False)), "src").otherwise("")
    candidates = places.agg(F.concat(F.array(first), tail).alias("c"))  # one row
    guesses = [(k, m, None) for k, m in enumerate(MARKS)] + [(len(MARKS) + k, f"{b}/", b) for k, b in enumerate(BARE)]
    g = candidates.crossJoin(F.broadcast(paths.sparkSession.createDataFrame(guesses, "k int, prefix string, bare string")))
    targets = F.when(F.col("bare").isNull(), F.col("c")).otherwise(F.concat(F.transform("c", lambda x: F.when(x == "", F.col("bare")).otherwise(F.concat(x, F.lit("/"), F.col("bare")))), F.array("bare")))
    guessed = g.select(order(F.lit(5).alias("a"), F.lit("").alias("b"), F.lit(0).alias("c"), F.col("k").alias("d")), "prefix", targets.alias("targets"), F.lit(True).alias("is_wildcard"), F.lit(False).alias("is_explicit"))
    every = base.unionByName(own).unionByName(inner).unionByName(guessed)
    nth = F.row_number().over(Window.orderBy(F.desc(F.length("prefix")), "source"))  # as many rows as a repository's configurations have
    return every.select(nth.alias("nth"), "prefix", "targets", "is_wildcard", "is_explicit")


def resolve_aliases(imports: DataFrame, entries: DataFrame, paths: DataFrame) -> DataFrame:
    """(specifier, kind, path, name) of imports that are no relative paths: by the first entry that leads to a file or is explicit.

    An explicit entry that leads to no file makes an import unresolved; where
    none decides it is external. Equal imports are resolved once.
    """
    s = F.col("specifier")
    own = imports.where(~s.rlike(r"^[./]")).select("specifier").distinct()
    entries = cut_lineage(entries, "entries")
    lengths = entries.agg(F.collect_set(F.length("prefix")).alias("lengths"))
    starts = F.transform(F.filter("lengths", lambda n: n <= F.length(s)), lambda n: F.substr(s, F.lit(1), n))
    met = own.crossJoin(F.broadcast(lengths)).select("specifier", F.explode(starts).alias("prefix")).join(entries, "prefix")  # one row
    # an explicit entry decides, so those after the first are not tried
    last = F.min(F.when(F.col("is_explicit"), F.col("nth"))).over(Window.partitionBy("specifier"))
    met = cut_lineage(dealt(met, "specifier").withColumn("last", last).where("last is null or nth <= last").drop("last"), "aliases")
    rest = F.when(F.col("is_wildcard"), F.substr(s, F.length("prefix") + 1)).otherwise("")
    tried = met.select("specifier", "nth", rest.alias("rest"), F.posexplode("targets").alias("t", "target"))
    tried = dealt(tried.select("specifier", "nth", "t", normalised_path(F.concat_ws("/", "target", "rest")).alias("base")), "base")
    # a path has a row for each end that it has, without it, so that what is tried needs none for each end
    ends = F.posexplode(F.array(*[F.lit(e) for e in SCRIPT_ENDS])).alias("e", "end")
    bases = paths.select("path").distinct().select("path", ends).where(F.col("path").endswith(F.col("end"))).select("path", "e", F.substr("path", F.lit(1), F.length("path") - F.length("end")).alias("base"))
    found = tried.join(merged(dealt(bases, "base")), "base").groupBy("specifier", "nth").agg(F.min_by("path", F.struct("t", "e")).alias("path"))
    first = met.join(merged(found), ["specifier", "nth"], "left").where("path is not null or is_explicit").groupBy("specifier").agg(F.min_by(F.struct("path"), "nth").alias("r"))
    out = own.join(merged(first), "specifier", "left")
    kind = F.when(F.col("r").isNull(), "external").when(F.col("r.path").isNull(), "unresolved").otherwise("internal")
    return out.select("specifier", kind.alias("kind"), F.col("r.path").alias("path"), F.when(kind == "external", package_name(s)).alias("name"))
