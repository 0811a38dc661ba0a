"""Resolution of imports to files: ordered candidates joined with the set of paths.

Instead of looking candidates up one after the other, every import becomes its
candidate paths with their order; one equi-join with the paths keeps those that
exist, and the first of them is the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkstrata.functions.classify import NODE_BUILTINS
from sparkstrata.functions.text import base_name, folder, normalised_path, shared_prefix_length, strings
from sparkstrata.operators.graph import dealt, merged

#: Ends that complete a script import, in order; names of include folders; most files of a Go package.
SCRIPT_ENDS = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
INCLUDE_NAMES = ["include", "inc", "includes", "headers", "src", "lib", "source"]
HEADER_ENDS = [".h", ".hpp", ".hh", ".hxx"]
GO_FILES = 30


def ancestors(path: Column) -> Column:
    """The folders above a path, from the top."""
    parts = F.split(path, "/")
    return F.transform(F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: i > 0), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def longest_prefix(files: DataFrame, packages: DataFrame) -> DataFrame:
    """(id, package): the package (root, name) with the longest root above each file, null if none.

    A prefix join is an equi-join on the file's ancestors; root "." is skipped.
    """
    up = dealt(files.select("id"), "id").select("id", F.explode(ancestors(F.col("id"))).alias("root"))
    hit = up.join(packages.where("root <> '.'").select("root", F.col("name").alias("package")), "root")
    best = hit.groupBy("id").agg(F.max_by("package", F.struct(F.length("root"), "package")).alias("package"))
    return files.select("id").join(merged(best), "id", "left")


def existing(candidates: DataFrame, paths: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path): the first candidate (keys, candidate, ord) of each key that is a path."""
    own = paths.select(F.col("path").alias("candidate")).distinct()
    return candidates.join(merged(own), "candidate").groupBy(*keys).agg(F.min_by("candidate", F.struct("ord", "candidate")).alias("path"))


def package_name(specifier: Column) -> Column:
    parts = F.split(specifier, "/")
    return F.when(specifier.startswith("@"), F.array_join(F.slice(parts, 1, 2), "/")).otherwise(F.element_at(parts, 1))


def resolve_scripts(imports: DataFrame, paths: DataFrame, aliases: DataFrame | None = None, packages: DataFrame | None = None, own_package: str | None = None) -> DataFrame:
    """(file, specifier, kind, path, name): internal, external or unresolved script imports (file, specifier).

    Relative imports try eleven ends. Others are built-in modules, the own
    package, a workspace package (name, source), or go by the alias
    (prefix, target, is_wildcard, is_explicit) with the longest prefix that
    resolves; a path under an explicit alias that doesn't exist is unresolved,
    the rest is an external package. Equal imports of a folder are resolved once.
    """
    spark = imports.sparkSession
    x = imports.select("file", "specifier", folder(F.col("file")).alias("dir")).distinct()
    s = F.col("specifier")
    keys = x.select("dir", "specifier", s.rlike(r"^[./]").alias("is_relative"), F.regexp_replace(s, "^node:", "").isin(NODE_BUILTINS).alias("is_builtin")).distinct()
    base = keys.where("is_relative").select("dir", "specifier", normalised_path(F.when(s.startswith("/"), s).otherwise(F.concat_ws("/", "dir", "specifier"))).alias("base"), F.lit(0).alias("rank"))
    plain = keys.where("not is_relative and not is_builtin")
    if own_package:
        own = plain.where((s == own_package) | s.startswith(f"{own_package}/"))
        base = base.unionByName(own.select("dir", "specifier", F.when(s == own_package, "src").otherwise(F.substring(s, len(own_package) + 2, 1 << 20)).alias("base"), F.lit(1).alias("rank")))
    if packages is not None:
        p = plain.withColumn("name", package_name(s)).join(packages.select("name", "source"), "name")
        rest = F.substr(s, F.length("name") + 2)
        base = base.unionByName(p.select("dir", "specifier", normalised_path(F.concat_ws("/", "source", F.when(rest != "", rest))).alias("base"), F.lit(2).alias("rank")))
    explicit = plain.select("dir", "specifier").where(F.lit(False))
    if aliases is not None:
        starts = F.transform(F.sequence(F.lit(1), F.length(s)), lambda n: F.substr(s, F.lit(1), n))
        a = plain.withColumn("prefix", F.explode(starts)).join(aliases, "prefix")  # a prefix join by equality
        longest = 1000 - F.length("prefix")
        rest = F.when(F.col("is_wildcard"), F.substr(s, F.length("prefix") + 1)).otherwise("")
        base = base.unionByName(a.select("dir", "specifier", normalised_path(F.concat_ws("/", "target", F.when(rest != "", rest))).alias("base"), (3 + longest).alias("rank")))
        explicit = a.where("is_explicit").select("dir", "specifier").distinct()
    ends = spark.createDataFrame(list(enumerate(SCRIPT_ENDS)), "n int, end string")
    candidates = base.crossJoin(F.broadcast(ends)).select("dir", "specifier", F.concat("base", "end").alias("candidate"), (F.col("rank") * 100 + F.col("n")).alias("ord"))
    found = existing(candidates, paths, ["dir", "specifier"])
    out = keys.join(merged(found), ["dir", "specifier"], "left").join(explicit.withColumn("ex", F.lit(True)), ["dir", "specifier"], "left")
    unresolved = F.col("is_relative") | F.coalesce("ex", F.lit(False))
    kind = F.when(F.col("is_builtin"), "external").when(F.col("path").isNotNull(), "internal").when(unresolved, "unresolved").otherwise("external")
    name = F.when(kind == "external", F.when(F.col("is_builtin"), F.regexp_replace(s, "^node:", "")).otherwise(package_name(s)))
    return x.join(merged(out.select("dir", "specifier", kind.alias("kind"), "path", name.alias("name"))), ["dir", "specifier"]).select("file", "specifier", "kind", "path", "name")


def alias_table(configs: DataFrame) -> DataFrame:
    """(prefix, target, is_wildcard, is_explicit) of the ``compilerOptions.paths`` of configuration texts (dir, content)."""
    from sparkstrata.functions.text import parse_commented_json

    c = configs.select("dir", parse_commented_json(F.col("content"), "compilerOptions struct<baseUrl:string,paths:map<string,array<string>>>")["compilerOptions"].alias("o"))
    c = c.select("dir", F.coalesce("o.baseUrl", F.lit(".")).alias("base"), F.explode("o.paths").alias("prefix", "targets")).select("dir", "base", "prefix", F.explode("targets").alias("target"))
    clean = lambda x: F.regexp_replace(x, r"\*$", "")
    target = normalised_path(F.concat_ws("/", "dir", "base", clean(F.col("target"))))
    return c.select(clean(F.col("prefix")).alias("prefix"), target.alias("target"), F.col("prefix").endswith("*").alias("is_wildcard"), F.lit(True).alias("is_explicit"))


def workspace_packages(manifests: DataFrame) -> DataFrame:
    """(name, root, version, is_private, dependencies) of package manifests (path, content); dependencies are those on each other."""
    from sparkstrata.functions.text import parse_commented_json

    schema = "name string, version string, private boolean, dependencies map<string,string>, devDependencies map<string,string>"
    m = manifests.select(folder(F.col("path"), ".").alias("root"), parse_commented_json(F.col("content"), schema).alias("m")).where("m.name is not null")
    none = F.array().cast("array<string>")
    deps = F.array_distinct(F.concat(F.coalesce(F.map_keys("m.dependencies"), none), F.coalesce(F.map_keys("m.devDependencies"), none)))
    own = m.select(F.col("m.name").alias("name"), "root", F.col("m.version").alias("version"), F.coalesce("m.private", F.lit(False)).alias("is_private"), deps.alias("deps"))
    inside = own.select("root", F.explode("deps").alias("dep")).join(own.select(F.col("name").alias("dep")).distinct(), "dep", "left_semi").groupBy("root").agg(F.array_sort(F.collect_set("dep")).alias("dependencies"))
    return own.drop("deps").join(inside, "root", "left").select("name", "root", "version", "is_private", F.coalesce("dependencies", none).alias("dependencies"))


def python_roots(paths: DataFrame) -> DataFrame:
    """(root): folders that Python imports start from: the first above each module that is no package, and the top."""
    py = paths.where(F.col("path").endswith(".py"))
    dirs = py.select(folder(F.col("path")).alias("dir")).distinct().where("dir <> ''")
    packages = py.where(base_name(F.col("path")) == "__init__.py").select(folder(F.col("path")).alias("up"), F.lit(1).alias("is_package"))
    chain = dirs.select("dir", F.posexplode(F.reverse(F.concat(ancestors(F.col("dir")), F.array("dir")))).alias("n", "up"))
    gaps = chain.join(packages, "up", "left").where("is_package is null")
    top = gaps.groupBy("dir").agg(F.min_by("up", "n").alias("root"))
    return dirs.join(top, "dir", "left").select(F.coalesce("root", F.lit("")).alias("root")).unionByName(paths.sparkSession.createDataFrame([("",)], "root string")).distinct()


def resolve_python(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """(file, specifier, dots, kind, targets, name) of Python imports (file, specifier, dots, symbols, is_from).

    Relative imports go up a folder for each dot after the first. What a from
    import names may be modules of its own; where all names are, only they are
    targets, else the module too. Otherwise the module, and then its parents,
    are looked for under each root.
    """
    x = imports.select("file", "specifier", "dots", F.coalesce("symbols", F.array().cast("array<string>")).alias("symbols"), "is_from").distinct().withColumn("key", F.xxhash64("file", "specifier", "dots", F.concat_ws(",", "symbols"), "is_from"))
    dirs = F.split(folder(F.col("file")), "/")
    up = F.array_join(F.slice(dirs, F.lit(1), F.greatest(F.size(dirs) - (F.col("dots") - 1), F.lit(0))), "/")
    roots = python_roots(paths).withColumn("depth", F.when(F.col("root") == "", 0).otherwise(F.size(F.split("root", "/"))))
    relative = x.where("dots > 0").withColumn("root", up).withColumn("depth", F.lit(0))
    absolute = x.where("dots = 0").crossJoin(roots)  # a repository's roots are few
    placed = relative.unionByName(absolute)
    segments = F.filter(F.split("specifier", r"\."), lambda s: s != "")
    names = F.filter(F.transform("symbols", lambda s: F.trim(F.element_at(F.split(s, " as "), 1))), lambda s: ~s.startswith("*"))
    modules = F.array(F.struct(F.lit("module").alias("what"), F.lit(0).alias("n"), segments.alias("parts")))
    of_symbols = F.when(F.col("is_from"), F.transform(names, lambda s: F.struct(F.lit("symbol").alias("what"), F.lit(0).alias("n"), F.concat(segments, F.split(s, r"\.")).alias("parts"))))
    parents = F.when(
        F.col("dots") == 0,
        F.transform(F.filter(F.sequence(F.lit(0), F.size(segments) - 1), lambda i: i > 0), lambda i: F.struct(F.lit("parent").alias("what"), (F.size(segments) - i).alias("n"), F.slice(segments, F.lit(1), i).alias("parts"))),
    )
    none = F.array().cast("array<struct<what:string,n:int,parts:array<string>>>")
    looked = placed.select("key", "root", "depth", F.explode(F.concat(modules, F.coalesce(of_symbols, none), F.coalesce(parents, none))).alias("c"))
    stem = F.concat_ws("/", F.when(F.col("root") != "", F.col("root")), F.when(F.size("c.parts") > 0, F.array_join("c.parts", "/")))
    looked = looked.select("key", "depth", "root", "c.what", "c.n", F.array_join("c.parts", ".").alias("dotted"), stem.alias("stem"))
    ends = F.when(F.col("dotted") == "", F.array(F.lit("/__init__.py"))).otherwise(F.array(F.lit(".py"), F.lit("/__init__.py")))
    candidates = looked.select("key", "what", "n", "dotted", "depth", "root", "stem", F.posexplode(ends).alias("e", "end")).select(
        "key", "what", "n", "dotted", F.regexp_replace(F.concat("stem", "end"), "^/", "").alias("candidate"), F.struct("depth", "root", "e").alias("ord")
    )
    found = existing(candidates, paths, ["key", "what", "n", "dotted"])
    got = found.groupBy("key").agg(
        F.max(F.when(F.col("what") == "module", F.col("path"))).alias("module"),
        F.array_sort(F.collect_set(F.when(F.col("what") == "symbol", F.col("path")))).alias("subs"),
        F.count_if(F.col("what") == "symbol").alias("n_subs"),
        F.min_by("path", F.when(F.col("what") == "parent", F.col("n"))).alias("parent"),
    )
    y = x.join(got, "key", "left")
    subs = F.coalesce("subs", F.array().cast("array<string>"))
    some = F.when((F.size(subs) > 0) & (F.col("n_subs") < F.size("symbols")), F.array_union(subs, F.array_compact(F.array("module")))).otherwise(subs)
    usable = F.when((F.col("dots") > 0) & (F.col("specifier") != "") & ~F.coalesce(F.col("module").endswith("__init__.py"), F.lit(False)), F.array().cast("array<string>")).otherwise(some)
    targets = F.when(F.size(usable) > 0, usable).when(F.col("module").isNotNull(), F.array("module")).when(F.col("parent").isNotNull(), F.array("parent")).otherwise(F.array().cast("array<string>"))
    kind = F.when(F.size(targets) > 0, "internal").when((F.col("dots") > 0) | (F.col("specifier") == ""), "unresolved").otherwise("external")
    return y.select("file", "specifier", "dots", kind.alias("kind"), targets.alias("targets"), F.when(kind == "external", F.element_at(F.split("specifier", r"\."), 1)).alias("name"))


def resolve_go(imports: DataFrame, paths: DataFrame, modules: DataFrame, most: int = GO_FILES) -> DataFrame:
    """(file, specifier, path): Go imports with the files of their package, ``most`` of each in order of path.

    ``modules`` has (module, dir); the longest module path that begins the
    specifier decides the folder. Tests are no part of a package.
    """
    s = F.col("specifier")
    x = imports.select("file", "specifier").distinct()
    own = paths.where(F.col("path").endswith(".go") & ~F.col("path").endswith("_test.go")).select("path", folder(F.col("path")).alias("dir"))
    files = own.withColumn("n", F.row_number().over(Window.partitionBy("dir").orderBy("path"))).where(F.col("n") <= most).drop("n")
    local = x.where(s.rlike(r"^\.\.?/")).select("file", "specifier", normalised_path(F.concat_ws("/", folder(F.col("file")), "specifier")).alias("dir"))
    prefixes = x.where(~s.rlike(r"^\.\.?/")).select("file", "specifier", F.explode(F.concat(ancestors(s), F.array("specifier"))).alias("module"))
    hit = prefixes.join(modules, "module")
    best = hit.groupBy("file", "specifier").agg(F.max_by(F.struct("module", "dir"), F.length("module")).alias("m"))
    rest = F.substr(s, F.length("m.module") + 2)
    inside = best.select("file", "specifier", F.concat_ws("/", F.when(F.col("m.dir") != "", F.col("m.dir")), F.when(rest != "", rest)).alias("dir"))
    return local.unionByName(inside).join(files, "dir").select("file", "specifier", "path")


def resolve_includes(includes: DataFrame, paths: DataFrame) -> DataFrame:
    """(file, specifier, kind, path, name) of C-family includes (file, specifier).

    The including file's folder comes first, then include roots from the top
    down, then the file whose path ends with the specifier, of several the one
    that shares most leading segments with the including file.
    """
    spark = includes.sparkSession
    s = F.regexp_replace("specifier", r"\\", "/")
    x = includes.select("file", "specifier", s.alias("spec"), folder(F.col("file")).alias("dir")).distinct()
    parts = F.split(folder(F.col("path")), "/")
    roots = paths.select(F.explode(F.filter(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.when(F.lower(F.element_at(parts, i.cast("int"))).isin(INCLUDE_NAMES), F.array_join(F.slice(parts, F.lit(1), i), "/"))), lambda r: r.isNotNull())).alias("root")).distinct()
    roots = roots.unionByName(spark.createDataFrame([("",)], "root string")).distinct().withColumn("depth", F.when(F.col("root") == "", 0).otherwise(F.size(F.split("root", "/"))))
    near = x.select("file", "specifier", normalised_path(F.concat_ws("/", "dir", "spec")).alias("candidate"), F.struct(F.lit(-1).alias("depth"), F.lit("").alias("root")).alias("ord"))
    under = x.crossJoin(roots).select("file", "specifier", normalised_path(F.concat_ws("/", "root", "spec")).alias("candidate"), F.struct("depth", "root").alias("ord"))  # few roots
    direct = existing(near.unionByName(under), paths, ["file", "specifier"])
    named = paths.select("path", base_name(F.col("path")).alias("base"))
    ends = x.join(direct, ["file", "specifier"], "left_anti").withColumn("base", base_name(F.col("spec"))).join(named, "base")
    ends = ends.where((F.col("path") == F.col("spec")) | F.col("path").endswith(F.concat(F.lit("/"), "spec")))
    best = ends.groupBy("file", "specifier").agg(F.min_by("path", F.struct(-shared_prefix_length(F.col("path"), F.col("file")), "path")).alias("path"))
    found = direct.unionByName(best)
    library = F.regexp_replace(F.element_at(F.split("spec", "/"), 1), r"(?i)\.(h|hpp|hh|hxx)$", "")
    y = x.join(found, ["file", "specifier"], "left")
    return y.select("file", "specifier", F.when(F.col("path").isNotNull(), "internal").otherwise("external").alias("kind"), "path", F.when(F.col("path").isNull(), library).alias("name"))


def companions(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, target): sources of the C family with the header that belongs to them, where no edge joins them yet."""
    stem = F.regexp_extract("path", r"(?i)^(.*)\.(c|cc|cpp|cxx)$", 1)
    x = paths.select(F.col("path").alias("source"), stem.alias("stem")).where("stem <> ''")
    swapped = F.regexp_replace("stem", "(^|/)(src|source)/", "$1include/")
    ends = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(e).alias("end")) for n, e in enumerate(HEADER_ENDS)])
    y = x.select("source", "stem", F.explode(ends).alias("e"))
    candidates = y.select("source", F.concat("stem", "e.end").alias("candidate"), F.struct("e.n", F.lit(0).alias("s")).alias("ord")).unionByName(
        y.where(swapped != F.col("stem")).select("source", F.concat(swapped, F.col("e.end")).alias("candidate"), F.struct("e.n", F.lit(1).alias("s")).alias("ord"))
    )
    direct = existing(candidates, paths, ["source"])
    named = paths.select("path", base_name(F.col("path")).alias("base"))
    lone = named.groupBy("base").agg(F.count("*").alias("c"), F.min("path").alias("path")).where("c = 1")
    by_name = y.join(direct, "source", "left_anti").select("source", F.concat(base_name(F.col("stem")), F.col("e.end")).alias("base"), F.col("e.n").alias("n")).join(lone, "base")
    by_name = by_name.groupBy("source").agg(F.min_by("path", "n").alias("path"))
    found = direct.unionByName(by_name).select("source", F.col("path").alias("target"))
    return found.join(edges.select("source", "target"), ["source", "target"], "left_anti")


def requested_paths(requested: DataFrame, paths: DataFrame) -> DataFrame:
    r"""(requested, path): a file for each requested path.

    Backslashes count as slashes, a leading ./ and blanks at the ends go. First
    comes the equal path; then, without regard to case, the only file of that
    name, the first path that ends with the request, and the first file of the
    name. Paths are in their own order. A request for which none is found, and
    an empty one, has no row.
    """
    norm = F.trim(F.regexp_replace(F.regexp_replace("requested", r"\\", "/"), r"^\./", ""))
    asked = requested.select("requested").distinct().withColumn("norm", norm).withColumn("low", F.lower("norm")).withColumn("base", base_name(F.col("low")))
    own = paths.select("path", F.lower("path").alias("low_path")).distinct().withColumn("name", base_name(F.col("low_path")))
    equal = asked.join(merged(own.select("path")), F.col("norm") == F.col("path"), "left_semi").select("requested", F.col("norm").alias("path"))
    # what ends with a request has a name that ends with the request's name
    ends = dealt(own.withColumn("base", F.explode(F.transform(F.sequence(F.lit(1), F.length("name")), lambda n: F.substr("name", n)))), "base")
    rest = asked.where("base <> ''").join(merged(equal.select("requested")), "requested", "left_anti")
    hits = rest.join(merged(ends), "base").withColumn("named", F.col("name") == F.col("base")).withColumn("ends", F.col("low_path").endswith(F.col("low")))
    first = lambda c: F.min(F.when(F.col(c), F.col("path")))
    found = hits.groupBy("requested").agg(F.count_if("named").alias("n"), first("named").alias("named"), first("ends").alias("ends"))
    found = found.select("requested", F.when(F.col("n") == 1, F.col("named")).otherwise(F.coalesce("ends", "named")).alias("path")).where("path is not null")
    return equal.unionByName(found)


def barrel_functions(barrels: DataFrame, functions: DataFrame, most: int = 10) -> DataFrame:
    """Functions (file, name, ord) of the first targets of barrels (id, barrel_targets), with the barrel and the file they come from."""
    targets = barrels.select("id", F.posexplode(F.slice("barrel_targets", 1, most)).alias("pos", "file"))
    return targets.join(functions.select("file", "name", "ord"), "file").select(F.col("id").alias("barrel"), F.col("file").alias("source_file"), "name", "pos", "ord")


def file_index(paths: DataFrame) -> DataFrame:
    """(dir, n_files, extensions): the files of each folder."""
    ext = F.regexp_extract(F.lower(base_name(F.col("path"))), r".(\.[^.]*)$", 1)
    return paths.groupBy(folder(F.col("path")).alias("dir")).agg(F.count("*").alias("n_files"), F.array_sort(F.collect_set(ext)).alias("extensions"))
