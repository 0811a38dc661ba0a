"""Classes of files and paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkstrata.functions.text import base_name, strings

#: Folders, extensions and name ends of files that are not read, and extensions of those that are.
SKIP_FOLDERS = "node_modules .git dist build .next .nuxt .output coverage __pycache__ .cache vendor third_party extern generated auto_generated".split()
SKIP_EXTENSIONS = (
    ".png .jpg .jpeg .gif .svg .ico .webp .mp4 .mp3 .wav .ogg .webm .pdf .zip .tar .gz .rar .ttf .woff .woff2 .eot .exe .dll .so .dylib .bin .map .lock"
).split()
SKIP_ENDS = ".min.js .min.ts .bundle.js .chunk.js .generated.ts .generated.js package-lock.json yarn.lock pnpm-lock.yaml".split()
SOURCE_EXTENSIONS = ".js .ts .jsx .tsx .mjs .cjs .py .go .c .cpp .cc .cxx .c++ .h .hpp .hh .hxx".split()
#: Folders of tests of other languages than scripts.
TEST_FOLDERS = "test tests testing __tests__ spec unittests unit_tests".split()
#: Starts of the names of configuration files.
CONFIG_STARTS = "jest vite webpack tsdown rollup eslint prettier lint-staged babel next nuxt tailwind postcss".split()
#: Segments of folders whose files count as unused more easily, and of shared code; stems that a framework finds by name.
PENALTY_SEGMENTS = (
    "example examples demo demos fixture fixtures seed seeds scaffold scaffolds storybook .storybook bench benchmarks docs documentation"
).split()
UTILITY_SEGMENTS = "utils util utility utilities helpers helper support shared common lib tools".split()
FRAMEWORK_STEMS = "page layout route loading error not-found template middleware _app _document index".split()
#: Built-in modules of two languages.
NODE_BUILTINS = (
    "assert async_hooks buffer child_process cluster console constants crypto dgram diagnostics_channel dns domain events fs http http2 https "
    "inspector module net os path perf_hooks process punycode querystring readline repl stream string_decoder sys timers tls trace_events tty url "
    "util v8 vm wasi worker_threads zlib"
).split()
PYTHON_BUILTINS = (
    "abc argparse array ast asyncio atexit base64 bisect builtins calendar cmath codecs collections concurrent configparser contextlib contextvars "
    "copy copyreg csv ctypes dataclasses datetime decimal difflib dis email enum errno faulthandler fcntl filecmp fileinput fnmatch fractions "
    "functools gc getopt getpass gettext glob gzip hashlib heapq hmac html http imaplib importlib inspect io ipaddress itertools json keyword "
    "linecache locale logging lzma marshal math mimetypes mmap multiprocessing numbers operator os pathlib pickle pickletools pkgutil platform "
    "plistlib poplib posixpath pprint profile pstats pty pwd py_compile pyclbr pydoc queue quopri random re readline reprlib resource runpy sched "
    "secrets select selectors shelve shlex shutil signal site smtplib socket socketserver sqlite3 ssl stat statistics string stringprep struct "
    "subprocess symtable sys sysconfig tarfile tempfile termios textwrap threading time timeit token tokenize tomllib trace traceback tracemalloc "
    "types typing unicodedata unittest urllib uuid venv warnings wave weakref webbrowser wsgiref xml xmlrpc zipapp zipfile zipimport zlib zoneinfo "
    "__future__"
).split()
#: Paths whose presence tells a repository's tools.
CI_PATHS = {
    ".github/workflows": "github-actions", ".circleci": "circleci", ".travis.yml": "travis", ".gitlab-ci.yml": "gitlab-ci", "Jenkinsfile": "jenkins",
    "azure-pipelines.yml": "azure-devops", "bitbucket-pipelines.yml": "bitbucket", ".buildkite": "buildkite", "vercel.json": "vercel",
    "netlify.toml": "netlify", "railway.json": "railway", "render.yaml": "render", "fly.toml": "fly-io",
}
BUILD_PATHS = {
    "vite.config.ts": "vite", "vite.config.js": "vite", "webpack.config.js": "webpack", "webpack.config.ts": "webpack", "rollup.config.js": "rollup",
    "rollup.config.ts": "rollup", "esbuild.config.js": "esbuild", "tsup.config.ts": "tsup", "tsdown.config.ts": "tsdown", "next.config.js": "nextjs",
    "next.config.ts": "nextjs", "next.config.mjs": "nextjs", "nuxt.config.ts": "nuxt", "nuxt.config.js": "nuxt", "remix.config.js": "remix",
    "astro.config.mjs": "astro", "svelte.config.js": "sveltekit", "turbo.json": "turborepo", "nx.json": "nx", "lerna.json": "lerna",
    "Makefile": "make", "Cargo.toml": "cargo", "go.mod": "go", "tsconfig.json": "tsc",
}
DOCKER_PATHS = (
    "Dockerfile Dockerfile.dev Dockerfile.prod docker-compose.yml docker-compose.yaml docker-compose.dev.yml docker-compose.prod.yml .dockerignore"
).split()
ENV_PATHS = ".env .env.local .env.development .env.production .env.staging .env.test .env.example .env.sample".split()
ZONE_FOLDERS = {
    "frontend": "frontend", "client": "frontend", "web": "frontend", "app": "frontend", "backend": "backend", "server": "backend", "api": "backend",
    "services": "services", "microservices": "services", "libs": "shared-libs", "lib": "shared-libs", "shared": "shared-libs",
    "common": "shared-libs", "core": "shared-libs", "packages": "packages", "infra": "infrastructure", "infrastructure": "infrastructure",
    "deploy": "infrastructure", "k8s": "infrastructure", "docs": "docs", "documentation": "docs", "scripts": "tooling", "tools": "tooling",
    "bin": "tooling",
}


def extension(path: Column) -> Column:
    """The last extension of a file name with its dot, lower-cased; empty if it has none."""
    return F.regexp_extract(F.lower(base_name(path)), r".(\.[^.]*)$", 1)


def is_processable(path: Column) -> Column:
    """Whether a file is source code outside the folders and name patterns that are skipped."""
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    parts = F.split(low, "/")
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    name, ext = base_name(low), extension(low)
    skipped = F.arrays_overlap(folders, strings(SKIP_FOLDERS)) | ext.isin(SKIP_EXTENSIONS) | F.exists(strings(SKIP_ENDS), lambda x: name.endswith(x))
    return ~skipped & ext.isin(SOURCE_EXTENSIONS)


def parse_mode(path: Column, size: Column) -> Column:
    """struct(mode, reason): how much of a file is read."""
    name = F.lower(base_name(path))
    mode = (
        F.when(name.contains(".min.") | name.contains(".bundle.") | name.contains(".chunk."), "skip")
        .when(name.endswith(".d.ts"), "imports-only")
        .when(size < 500 * 1024, "full")
        .otherwise("imports-only")
    )
    reason = F.when(name.endswith(".d.ts") & (mode != "skip"), "type definition file (imports only)").when((mode == "imports-only") & (size > 2 * 1024 * 1024), "large file - imports only for performance")
    return F.struct(mode.alias("mode"), reason.alias("reason"))


def file_kind(path: Column, exports_component: Column | None = None) -> Column:
    """declaration, test, ui, config or source of a script file; the first that holds."""
    name = F.lower(base_name(path))
    parts = F.split(path, r"[\\/]")
    test = (
        name.contains(".test.") | name.contains(".spec.") | F.arrays_overlap(parts, strings(["__tests__", "__mocks__", "test", "tests"]))
        | name.isin("setuptests.ts", "setuptests.js", "setup.ts", "setup.js", "teardown.ts", "teardown.js")
    )
    ui = (name.endswith(".jsx") | name.endswith(".tsx")) & F.coalesce(exports_component if exports_component is not None else F.lit(False), F.lit(False))
    config = F.exists(strings([f"{x}.config" for x in CONFIG_STARTS]), lambda x: name.startswith(x))
    return F.when(name.endswith(".d.ts"), "declaration").when(test, "test").when(ui, "ui").when(config, "config").otherwise("source")


def file_kind_other(path: Column, language: Column) -> Column:
    """test, config, declaration or source of a Python, Go or C-family file."""
    name = F.lower(base_name(path))
    in_tests = F.arrays_overlap(F.split(F.lower(path), "/"), strings(TEST_FOLDERS))
    python = F.when(in_tests | name.startswith("test_") | name.endswith("_test.py") | (name == "conftest.py"), "test").when(name.isin("setup.py", "conf.py", "settings.py"), "config").otherwise("source")
    go = F.when(name.endswith("_test.go"), "test").otherwise("source")
    c_test = in_tests | name.startswith("test_") | name.rlike(r"(_test|_tests|\.test)\.(c|cc|cpp|cxx)$")
    c = F.when(c_test, "test").when(name.rlike(r"\.(h|hpp|hh|hxx)$"), "declaration").otherwise("source")
    return F.when(language == "python", python).when(language == "go", go).when(language.isin("c", "cpp"), c).otherwise(F.lit("source"))


def language_of(path: Column, headers_are_cpp: Column | None = None) -> Column:
    """Language by extension; .h goes by ``headers_are_cpp``."""
    ext = extension(path)
    return (
        F.when(ext.isin(".ts", ".tsx"), "typescript")
        .when(ext.isin(".js", ".jsx", ".mjs", ".cjs"), "javascript")
        .when(ext == ".py", "python")
        .when(ext == ".go", "go")
        .when(ext == ".c", "c")
        .when(ext.isin(".cpp", ".cc", ".cxx", ".c++", ".hpp", ".hh", ".hxx"), "cpp")
        .when(ext == ".h", F.when(headers_are_cpp if headers_are_cpp is not None else F.lit(False), "cpp").otherwise("c"))
        .otherwise("unknown")
    )


def is_noise(path: Column) -> Column:
    """Generated, built, vendored or declared-only files."""
    return F.lower(path).rlike(
        r"\.d\.ts$|gql\.tada|-env\.d\.ts$|\.generated\.|\.gen\.(ts|js)$|schema\.(graphql|gql)$|/auto-(docs|schema)/"
        r"|(^|/)(dist|build|out|node_modules|vendor|coverage|__generated__)/|\.min\.|(^|/)(package-lock\.json|yarn\.lock|pnpm-lock\.yaml)$"
    )


def is_low_signal(path: Column) -> Column:
    return F.lower(path).rlike("(^|/)(docs?|mkdocs|examples?|samples?|demos?)/")


def is_test(path: Column) -> Column:
    """Test files of several languages, by folder or by each language's names."""
    norm = F.replace(path, F.lit("\\"), F.lit("/"))
    name = base_name(norm)
    low = F.lower(name)
    ext = F.regexp_extract(low, r"\.([a-z0-9+]+)$", 1)
    c_ends = r"(c|cc|cpp|cxx|c\+\+|h|hpp|hh|hxx)"
    return (
        F.when(F.lower(norm).rlike("(^|/)(test|tests|testing|__tests__|__mocks__|spec|specs)/"), True)
        .when(ext.isin("ts", "tsx", "js", "jsx", "mjs", "cjs"), low.rlike(r"\.(test|spec)\.[a-z]+$"))
        .when(ext == "py", low.rlike(r"^test_.+\.py$|_test\.py$|^conftest\.py$"))
        .when(ext == "go", low.endswith("_test.go"))
        .when(ext.rlike(f"^{c_ends}$"), low.rlike(r"^test_.+\.[a-z+]+$|_tests?\.[a-z+]+$") | name.rlike(rf"Tests?\.{c_ends}$"))
        .otherwise(False)
    )


def is_infrastructure(path: Column, kind: Column) -> Column:
    """Documentation, scripts and configuration."""
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    name = base_name(low)
    return (
        low.rlike(r"^(docs|\.github|scripts|tools|docker|website|site)/") | low.rlike(r"\.(md|json|yaml|yml|toml|lock|sh|bat)$")
        | F.coalesce(kind == "config", F.lit(False)) | name.contains("config.") | name.rlike(r"^(tsconfig|\.eslintrc|\.prettierrc|\.babelrc|\.env)")
    )


def _has_segment(path: Column, names: list[str]) -> Column:
    return F.arrays_overlap(F.split(F.lower(path), "/"), strings(names))


def in_penalty_folder(path: Column) -> Column:
    return _has_segment(path, PENALTY_SEGMENTS)


def in_utility_folder(path: Column) -> Column:
    return _has_segment(path, UTILITY_SEGMENTS)


def is_framework_file(path: Column, is_entry_point: Column) -> Column:
    stem = F.lower(F.regexp_replace(base_name(path), r"\.[^.]+$", ""))
    return F.coalesce(is_entry_point, F.lit(False)) | stem.isin(FRAMEWORK_STEMS)


def semantic_role(path: Column, is_barrel: Column) -> Column:
    return F.when(is_barrel, "barrel").when(path.rlike(r"(?i)\.(test|spec)\.(ts|js|tsx|jsx)$|/__(tests?|mocks?)__/"), "test").otherwise("unknown")


def is_builtin_module(specifier: Column, language: str = "javascript") -> Column:
    if language == "python":
        return F.element_at(F.split(specifier, r"\."), 1).isin(PYTHON_BUILTINS)
    return F.regexp_replace(specifier, "^node:", "").isin(NODE_BUILTINS)


def has_startup_call(calls: Column) -> Column:
    return F.arrays_overlap(calls, strings(["listen", "createServer", "start", "bootstrap"]))


def has_route_call(calls: Column) -> Column:
    return F.arrays_overlap(calls, strings(["get", "post", "put", "patch", "delete", "head", "options", "all", "use", "route", "handle"]))


def schema_hit(path: Column, role: Column, is_barrel: Column, n_structures: Column, n_functions: Column, in_degree: Column, out_degree: Column) -> Column:
    """metadata, graph or fallback where a file looks like a schema or configuration, else null."""
    low = F.lower(path)
    named = low.rlike("schema|config|model|drizzle|prisma|db|settings") | low.endswith(".json")
    return (
        F.when((role == "test") | is_barrel, None)
        .when((n_structures > 0) & ((n_functions == 0) | (n_functions / n_structures <= 0.25)), "metadata")
        .when((in_degree >= 2) & (out_degree <= 2) & ((n_structures > 0) | (n_functions == 0)), "graph")
        .when(named, "fallback")
    )


def shown(kinds: list[str], languages: list[str], kind: Column, language: Column, path: Column, is_entry_point: Column) -> Column:
    """Whether a file passes the chosen kinds (any of them) and languages (any of them); nothing chosen passes all."""
    ui = F.lower(path).rlike(r"\.(tsx|jsx)$")
    tests = {"entry": F.coalesce(is_entry_point, F.lit(False)), "test": kind == "test", "config": kind == "config", "ui": ui}
    by_kind = F.lit(not kinds)
    for k in kinds:
        by_kind = by_kind | tests[k]
    return by_kind & (F.lit(True) if not languages else language.isin(languages))


def function_marker(language: Column, is_declaration: Column, is_exported: Column) -> Column:
    """The short mark of a function's visibility, by language: what is out of the ordinary there."""
    scripts, c_family = language.isin("typescript", "javascript"), language.isin("c", "cpp")
    return (
        F.when(is_declaration & c_family, "decl")
        .when(scripts & is_exported, "exp")
        .when(scripts, None)
        .when(language == "go", F.when(is_exported, "exported"))
        .when(language == "python", F.when(~is_exported, "private"))
        .when(c_family, F.when(~is_exported, "static"))
        .when(is_exported, "exp")
    )


def detected(paths, table: dict[str, str], what: str):
    """(what, name, path) of the paths (column path of a repository's files and folders) that a table lists, a semi-join with a fixed table."""
    spark = paths.sparkSession
    known = spark.createDataFrame(list(table.items()), "path string, name string")
    return paths.select("path").distinct().join(F.broadcast(known), "path").select(F.lit(what).alias("what"), "name", "path")


def repository_metadata(paths):
    """(what, name, paths) of the continuous-integration, build, container, environment and zone findings of a repository.

    ``paths`` has the files (column path); their folders are derived.
    """
    parts = F.split("path", "/")
    folders = paths.select(F.explode(F.transform(F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: i > 0), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("path"))
    every = paths.select("path").unionByName(folders).distinct()
    found = detected(every, CI_PATHS, "ci")
    for table, what in ((BUILD_PATHS, "build"), ({x: x for x in DOCKER_PATHS}, "docker"), ({x: x for x in ENV_PATHS}, "env"), (ZONE_FOLDERS, "zone")):
        found = found.unionByName(detected(every, table, what))
    return found.groupBy("what", "name").agg(F.array_sort(F.collect_set("path")).alias("paths"))
