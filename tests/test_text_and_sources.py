import pytest
from pyspark.sql import functions as F

from sparkstrata.functions import classify as C
from sparkstrata.functions import text as T
from sparkstrata.operators import budget, evaluate, resolve
from sparkstrata.sources import extract, listing


def one(spark, f, *values):
    names = [f"c{k}" for k in range(len(values))]
    return spark.createDataFrame([values], names).select(f(*map(F.col, names)).alias("x")).first().x


@pytest.mark.parametrize("f, value, want", [
    (T.index_tokens, "src/authService.ts", ["src/authservice.ts", "src", "authservice", "auth", "service", "ts"]),
    (T.query_tokens, '  "Hot Bolt" old RING ', ["hot bolt", "old", "ring"]),
    (T.ranker_tokens, "getURL2Path a_b x", ["get", "url2", "path"]),
    (T.issue_tokens, "The userReducer can't load", ["user", "reducer", "can't", "load"]),
    (T.code_identifiers, "call `createEvent` in AgendaItem", ["create", "event", "createevent", "agenda", "item"]),
    (T.explicit_paths, "see src\\A\\b.ts and c.py", ["src/a/b.ts", "b.ts", "c.py"]),
    (T.strong_identifiers, "call `Foo` in userReducer2", ["foo", "userreducer2"]),
    (T.entity_noun, "createUserResolver.ts", "User"),
    (T.entity_noun, "index.ts", "Core"),
    (T.normalised_path, "a/./b//../c", "a/c"),
    (T.dedent, "    a\n\n      b", "a\n\n  b"),
    (T.strip_boilerplate, "// x\nimport a from 'b'\n\nconst y = 1\n", "const y = 1\n"),
    (T.line_count, "a\nb\n", 3),
    (T.sanitised_key, "a/b c", "a-b_c"),
    (T.device_id, "ab-12 34_56", "ab-123456"),
    (T.chat_title, " a\n b ", "a b"),
    (T.half_up, -2.5, -2.0),
    (C.is_test, "src/FooTest.cpp", True),
    (C.is_test, "src/fooTest.ts", False),
    (C.is_noise, "a/dist/x.js", True),
    (C.is_processable, "a/vendor/x.ts", False),
    (C.is_processable, "vendor.ts", True),
    (C.extension, "a/.env", ""),
    (C.is_builtin_module, "node:fs", True),
])
def test_expressions(spark, f, value, want):
    assert one(spark, f, value) == want


def test_truncation(spark):
    text = "\n".join(map(str, range(1, 101)))
    got = one(spark, T.semantic_truncate, text).split("\n")
    assert got[:60] == [str(k) for k in range(1, 61)] and got[60] == "// ... [20 lines omitted] ..." and got[61:] == [str(k) for k in range(81, 101)]
    got = one(spark, lambda c: T.smart_truncate(c, F.array(F.lit("50")), 90), text)
    assert got.split("\n")[2] == "L40: 40" and got.endswith("L60: 60")
    assert one(spark, lambda c: T.line_slice(c, F.lit(2), F.lit(3)), text) == "2\n3"


def test_intent(spark):
    got = one(spark, lambda t, b: T.search_intent(t, b, F.array(F.lit("x"))), "Bug in createEvent", "short")
    assert got.strong_identifiers == ["createevent"] and got.exact_paths == [] and not got.is_vague
    assert one(spark, lambda t, b: T.search_intent(t, b, F.array(F.lit("x"))), "Help", "").is_vague


def test_event_frames(spark):
    got = one(spark, T.event_frames, 'data: {"type":"a","text":"t"}\n\ndata: {broken\n\nother\n\ndata: {"type":"b"}')
    assert [x.type for x in got] == ["a", "b"]


def test_budgets(spark):
    turns = spark.createDataFrame([(1, k, "x" * n) for k, n in enumerate([50, 10, 30, 90])] + [(2, 0, None)], "conv_id long, turn long, text string")
    got = {(r.conv_id, r.turn) for r in budget.history_budget(turns, 125).collect()}
    assert got == {(1, 3), (1, 2), (2, 0)}
    s = spark.createDataFrame([("f", k, n) for k, n in enumerate([100, 100, 50, 10])], "f string, k int, n int")
    # over 80 lines are shortened to 60 + 1 + 20; the fourth reaches over the file's 220 and gets what is left and a marker
    cut = lambda rows, **k: {r.k: (r.kept_lines, r.is_clamped) for r in budget.line_budget(rows, ["f"], ["k"], F.col("n"), [], **k).collect()}
    assert cut(s) == {0: (81, False), 1: (81, False), 2: (50, False), 3: (9, True)}
    assert cut(s, most=3) == {0: (81, False), 1: (81, False), 2: (50, False)}
    many = spark.createDataFrame([("f", 0, 5000), ("f", 1, 80), ("f", 2, 59), ("f", 3, 1), ("g", 4, 1)], "f string, k int, n int")
    assert cut(many) == {0: (81, False), 1: (80, False), 2: (59, False), 4: (1, False)}


def test_metrics(spark):
    p = spark.createDataFrame([("q", "A", 1), ("q", "b", 2), ("q", "c", 3)], "query string, id string, rank long")
    t = spark.createDataFrame([("q", "B"), ("q", "z"), ("r", "a")], "query string, id string")
    got = {r.query: r for r in evaluate.retrieval_metrics(p, t).collect()}
    assert (got["q"].p_at_1, got["q"].p_at_3, got["q"].r_at_3, got["q"].reciprocal_rank) == (0.0, pytest.approx(1 / 3), 0.5, 0.5) and got["r"].reciprocal_rank == 0.0
    assert evaluate.mean_metrics(evaluate.retrieval_metrics(p, t)).first().n_queries == 2


def test_script_resolution(spark):
    paths = spark.createDataFrame([(p,) for p in ("src/a.ts", "src/b/index.tsx", "pkg/ui/src/button.ts", "lib/x.js")], "path string")
    imports = spark.createDataFrame([("src/a.ts", s) for s in ("./b", "../lib/x", "./none", "node:fs", "@ui/button", "@/b", "@/none", "@s/p/q", "react/x")], "file string, specifier string")
    aliases = spark.createDataFrame([("@/", "src", True, True)], "prefix string, target string, is_wildcard boolean, is_explicit boolean")
    packages = spark.createDataFrame([("@ui/button", "pkg/ui/src/button")], "name string, source string")
    got = {r.specifier: (r.kind, r.path or r.name) for r in resolve.resolve_scripts(imports, paths, aliases, packages).collect()}
    assert got == {
        "./b": ("internal", "src/b/index.tsx"), "../lib/x": ("internal", "lib/x.js"), "./none": ("unresolved", None), "node:fs": ("external", "fs"),
        "@ui/button": ("internal", "pkg/ui/src/button.ts"), "@/b": ("internal", "src/b/index.tsx"), "@/none": ("unresolved", None),
        "@s/p/q": ("external", "@s/p"), "react/x": ("external", "react"),
    }


def test_python_resolution(spark):
    paths = spark.createDataFrame([(p,) for p in ("src/pkg/__init__.py", "src/pkg/a.py", "src/pkg/sub/__init__.py", "src/pkg/sub/b.py", "tool.py")], "path string")
    rows = [("src/pkg/a.py", "", 1, ["sub"], True), ("src/pkg/sub/b.py", "a", 2, ["x"], True), ("src/pkg/a.py", "pkg.sub", 0, ["b"], True), ("src/pkg/a.py", "pkg.sub", 0, ["b", "k"], True), ("tool.py", "os.path", 0, [], False), ("tool.py", "pkg.a.f", 0, [], False), ("tool.py", "gone", 1, ["x"], True)]
    got = resolve.resolve_python(spark.createDataFrame(rows, "file string, specifier string, dots int, symbols array<string>, is_from boolean"), paths).collect()
    by = sorted((r.file, r.specifier, r.kind, tuple(r.targets), r.name) for r in got)
    assert by == sorted([
        ("src/pkg/a.py", "", "internal", ("src/pkg/sub/__init__.py",), None), ("src/pkg/sub/b.py", "a", "internal", ("src/pkg/a.py",), None),
        ("src/pkg/a.py", "pkg.sub", "internal", ("src/pkg/sub/b.py",), None), ("src/pkg/a.py", "pkg.sub", "internal", ("src/pkg/sub/b.py", "src/pkg/sub/__init__.py"), None),
        ("tool.py", "os.path", "external", (), "os"), ("tool.py", "pkg.a.f", "internal", ("src/pkg/a.py",), None), ("tool.py", "gone", "unresolved", (), None),
    ])


def test_go_and_c_resolution(spark):
    paths = spark.createDataFrame([(p,) for p in ("api/h.go", "api/h_test.go", "api/k.go", "src/foo.c", "include/foo.h", "src/x/bar.h", "other/bar.h", "src/x/m.c")], "path string")
    go = resolve.resolve_go(spark.createDataFrame([("main.go", "ex.org/m/api"), ("main.go", "fmt"), ("api/h.go", "../api")], "file string, specifier string"), paths, spark.createDataFrame([("ex.org/m", "")], "module string, dir string"))
    assert sorted((r.file, r.specifier, r.path) for r in go.collect()) == [("api/h.go", "../api", "api/h.go"), ("api/h.go", "../api", "api/k.go"), ("main.go", "ex.org/m/api", "api/h.go"), ("main.go", "ex.org/m/api", "api/k.go")]
    inc = resolve.resolve_includes(spark.createDataFrame([("src/foo.c", "foo.h"), ("src/x/m.c", "bar.h"), ("src/foo.c", "bar.h"), ("src/foo.c", "stdio.h")], "file string, specifier string"), paths)
    assert {(r.file, r.specifier): (r.kind, r.path or r.name) for r in inc.collect()} == {
        ("src/foo.c", "foo.h"): ("internal", "include/foo.h"), ("src/x/m.c", "bar.h"): ("internal", "src/x/bar.h"), ("src/foo.c", "bar.h"): ("internal", "src/x/bar.h"), ("src/foo.c", "stdio.h"): ("external", "stdio"),
    }
    pairs = resolve.companions(paths, spark.createDataFrame([], "source string, target string")).collect()
    assert {(r.source, r.target) for r in pairs} == {("src/foo.c", "include/foo.h")}


def test_aliases_and_packages(spark):
    c = spark.createDataFrame([("", '{ // x\n "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"], "k": ["lib/k.ts"]}}}')], "dir string, content string")
    assert {(r.prefix, r.target, r.is_wildcard) for r in resolve.alias_table(c).collect()} == {("@/", "src", True), ("k", "lib/k.ts", False)}
    m = spark.createDataFrame([("a/package.json", '{"name":"a","dependencies":{"b":"1","x":"2"}}'), ("b/package.json", '{"name":"b","private":true}')], "path string, content string")
    assert {r.name: (r.root, r.is_private, r.dependencies) for r in resolve.workspace_packages(m).collect()} == {"a": ("a", False, ["b"]), "b": ("b", True, [])}


def test_extraction(spark):
    ts = "import type { A, B as C } from './a';\nimport * as ns from 'ns';\nexport { x } from './x';\nconst y = require('y');\nexport async function load(id: string) {\n  fetchAll(id); JSON.parse('x');\n}\ndescribe('suite', () => {});\nexport interface Shape { a: number }\n"
    go = 'package main\nimport (\n "fmt"\n "ex.org/m"\n)\ntype Box struct {\n}\nfunc (b *Box) Open() {\n run()\n}\nfunc main() {\n}\n'
    c = '#include "a.h"\nstatic int add(int a) {\n  return twice(a);\n}\n'
    py = "from .core import load\nclass Ring:\n    async def open(self):\n        self.go()\nif __name__ == '__main__':\n    pass\n"
    rows = [("a.ts", ts, "typescript"), ("m.go", go, "go"), ("a.c", c, "c"), ("a.py", py, "python"), ("bad.py", "def f(:\n", "python"), ("n.py", None, "python")]
    got = extract.extract(spark.createDataFrame(rows, "path string, content string, language string")).collect()
    have = {(r.file, r.what, r.name) for r in got}
    assert {("a.ts", "import", "./a"), ("a.ts", "import", "./x"), ("a.ts", "import", "y"), ("a.ts", "function", "load"), ("a.ts", "test-suite", "suite"), ("a.ts", "structure", "Shape"),
            ("m.go", "import", "fmt"), ("m.go", "function", "Box.Open"), ("m.go", "startup", "main"), ("m.go", "structure", "Box"), ("a.c", "import", "a.h"), ("a.c", "function", "add"),
            ("a.py", "function", "Ring.open"), ("a.py", "startup", "__main__"), ("a.py", "structure", "Ring"), ("bad.py", "function", "f")} <= have
    by = {(r.file, r.what, r.name): r for r in got}
    assert by["a.ts", "function", "load"].calls == ["fetchAll"] and by["a.ts", "function", "load"].kind == "async" and by["a.ts", "import", "./a"].is_type_only
    assert by["a.c", "function", "add"].is_exported is False and by["a.py", "function", "Ring.open"].analysis_confidence == "high" and by["m.go", "function", "Box.Open"].calls == ["run"]
    df = extract.extract(spark.createDataFrame([("b.ts", "export * from './x';\n", "typescript"), ("a.ts", ts, "typescript")], "path string, content string, language string"))
    assert [r.file for r in extract.barrels(df).collect()] == ["b.ts"] and {r.id for r in extract.functions_of(df).collect()} == {"a.ts::load", "a.ts::describe(suite)"}


def test_listing_and_artifacts(spark, tmp_path):
    root = tmp_path / "in"
    (root / "src").mkdir(parents=True)
    (root / "src" / "a.ts").write_text("x")
    (root / "b.md").write_text("yy")
    got = {r.path: r.size_bytes for r in listing.file_listing(spark, str(root)).collect()}
    assert got == {"src/a.ts": 1, "b.md": 2}
    assert [tuple(r) for r in listing.file_contents(spark, str(root), spark.createDataFrame([("src/a.ts",)], "path string")).collect()] == [("src/a.ts", "x")]
    out = str(tmp_path / "out")
    row = lambda sha, t: spark.createDataFrame([("r", sha, t, 1)], "repo_id string, commit_sha string, analyzed_at long, v int")
    listing.write_artifact(row("s1", 1), out)
    listing.write_artifact(row("s2", 2), out)
    assert listing.read_artifact(spark, out, "r").first().commit_sha == "s2" and listing.read_artifact(spark, out, "r", "s1").count() == 1
    assert len(listing.delete_partition(spark, out, "r", "s1")) == 1 and listing.read_artifact(spark, out, "r", "s1").count() == 1
    listing.delete_partition(spark, out, "r", "s1", dry_run=False)
    assert spark.read.parquet(out).count() == 1
    metadata = {(r.what, r.name): r.paths for r in C.repository_metadata(spark.createDataFrame([("Dockerfile",), ("backend/x.ts",), (".github/workflows/a.yml",)], "path string")).collect()}
    assert metadata == {("docker", "Dockerfile"): ["Dockerfile"], ("zone", "backend"): ["backend"], ("ci", "github-actions"): [".github/workflows"]}


@pytest.mark.parametrize("path, language, exported, declared, kind, mark", [
    ("a/unittests/x.py", "python", True, False, "test", None),
    ("setup.py", "python", False, False, "config", "private"),
    ("x_tests.cpp", "cpp", False, False, "test", "static"),
    ("inc/x.h", "c", True, True, "declaration", "decl"),
    ("x_test.go", "go", True, False, "test", "exported"),
    ("x.rs", "rust", True, False, "source", "exp"),
])
def test_kinds_and_marks_by_language(spark, path, language, exported, declared, kind, mark):
    got = one(spark, lambda p, g, e, d: F.struct(C.file_kind_other(p, g).alias("kind"), C.function_marker(g, d, e).alias("mark")), path, language, exported, declared)
    assert (got.kind, got.mark) == (kind, mark)


def test_long_functions_are_extracted_whole(spark):
    lines = ["func Long() {", *["\tx := 1"] * 5000, "}"]
    got = extract.extract(spark.createDataFrame([("a.go", "package a\n\n" + "\n".join(lines) + "\n", "go")], "path string, content string, language string")).collect()
    assert "Long" in {r.name for r in got if r.kind == "function"}
