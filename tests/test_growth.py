"""Joins whose both sides grow with the input are never broadcast by the size of compressed files, and rows that can't decide are not made."""

from sparkstrata.operators import deadcode, graph, rank, resolve, workspaces
from sparkstrata.plans import views
from sparkstrata.plans.queries import QUERIES


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_entries_after_an_explicit_one_are_not_tried(spark, monkeypatch):
    written = {}

    def keep(df, name="graph"):
        written[name] = graph.cut_lineage(df, name)
        return written[name]

    monkeypatch.setattr(workspaces, "cut_lineage", keep)
    many = [f"top{i}/a.ts" for i in range(30)]
    paths = spark.createDataFrame([(p,) for p in ["src/a.ts", "src/d/index.ts", "src/d", *many]], "path string")
    configs = spark.createDataFrame([("tsconfig.json", '{"compilerOptions": {"paths": {"@b/*": ["src/*"]}}}')], "path string, content string")
    imports = spark.createDataFrame([("@b/a",), ("@b/none",), ("@b/d",), ("@/a",)], "specifier string")
    got = {r.specifier: (r.kind, r.path) for r in workspaces.resolve_aliases(imports, workspaces.alias_entries(paths, configs), paths).collect()}
    assert got == {"@b/a": ("internal", "src/a.ts"), "@b/none": ("unresolved", None), "@b/d": ("internal", "src/d"), "@/a": ("internal", "src/a.ts")}
    assert written["aliases"].where("specifier like '@b/%'").count() == 3


def test_requested_paths_and_prefixes_broadcast_no_files(spark, tmp_path):
    spark.createDataFrame([(f"src/a{i}.ts",) for i in range(50)], "path string").write.parquet(str(tmp_path / "p"))
    p = spark.read.parquet(str(tmp_path / "p"))
    asked = resolve.requested_paths(p.selectExpr("upper(path) as requested"), p)
    assert "BroadcastHashJoin" not in plan_of(asked)
    assert {r.path for r in asked.collect()} == {f"src/a{i}.ts" for i in range(50)}


def test_issue_paths_are_broadcast_and_not_the_names_of_files(spark, tmp_path):
    spark.createDataFrame([(f"src/a{i}.ts",) for i in range(50)], "id string").write.parquet(str(tmp_path / "p"))
    intents = spark.createDataFrame([(1, ["a1.ts"])], "query long, exact_paths array<string>")
    got = rank.exact_matches(spark.read.parquet(str(tmp_path / "p")), intents)
    assert {r.id for r in got.collect()} == {"src/a1.ts"}
    assert "BuildRight" in plan_of(got) and "BuildLeft" not in plan_of(got)


def test_views_of_files_are_dealt_out_and_merged(spark):
    d = "/root/testdata/sf0.001"
    assert "hashpartitioning(p_partkey" in plan_of(views.files(spark, d)) and "REPARTITION_BY_NUM" in plan_of(views.files(spark, d))
    assert "BroadcastHashJoin" not in plan_of(views.file_edges(spark, d))


def test_call_edges_by_file_and_callers_by_counts(spark, tmp_path):
    f = [("a.ts::x", "x", "a.ts", 1), ("a.ts::y", "y", "a.ts", 2), ("b.ts::x", "x", "b.ts", 3), ("dup", "z", "a.ts", 4), ("dup", "z", "c.ts", 5)]
    spark.createDataFrame(f, "id string, name string, file string, ord long").write.parquet(str(tmp_path / "f"))
    functions = spark.read.parquet(str(tmp_path / "f"))
    edges = spark.createDataFrame([("a.ts::x", "a.ts::y"), ("a.ts::x", "b.ts::x"), ("dup", "a.ts::y"), ("dup", "none"), ("gone", "none"), ("a.ts::x", "a.ts::y")], "source string, target string")
    got = [tuple(r) for r in graph.edges_of_file(edges, functions).collect()]
    want = {("a.ts", "a.ts::x", "a.ts::y"), ("a.ts", "a.ts::x", "b.ts::x"), ("b.ts", "a.ts::x", "b.ts::x"), ("a.ts", "dup", "a.ts::y"), ("c.ts", "dup", "a.ts::y"), ("a.ts", "dup", "none"), ("c.ts", "dup", "none")}
    assert len(got) == len(want) and set(got) == want
    counts = {r.id: (r.n_callers, r.first_caller) for r in graph.caller_counts(functions.where("ord < 4"), edges).collect()}
    assert counts == {"a.ts::x": (0, None), "a.ts::y": (2, "a.ts::x"), "b.ts::x": (1, "a.ts::x")}
    calls = spark.createDataFrame([("a.ts::y", "x"), ("b.ts::x", "x"), ("b.ts::x", "y")], "caller string, raw string")
    resolved = graph.resolve_calls(calls, functions)
    assert {tuple(r) for r in resolved.collect()} == {("a.ts::y", "a.ts::x"), ("b.ts::x", "a.ts::y")}
    assert plan_of(resolved).count("SortMergeJoin") >= 2


def test_unused_exports_merge(spark, tmp_path):
    spark.createDataFrame([("a", "x", True), ("a", "y", True), ("b", "x", True)], "file string, name string, is_exported boolean").write.parquet(str(tmp_path / "f"))
    spark.createDataFrame([("b", "a", ["x"]), ("c", "b", ["*"])], "source string, target string, symbols array<string>").write.parquet(str(tmp_path / "e"))
    got = deadcode.unused_exports(spark.read.parquet(str(tmp_path / "f")), spark.read.parquet(str(tmp_path / "e")))
    assert [tuple(r) for r in got.collect()] == [("a", "y")] and "BroadcastHashJoin" not in plan_of(got)


def test_tasks_of_call_resolution_grow_in_number_with_the_input(spark, monkeypatch):
    """lineitem at scale 0.001 has 6,000 rows: 12 tasks of 500 for each step on edges and calls, where shuffles have 4."""
    monkeypatch.setattr(graph, "TASK_ROWS", 500)
    d = "/root/testdata/sf0.001"
    n = -(-views.n_items(spark, d) // 500)
    assert n > 4
    for name in ("call_resolution", "orphan_symbols"):
        df = QUERIES[name](spark, d)
        edges = [x for x in plan_of(df).split("\n") if "REPARTITION_BY_NUM" in x and "p_partkey" not in x]
        assert len(edges) > 8 and all(f", {n}), REPARTITION_BY_NUM" in x for x in edges), edges
        got = sorted(map(tuple, df.collect()))
        with monkeypatch.context() as m:
            m.setattr(graph, "TASK_ROWS", 200_000)
            assert got == sorted(map(tuple, QUERIES[name](spark, d).collect())) and got
