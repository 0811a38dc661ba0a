"""Numbers for files and functions, which leave far less to shuffles and disks than paths: the retrieval index, what is expanded from it, and the callers of functions."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sparkstrata.operators import graph, index, rank
from sparkstrata.plans import views
from sparkstrata.plans.queries import QUERIES

PATHS = ["src/a.ts", "src/b.ts", "src/config.json", "src/b.test.ts", "dist/x.ts", "src/c.ts"]
EDGES = [(1, 2, "static"), (2, 3, "re-export"), (2, 1, "static"), (4, 2, "static"), (5, 2, "static"), (6, 3, "re-export"), (2, 9, "static"), (9, 2, "static")]
CALLS = [(6, 2), (2, 6), (2, 2), (5, 2), (3, 1)]


@pytest.mark.parametrize("categories", [["callers", "schemas", "tests"], ["none"], ["Configuration ", "callees", "exports"]])
@pytest.mark.parametrize("seeds", [[2, 4], []])
def test_numbers_give_what_paths_give(spark, categories, seeds):
    name = lambda k: PATHS[k - 1] if k <= len(PATHS) else f"gone{k}"
    got = []
    for of, kind in ((lambda k: k, "long"), (name, "string")):
        numbers = kind == "long"
        f = spark.createDataFrame([(of(k), name(k), False) for k in range(1, 7)], f"id {kind}, path string, is_barrel boolean")
        e = spark.createDataFrame([(of(s), of(t), k) for s, t, k in EDGES], f"source {kind}, target {kind}, kind string")
        fn = spark.createDataFrame([(of(k),) for k in (1, 2, 4, 5)], f"file {kind}")
        idx = index.retrieval_index(f if numbers else f.drop("path"), e, fn, fn.limit(0))
        rows = {r.path if numbers else r.id: ([name(x) if numbers else x for x in r.imports], [name(x) if numbers else x for x in r.imported_by], r.is_barrel, r.semantic_role, r.n_functions) for r in idx.collect()}
        rows = {k: (sorted(v[0]), sorted(v[1]), *v[2:]) for k, v in rows.items()}
        assert rows["src/b.ts"][:3] == (["gone9", "src/a.ts", "src/config.json"], ["dist/x.ts", "gone9", "src/a.ts", "src/b.test.ts"], False) and rows["src/c.ts"][2]
        calls = spark.createDataFrame([(of(s), of(t)) for s, t in CALLS], f"file {kind}, to {kind}")
        if not numbers:
            calls = calls.select("file", F.concat("to", F.lit("::f")).alias("call"))
        start = spark.createDataFrame([(of(k),) for k in seeds], f"id {kind}")
        got.append((rows, sorted(map(tuple, rank.expand_categories(start, idx, categories, calls).collect()))))
    assert got[0] == got[1]


def shuffled(spark) -> int:
    """Bytes that all finished stages wrote to shuffles."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty()
    jvm, none = context._jvm, context._gateway.new_array(context._jvm.double, 0)
    stages = context._jsc.sc().statusStore().stageList(None, False, False, none, jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_category_expansion_shuffles_an_edge_few_times(spark):
    d = "/root/testdata/sf0.01"
    before = shuffled(spark)
    assert QUERIES["category_expansion"](spark, d).count() > 0
    assert shuffled(spark) - before < 100 * views.n_items(spark, d)  # bytes for a row of lineitem


@pytest.mark.parametrize("extra, numbers", [([], True), ([(3, "cold nut")], False), ([(None, "old ring")], False)])
def test_files_have_numbers_only_where_these_tell_them_apart(spark, tmp_path, extra, numbers):
    parts = [(k, n, "Brand#1", "SMALL", k, 1.0) for k, n in [(1, "hot ring"), (2, "big bolt"), (3, "old nut"), (4, "red cog"), *extra]]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    # order 1 goes 1 2 3 1, order 2 by a part that is none, order 3 repeats a pair
    items = [(1, 1, 1), (1, 2, 2), (1, 3, 3), (1, 1, 4), (2, 4, 1), (2, 8, 2), (2, 1, 3), (3, 1, 1), (3, 2, 2)]
    spark.createDataFrame([(o, p, 1, n) for o, p, n in items], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    f, e = views.keyed_files(spark, str(tmp_path))
    assert (f.schema["id"].dataType.simpleString() == "bigint") == numbers
    path = {r.id: r.path for r in f.collect()}
    want = {tuple(r) for r in views.file_edges(spark, str(tmp_path)).collect()}
    got = [(path[r.source], path[r.target]) for r in e.collect()]
    assert len(got) == len(want) and set(got) == want and len(want) == (3 if not extra or extra[0][0] is None else 5)
    # by paths, from the views that other queries use
    own, fn = views.files(spark, str(tmp_path)), views.functions(spark, str(tmp_path))
    by_path = views.file_edges(spark, str(tmp_path))
    kinds = by_path.withColumn("kind", F.when(F.crc32("source") % 2 == 0, "re-export").otherwise("static"))
    idx = index.retrieval_index(own.select("id", F.lit(False).alias("is_barrel")), kinds, fn.where("kind = 'function'"), fn.where("kind = 'test'"))
    calls = by_path.join(fn.select(F.col("file").alias("target"), F.col("id").alias("call")), "target").select(F.col("source").alias("file"), "call")
    expanded = rank.expand_categories(own.where("label like '%Ring%'").select("id"), idx, ["callers", "schemas", "tests"], calls)
    assert sorted(map(tuple, QUERIES["category_expansion"](spark, str(tmp_path)).collect())) == sorted(map(tuple, expanded.collect()))
    counts = lambda df: sorted((r.id, r.is_barrel, r.semantic_role, r.n_functions, r.n_structures, r.n_targets) for r in df.collect())
    assert counts(QUERIES["retrieval_index"](spark, str(tmp_path))) == counts(idx.withColumn("n_targets", F.size("barrel_targets")))


@pytest.mark.parametrize("numbers", [False, True])
def test_all_callers_are_given_in_the_order_of_functions(spark, numbers):
    at = {"z": 1, "y": 2, "x": 3, "a": 4, "gone": 9}
    of = at.get if numbers else str
    kind = "long" if numbers else "string"
    functions = spark.createDataFrame([(of(k), at[k], f"l{k}") for k in ("a", "x", "y", "z", "z")], f"id {kind}, ord long, label string")
    pairs = [("a", "x"), ("z", "x"), ("y", "x"), ("a", "x"), ("x", "a"), ("gone", "a"), ("x", "gone"), ("y", "a")]
    edges = spark.createDataFrame([(of(s), of(t)) for s, t in pairs], f"source {kind}, target {kind}")
    got = graph.called_by(functions if numbers else functions.drop("label"), edges)
    assert got.columns == ["id", "n_callers", "nth", "caller"]
    name = lambda k: f"l{k}" if numbers else k
    want = [(name("x"), 3, n, name(c)) for n, c in ((1, "z"), (2, "y"), (3, "a"))] + [(name("a"), 3, 1, name("y")), (name("a"), 3, 2, name("x")), (name("a"), 3, 3, None if numbers else "gone")]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, [*want, (name("y"), 0, None, None), (name("z"), 0, None, None)]))


def test_called_by_gives_every_call_edge(spark):
    d = "/root/testdata/sf0.001"
    edges = {(r.source, r.target) for r in QUERIES["call_resolution"](spark, d).collect()}
    rows = QUERIES["called_by"](spark, d).collect()
    assert {(r.caller, r.id) for r in rows if r.caller} == edges and len(edges) > 100
    assert {r.id for r in rows} == {r.id for r in views.functions(spark, d).collect()}


@pytest.mark.parametrize("extra", [[], [(3, "cold nut")], [(1, "hot ring")], [(5, None)]])
def test_called_by_equals_sql_on_odd_parts(spark, tmp_path, extra):
    parts = [(k, n, "Brand#1", "SMALL", k, 1.0) for k, n in [(1, "hot ring"), (2, "big bolt"), (3, "hot ring"), (4, "big bolt"), *extra]]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    items = [(o, p, 1, n) for o, ps in enumerate([[1, 2, 3, 1], [4, 8, 1], [5, 1, 2, 5, 4, 3], [1, 2]]) for n, p in enumerate(ps)]
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()["called_by"])
    columns = [c[0] for c in want.description]
    got = QUERIES["called_by"](spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))
