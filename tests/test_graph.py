import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkstrata.operators import cluster, deadcode, evaluate, graph, index, rank, resolve, search
from sparkstrata.sources import extract
from sparkstrata.streaming import counters

FILES = ["src/server.ts", "src/db/connection.ts", "src/db/schema.ts", "src/routes/user.ts", "src/tests/user.test.ts"]
EDGES = [(0, 1), (0, 3), (1, 2), (3, 1), (4, 3)]


def edges_of(spark, pairs):
    return spark.createDataFrame([(FILES[a], FILES[b]) for a, b in pairs], "source string, target string")


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame([(f,) for f in FILES], "id string")


def test_hand_worked_scores(spark, nodes):
    e = edges_of(spark, EDGES)
    got = {r.id: (r.in_degree, r.out_degree, r.hub_score) for r in graph.hub_scores(nodes, e).collect()}
    assert got == {FILES[0]: (0, 2, 40.0), FILES[1]: (2, 1, 100.0), FILES[2]: (1, 0, 40.0), FILES[3]: (2, 1, 100.0), FILES[4]: (0, 1, 20.0)}
    cyclic = edges_of(spark, [*EDGES, (2, 1)])
    circ = graph.circular_edges(cyclic)
    got = {r.id: (r.hub_score, r.cycle_score, r.importance) for r in graph.cycle_scores(nodes, circ, graph.hub_scores(nodes, cyclic)).collect()}
    assert got[FILES[1]] == (140.0, 2, 100.0) and got[FILES[2]] == (60.0, 2, 70.0) and got[FILES[3]] == (100.0, 0, 100.0)
    assert circ.where("is_circular").count() == 2


def plain_components(pairs):
    reach = {}
    nodes = {x for p in pairs for x in p}
    for s in nodes:
        seen, todo = set(), [s]
        while todo:
            x = todo.pop()
            for a, b in pairs:
                if a == x and b not in seen:
                    seen.add(b)
                    todo.append(b)
        reach[s] = seen
    out = {}
    for s in nodes:
        own = {t for t in reach[s] if s in reach[t]} | {s}
        if len(own) > 1:
            out[s] = min(own)
    return out


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8)), max_size=16))
def test_strong_components_equal_closure(spark, pairs):
    df = spark.createDataFrame(pairs, "source long, target long")
    assert {r.id: r.component for r in graph.strong_components(df).collect()} == plain_components(pairs)


def test_dead_code_of_the_mock(spark):
    f = spark.createDataFrame(
        [(FILES[0], "source", "typescript", 50, False, 40.0, False), (FILES[4], "test", "typescript", 50, False, 20.0, False), ("a/lib/x.ts", "source", "typescript", 5, False, 0.0, False), ("a/x.c", "source", "c", 50, False, 0.0, False), ("a/x.h", "declaration", "c", 9, False, 0.0, False)],
        "id string, kind string, language string, line_count int, is_entry_point boolean, importance double, has_startup boolean",
    )
    e = edges_of(spark, EDGES).unionByName(spark.createDataFrame([("a/x.c", "a/x.h"), ("b.c", "a/x.h")], "source string, target string")).withColumn("symbols", F.array(F.lit("a")))
    none = spark.createDataFrame([], "file string, name string, is_exported boolean")
    got = {r.id: r.dead_code_score for r in deadcode.dead_code(f, e, none).collect()}
    assert got == {FILES[0]: 50, FILES[4]: 0, "a/lib/x.ts": 0, "a/x.c": 0, "a/x.h": 0}


ENTRIES = [
    ("src/auth/authService.ts", "file", "authService.ts", "src auth authservice ts service typescript source", 15, 80.0, False),
    ("src/auth/authService.ts::login", "export", "login", "login src auth authservice ts function", 5, None, None),
    ("src/store/userReducer.ts", "file", "userReducer.ts", "src store userreducer ts reducer state typescript source", 10, 50.0, False),
    ("src/api/routes/loginRoute.ts", "file", "loginRoute.ts", "src api routes loginroute ts route typescript source", 2, 20.0, True),
    ("src/middleware/authMiddleware.ts", "file", "authMiddleware.ts", "src middleware authmiddleware ts middleware typescript source auth", 20, 90.0, False),
]


@pytest.fixture(scope="module")
def entries(spark):
    rows = [(i, t, n, i.split("::")[0], None, None, tok.split(), u, h, e, False) for i, t, n, tok, u, h, e in ENTRIES]
    return spark.createDataFrame(rows, "id string, type string, name string, file string, kind string, package string, tokens array<string>, usage_count long, hub_score double, is_entry_point boolean, is_dead_code boolean")


@pytest.mark.parametrize("query, best", [
    ("Users cannot login, the auth service is throwing an error", "src/auth/authService.ts"),
    ("Fix user state bug in the userReducer", "src/store/userReducer.ts"),
    ("The /api/routes/loginRoute is returning 500", "src/api/routes/loginRoute.ts"),
    ("Auth middleware is blocking requests", "src/middleware/authMiddleware.ts"),
])
def test_issue_cases(spark, entries, query, best):
    q = spark.createDataFrame([(query,)], "query string")
    assert search.map_issue(entries, q, 5).orderBy("rank").first().file == best


def test_search_ignores_row_order(spark, entries):
    q = spark.createDataFrame([("login",), ("athService",)], "query string")
    a = sorted(map(tuple, search.search(entries, q).collect()))
    assert a and a == sorted(map(tuple, search.search(entries.orderBy(F.rand(3)).repartition(5), q).collect()))


def test_retrieval_and_categories(spark):
    f = spark.createDataFrame([(x, False) for x in FILES], "id string, is_barrel boolean")
    e = edges_of(spark, EDGES).withColumn("kind", F.lit("static"))
    fn = spark.createDataFrame([("src/routes/user.ts", "getUser")], "file string, name string")
    s = spark.createDataFrame([("src/db/schema.ts", "UserTable")], "file string, name string")
    idx = index.retrieval_index(f, e, fn, s)
    rows = {r.id: r for r in idx.collect()}
    assert rows[FILES[4]].semantic_role == "test" and rows[FILES[1]].imported_by == [FILES[3], FILES[0]] and not rows[FILES[1]].is_barrel
    got = {r.id: (r.score, r.category) for r in rank.expand_categories(f.where(F.col("id") == FILES[3]), idx, ["usages", "tests", "schemas"]).collect()}
    assert got[FILES[4]] == (85.0, "tests") and got[FILES[0]][1] == "usages" and got[FILES[1]][1] == "schemas"


def test_bm25_equals_a_plain_loop(spark):
    import math
    from collections import Counter

    r = random.Random(1)
    docs = {k: [r.choice("abcdefgh") for _ in range(r.randint(1, 12))] for k in range(25)}
    terms = spark.createDataFrame([(k, t) for k, d in docs.items() for t in d], "id long, term string")
    wanted = spark.createDataFrame([(1, "a", 3.0), (1, "b", 1.0), (2, "zz", 1.0), (2, "c", 1.0)], "query long, term string, weight double")
    got = {(x.query, x.id): x.bm25 for x in rank.bm25(terms, wanted).collect()}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(t for d in docs.values() for t in set(d))
    want = {}
    for q, t, w in ((1, "a", 3.0), (1, "b", 1.0), (2, "c", 1.0)):
        for k, d in docs.items():
            if tf := d.count(t):
                want[q, k] = want.get((q, k), 0) + w * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / avg))
    assert got == pytest.approx(want)


def test_merging_keeps_files_and_bounds():
    r = random.Random(2)
    names = [f"src/{a}/{b}" for a in "abcd" for b in "wxyz"] + ["", "lib"]
    sizes = {n: r.randint(1, 9) for n in names}
    links = {(a, b): r.randint(1, 5) for a in names for b in names if a < b and r.random() < 0.3}
    out = cluster.merge_greedily(sizes, links, 5, 40)
    assert set(out) == set(names) and len(set(out.values())) == 5
    assert cluster.merge_greedily(sizes, links, 30, 40).keys() == sizes.keys()


def test_walk_and_focus(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5)], "source long, target long")
    start = spark.createDataFrame([(1,)], "id long")
    assert {r.id: r.hop for r in graph.walk(e, start, 2).collect()} == {1: 0, 2: 1, 3: 2}
    assert {r.id: r.is_cyclic for r in graph.focus(e, start, 10).collect()} == {2: True, 3: True, 4: False, 5: False}
    assert {(r.source, r.target) for r in graph.back_edges(e.withColumn("g", F.lit("x")), "g").collect()} == {(3, 1)}


def test_traversal_seeds(spark):
    names = ["src/ring.ts", "docs/ring_guide.md", "src/index.ts", "src/gear.ts", "lib/other.ts", "src/call.ts", "dist/ring.ts"]
    files = spark.createDataFrame([(n, ["ring"] if "ring" in n or n == "src/index.ts" else ["x"], []) for n in names], "id string, function_names array<string>, structure_names array<string>")
    intents = spark.createDataFrame([(1, ["ring"], [], [], ["docs/ring_guide.md"])], "query long, strong_identifiers array<string>, weak_terms array<string>, entities array<string>, exact_paths array<string>")
    edges = spark.createDataFrame([("src/ring.ts", "src/gear.ts")], "source string, target string")
    calls = spark.createDataFrame([("src/ring.ts", "src/call.ts::go"), ("src/ring.ts", "gone.ts::x")], "file string, call string")
    barrels = spark.createDataFrame([("src/index.ts", "lib/other.ts")], "id string, target string")
    pulled = spark.createDataFrame([(1, "lib/other.ts"), (1, "no/such.ts")], "query long, id string")
    got = {r.id: (r.source, r.score) for r in rank.traverse(files, intents, rank.graph_neighbours(edges, calls), barrels, pulled).collect()}
    assert got["docs/ring_guide.md"] == ("keyword", 135.0)  # named by the issue, though no ranked file
    assert got["src/ring.ts"] == ("keyword", 130.0) and got["lib/other.ts"] == ("pr", 140.0)
    assert got["src/gear.ts"] == ("neighborhood", 78.0) and got["src/call.ts"] == ("neighborhood", 78.0)
    assert set(got) == {"docs/ring_guide.md", "src/ring.ts", "lib/other.ts", "src/gear.ts", "src/call.ts"}
    weak = spark.createDataFrame([(1, "src/ring.ts", 24.9), (2, "src/ring.ts", 25.0)], "query long, id string, score double")
    out = {(r.query, r.id): r.score for r in rank.expand(weak, rank.both_ways(edges), files).collect()}
    assert out == {(1, "src/ring.ts"): 24.9, (2, "src/ring.ts"): 25.0, (2, "src/gear.ts"): 15.0}


@pytest.mark.parametrize("task_edges", [3, 1 << 20])
def test_strong_components_by_both_ways(spark, task_edges):
    r = random.Random(task_edges)
    edges = {(r.randrange(25), r.randrange(25)) for _ in range(38)} | {(40, 41), (41, 42), (42, 40), (50, 51)}
    reach = {(a, b) for a, b in edges}
    while True:
        more = {(a, d) for a, b in reach for c, d in edges if b == c} - reach
        if not more:
            break
        reach |= more
    nodes = {x for e in edges for x in e}
    want = {a: min(b for b in nodes if b == a or ((a, b) in reach and (b, a) in reach)) for a in nodes if any(b != a and (a, b) in reach and (b, a) in reach for b in nodes)}
    df = spark.createDataFrame(sorted(edges), "source long, target long")
    assert {x.id: x.component for x in graph.strong_components(df, task_edges).collect()} == want
    assert graph.strong_components(df.limit(0), task_edges).count() == 0


def test_requested_paths_by_tiers(spark):
    paths = ["src/a/File.ts", "src/b/file.ts", "src/b/Only.go", "lib/xonly.go", "x/yring.ts", "x/zring.ts"]
    asked = ["src/b/file.ts", "./src/a/File.ts", "only.go", "A\\FILE.TS", "file.ts", "ring.ts", "nope.ts", "", " Only.go "]
    got = {r.requested: r.path for r in resolve.requested_paths(spark.createDataFrame([(x,) for x in asked], "requested string"), spark.createDataFrame([(x,) for x in paths], "path string")).collect()}
    assert got == {"src/b/file.ts": "src/b/file.ts", "./src/a/File.ts": "src/a/File.ts", "only.go": "src/b/Only.go", "A\\FILE.TS": "src/a/File.ts", "file.ts": "src/a/File.ts", "ring.ts": "x/yring.ts", " Only.go ": "src/b/Only.go"}


def test_truth_of_pulls(spark):
    rows = [
        (1, True, "closed", ["./a\\b.ts", "c.ts", None]), (1, False, "closed", ["other.ts"]), (1, True, "closed", ["c.ts"]),
        (2, None, "closed", ["d.ts"]), (2, False, "open", ["e.ts"]), (3, False, "open", ["f.ts"]), (4, True, "closed", None), (4, False, "closed", ["g.ts"]),
    ]
    pulls = spark.createDataFrame(rows, "query long, is_merged boolean, state string, changed_files array<string>")
    assert sorted(evaluate.truth_of_pulls(pulls).collect()) == [(1, "a/b.ts"), (1, "c.ts"), (2, "d.ts")]
    assert evaluate.truth_of_pulls(pulls.limit(0)).count() == 0


def test_modules_and_representatives_in_order(spark):
    m = spark.createDataFrame([("b", 2.0), ("a", 2.0), ("c", None), ("d", 3.0)], "module_id string, importance double")
    assert [r.module_id for r in cluster.by_importance(m).orderBy("nth").collect()] == ["d", "a", "b", "c"]
    files = spark.createDataFrame([("m", f"f{k}", k) for k in range(40)], "module_id string, id string, ord long")
    stands = spark.createDataFrame([("m", "f39"), ("m", "f5"), ("m", "f5"), ("n", "f1")], "module_id string, id string")
    got = cluster.representatives_first(files, stands).orderBy("nth").collect()
    assert [r.id for r in got] == ["f5", "f39", *[f"f{k}" for k in range(29) if k != 5]]
    assert [r.is_representative for r in got[:3]] == [True, True, False]
    assert cluster.representatives_first(files, stands, None).count() == 40


def test_infrastructure_shows_key_files(spark):
    rows = [("module_infra", x, 1.0) for x in ("readme.md", "Dockerfile", "package.json", "tsconfig.json", "next.config.js", "x.md")] + [("module_1", x, float(k)) for k, x in enumerate(("a", "b", "c"))]
    files = spark.createDataFrame(rows, "module_id string, id string, importance double")
    shown = lambda p: sorted(r.id for r in cluster.representatives(files, spark.createDataFrame(p, "module_id string, id string")).collect())
    assert shown([("module_1", "a"), ("module_1", "zz")]) == ["Dockerfile", "a", "next.config.js", "package.json", "readme.md"]
    assert shown([("module_1", "zz")])[1:3] == ["b", "c"]


def test_titles_of_tests(spark):
    text = "fdescribe('s', () => {\n  xit(\"c\", f)\n  test('t', f)\n  foo.it('no', f)\n  it(`no`, f)\n  exit('no')\n})\n"
    rows = extract.extract(spark.createDataFrame([("a.test.ts", text, "typescript")], "path string, content string, language string")).where("what like 'test-%'")
    got = [(r.what, r.name, r.start_line) for r in rows.orderBy("ord").collect()]
    assert got == [("test-suite", "s", 1), ("test-case", "c", 2), ("test-case", "t", 3)]


def test_streams_keep_their_batches(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 01:00:00"), ("a", "2024-01-01 02:00:00"), ("b", "2024-01-02 01:00:00")], "k string, ts string").selectExpr("k", "cast(ts as timestamp) as ts")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    daily = counters.windowed_usage(stream(), "ts", ["k"])
    assert sorted((r.k, r.n) for r in counters.run_available(daily).collect()) == [("a", 2), ("b", 1)]
    assert sorted(r.k for r in counters.run_available(stream().select("k"), mode="append").collect()) == ["a", "a", "b"]
    with pytest.raises(ValueError):
        counters.run_available(daily, mode="update")


def test_strong_components_of_long_paths(spark):
    """Chains, rings and dead ends are put together in few rounds, whatever the order of ids."""
    r = random.Random(4)
    ids = list(range(30000))
    r.shuffle(ids)
    chain = [(ids[k], ids[k + 1]) for k in range(10000)]
    ring = [(ids[k], ids[k + 1]) for k in range(15000, 17000)] + [(ids[17000], ids[15000])]
    tail = [(ids[16000], ids[20000]), *[(ids[k], ids[k + 1]) for k in range(20000, 20500)]]
    want = {ids[k]: min(ids[9000:10001]) for k in range(9000, 10001)} | {ids[k]: min(ids[15000:17001]) for k in range(15000, 17001)}
    spark.sparkContext.setJobGroup("paths", "paths")
    df = spark.createDataFrame(chain + [(ids[10000], ids[9000])] + ring + tail, "source long, target long")
    assert {x.id: x.component for x in graph.strong_components(df, 100).collect()} == want
    # with adaptive execution each exchange is a job of its own
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("paths")) < 120
    alone = spark.createDataFrame(chain, "source long, target long")
    spark.sparkContext.setJobGroup("chain", "chain")
    assert graph.strong_components(alone, 100).count() == 0
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain")) < 50
    spark.sparkContext.setJobGroup("other", "other")


@pytest.mark.parametrize("seed", range(4))
def test_strong_components_with_few_edges_a_task(spark, seed):
    r = random.Random(seed)
    n = r.choice([6, 15, 40])
    pairs = [(r.randrange(n), r.randrange(n)) for _ in range(int(n * r.choice([0.7, 1.2, 2])))]
    pairs += [(a, a + 1) for a in range(100, 120)] + [(120, r.choice([100, 110, 0])), (r.randrange(n), 105)] + [(a, a + 1) for a in range(200, 206)] + [(206, 200)]
    df = spark.createDataFrame(pairs + pairs[:3], "source long, target long").withColumn("kind", F.lit("clash"))
    assert {x.id: x.component for x in graph.strong_components(df, 2).collect()} == plain_components(pairs)


def plain_merging(sizes, links, target, most):
    """The merging by a search of all pairs for each step."""
    groups = [[n, [n], sizes[n]] for n in sorted(sizes)]
    while len(groups) > target:
        def edges(x, y):
            return sum(n for (a, b), n in links.items() if a in x[1] and b in y[1] or a in y[1] and b in x[1])

        pairs = [(-edges(x, y) / (x[2] + y[2]), i, j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j and x[2] + y[2] <= most and edges(x, y)]
        if pairs:
            _, i, j = min(pairs)
        else:
            i = min(range(len(groups)), key=lambda k: (groups[k][2], k))
            near = [k for k in range(len(groups)) if k != i and edges(groups[i], groups[k])] or [k for k in range(len(groups)) if k != i]
            i, j = sorted((i, min(near, key=lambda k: (groups[k][2], k))))
        x, y = groups[i], groups.pop(j)
        prefix = cluster._common(x[0], y[0])
        x[0] = prefix if prefix.count("/") else x[0] if x[2] >= y[2] else y[0]
        x[1], x[2] = x[1] + y[1], x[2] + y[2]
    return {m: f"{k:03d}:{name or 'Root/Core'}" for k, (name, members, _) in enumerate(groups) for m in members}


@pytest.mark.parametrize("seed", range(12))
def test_merging_equals_a_search_of_all_pairs(seed):
    r = random.Random(seed)
    names = [f"src/{a}/{b}" for a in "abc" for b in "wxyz"] + ["", "lib", "src"]
    sizes = {n: r.randint(1, 20) for n in names}
    links = {(a, b): r.randint(1, 4) for a in names for b in names if a < b and r.random() < r.choice([0.05, 0.3, 0.7])}
    target, most = r.choice([1, 3, 6]), r.choice([15, 40, 500])
    assert cluster.merge_greedily(sizes, links, target, most) == plain_merging(sizes, links, target, most)


def test_modules_of_many_repositories(spark):
    r = random.Random(7)
    files, edges = [], []
    for repo in ("one", "two", "three"):
        own = [f"src/{r.choice('abcdefghij')}/{r.choice('klmnopqrst')}/f{k}.ts" for k in range(60)] + (["package.json"] if repo == "two" else [])
        files += [(repo, f, "config" if f.endswith("json") else "source") for f in own]
        edges += [(repo, r.choice(own), r.choice(own)) for _ in range(150)]
    f = spark.createDataFrame(files, "repo string, id string, kind string")
    e = spark.createDataFrame(edges, "repo string, source string, target string")
    together = {tuple(x) for x in cluster.modules(f, e, ["repo"]).select("repo", "id", "module_id", "name").collect()}
    alone = set()
    for repo in ("one", "two", "three"):
        own = cluster.modules(f.where(F.col("repo") == repo).drop("repo"), e.where(F.col("repo") == repo).drop("repo"))
        alone |= {(repo, *x) for x in own.select("id", "module_id", "name").collect()}
    assert together == alone and len(together) == len(files)
    assert {x[2] for x in together if x[0] == "two"} >= {"module_infra", "module_13"} and "module_14" not in {x[2] for x in together if x[0] == "two"}
