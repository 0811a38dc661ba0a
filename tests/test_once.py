"""Work that is done once for each row, file or text, however often its result is used."""

from pyspark.sql import functions as F

from sparkstrata.functions import text as T
from sparkstrata.operators import rank
from sparkstrata.sources import extract


def test_search_intent_reads_a_text_once(spark):
    df = spark.createDataFrame([("Cannot open smallRing1.ts", "The `hotBolt` in src/core/a.go fails when loadSmallRing and smallRing run small small")], "title string, body string")
    got = df.select(T.search_intent(F.col("title"), F.col("body"), F.array(F.lit("x"))).alias("i")).select("i.*")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("regexp_extract_all(") <= 5  # one for each pattern, none for each word
    r = got.first()
    assert r.exact_paths == ["smallring1.ts", "src/core/a.go", "a.go"] and r.strong_identifiers == ["hotbolt", "smallring1", "loadsmallring", "smallring"]
    assert r.weak_terms == ["cannot", "open", "small", "ring1", "cannot", "open", "small", "ring1", "hot", "bolt", "src", "core", "fails", "load", "small", "ring", "small", "ring", "run", "small"]


def test_facts_are_numbered_before_rows_are_made(spark):
    text = "function a() { b(); c.d(1); }\napp.get('/x', e);\nit('works', () => f());\nimport('./y');\n"
    assert [x["name"] for x in extract.file_facts("a.js", text, "javascript") if x["what"] == "call"] == ["app.get", "it", "import"]
    rows = extract.extract(spark.createDataFrame([("a.js", text, "javascript")], "path string, content string, language string"))
    assert "namedlambdavariable()) IS NOT NULL" not in (plan := rows._jdf.queryExecution().optimizedPlan().toString()) and "lambdafunction(isnotnull(" not in plan
    got = {(r.what, r.name) for r in rows.collect()}
    assert got == {
        ("function", "a"), ("local", "a"), ("structure", "get(/x)"), ("routes", "register"), ("function", "it(works)"), ("structure", "it(works)"), ("test-case", "works"), ("import", "./y"), ("structure", "import(./y)"),
    }
    calls = {r.name: r.calls for r in rows.collect() if r.what == "function"}
    assert calls["a"] == ["b", "d"]


def test_terms_of_texts_are_read_once_and_counted_for_queries_alone(spark):
    df = spark.createDataFrame([("getURL2Path a_b x Kelvin AB A 9 42 aB1 éXy",)], "t string").select(T.ranker_tokens(F.col("t")).alias("r"))
    assert df.first().r == ["get", "url2", "path", "elvin", "ab", "42", "b1", "xy"]
    assert "regexp_replace" not in df._jdf.queryExecution().optimizedPlan().toString()
    texts = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b", "c"]), (2, ["a"]), (3, []), (4, None)], "id long, terms array<string>")
    wanted = spark.createDataFrame([("q", "a", 1.0), ("q", "c", 2.0), ("r", "b", 1.0)], "query string, term string, weight double")
    got = {(r.query, r.id): round(r.bm25, 9) for r in rank.bm25_of_texts(texts, wanted).collect()}
    plain = {(r.query, r.id): round(r.bm25, 9) for r in rank.bm25(texts.select("id", F.explode("terms").alias("term")), wanted).collect()}
    assert got == plain and set(got) == {("q", 1), ("q", 2), ("r", 1), ("r", 2)}
