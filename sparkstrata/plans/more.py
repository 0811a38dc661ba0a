"""Queries over the driver's tables for functions of files, texts, sessions and views, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkstrata.functions import classify as C
from sparkstrata.functions import text as T
from sparkstrata.operators import cluster, evaluate, graph, index, workspaces
from sparkstrata.plans.queries import query
from sparkstrata.plans.views import file_edges, files, functions, sql, supply, table
from sparkstrata.sources import listing
from sparkstrata.streaming import counters, stateful


def _sql_case(column: str, values: dict[str, str], other: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE {other} END"


EXT = "regexp_extract(lower(label), '(\\.[^.]*)$', 1)"


def _language(label="label"):
    ext = F.regexp_extract(F.lower(F.col(label)), r"(\.[^.]*)$", 1)
    return F.when(ext == ".py", "python").when(ext == ".go", "go").when(ext == ".cpp", "cpp").when(ext == ".h", "c").when(ext.isin(".ts", ".tsx"), "typescript").otherwise("other")


LANGUAGE = f"CASE {EXT} WHEN '.py' THEN 'python' WHEN '.go' THEN 'go' WHEN '.cpp' THEN 'cpp' WHEN '.h' THEN 'c' WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript' ELSE 'other' END"


@query("SELECT o_orderkey AS repo_id FROM orders WHERE o_orderpriority <> '1-URGENT' AND o_totalprice * 4 <= 512000")
def admissible_repositories(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("repo_id"), (F.col("o_orderpriority") == "1-URGENT").alias("is_private"), (F.col("o_totalprice") * 4).alias("size_kb"))
    return listing.admissible_repositories(o).select("repo_id")


@query("SELECT conv_id AS issue, turn AS comment_id FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n <= 3")
def issue_comments(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("issue"), F.col("turn").alias("created_at"), F.col("turn").alias("comment_id"))
    return listing.issue_comments(c, 3).select("issue", "comment_id")


@query("SELECT doc_id, quality FROM labels UNION ALL SELECT doc_id, -1 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def rows_with_fallback(spark, d):
    return listing.with_fallback(table(spark, d, "labels").select("doc_id", "quality"), table(spark, d, "documents").select("doc_id", F.lit(-1).alias("quality")), "doc_id")


@query("""SELECT session_id, CASE WHEN length(t) > 48 THEN substr(t, 1, 47) || '…' ELSE t END AS title FROM (SELECT conv_id AS session_id, max(turn) AS u,
    trim(regexp_replace(arg_min(text, turn) FILTER (role = 'user'), '\\s+', ' ', 'g')) AS t FROM conversations GROUP BY conv_id) ORDER BY u DESC, session_id LIMIT 50""")
def chat_sessions(spark, d):
    c = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("session_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"), F.max("turn").alias("updated_at"))
    return listing.chat_sessions(c).select("session_id", "title")


@query(sql("files", f"""SELECT id, CASE WHEN lang = 'python' THEN CASE WHEN t OR starts_with(n, 'test_') OR ends_with(n, '_test.py') THEN 'test' ELSE 'source' END WHEN lang = 'go' THEN CASE WHEN ends_with(n, '_test.go') THEN 'test' ELSE 'source' END
    WHEN lang IN ('c', 'cpp') THEN CASE WHEN t OR starts_with(n, 'test_') OR regexp_matches(n, '(_test|_tests|\\.test)\\.(c|cc|cpp|cxx)$') THEN 'test' WHEN regexp_matches(n, '\\.(h|hpp|hh|hxx)$') THEN 'declaration' ELSE 'source' END ELSE 'source' END AS kind
    FROM (SELECT id, lower(label) AS n, {LANGUAGE} AS lang, list_has_any(string_split(lower(id), '/'), {C.TEST_FOLDERS}) AS t FROM files)"""))
def other_file_kinds(spark, d):
    return files(spark, d).select("id", C.file_kind_other(F.col("id"), _language()).alias("kind"))


SPECIFIERS = ["node:fs", "path", "react", "os.path", "json", "numpy.linalg"]


@query(sql("files", f"SELECT id, list_contains({C.NODE_BUILTINS}, regexp_replace(s, '^node:', '')) AS in_node, list_contains({C.PYTHON_BUILTINS}, string_split(s, '.')[1]) AS in_python FROM (SELECT id, {SPECIFIERS}[partkey % 6 + 1] AS s FROM files)"))
def builtin_modules(spark, d):
    s = F.element_at(F.array(*[F.lit(x) for x in SPECIFIERS]), (F.col("partkey") % 6 + 1).cast("int"))
    return files(spark, d).select("id", C.is_builtin_module(s).alias("in_node"), C.is_builtin_module(s, "python").alias("in_python"))


CALLED = ["listen", "route", "bootstrap", "load", "patch"]


@query(sql("files", f"SELECT id, list_contains(['listen', 'createServer', 'start', 'bootstrap'], c) AS starts, list_contains(['get', 'post', 'put', 'patch', 'delete', 'head', 'options', 'all', 'use', 'route', 'handle'], c) AS routes FROM (SELECT id, {CALLED}[partkey % 5 + 1] AS c FROM files)"))
def startup_and_route_calls(spark, d):
    calls = F.array(F.lit("other"), F.element_at(F.array(*[F.lit(x) for x in CALLED]), (F.col("partkey") % 5 + 1).cast("int")))
    return files(spark, d).select("id", C.has_startup_call(calls).alias("starts"), C.has_route_call(calls).alias("routes"))


@query(sql("files", f"SELECT id, true AS everything, (size = 1 OR regexp_matches(lower(id), '\\.(tsx|jsx)$')) AND {LANGUAGE} IN ('typescript', 'go') AS chosen FROM files"))
def shown_files(spark, d):
    f = files(spark, d).withColumn("language", _language())
    own = lambda kinds, languages: C.shown(kinds, languages, F.lit("source"), F.col("language"), F.col("id"), F.col("size") == 1)
    return f.select("id", own([], []).alias("everything"), own(["entry", "ui"], ["typescript", "go"]).alias("chosen"))


@query(sql("files", f"""SELECT id, CASE WHEN size % 5 = 0 AND l IN ('c', 'cpp') THEN 'decl' WHEN l = 'typescript' THEN CASE WHEN e THEN 'exp' END WHEN l = 'go' THEN CASE WHEN e THEN 'exported' END
    WHEN l = 'python' THEN CASE WHEN NOT e THEN 'private' END WHEN l IN ('c', 'cpp') THEN CASE WHEN NOT e THEN 'static' END WHEN e THEN 'exp' END AS mark FROM (SELECT *, size % 2 = 1 AS e, {LANGUAGE} AS l FROM files)"""))
def function_marks(spark, d):
    return files(spark, d).select("id", C.function_marker(_language(), F.col("size") % 5 == 0, F.col("size") % 2 == 1).alias("mark"))


PAIRS = """p AS (SELECT source, target, string_split(source, '/') AS a, string_split(target, '/') AS b FROM file_edges),
    n AS (SELECT *, len(list_filter(range(1, least(len(a), len(b)) + 1), lambda k: a[1:k] = b[1:k])) AS k FROM p)"""


@query(sql("file_edges", """SELECT source, target, CAST(k AS INTEGER) AS n_shared, array_to_string(a[1:k], '/') AS shared, CASE WHEN k >= 2 THEN array_to_string(a[1:k], '/') WHEN length(source) >= length(target) THEN source ELSE target END AS merged FROM n""", more=PAIRS))
def shared_paths(spark, d):
    s, t = F.col("source"), F.col("target")
    return file_edges(spark, d).select("source", "target", T.shared_prefix_length(s, t).cast("int").alias("n_shared"), T.common_path(s, t).alias("shared"), T.merged_name(s, t, F.length(s), F.length(t)).alias("merged"))


@query(sql("files", "SELECT id, id AS path FROM files"))
def normalised_paths(spark, d):
    return files(spark, d).select("id", T.normalised_path(F.concat(F.lit("../"), F.regexp_replace("id", "/", "/./x/..//"))).alias("path"))


HEAD = "// head\n\nimport os\n"


@query("""SELECT doc_id, sha256(CASE WHEN len(k) = 0 THEN t ELSE array_to_string(s[k[1]:], chr(10)) END) AS body FROM (SELECT *, list_filter(range(1, len(s) + 1), lambda i: NOT regexp_matches(s[i], '""" + T.BOILERPLATE + """')) AS k
    FROM (SELECT doc_id, t, string_split(t, chr(10)) AS s FROM (SELECT doc_id, '// head' || chr(10) || chr(10) || 'import os' || chr(10) || text AS t FROM documents)))""")
def stripped_boilerplate(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(T.strip_boilerplate(F.concat(F.lit(HEAD), "text")), 256).alias("body"))


@query("""SELECT doc_id, sha256(array_to_string(list_transform(s, lambda x: substr(x, coalesce(m, 0) + 1)), chr(10))) AS body FROM (SELECT *, list_min(list_transform(list_filter(s, lambda x: trim(x) <> ''), lambda x: length(regexp_extract(x, '^\\s*', 0)))) AS m
    FROM (SELECT doc_id, string_split('  ' || replace(text, chr(10), chr(10) || '   '), chr(10)) AS s FROM documents))""")
def dedented_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(T.dedent(F.concat(F.lit("  "), F.replace("text", F.lit("\n"), F.lit("\n   ")))), 256).alias("body"))


@query(sql("files", "SELECT id, greatest(6.0::DOUBLE, least(30.0::DOUBLE, sqrt((CASE WHEN size = 7 THEN 1 ELSE size * 10 END)::DOUBLE) * 1.5::DOUBLE)) AS radius FROM files"))
def node_sizes(spark, d):
    return files(spark, d).select("id", T.node_radius(F.when(F.col("size") == 7, 0).otherwise(F.col("size") * 10)).alias("radius"))


@query(sql("supply", "SELECT kind, CASE kind WHEN 'dynamic' THEN '6,3' WHEN 're-export' THEN '2,2' ELSE 'none' END AS dash, greatest(1.0::DOUBLE, least(4.0::DOUBLE, (ord % 10) * 0.5::DOUBLE)) AS width, count(*) AS n FROM supply GROUP BY ALL"))
def edge_styles(spark, d):
    symbols = F.slice(F.array_repeat(F.lit("s"), 9), 1, (F.col("ord") % 10).cast("int"))
    return supply(spark, d).select("kind", T.edge_dash(F.col("kind")).alias("dash"), T.edge_width(symbols).alias("width")).groupBy("kind", "dash", "width").agg(F.count("*").alias("n"))


@query(sql("files", "SELECT id, 'https://host/own/' || lower(p_type) || '/blob/c1/' || id || '#L' || size || '-L' || (size + 9) AS link, 'https://host/own/r%20x/blob/c1/' || string_split(id, '/')[1] || '/a%20b/%C3%A9%23' AS quoted FROM files"))
def source_links(spark, d):
    f = files(spark, d)
    link = T.source_link("https://host", F.lit("own"), F.lower("p_type"), F.lit("c1"), F.col("id"), F.col("size"), F.col("size") + 9)
    quoted = T.source_link("https://host", F.lit("own"), F.lit("r%20x"), F.lit("c1"), F.concat(F.element_at(F.split("id", "/"), 1), F.lit("/a b/é#")))
    return f.select("id", link.alias("link"), quoted.alias("quoted"))


KINDS = ["arrow", "hook", "test", "structure", "nothing", "route-handler", "callback"]


@query(sql("files", f"SELECT id, {_sql_case('l', T.LANGUAGE_COLOURS, repr(T.LANGUAGE_COLOURS['unknown']))} AS colour, {_sql_case('k', T.KIND_BADGES, repr('fn'))} AS badge FROM (SELECT id, {LANGUAGE} AS l, {KINDS}[partkey % 7 + 1] AS k FROM files)"))
def colours_and_badges(spark, d):
    k = F.element_at(F.array(*[F.lit(x) for x in KINDS]), (F.col("partkey") % 7 + 1).cast("int"))
    return files(spark, d).select("id", T.language_colour(_language()).alias("colour"), T.kind_badge(k).alias("badge"))


@query("SELECT doc_id, CASE WHEN length(x) >= 8 THEN x END AS device FROM (SELECT doc_id, substr(regexp_replace(text, '[^A-Za-z0-9-]', '', 'g'), 1, 64) AS x FROM documents)")
def device_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", T.device_id(F.col("text")).alias("device"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def day_buckets(spark, d):
    return table(spark, d, "events").select("event_id", T.day_bucket(F.col("ts")).alias("day"))


@query("SELECT event_id, CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT) AS k FROM events")
def commented_json(spark, d):
    c = F.concat(F.lit("// a note\n/* more\n notes */"), "props", F.lit(" // end"))
    return table(spark, d, "events").select("event_id", T.parse_commented_json(c, "k long")["k"].alias("k"))


@query("SELECT conv_id, turn, role AS type, text FROM conversations")
def event_frames(spark, d):
    c = table(spark, d, "conversations")
    frame = F.to_json(F.struct(F.col("role").alias("type"), F.col("text").alias("text")))
    stream = F.concat(F.lit("event: ping\n\ndata: "), frame, F.lit("\n\ndata: {broken\n\ndata: "), F.lit('{"label": "no type"}'), F.lit("\n\n"))
    return c.select("conv_id", "turn", F.explode(T.event_frames(stream)).alias("f")).select("conv_id", "turn", "f.type", "f.text")


@query("SELECT conv_id, string_agg(role || ': ' || substr(text, 1, 300), chr(10) ORDER BY turn) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n <= 5 GROUP BY conv_id")
def comment_digests(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return c.select("conv_id", T.comment_digest(F.transform("m", lambda x: F.struct(x["role"].alias("author"), x["text"].alias("body")))).alias("digest"))


@query("SELECT p_brand AS file, count(*) AS n_functions, arg_min(p_name, p_partkey) AS first_function, arg_max(p_name, p_partkey) AS last_function FROM part GROUP BY p_brand")
def functions_of_files(spark, d):
    f = table(spark, d, "part").select(F.col("p_brand").alias("file"), F.col("p_name").alias("name"), F.col("p_partkey").alias("ord"))
    x = graph.functions_of_files(f)
    return x.select("file", F.size("functions").cast("long").alias("n_functions"), F.element_at("functions", 1)["name"].alias("first_function"), F.element_at("functions", -1)["name"].alias("last_function"))


@query(sql("files", "SELECT id, count(*) AS n_tokens, min(t) AS first_token FROM (SELECT id, unnest(list_distinct(list_concat(list_filter(regexp_split_to_array(lower(id), '[^a-z0-9]+'), lambda x: length(x) > 1), list_filter(regexp_split_to_array(lower(label), '[^a-z0-9]+'), lambda x: length(x) > 1)))) AS t FROM files) GROUP BY id"))
def inline_index(spark, d):
    return index.inline_index(files(spark, d).select("id", "label")).select("id", F.size("tokens").cast("long").alias("n_tokens"), F.array_min("tokens").alias("first_token"))


RETRIEVAL = """e AS (SELECT DISTINCT source, target, length(source) % 2 = 0 AS re FROM file_edges), t AS (SELECT source AS id, count(DISTINCT target) FILTER (re) AS n FROM e GROUP BY source),
    r AS (SELECT f.id, coalesce(t.n, 0) AS n, CASE WHEN size % 7 <> 0 THEN 1 ELSE 0 END AS nf, CASE WHEN size % 7 = 0 AND size < 30 THEN 1 ELSE 0 END AS ns FROM files f LEFT JOIN t ON f.id = t.id),
    q AS (SELECT *, nf = 0 AND ns = 0 AND n > 0 AS barrel FROM r)"""


@query(sql("file_edges files", "SELECT id, barrel AS is_barrel, CASE WHEN barrel THEN 'barrel' WHEN regexp_matches(id, '(?i)\\.(test|spec)\\.(ts|js|tsx|jsx)$|/__(tests?|mocks?)__/') THEN 'test' ELSE 'unknown' END AS semantic_role, CAST(nf AS BIGINT) AS n_functions, CAST(ns AS BIGINT) AS n_structures, CAST(CASE WHEN barrel THEN n ELSE 0 END AS BIGINT) AS n_targets FROM q", more=RETRIEVAL))
def retrieval_rows(spark, d):
    f = files(spark, d)
    e = file_edges(spark, d).withColumn("kind", F.when(F.length("source") % 2 == 0, "re-export").otherwise("static"))
    x = index.retrieval_index(f.select("id", F.lit(False).alias("is_barrel")), e, functions(spark, d).where("kind = 'function'"), f.where("size % 7 = 0 and size < 30").select(F.col("id").alias("file")))
    return x.select("id", "is_barrel", "semantic_role", "n_functions", "n_structures", F.size("barrel_targets").cast("long").alias("n_targets"))


PULLS = "pulls AS (SELECT o_custkey AS query, o_orderpriority = '1-URGENT' AS is_merged, CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'closed' END AS state, o_orderkey FROM orders)"


@query("WITH " + PULLS + """ SELECT DISTINCT p.query, 'src/P' || l_partkey AS id FROM (SELECT *, bool_or(is_merged) OVER (PARTITION BY query) AS has_key FROM pulls) p JOIN lineitem ON l_orderkey = o_orderkey
    WHERE is_merged OR (NOT has_key AND state = 'closed')""")
def truth_of_pulls(spark, d):
    changed = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.concat(F.lit(".\\src\\P"), "l_partkey")).alias("changed_files"))
    o = table(spark, d, "orders").select(
        F.col("o_custkey").alias("query"), (F.col("o_orderpriority") == "1-URGENT").alias("is_merged"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("state"), "o_orderkey"
    )
    return evaluate.truth_of_pulls(o.join(changed, F.col("o_orderkey") == F.col("l_orderkey"), "left"))


@query("SELECT p_brand AS module_id, avg(p_size) AS importance, row_number() OVER (ORDER BY avg(p_size) DESC, p_brand) AS nth FROM part GROUP BY p_brand")
def modules_by_importance(spark, d):
    return cluster.by_importance(table(spark, d, "part").groupBy(F.col("p_brand").alias("module_id")).agg(F.avg("p_size").alias("importance")))


REPRESENTATIVES = """m AS (SELECT CASE WHEN size < 10 THEN 'module_infra' ELSE p_brand END AS module_id, id, size FROM files),
    k AS (SELECT *, module_id <> 'module_infra' AND size % 7 = 0 AS key, row_number() OVER (PARTITION BY module_id ORDER BY size DESC, id) AS n FROM m),
    r AS (SELECT module_id, id FROM (SELECT *, bool_or(key) OVER (PARTITION BY module_id) AS has_key FROM k) WHERE CASE WHEN has_key THEN key ELSE n <= 2 END)"""


def _module_files(spark, d):
    at = F.when(F.col("size") < 10, "module_infra").otherwise(F.col("p_brand"))
    return files(spark, d).select(at.alias("module_id"), "id", F.col("size").alias("importance"), F.col("partkey").alias("ord"))


def _representatives(spark, d):
    f = _module_files(spark, d)
    return cluster.representatives(f, f.where("importance % 7 = 0").select("module_id", "id"))


@query(sql("files", "SELECT module_id, id FROM r", more=REPRESENTATIVES))
def representatives(spark, d):
    return _representatives(spark, d)


@query(sql("files", "SELECT module_id, id, is_representative, nth FROM (SELECT *, row_number() OVER (PARTITION BY module_id ORDER BY is_representative DESC, partkey, id) AS nth FROM (SELECT CASE WHEN f.size < 10 THEN 'module_infra' ELSE f.p_brand END AS module_id, f.id, f.partkey, r.id IS NOT NULL AS is_representative FROM files f LEFT JOIN r ON f.id = r.id)) WHERE nth <= 30", more=REPRESENTATIVES))
def representatives_first(spark, d):
    return cluster.representatives_first(_module_files(spark, d), _representatives(spark, d))


@query("""WITH r AS (SELECT event_id, user_id, ts, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS n FROM events),
    g AS (SELECT *, CASE WHEN n <= 3 THEN sum(CASE WHEN n <= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY day ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) END AS k FROM r),
    a AS (SELECT *, n <= 3 AND k <= 30 AS ok FROM g),
    b AS (SELECT *, coalesce(sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY day, user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS had FROM a)
    SELECT event_id AS request_id, ok AS is_allowed, CASE WHEN ok THEN NULL WHEN had >= 3 THEN 'device' ELSE 'global' END AS reason FROM b""")
def request_limits(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("request_id"), F.col("ts").alias("at"), F.col("user_id").cast("string").alias("device"), F.lit("one").alias("address"), F.lit(0).alias("tokens"))
    return stateful.request_limits(e, (3, 10**12, 30, 10**12))


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 10")
def recent_events(spark, d):
    return stateful.last_rows(table(spark, d, "events").select("event_id", "user_id", "ts"), ["user_id"], ["ts", "event_id"], 10).select("event_id", "user_id")


@query("SELECT DISTINCT lower(user_id || '--' || event_type) AS job_id FROM events")
def distinct_jobs(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("owner"), F.upper("event_type").alias("repo"), "ts")
    return counters.distinct_jobs(e, "ts").select("job_id")


@query(sql("files", """SELECT 'turbo' AS tool, true AS is_monorepo, b AS name, 'packages/' || b AS root, CASE WHEN (SELECT count(*) FROM files WHERE starts_with(id, 'brand_11/')) > 0 THEN 'brand_11' ELSE '' END AS dependencies
    FROM (SELECT DISTINCT string_split(id, '/')[1] AS b FROM files)"""))
def workspace_members(spark, d):
    f = files(spark, d).select("id", F.element_at(F.split("id", "/"), 1).alias("brand"))
    manifests = f.select("brand").distinct().select(F.concat(F.lit("packages/"), "brand", F.lit("/package.json")).alias("path"), F.format_string('{"name": "%s", "dependencies": {"brand_11": "1", "react": "2"}}', "brand").alias("content"))
    configs = manifests.unionByName(spark.createDataFrame([("package.json", '{"workspaces": ["./packages/*"]}'), ("turbo.json", "{}")], "path string, content string"))
    summary, packages = workspaces.detect_workspaces(f.select(F.concat(F.lit("packages/"), "id").alias("path")).unionByName(configs.select("path")), configs)
    return packages.crossJoin(F.broadcast(summary)).select("tool", "is_monorepo", "name", "root", F.array_join("dependencies", ",").alias("dependencies"))  # one row


@query(sql("files", """, i AS (SELECT id, '@b/' || regexp_replace(id, '\\.[^./]*$', '') AS specifier, regexp_matches(id, '\\.(ts|tsx|js)$') AS found FROM files)
    SELECT specifier, CASE WHEN found THEN 'internal' ELSE 'unresolved' END AS kind, CASE WHEN found THEN id END AS path, CAST(NULL AS VARCHAR) AS name FROM i
    UNION SELECT w, 'external', NULL, w FROM (SELECT DISTINCT string_split(p_name, ' ')[1] AS w FROM files)"""))
def alias_resolution(spark, d):
    f = files(spark, d)
    imports = f.select(F.concat(F.lit("@b/"), F.regexp_replace("id", r"\.[^./]*$", "")).alias("specifier")).unionByName(f.select(F.element_at(F.split("p_name", " "), 1).alias("specifier")))
    configs = spark.createDataFrame([("tsconfig.json", '{"compilerOptions": {"paths": {"@b/*": ["./*"], "@/*": ["src/*"]}}} // c')], "path string, content string")
    paths = f.select(F.col("id").alias("path"))
    return workspaces.resolve_aliases(imports, workspaces.alias_entries(paths, configs), paths)
