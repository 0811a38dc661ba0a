"""Extraction of imports, functions and structures from source text.

Each file's text becomes plain facts in one pass: Python's by its own grammar,
those of script languages, Go and C by walks over their tokens. Spark decides
which facts are rows, names their kinds, filters calls and drops repeated names.
``analysis_confidence`` is high for whole grammars and sound script files, medium
for sound Go and C, low for files with open brackets or literals and for
functions that were found again behind a broken place.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkstrata.sources.native import native_facts
from sparkstrata.sources.script import TEST_CALL, script_facts

SCHEMA = (
    "file string, what string, name string, kind string, start_line int, end_line int, is_exported boolean, is_async boolean, parent string, "
    "dots int, is_from boolean, is_type_only boolean, symbols array<string>, calls array<string>, analysis_confidence string, ord int"
)
#: The schema of rows.
ROWS = SCHEMA + ", visibility string, is_recovered boolean"
#: Besides what rows have: of functions their form, the texts of their calls, their parameters and what they are handed to; of calls their first argument.
FACTS = ROWS + ", form string, texts array<string>, params array<string>, direct boolean, exports_name string, in_exported boolean, first_text string, top boolean"
FIELDS = [c.split()[0] for c in SCHEMA.split(", ")]
FACT_FIELDS = [c.split()[0] for c in FACTS.split(", ")]
FACTS_ARROW = pa.schema(
    [(n, {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}[t]) for n, t in (c.split() for c in FACTS.split(", "))]
)
#: Calls that say nothing about the graph, words that look like calls, and calls that name tests.
SKIPPED_CALLS = {
    "console.log", "console.error", "console.warn", "console.info", "JSON.parse", "JSON.stringify", "Object.keys", "Object.values", "Object.entries",
    "Object.assign", "Array.from", "Array.isArray", "Math.floor", "Math.ceil", "Math.round", "Math.max", "Math.min", "parseInt", "parseFloat",
    "isNaN", "isFinite", "setTimeout", "setInterval", "clearTimeout", "clearInterval", "Promise.all", "Promise.race", "Promise.resolve", "Promise.reject",
}


def _row(file: str, what: str, name: str, **more) -> dict:
    return dict.fromkeys(FIELDS) | {"file": file, "what": what, "name": name} | more


def python_rows(file: str, text: str) -> list[dict]:
    """Imports, functions, classes and start signals of a Python file."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return broken_python_rows(file, text)
    out: list[dict] = []
    in_tests = re.search(r"(^|/)(test_[^/]*|[^/]*_test|conftest)\.py$|(^|/)tests?/", file) is not None

    def calls_of(node: ast.AST) -> list[str]:
        names = []
        for x in ast.walk(node):
            if isinstance(x, ast.Call):
                f = x.func
                n = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                if n and not n[0].isupper() and n not in names:
                    names.append(n)
        return names

    def visit(body: list[ast.stmt], parent: str | None) -> None:
        for x in body:
            if isinstance(x, ast.Import):
                for a in x.names:
                    out.append(_row(file, "import", a.name, kind="static", dots=0, is_from=False, is_type_only=False, symbols=[], start_line=x.lineno))
            elif isinstance(x, ast.ImportFrom):
                names = [a.name + (f" as {a.asname}" if a.asname else "") for a in x.names]
                out.append(_row(file, "import", x.module or "", kind="re-export" if "*" in names else "static", dots=x.level, is_from=True, is_type_only=False, symbols=names, start_line=x.lineno))
            elif isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                test = in_tests and x.name.startswith("test")
                public = not x.name.startswith("_") or (x.name.startswith("__") and x.name.endswith("__"))
                out.append(_row(file, "function", f"{parent}.{x.name}" if parent else x.name, kind="test" if test else "method" if parent else "function", start_line=x.lineno,
                                end_line=x.end_lineno, is_exported=public, is_async=isinstance(x, ast.AsyncFunctionDef), parent=parent, calls=calls_of(x)))
                if test:
                    out.append(_row(file, "test-case", x.name, start_line=x.lineno))
            elif isinstance(x, ast.ClassDef):
                out.append(_row(file, "structure", x.name, kind="class", start_line=x.lineno, end_line=x.end_lineno, is_exported=not x.name.startswith("_"), parent=parent))
                if in_tests and x.name.startswith("Test"):
                    out.append(_row(file, "test-suite", x.name, start_line=x.lineno))
                visit(x.body, x.name)
            elif isinstance(x, ast.If):
                if "__name__" in ast.unparse(x.test) and "__main__" in ast.unparse(x.test):
                    out.append(_row(file, "startup", "__main__", start_line=x.lineno))
                visit([*x.body, *x.orelse], parent)
            elif isinstance(x, ast.Try):
                visit([*x.body, *[s for h in x.handlers for s in h.body], *x.orelse, *x.finalbody], parent)

    visit(tree.body, None)
    if re.search(r"\bapp\.run\(|\buvicorn\.run\(", text):
        out.append(_row(file, "startup", "app.run"))
    return [r | {"analysis_confidence": "high"} for r in out]


def broken_python_rows(file: str, text: str) -> list[dict]:
    """What lines of a Python file that its grammar refuses still show: imports, functions and classes, without their ends."""
    out = []
    for k, line in enumerate(text.split("\n"), 1):
        if m := re.match(r"\s*(?:from\s+(\.*)([\w.]*)\s+import\b|import\s+([\w.]+))", line):
            out.append(_row(file, "import", m[2] if m[3] is None else m[3], kind="static", dots=len(m[1] or ""), is_from=m[3] is None, is_type_only=False, symbols=[], start_line=k))
        elif m := re.match(r"\s*(async\s+)?def\s+(\w+)\s*\(", line):
            out.append(_row(file, "function", m[2], kind="function", start_line=k, end_line=k, is_exported=not m[2].startswith("_"), is_async=bool(m[1]), calls=[]))
        elif m := re.match(r"class\s+(\w+)", line):
            out.append(_row(file, "structure", m[1], kind="class", start_line=k, end_line=k, is_exported=not m[1].startswith("_")))
    return [r | {"analysis_confidence": "low"} for r in out]


def _tells(call: dict) -> bool:
    """Whether a call can give a row of its own: others only show among the texts of their functions, and are most of a file's facts."""
    name = call["name"] or ""
    last = name.rpartition(".")[2]
    return last in TELLING or call["first_text"] is not None and (name in ("import", "require") or TEST_CALL.match(name) is not None)


def file_facts(file: str, text: str, language: str) -> list[dict]:
    """The facts of one file, in order."""
    if language in ("typescript", "javascript"):
        try:
            facts, sound = script_facts(text, not re.search(r"\.[cm]?ts$", file))
        except RecursionError:  # nested beyond what one walk can follow
            facts, sound = [], False
        out = [x | {"file": file, "analysis_confidence": "high" if sound else "low"} for x in facts]
        return [x | {"ord": k} for k, x in enumerate(out) if x["what"] != "call" or _tells(x)]
    elif language == "python":
        out = [x | {"form": "row"} for x in python_rows(file, text)]
    elif language in ("go", "c", "cpp"):
        out = [x | {"file": file, "form": "row"} for x in native_facts(text, language, file)]
    else:
        out = []
    return [x | {"ord": k} for k, x in enumerate(out)]


#: Facts from which on a batch is passed on.
BATCH = 4096


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x.get(f.name) for x in rows], f.type) for f in FACTS_ARROW], schema=FACTS_ARROW)


def facts(contents: DataFrame) -> DataFrame:
    """The facts of each file (path, content, language), one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[dict] = []
            for file, text, language in zip(*(b.column(k).to_pylist() for k in range(3))):
                rows += file_facts(file or "", text or "", language or "")
                # files share a batch, as each batch has a cost of its own for each column
                if len(rows) >= BATCH:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    # reading a text takes far longer than moving it, and files may come in few partitions
    n = int(contents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return contents.select("path", "content", "language").repartition(n, "path", "content").mapInArrow(run, FACTS)


#: Forms of script functions in the order in which the first of a name wins.
FORMS = ["declaration", "arrow", "expression", "method", "exports", "getter", "setter", "constructor"]
#: Calls that start a server, and calls that register a route.
STARTUP = ["listen", "createServer", "start", "bootstrap"]
ROUTES = ["get", "post", "put", "patch", "delete", "head", "options", "all", "use", "route", "handle"]
TELLING = {*STARTUP, *ROUTES}


def called_names(texts):
    """Names of calls from their texts, in order: the last dotted part, without built-ins, capitalised names and texts over 100 characters."""
    wanted = F.filter(F.transform(texts, F.trim), lambda t: (F.length(t) <= 100) & ~t.isin(*SKIPPED_CALLS))
    names = F.transform(wanted, lambda t: F.element_at(F.split(t, r"\."), -1))
    return F.array_distinct(F.filter(names, lambda n: (n != "") & ~n.rlike("^[A-Z]")))


def script_kind(form, name, params, is_async):
    """Kind of a script function, first match: constructor, getter, setter, test, middleware, async, else method, arrow or function."""
    low = F.transform(params, F.lower)
    at = lambda k: F.get(low, F.lit(k - 1))
    three = (F.size(params) == 3) & at(1).isin("req", "request", "ctx", "context") & at(2).isin("res", "response") & (at(3) == "next")
    two = (F.size(params) == 2) & at(1).isin("ctx", "context") & (at(2) == "next")
    return (
        F.when(form.isin("constructor", "getter", "setter"), form)
        .when(name.rlike(r"^([xf]?(it|test|describe|suite|context|specify)|(before|after)(Each|All)?)\("), "test")
        .when(form.isin("declaration", "arrow", "expression", "method", "exports") & (three | two), "middleware")
        .when(is_async, "async")
        .when(form == "method", "method")
        .when(form.isin("arrow", "expression"), "arrow")
        .otherwise("function")
    )


def rows_of(found: DataFrame) -> DataFrame:
    """The rows that facts give; of script functions with one name in a file the first by form and place stays.

    A function that is a property's own value on one line and isn't async is
    left out, as is one that nothing names, such as what is handed to a call
    that runs no tests (routes too: they show as the structure of their call).
    """
    c = {x: F.col(x) for x in FACT_FIELDS}
    fields = [*FIELDS, "visibility", "is_recovered"]

    def row(on, **values):
        return on, values

    function, call, statement = c["what"] == "function", c["what"] == "call", c["what"] == "statement"
    script = c["form"].isNull() | (c["form"] != "row")
    off = F.lit(False)
    literal = F.regexp_replace(c["first_text"], "^[\"'`]|[\"'`]$", "")
    last = F.element_at(F.split("name", r"\."), -1)
    calls = called_names(c["texts"])
    trivial = c["direct"] & (c["start_line"] == c["end_line"]) & ~c["is_async"]
    exported = F.when(c["form"] == "declaration", c["is_exported"]).when(c["form"].isin("getter", "setter", "constructor"), c["in_exported"]).otherwise(off)
    form = F.when(c["form"] == "expression", F.lit("exports")).otherwise(c["form"])
    order = lambda x: F.array_position(F.array(*[F.lit(f) for f in FORMS]), x).cast("int")
    statement_name = F.when(literal != "", F.concat(last, F.lit("("), literal, F.lit(")"))).otherwise(c["name"])
    one = F.lit(1)
    made = [
        row(~script),
        row(script & function & c["name"].isNotNull() & ~F.coalesce(trivial, off), kind=script_kind(c["form"], c["name"], c["params"], c["is_async"]), is_exported=F.coalesce(exported, off), calls=calls, pass_=order(c["form"]), once=c["name"]),
        row(script & function & c["exports_name"].isNotNull(), name=c["exports_name"], kind=script_kind(form, c["exports_name"], c["params"], c["is_async"]), is_exported=F.lit(True), calls=calls, pass_=F.lit(5), once=c["exports_name"]),
        row(script & function & (c["form"] == "declaration") & c["top"], what=F.lit("local"), kind=F.lit("function")),
        row(script & c["what"].isin("class", "value") & c["top"], kind=c["what"], what=F.lit("local")),
        row(script & (c["what"] == "import"), dots=F.lit(0), is_from=off),
        row(script & call & c["name"].isin("import", "require") & c["first_text"].isNotNull(), what=F.lit("import"), name=F.regexp_replace(c["first_text"], "[\"']", ""), kind=F.lit("dynamic"), dots=F.lit(0), is_from=off, is_type_only=off, symbols=F.array().cast("array<string>")),
        row(script & c["what"].isin("variable"), what=F.lit("structure")),
        row(script & statement & (F.length("name") <= 150) & (c["name"] != ""), what=F.lit("structure"), name=statement_name, is_exported=off),
        row(script & c["what"].isin("interface", "type") & c["is_exported"] & c["top"], what=F.lit("structure"), kind=c["what"]),
        row(script & call & c["name"].rlike("^[xf]?(describe|suite|context)$") & c["first_text"].isNotNull(), what=F.lit("test-suite"), name=literal),
        row(script & call & c["name"].rlike("^[xf]?(it|test|specify)$") & c["first_text"].isNotNull(), what=F.lit("test-case"), name=literal),
        row(script & call & last.isin(*STARTUP), what=F.lit("startup"), name=F.lit("listen"), once=F.lit("startup"), pass_=one),
        row(script & call & last.isin(*ROUTES) & c["name"].contains("."), what=F.lit("routes"), name=F.lit("register"), once=F.lit("routes"), pass_=one),
    ]
    # first the numbers of the rows that a fact gives, then their fields: whole rows in one expression are more code than the JVM compiles
    given = found.withColumn("made", F.explode(F.array(*[F.when(on, F.lit(k)) for k, (on, _) in enumerate(made)]))).where("made is not null")

    def field(name, other):
        value = other
        for k, (_, values) in enumerate(made):
            if name in values:
                value = F.when(F.col("made") == k, values[name]).otherwise(value)
        return value

    out = given.select(
        *[field(x, c[x]).alias(x) for x in fields], field("pass_", F.lit(0)).alias("pass"), field("once", F.lit(None).cast("string")).alias("once"),
    )
    # only rows that may stand once are numbered together; all others have a key of their own
    key = F.coalesce(F.concat(F.lit("1"), "once"), F.concat(F.lit("0"), F.col("ord").cast("string"), F.lit("/"), F.col("pass").cast("string"), F.lit("/"), F.col("what")))
    first = F.row_number().over(Window.partitionBy("file", "what", key).orderBy("pass", "ord"))
    return out.withColumn("first", first).where("first = 1").select(*fields)


def extract(contents: DataFrame) -> DataFrame:
    """Rows of what each file (path, content, language) has.

    ``what`` is import, function, declaration (a prototype in a header),
    structure, test-suite, test-case, startup, routes, or local (what makes a
    script file more than a barrel). Null paths, contents and languages are
    empty; unknown languages and empty files give no rows; repeated files are
    one file whose rows of one name stand once.
    """
    return rows_of(facts(contents))


def functions_of(rows: DataFrame) -> DataFrame:
    """Functions of extracted rows with ids: path and name, later ones of a name with their line."""
    n = F.row_number().over(Window.partitionBy("file", "name").orderBy("ord"))
    plain = F.concat("file", F.lit("::"), "name")
    return rows.where("what = 'function'").withColumn("id", F.when(n == 1, plain).otherwise(F.concat(plain, F.lit("@"), F.col("start_line").cast("string"))))


def barrels(rows: DataFrame) -> DataFrame:
    """(file): files whose imports are all re-exports, at least one, and that declare no function, class or variable with a function at their top."""
    own = rows.where((F.col("what") == "local") | ((F.col("what") == "structure") & (F.col("kind") == "class"))).select("file").distinct()
    imports = rows.where("what = 'import'").groupBy("file").agg(F.bool_and(F.col("kind") == "re-export").alias("all"))
    return imports.where("all").select("file").join(own, "file", "left_anti")
