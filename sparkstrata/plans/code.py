"""Queries that extract rows from source files of several languages, one file for each part, with their SQL.

Each file is a fixed text with the part's name in it, so SQL states a file's
rows by hand and puts the name in.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkstrata.plans.queries import query
from sparkstrata.plans.views import camel, files, sql
from sparkstrata.sources import extract

SCRIPT = r"""import { load } from "./NAME";
export { default as x } from './x';
type Fn = (a: number) => void;
export const NAMESchema = z.object({ id: z.string() });
export class NAME extends Base<string> {
  private seen: (x: string) => void = () => {};
  constructor(private db: Db) { super(); this.init(); }
  async open(a: string): Promise<void> { await load<string>(JSON.parse(`${a} }`)); }
}
const routes = {
  getNAME: async (req, res, next) => {
    res.send(find(req.id));
  },
  tiny: x => x.id,
};
app.get("/NAME", (req, res) => { hidden(res); });
describe("NAME", () => { it('works', () => expect(new NAME(db).open("}")).toBe(/[/}]/)); });
"""
SCRIPT_ROWS = [
    ("import", "./NAME", "static", 1, 1, None, None), ("import", "./x", "re-export", 2, 2, None, None), ("structure", "NAMESchema", None, 4, 4, True, None), ("local", "NAME", "class", 5, 9, True, None),
    ("function", "NAME.constructor", "constructor", 7, 7, True, "super,init"), ("function", "NAME.open", "async", 8, 8, False, "load"),
    ("function", "getNAME", "middleware", 11, 13, False, "send,find"), ("routes", "register", None, 16, 16, None, None), ("structure", "get(/NAME)", None, 16, 16, False, None),
    ("test-suite", "NAME", None, 17, 17, None, None), ("function", "describe(NAME)", "test", 17, 17, False, "it,toBe,expect,open"), ("test-case", "works", None, 17, 17, None, None),
    ("function", "it(works)", "test", 17, 17, False, "toBe,expect,open"), ("structure", "describe(NAME)", None, 17, 17, False, None),
]
GO = """package main

import (
	"fmt"
	n "ex.org/NAME"
)

type NAME[T any] struct{ f func(x int) }

func (r *NAME) Open(m map[string]struct{}) error {
	s := "}" // }
	return fmt.Errorf(s, n.Make(`}`, len(m)))
}

func main() { new(NAME).Open(nil) }
"""
GO_ROWS = [
    ("import", "fmt", "static", 4, 4, None, None), ("import", "ex.org/NAME", "static", 5, 5, None, None), ("structure", "NAME", None, 8, 8, True, None),
    ("function", "NAME.Open", "method", 10, 13, True, "Errorf,Make,len"), ("function", "main", "function", 15, 15, False, "Open,new"), ("startup", "main", None, 15, None, None, None),
]
CPP = """#include "NAME.h"
#ifdef DEBUG
#include <vector>
#endif
#define OPEN(x) do { x(
namespace shop {
template <typename T> struct NAME {
  NAME(int n) : n_{n} { init(n); }
  bool operator==(const NAME& o) const { return eq(o.n_); }
};
}
static int broken(int a) {
  if (a) {
    call();
  static int inside(int q) {
    return z(q, '}');
  }
int NAME::size(void) { return this->vec->at(count<int>(0)); }
TEST(NAME, Works) { EXPECT_TRUE(ok()); }
"""
CPP_ROWS = [
    ("import", "NAME.h", "static", 1, 1, None, None), ("import", "vector", "static", 3, 3, None, None), ("structure", "NAME", None, 7, 10, True, None),
    ("function", "NAME.NAME", "method", 8, 8, True, "init"), ("function", "NAME.operator==", "method", 9, 9, True, "eq"), ("function", "inside", "function", 15, 17, False, "z"),
    ("function", "NAME.size", "method", 18, 18, True, "at,count"), ("test-suite", "NAME", None, 19, 19, None, None), ("test-case", "NAME.Works", None, 19, 19, None, None),
]


def _rows(rows: list[tuple]) -> str:
    value = lambda x: "NULL" if x is None else str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, int) else f"'{x}'"
    body = ", ".join(f"({', '.join(map(value, r))})" for r in rows)
    columns = "what, replace(name, 'NAME', camel) AS name, CAST(kind AS VARCHAR) AS kind, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, CAST(is_exported AS BOOLEAN) AS is_exported, CAST(calls AS VARCHAR) AS calls"
    return f"SELECT id AS file, {columns} FROM files, (VALUES {body}) v(what, name, kind, start_line, end_line, is_exported, calls)"


def _extracted(spark, d, text: str, language: str):
    own = files(spark, d).withColumn("content", F.replace(F.lit(text), F.lit("NAME"), camel(F.col("p_name"))))
    out = extract.extract(own.select(F.col("id").alias("path"), "content", F.lit(language).alias("language")))
    return out.select("file", "what", "name", "kind", "start_line", "end_line", "is_exported", F.array_join("calls", ",").alias("calls"))


@query(sql("files", _rows(SCRIPT_ROWS)))
def extracted_script(spark, d):
    return _extracted(spark, d, SCRIPT, "typescript")


@query(sql("files", _rows(GO_ROWS)))
def extracted_go(spark, d):
    return _extracted(spark, d, GO, "go")


@query(sql("files", _rows(CPP_ROWS)))
def extracted_cpp(spark, d):
    return _extracted(spark, d, CPP, "cpp")
