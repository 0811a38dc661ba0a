import random

import pytest

from sparkstrata.sources import extract
from sparkstrata.sources.lexer import Tokens
from sparkstrata.sources.native import native_facts
from sparkstrata.sources.script import script_facts

FILES = "path string, content string, language string"


def rows(spark, path, text, language):
    return extract.extract(spark.createDataFrame([(path, text, language)], FILES)).orderBy("ord", "what").collect()


def functions(found, what="function"):
    """name: (kind, first line, last line, exported, calls)"""
    return {r.name: (r.kind, r.start_line, r.end_line, r.is_exported, r.calls) for r in found if r.what == what}


SCRIPT = r"""import def, { A as B, type C } from "./a";
import type { T } from './t';
import * as ns from 'ns';
export { x, y as z } from './x';
export * from "./all";
const lazy = () => import('./lazy'), old = require("old");
type Fn<T> = (a: number, b?: string) => Promise<T>;
export interface Shape<T extends object = {}> { a: number; f(x: string): void; g: (y: number) => void }
export type Id = T extends string ? (x: T) => void : never
interface Hidden { a(): void }
export const schema = z.object({ id: z.string() }), plain = 3;
export const handler = async (req: Request, Response, next: Next): Promise<void> => { await save(req.body); };
export const guard = (ctx: Ctx, next: () => Promise<void>) => next();
const one = (a, b = () => inner()) => a + b, two = function named(x) { return deep(x) };
class Repo<T> extends Base<T> implements I {
  private readonly cache: Map<string, (x: number) => void> = new Map();
  field = () => { this.touch(); };
  constructor(private readonly db: Db) { super(); this.init(); }
  get size(): number { return this.cache.size; }
  set size(v) { this.cache.resize(v); }
  static async load<T>(id: string): Promise<T> { return fetchIt<T>(id)?.then((r) => r.json()); }
  protected abstract over(a: string): void;
}
const resolvers = {
  Query: {
    user: async (_p, args, ctx) => ctx.db.find(args.id),
    tiny: x => x.id,
    big(a) {
      return a;
    },
    long: (x) => {
      return map(x);
    },
  },
};
app.get("/x", (req, res) => { send(res); });
app.use(cors());
container.bind(Foo).toSelf();
describe("suite's", () => {
  beforeEach(async () => { reset(); });
  it(`works ${1}`, () => expect(run({ a: "}" })).toBe(1));
  xit("skipped", function () { later() });
});
items.map((x) => x + 1).filter(Boolean);
exports.foo = function () { a(); };
module.exports = { bar: () => 1, baz: function () { b(); } };
function over(a: string): void;
function over(a: any) { return a < b ? c(a) : (d) => e; }
const q = cond ? (v) : w => w;
const App = () => <div onClick={() => { go(`}`); }}>don't {list.map(i => <li key={i}>{i}</li>)}</div>;
if (a) topless(); else { c() }
const re = /[/'"]+/.test(s) ? 1 : 2
new Foo(bar()).baz();
function factory() {
  return () => { hidden(); };
}
export default factory;
export { over };
"""


def test_script_functions(spark):
    found = rows(spark, "src/a.tsx", SCRIPT, "typescript")
    assert {r.analysis_confidence for r in found} == {"high"}
    assert functions(found) == {
        "lazy": ("arrow", 6, 6, False, ["import"]),
        "handler": ("middleware", 12, 12, False, ["save"]),  # an arrow function never says that it is exported
        "guard": ("middleware", 13, 13, False, ["next"]),
        "one": ("arrow", 14, 14, False, ["inner"]),
        "two": ("arrow", 14, 14, False, ["deep"]),
        "Repo.constructor": ("constructor", 18, 18, False, ["super", "init"]),
        "Repo.size": ("getter", 19, 19, False, []),
        "Repo.load": ("async", 21, 21, False, ["then", "fetchIt", "json"]),
        "Repo.over": ("method", 22, 22, False, []),
        "user": ("async", 26, 26, False, ["find"]),
        "big": ("method", 28, 30, False, []),
        "long": ("arrow", 31, 33, False, ["map"]),
        "describe(suites)": ("test", 39, 43, False, ["beforeEach", "reset", "it", "toBe", "expect", "run", "xit", "later"]),
        "beforeEach(async () => { reset(); })": ("test", 40, 40, False, ["reset"]),
        "it(works ${1})": ("test", 41, 41, False, ["toBe", "expect", "run"]),
        "xit(skipped)": ("test", 42, 42, False, ["later"]),
        "foo": ("arrow", 45, 45, False, ["a"]),
        "bar": ("arrow", 46, 46, True, []),
        "baz": ("function", 46, 46, True, ["b"]),
        "over": ("function", 47, 47, True, []),
        "q": ("arrow", 49, 49, False, []),
        "App": ("arrow", 50, 50, False, ["go", "map"]),
        "factory": ("function", 54, 56, True, ["hidden"]),
    }
    assert {r.name: (r.visibility, r.parent) for r in found if r.what == "function" and r.parent} == {
        "Repo.constructor": ("public", "Repo"), "Repo.size": ("public", "Repo"), "Repo.load": ("public", "Repo"), "Repo.over": ("protected", "Repo"),
    }


def test_script_imports_structures_and_signals(spark):
    found = rows(spark, "src/a.tsx", SCRIPT, "typescript")
    assert [(r.name, r.kind, r.symbols, r.is_type_only) for r in found if r.what == "import"] == [
        ("./a", "static", ["A", "C", "def"], False), ("./t", "static", ["T"], True), ("ns", "static", ["* as ns"], False), ("./x", "re-export", ["x", "y"], False),
        ("./all", "re-export", ["*"], False), ("./lazy", "dynamic", [], False), ("old", "dynamic", [], False),
    ]
    assert [(r.name, r.kind, r.start_line, r.end_line, r.is_exported) for r in found if r.what == "structure"] == [
        ("Shape", "interface", 8, 8, True), ("Id", "type", 9, 9, True), ("schema", None, 11, 11, True), ("get(/x)", None, 36, 36, False), ("app.use", None, 37, 37, False),
        ("container.bind(Foo).toSelf", None, 38, 38, False), ("describe(suite's)", None, 39, 43, False), ("items.map((x) => x + 1).filter", None, 44, 44, False),
        ("new Foo(bar()).baz", None, 53, 53, False),
    ]
    assert [(r.what, r.name) for r in found if r.what in ("test-suite", "test-case", "startup", "routes")] == [("routes", "register"), ("test-suite", "suite's"), ("test-case", "skipped")]
    assert rows(spark, "s.js", "http.createServer(app).listen(3); bootstrap(x); a.start", "javascript")[-1].what in ("startup", "structure")
    assert [r.what for r in rows(spark, "s.js", "bootstrap(x)", "javascript")] == ["startup", "structure"]


@pytest.mark.parametrize("text, want", [
    ("const a = <T,>(x: T) => x;", {"a": (1, 1)}),
    ("const f = (a: { b: (c: string) => void }, [d, e]: number[] = g(() => 1)): a is B => {\n  return h<X<Y>>(1)\n}\nj()", {"f": (1, 3)}),
    ("let x = a\nfoo(() => {})\nlet y = () => {\n}\n(z)", {"y": (3, 4)}),
    ("const o = { get a() { return 1 }, async *b() {}, [c]: () => {\n}, 'd-e': async () => 1, f() {} }", {"a": (1, 1), "b": (1, 1), "[c]": (1, 2), "'d-e'": (2, 2), "f": (2, 2)}),
    ("const t = `a ${ (() => { return `}` })() } b`, u = () => t", {"t": (1, 1), "u": (1, 1)}),
    ("const l = [() => 1, function () {}]", {"l": (1, 1)}),
    ("x = a / b / c; const r = s => /}/.test(s)", {"r": (1, 1)}),
    ("class A { m = () => 1; static { k(() => 1) } 'n'() {} #p() {} }", {"A.'n'": (1, 1), "A.#p": (1, 1)}),
    ("namespace N { export function inside(): void {} }\ndeclare function d(a: string): number\nabstract class Q { abstract z(): void }", {"inside": (1, 1), "d": (2, 2), "Q.z": (3, 3)}),
    ("for (const k of [() => 1]) { run(k) }\nlabel: while (x) break label\nswitch (a) { case 'b': const v = () => 2; default: c() }", {"k": (1, 1), "v": (3, 3)}),
    ("const e = <A b='}' {...c} d={() => {\n}}><>text {x}</> it's <B/></A>; const g = () => e", {"e": (1, 2), "g": (2, 2)}),
    ("export default function () { a() }\nexport default async function named() {}", {"named": (2, 2)}),
    ("useEffect(() => { load({ onDone: async () => 1 }) }, [])", {"onDone": (1, 1)}),
    ("", {}), ("}}}) ( [", {}), ("`${", {}), ("const a = (", {}), ("function", {}), ("class", {}), ("import", {}), ("export", {}), ("<div", {}), ("a<b>(c", {}), ("'", {}), ("/*", {}),
])
def test_script_pieces(spark, text, want):
    found = functions(rows(spark, "a.tsx", text, "typescript"))
    assert {k: v[1:3] for k, v in found.items()} == want


GO = """package main
import (
 "fmt"
 m "ex.org/m"
 . "dot"
)
import "one"
type Box[T any] struct {
 f func(x int) error
}
type (
 A interface { Foo() ; Bar(int) }
 B = int
 c string
)
var x = func() { hidden() }
func (b *Box) Open(a map[string]struct{}, f func(int)) (err error) {
 run(b.x.y(z()))
 s := []byte("}") // }
 go func() { spawn() }()
 return fmt.Errorf(`}`, make([]int, 3))
}
func (Box) Close() interface{ Foo() } {
 defer b.Lock().Unlock()
}
func gen[T any](x T) T { return x }
func ext(a int) int
func broken() {
 if x {
func After() { ok() }
func main() { After() }
"""


def test_go(spark):
    found = rows(spark, "cmd/m.go", GO, "go")
    assert functions(found) == {
        "Box.Open": ("method", 17, 22, True, ["run", "y", "z", "spawn", "Errorf", "make"]), "Box.Close": ("method", 23, 25, True, ["Unlock", "Lock"]),
        "gen": ("function", 26, 26, False, []), "ext": ("function", 27, 27, False, []), "broken": ("function", 28, 29, False, []),
        "After": ("function", 30, 30, True, ["ok"]), "main": ("function", 31, 31, False, ["After"]),
    }
    assert {r.name for r in found if r.is_recovered} == {"broken"} == {r.name for r in found if r.analysis_confidence == "low"}
    assert [(r.name, r.symbols) for r in found if r.what == "import"] == [("fmt", []), ("ex.org/m", ["m"]), ("dot", ["."]), ("one", [])]
    assert [(r.name, r.start_line, r.end_line, r.is_exported) for r in found if r.what == "structure"] == [("Box", 8, 10, True), ("A", 12, 12, True), ("c", 14, 14, False)]
    assert [r.name for r in found if r.what == "startup"] == ["main"]
    tests = rows(spark, "m_test.go", "package m\nfunc TestOne(t *T) { t.Run() }\nfunc Testing() {}\nfunc (s S) TestTwo() {}\n", "go")
    assert [(r.what, r.name, r.kind) for r in tests] == [("function", "TestOne", "test"), ("test-case", "TestOne", None), ("function", "Testing", "function"), ("function", "S.TestTwo", "method")]


C = """#include "a.h"
#ifdef X
#include <sys/b.h>
static int add(int a, int *b) {
  return twice(a) + s->fn(a, g(b)) + sizeof(a);
}
#endif
#define MAC(x) do { foo(x
typedef struct { int a; } Point;
typedef struct node { struct node *next; } node_t;
struct S { int x; };
enum color { RED, GREEN };
int (*fp)(int) = 0;
int arr[] = { 1, 2 };
char *name(void)
{
  Foo x(1); if (a) { b(); } char c = '{';
  return new Foo(2);
}
EXPORT_API(int) exported(void) { return 0; }
int broken(int a) {
  if (a) {
    call();
  static int inner(int q) {
    return z(q);
  }
int after(void) { return ok(); }
int main(int argc, char **argv) { return after(); }
"""


def test_c_with_recovery(spark):
    found = rows(spark, "src/m.c", C, "c")
    assert functions(found) == {
        "add": ("function", 4, 6, False, ["twice", "fn", "g"]), "name": ("function", 15, 19, True, ["b"]), "exported": ("function", 20, 20, True, []),
        "inner": ("function", 24, 26, False, ["z"]), "after": ("function", 27, 27, True, ["ok"]), "main": ("function", 28, 28, True, ["after"]),
    }
    assert {r.name for r in found if r.is_recovered} == {"inner"}
    assert [r.name for r in found if r.what == "import"] == ["a.h", "sys/b.h"]
    assert [(r.name, r.start_line) for r in found if r.what == "structure"] == [("Point", 9), ("node", 10), ("S", 11), ("color", 12)]


CPP = """#include <vector>
namespace a::b {
template <typename T> class Ring : public Base<T> {
 public:
  Ring(int n) : n_(n), v_{1, 2} { init(); }
  ~Ring() {}
  Ring(const Ring&) = default;
  bool operator==(const Ring& o) const { return eq(o); }
  T get() const noexcept { return static_cast<T>(v_.at(0)); }
  virtual void pure() = 0;
  void decl(int);
  struct Inner { void deep() {} };
};
void Ring<int>::grow(int n) { this->resize(n); helper::go<int>(n); }
template <class U>
U make(U u) { return R"x(})x"; }
Ring::~Ring() { stop(); }
}
extern "C" {
int cfun(void) { auto f = [&](int x) { return lam(x); }; return f(1); }
}
TEST(Suite, Case) { EXPECT_EQ(1, one()); }
TEST_F(Suite, Other) { }
"""


def test_cpp(spark):
    found = extract.functions_of(extract.extract(spark.createDataFrame([("m.cpp", CPP, "cpp")], FILES))).orderBy("ord").collect()
    assert [(r.id, r.kind, r.start_line, r.calls) for r in found] == [
        ("m.cpp::Ring.Ring", "method", 5, ["init"]), ("m.cpp::Ring.destructor_Ring", "method", 6, []), ("m.cpp::Ring.Ring@7", "method", 7, []), ("m.cpp::Ring.operator==", "method", 8, ["eq"]),
        ("m.cpp::Ring.get", "method", 9, ["static_cast", "at"]), ("m.cpp::Inner.deep", "method", 12, []), ("m.cpp::Ring<int>.grow", "method", 14, ["resize", "go"]),
        ("m.cpp::make", "function", 16, []), ("m.cpp::Ring.~Ring", "method", 17, ["stop"]), ("m.cpp::cfun", "function", 20, ["lam", "f"]),
    ]
    other = rows(spark, "m.cpp", CPP, "cpp")
    assert [(r.what, r.name) for r in other if r.what.startswith("test")] == [("test-suite", "Suite"), ("test-case", "Suite.Case"), ("test-case", "Suite.Other")]


def test_headers_declare(spark):
    text = "int f(int x);\nextern char *g(void), *h(void);\nvoid (*cb)(int);\nFOO(bar);\nclass K { K(); ~K(); int m(int); int n() { return p(); } };\nstatic inline int q(void) { return 1; }\nint v;\n"
    found = rows(spark, "inc/a.hpp", text, "cpp")
    assert [r.name for r in found if r.what == "declaration"] == ["f", "g", "K.K", "K.destructor_K"]
    assert [r.name for r in found if r.what == "function"] == ["K.n", "q"]
    assert not [r for r in rows(spark, "inc/a.cpp", text, "cpp") if r.what == "declaration"]


def test_any_text_is_read(spark):
    """No text stops the walks, and each takes time in proportion."""
    r = random.Random(3)
    pieces = [*"(){}[]<>`'\"/*?:;,.=&|!@#$\\\n ", "=>", "${", "//", "function ", "class ", "const ", "async ", "import ", "export ", "type ", "interface ", "=> {", "func ", "struct ", "template<", "operator", "namespace ", "#if\n", "case ", "return ", "x", "new ", "<A ", "/>", "</A>"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randrange(60))) for _ in range(1500)]
    for k, x in enumerate(texts):
        script_facts(x, k % 2 == 0)
        native_facts(x, "go", "a.go")
        native_facts(x, "cpp", "a.hpp")
    found = extract.extract(spark.createDataFrame([(f"{k}.tsx", x, "typescript") for k, x in enumerate(texts[:100])] + [("n", None, "go"), (None, "func f() {}", "go"), ("n.ts", "(" * 5000, "typescript"), ("u", "x", None)], FILES))
    assert found.where("file = ''").count() == 1
    long = "const f0 = () => { g(1); };\n" * 3000
    assert len(script_facts(long, False)[0]) == 9000
    assert not Tokens("f({)", "go").sound and Tokens("f({})", "go").sound
