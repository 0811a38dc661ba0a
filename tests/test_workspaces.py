import json

import pytest

from sparkstrata.operators import workspaces as ws

FILES = "path string, content string"


def found(spark, configs: dict, more=()):
    paths = spark.createDataFrame([(p,) for p in {*configs, *more}], "path string")
    summary, packages = ws.detect_workspaces(paths, spark.createDataFrame(list(configs.items()), FILES))
    s = summary.first()
    return s.tool, s.is_monorepo, {p.root: (p.name, p.is_private, p.dependencies) for p in packages.collect()}


def member(name, **more):
    return json.dumps({"name": name, **more})


@pytest.mark.parametrize("configs, more, want", [
    ({"pnpm-workspace.yaml": "a: 1\npackages:\n  # note\n  - 'libs/*'\n  - \"tools/one\"\n\n  - ../x\nother:\n  - apps/*\n", "libs/a/package.json": member("a", dependencies={"b": "1", "root": "1", "x": "2"}, devDependencies={"a": "1"}),
      "tools/one/package.json": member("b", private=True), "apps/c/package.json": member("c"), "package.json": member("root", workspaces=["apps/*"]), "turbo.json": "{}"}, [],
     ("pnpm", True, {"libs/a": ("a", False, ["b", "root", "a"]), "tools/one": ("b", True, [])})),
    ({"turbo.json": "{ // note\n}", "package.json": member("root", workspaces={"packages": ["./mine/*"]}), "mine/a/package.json": member("a"), "mine/b/package.json": "{}", "mine/.hid/package.json": member("h")}, [], ("turbo", False, {"mine/a": ("a", False, [])})),
    ({"nx.json": "{}", "apps/a/package.json": member("a"), "libs/b/package.json": member("b"), "modules/c/package.json": member("c"), "lerna.json": "{}"}, [], ("nx", True, {"apps/a": ("a", False, []), "libs/b": ("b", False, [])})),
    ({"lerna.json": "{}", "packages/a/package.json": member("a"), "packages/node_modules/package.json": member("n")}, [], ("lerna", False, {"packages/a": ("a", False, [])})),
    ({"lerna.json": '{"packages": ["none/*"]}', "package.json": member("r", workspaces=["w/*"]), "w/a/package.json": member("a")}, ["yarn.lock"], ("lerna", False, {"w/a": ("a", False, [])})),
    ({"package.json": member("r", workspaces=["w/*"]), "w/a/package.json": member("a")}, ["yarn.lock"], ("yarn", False, {"w/a": ("a", False, [])})),
    ({"package.json": member("r", workspaces=["w/**"]), "w/a/package.json": member("a"), "w/a/deep/package.json": member("d")}, [], ("npm", False, {"w/a": ("a", False, [])})),
    ({"services/s/package.json": member("s"), "modules/m/package.json": member("m"), "nx.json": "broken"}, ["services/t/x.ts"], ("none", True, {"services/s": ("s", False, []), "modules/m": ("m", False, [])})),
    ({"nx.json": "{}", "turbo.json": "{}", "package.json": member("r")}, ["src/x.ts"], ("nx", False, {})),
])
def test_workspaces_by_tool(spark, configs, more, want):
    assert found(spark, configs, more) == want


def test_alias_table_and_resolution(spark):
    configs = {
        "tsconfig.json": '{ /* c */ "compilerOptions": {"baseUrl": "./app", "paths": {"@/*": ["app/*", "lib/*"], "exact": ["app/one.ts"], "@long/deep/*": ["none/*"]}}}',
        "jsconfig.json": '{"compilerOptions": {"paths": {"@/*": ["other/*"], "js/*": ["app/js/*"]}}}',
        "front/tsconfig.json": '{"compilerOptions": {"paths": {"~f/*": ["./src/*"]}}}',
        "front/deep/tsconfig.json": '{"compilerOptions": {"paths": {"never/*": ["x/*"]}}}',
        "dist/tsconfig.json": '{"compilerOptions": {"paths": {"dist/*": ["x/*"]}}}',
        "package.json": '{"imports": {"#in/*": "./internal/*", "#one": {"require": "./internal/r.js", "default": "./internal/one.js"}}}',
    }
    files = ["app/one.ts", "app/two.tsx", "lib/three/index.ts", "front/src/four.ts", "internal/five.js", "internal/one.js", "app/js/six.js", "src/seven.ts", "src/utils/u.ts", "front/utils/v.ts", "app/bare.ts"]
    paths = spark.createDataFrame([(p,) for p in [*configs, *files]], "path string")
    entries = ws.alias_entries(paths, spark.createDataFrame(list(configs.items()), FILES))
    table = [(r.prefix, r.targets, r.is_wildcard, r.is_explicit) for r in entries.orderBy("nth").collect()]
    assert [x[0] for x in table if x[3]] == ["@long/deep", "exact", "#one", "#in", "js", "~f", "@", "@", ""]
    assert table[-1] == ("", ["app"], True, True) and ("@", ["app", "lib"], True, True) in table
    assert ("utils/", ["src/utils", "app/utils", "dist/utils", "front/src/utils", "front/utils", "internal/utils", "lib/utils", "utils"], True, False) not in table
    assert ("utils/", ["src/utils", "app/utils", "front/src/utils", "front/utils", "internal/utils", "lib/utils", "src/utils", "utils"], True, False) in table
    wanted = {
        "@/two": ("internal", "app/two.tsx"), "@/three": ("internal", "lib/three/index.ts"), "@/none": ("unresolved", None), "exact": ("internal", "app/one.ts"), "exactly": ("internal", "app/one.ts"),
        "@long/deep/x": ("unresolved", None), "#in/five": ("internal", "internal/five.js"), "#one": ("internal", "internal/one.js"), "js/six": ("internal", "app/js/six.js"), "~f/four": ("internal", "front/src/four.ts"),
        "utils/u": ("internal", "src/utils/u.ts"), "utils/v": ("internal", "front/utils/v.ts"), "bare": ("internal", "app/bare.ts"), "react": ("unresolved", None),
    }
    imports = spark.createDataFrame([(s,) for s in [*wanted, "./rel", "/abs"]], "specifier string")
    got = {r.specifier: (r.kind, r.path) for r in ws.resolve_aliases(imports, entries, paths).collect()}
    assert got == wanted
    guessed = ws.alias_entries(spark.createDataFrame([("src/a.ts",)], "path string"), spark.createDataFrame([], FILES))
    got = {r.specifier: (r.kind, r.path or r.name) for r in ws.resolve_aliases(spark.createDataFrame([("@/a",), ("@scope/p/q",), ("react",), ("@a",)], "specifier string"), guessed, spark.createDataFrame([("src/a.ts",)], "path string")).collect()}
    assert got == {"@/a": ("internal", "src/a.ts"), "@scope/p/q": ("external", "@scope/p"), "react": ("external", "react"), "@a": ("internal", "src/a.ts")}
