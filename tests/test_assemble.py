"""A small workspace end to end: scan, resolution, the graph, its units, levels and tests, and what comes next."""

import json

import pytest

from ravelin.operators import ledger, resolve
from ravelin.plans import assemble, planning
from ravelin.sources import trees

CONFIG = trees.Config.parse("""
state_dir = "port"
roots = ["src/ts/app/src"]
packages_dir = "src/ts"
primary_package = "@x/app"
rust_crate = "crates/app"
rust_crate_name = "app"
test_markers = ["/__tests__/", ".test.ts"]
binary_test_markers = ["/__tests__/e2e/"]
external_packages = ["@x/generated"]
[batch]
max_files = 2
max_lines = 1000
""")
A, K = "src/ts/app/src/", "src/ts/kit/src/"
TREE = {
    "src/ts/app/package.json": json.dumps({"name": "@x/app", "dependencies": {"@x/kit": "workspace:*", "@x/generated": "workspace:*", "@x/sdk": "npm:@far/sdk@1.2.3"}}),
    A + "util.ts": "export function slug(s: string): string { return s.toLowerCase(); }\n",
    A + "types.ts": 'import type { Store } from "./store";\nexport interface Options { store?: Store }\nexport const NAME = "main";\n',
    A + "store.ts": 'import { NAME, Options } from "./types";\nimport { slug } from "./util";\nimport { help } from "@x/kit/helpers";\nimport { Client } from "@x/sdk";\nimport { G } from "@x/generated";\nimport "./gone";\nimport data from "./d.json";\nimport { readFile } from "fs/promises";\nexport class Store { name = slug(NAME); }\nexport async function open(o: Options): Promise<Store> { help(); return new Store(); }\n',
    A + "cycle-a.ts": 'import { b } from "./cycle-b";\nexport const a = () => b();\n',
    A + "cycle-b.ts": 'import { a } from "./cycle-a";\nexport const b = () => a;\n',
    A + "__tests__/util.test.ts": 'import { slug } from "../util";\n',
    A + "__tests__/store.test.ts": 'import { open } from "../store";\nimport { fixture } from "./helpers/fixture";\n',
    A + "__tests__/helpers/fixture.ts": 'import { NAME } from "../../types";\nexport const fixture = {};\n',
    A + "__tests__/e2e/cli.e2e.test.ts": 'import { slug } from "../../util";\n',
    "src/ts/kit/package.json": json.dumps({"name": "@x/kit", "exports": {"./helpers": {"types": "./dist/helpers.d.ts", "default": "./dist/helpers.js"}}}),
    K + "helpers.ts": "export function help() {}\n",
    K + "unused.ts": "export const unused = 1;\n",
    K + "__tests__/far.test.ts": 'import { unused } from "../unused";\nimport { help } from "../helpers";\n',
    K + "__tests__/near.test.ts": 'import { help } from "../helpers";\n',
    "src/ts/far-sdk/package.json": json.dumps({"name": "@far/sdk"}),
    "src/ts/far-sdk/src/index.ts": "export class Client {}\n",
    "src/ts/generated/package.json": json.dumps({"name": "@x/generated"}),
    "src/ts/generated/src/index.ts": "export class G {}\n",
    A + "node_modules/z/index.ts": "export {}\n",
}


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for rel, text in TREE.items():
        (root / rel).parent.mkdir(parents=True, exist_ok=True)
        (root / rel).write_text(text)
    return assemble.from_tree(spark, f"file://{root}", CONFIG)


def rows(df, *columns):
    return sorted(tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in df.select(*columns).collect())


def test_files_edges_and_names(found):
    assert [r for r, in rows(found.files, "rel")] == sorted([A + f"{n}.ts" for n in ("cycle-a", "cycle-b", "store", "types", "util")] + [K + "helpers.ts"])
    assert dict(rows(found.files, "rel", "package"))[K + "helpers.ts"] == "@x/kit"
    assert rows(found.edges, "src", "dst", "type_only") == sorted([
        (A + "cycle-a.ts", A + "cycle-b.ts", False), (A + "cycle-b.ts", A + "cycle-a.ts", False), (A + "types.ts", A + "store.ts", True),
        (A + "store.ts", A + "types.ts", False), (A + "store.ts", A + "util.ts", False), (A + "store.ts", K + "helpers.ts", False)])
    assert {d: n for s, d, n in rows(found.edges, "src", "dst", "names") if s == A + "store.ts"}[A + "types.ts"] == ("NAME", "Options")
    assert rows(found.externals, "rel", "name") == [(A + "store.ts", n) for n in ("@far/sdk", "@x/generated", "json-asset", "node:fs/promises")]
    assert rows(found.unresolved, "rel", "specifier") == [(A + "store.ts", "./gone")]


def test_units_levels_and_tests(found):
    unit = dict(rows(found.unit_of, "node", "unit"))
    assert unit[A + "cycle-a.ts"] == unit[A + "cycle-b.ts"] and unit[A + "types.ts"] != unit[A + "store.ts"] and len(set(unit.values())) == 5
    level = dict(rows(found.levels, "node", "level"))
    assert {k: v for k, v in level.items() if v} == {A + "store.ts": 1}
    assert rows(found.unit_types, "src", "dst") == [(A + "types.ts", A + "store.ts")]
    tests = {r["test"]: r for r in found.tests.collect()}
    short = lambda x: [p.removeprefix(A) for p in x]
    assert short(tests[A + "__tests__/util.test.ts"]["deps"]) == ["util.ts"]
    store = tests[A + "__tests__/store.test.ts"]
    assert short(store["deps"]) == ["store.ts", "types.ts"] and short(store["helpers"]) == ["__tests__/helpers/fixture.ts"]
    assert tests[A + "__tests__/e2e/cli.e2e.test.ts"]["is_binary"] and not store["is_binary"]
    assert K + "__tests__/near.test.ts" in tests and K + "__tests__/far.test.ts" not in tests  # it reaches a file outside


def test_what_comes_next(spark, found):
    none = spark.createDataFrame([], ledger.SCHEMA)
    progress = planning.unit_progress(found.unit_of, none, none.select("ts"))
    lines = found.unit_of.join(found.files.withColumnRenamed("rel", "node"), "node").groupBy("unit").agg({"lines": "sum"}).withColumnRenamed("sum(lines)", "lines")
    claimed = none.select("ts").toDF("test")
    tests = found.tests.where("not is_binary").selectExpr("test", "explode(deps) dep")
    enabled = planning.tests_enabled(progress.select("unit"), tests, found.unit_of, none.select("ts").toDF("node"), claimed)
    ranked = planning.candidates(progress, found.unit_edges, found.unit_types, lines, enabled)
    got = [r["unit"] for r in ranked.orderBy("rank").collect()]
    assert got[:2] == [K + "helpers.ts", A + "util.ts"] or got[0] == A + "util.ts"
    assert got[-1] == A + "types.ts" and set(got) == {A + "util.ts", K + "helpers.ts", A + "cycle-a.ts", A + "types.ts"}


def test_a_primary_package_is_needed(spark, found):
    packages = spark.createDataFrame([], "name string, dir string, main string, exports string, deps map<string,string>")
    with pytest.raises(ValueError):
        assemble.assemble(spark.createDataFrame([], "rel string, content string"), packages, CONFIG)


# Resolution


def candidates(spark, target):
    df = spark.createDataFrame([(target,)], "t string")
    return df.select(resolve.source_candidates(df["t"]).alias("c")).first()["c"]


def test_candidates_of_targets(spark):
    got = candidates(spark, "./dist/runtime/cli.js")
    assert got[:4] == [f"src/runtime/cli{e}" for e in (".ts", ".tsx", "/index.ts", "/index.tsx")] and not any(x.startswith("dist/") for x in got)
    got = candidates(spark, "src/worker.mjs")
    assert got[4] == "src/worker.mjs" and got.index("src/worker.ts") < got.index("src/worker.mjs") and got[5:7] == ["src/worker.js", "src/worker/index.js"]
    assert candidates(spark, "lib/x") == ["lib/x.ts", "lib/x.tsx", "lib/x/index.ts", "lib/x/index.tsx", *(f"lib/x{w}.{e}" for e in ("js", "mjs", "cjs", "jsx") for w in ("", "/index"))]
    assert candidates(spark, "src/a.ts") == ["src/a.ts"] and candidates(spark, "pkg/dist/a")[0] == "pkg/dist/a.ts"


EXPORTS = {
    "map": {"./a": "./dist/a.js", "./deep/*": {"types": "./dist/*.d.ts", "bun": "./src/*.ts", "default": "./dist/*.js"}, "./no": None, "./*": "./lib/*.js", ".": {"import": {"x": "./n.js"}, "require": "./r.js"}, "./list": ["./l.js"]},
    "text": "./main.js", "bare": {"import": "./i.js"}, "none": None,
}


@pytest.mark.parametrize(("package", "key", "want"), [
    ("map", "./a", ["./dist/a.js"]), ("map", "./deep/x/y", ["./lib/deep/x/y.js"]), ("map", "./no", []), ("map", "./other", ["./lib/other.js"]),
    ("map", ".", ["./r.js"]), ("map", "./list", []), ("text", ".", ["./main.js"]), ("text", "./a", []), ("bare", ".", []), ("none", ".", []), ("absent", ".", []),
])
def test_export_maps(spark, package, key, want):
    packages = spark.createDataFrame([(k, None if v is None else json.dumps(v)) for k, v in EXPORTS.items()], "name string, exports string")
    asked = spark.createDataFrame([(package, key)], "package string, key string")
    assert resolve.export_targets(packages, asked).first()["targets"] == want


def test_conditions_come_in_their_order(spark):
    packages = spark.createDataFrame([("p", json.dumps({"./x/*": {"types": "./t/*.d.ts", "default": "./d/*.js", "bun": "./s/*.ts"}}))], "name string, exports string")
    asked = spark.createDataFrame([("p", "./x/a")], "package string, key string")
    assert resolve.export_targets(packages, asked).first()["targets"] == ["./s/a.ts", "./d/a.js", "./t/a.d.ts"]


def test_links_by_declaration(spark):
    packages = spark.createDataFrame([("app", {"kit": "workspace:*", "gone": "workspace:*", "alias": "npm:@far/sdk@1.2", "lib": "^1"}), ("kit", {}), ("lib", {})], "name string, deps map<string,string>")
    asked = spark.createDataFrame([("r", s, "app") for s in ("kit/sub", "gone", "alias/deep", "lib", "lodash/fp")] + [("q", "kit", None)], "rel string, specifier string, package string")
    got = {(r["rel"], r["specifier"]): (r["link_kind"], r["link"]) for r in resolve.links(asked, packages).collect()}
    assert got == {("r", "kit/sub"): ("workspace", "kit"), ("r", "gone"): ("npm", "gone"), ("r", "alias/deep"): ("npm", "@far/sdk"), ("r", "lib"): ("npm", "lib"), ("r", "lodash/fp"): ("npm", "lodash"), ("q", "kit"): ("npm", "kit")}
    local = {r["specifier"]: r["local"] for r in resolve.local_package(asked.where("package = 'app'"), packages).collect()}
    assert local == {"kit/sub": "kit", "gone": None, "alias/deep": None, "lib": "lib", "lodash/fp": None}


def test_rules_of_packages(spark):
    rules = spark.createDataFrame([("fs-extra", "a"), ("node:fs", "b"), ("fs", "c")], "npm string, rust string")
    asked = spark.createDataFrame([(n,) for n in ("fs-extra", "node:fs", "fs", "node:fs-extra")], "name string")
    assert {r["name"]: r["rust"] for r in resolve.package_rule(asked, rules).collect()} == {"fs-extra": "a", "node:fs": "b", "fs": "c", "node:fs-extra": None}
    assert resolve.package_rule(asked.where("name = 'fs'"), rules.where("npm = 'node:fs'")).first()["rust"] == "b"


def test_names_of_exports_are_found_in_any_form(spark):
    exports = spark.createDataFrame([("f", n, k) for n, k in (("openStore", "function"), ("Store", "class"), ("limit", "const"), ("told", "const"), ("lost", "const"), ("again", "reexport"), ("none", "const"))], "rel string, name string, kind string")
    items = spark.createDataFrame([("f", i) for i in ("open_store", "Store", "LIMIT")], "rel string, item string")
    told, old = (spark.createDataFrame(x, "rel string, name string, item string") for x in ([("f", "told", "m::x")], [("f", "lost", "m::old"), ("f", "again", "m::no")]))
    got = {r["name"]: r["item"] for r in resolve.map_exports(exports, items, told, old).collect()}
    assert got == {"openStore": "open_store", "Store": "Store", "limit": "LIMIT", "told": "m::x", "lost": "m::old", "again": None, "none": None}
