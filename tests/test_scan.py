import pytest

from ravelin.operators import scan_rs, scan_ts


def imports(text):
    return [(s, k, n) for s, k, _, n in scan_ts.analyse("a.ts", text).imports]


def exports(text):
    return [(n, k, a) for n, k, _, a in scan_ts.analyse("a.ts", text).exports]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('import "x";', [("x", "value", [])]),
        ('import a, { b, type c as d } from "./x";', [("./x", "value", ["b", "c"])]),
        ("import type { A } from 'x'", [("x", "type", ["A"])]),
        ('import { type A, type B } from "x"', [("x", "type", ["A", "B"])]),
        ('import d, { type A } from "x"', [("x", "value", ["A"])]),
        ('import * as n from "x"', [("x", "value", [])]),
        ('import type from "x"', [("x", "value", [])]),
        ('export { a as b } from "x"', [("x", "reexport", ["a"])]),
        ('export * from "x"', [("x", "reexport", [])]),
        ('export type { A } from "x"', [("x", "type", ["A"])]),
        ('const m = await import("x")', [("x", "dynamic", [])]),
        ('let v: typeof import("x").Y', [("x", "type", [])]),
        ('function f(a: import("x").Y) {}', [("x", "type", [])]),
        ('type T = import("x").Y', [("x", "type", [])]),
        ('const o = { a: import("x") }', [("x", "dynamic", [])]),
        ('const r = require("x")', [("x", "require", [])]),
        ('foo.require("x"); import.meta.url', []),
        ('// import "a"\n/* import "b" */ const s = "import \'c\'"; const t = `import "d"`', []),
        ('const t = `a ${await import("x")} b`', [("x", "dynamic", [])]),
        ('const r = /import "x"/; import "y"', [("y", "value", [])]),
    ],
)
def test_imports(text, want):
    assert imports(text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("export function f() {}", [("f", "function", False)]),
        ("export async function* g() {}", [("g", "function", True)]),
        ("export abstract class C {}", [("C", "class", False)]),
        ("export interface I {} export type T = string; export enum E {}", [("I", "interface", False), ("T", "type", False), ("E", "enum", False)]),
        ("export const a = 1, b = async () => 2, c = function () {}", [("a", "const", False), ("b", "function", True), ("c", "function", False)]),
        ("export const f = (x: number): Promise<void> => {}\nexport const g = 3", [("f", "function", False), ("g", "const", False)]),
        ("export default class {}", [("default", "default", False)]),
        ("const a = 1; export { a, a as b }", [("a", "reexport", False), ("b", "reexport", False)]),
        ('export { a } from "x"', []),
        ("export namespace N {}", [("N", "namespace", False)]),
        ("export const enum K { A }", [("K", "enum", False)]),
    ],
)
def test_exports(text, want):
    assert exports(text) == want


def test_rules_and_containment():
    rules = [("await-in-loop", "for|while (", False, "await"), ("env", "process . env", False, None), ("jsx", "< /^[A-Z]/", True, None)]
    text = "for (const a of b) {\n  await f(a);\n}\nfor (const a of b) {\n  g(async () => { await f(a); });\n}\nx(process.env.A, process.env.B);\n<App/>"
    m = scan_ts.RuleMatcher(rules)
    assert [(r, n) for r, n, _ in scan_ts.analyse("a.ts", text, m).hits] == [("await-in-loop", 2), ("env", 7)]
    assert ("jsx", 8) in [(r, n) for r, n, _ in scan_ts.analyse("a.tsx", text, m).hits]
    with pytest.raises(ValueError):
        scan_ts.RuleMatcher([("x", "", False, None)])


def test_target_items():
    text = """
    // pub fn no() {}
    pub fn f() { pub_fn(); }
    pub(crate) struct S<'a> { x: &'a str }
    enum Private { A }
    pub enum E { A }
    impl<T> S<T> { pub fn m(&self) {} fn hidden() {} pub const C: u8 = 1; }
    impl Display for S { pub fn no(&self) {} }
    pub use a::{b, c as d, e::{self, g}, h::*};
    macro_rules! mac { () => {} }
    pub static mut X: u8 = 0; pub const r#type: u8 = 0;
    pub mod inner { pub fn no() {} }
    pub async unsafe fn k() {}
    """
    names = [n for n, _, _ in scan_rs.items(text)]
    assert names == ["f", "S", "E", "S::m", "b", "d", "g", "mac", "X", "type", "inner", "k"]
    assert scan_rs.declared_modules("mod a; pub mod r#b { mod c; } /* mod d; */") == ["a", "b"]


def test_extract(spark):
    files = spark.createDataFrame([("a.ts", 'import { b } from "./b"\nexport const a = 1\n'), ("b.ts", None)], "rel string, content string")
    facts = scan_ts.extract(files)
    assert [tuple(r) for r in scan_ts.imports_of(facts).collect()] == [("a.ts", 0, "./b", "value", 1, ["b"])]
    assert [tuple(r) for r in scan_ts.exports_of(facts).collect()] == [("a.ts", "a", "const", 2, False)]
    assert {r["rel"]: r["lines"] for r in facts.collect()} == {"a.ts": 2, "b.ts": 0}
