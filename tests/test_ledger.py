"""The ledger's commands and storage, staleness, gates, and process tests, on small fixtures."""

import datetime

import pytest
from pyspark.sql import functions as F

from ravelin.operators import ledger
from ravelin.plans import change, check, kinds, planning, reconcile

NOW = datetime.datetime(2024, 5, 1, 12)


def entry(ts, status="ported", rust="t.rs", base="r1", blobs=None, symbols=None, tests=(), provenance=(), notes=None, module="m"):
    return (1, ts, status, rust, module, NOW, base, blobs or {}, symbols or {}, list(tests), list(provenance), notes)


def ledger_of(spark, *rows):
    return spark.createDataFrame(list(rows), ledger.SCHEMA)


def test_save_keeps_the_old_ledger_until_the_new_one_is_whole(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/ledger"
    assert ledger.load(spark, path).count() == 0
    ledger.save(ledger_of(spark, entry("b"), entry("a")), path)
    assert [r["ts"] for r in ledger.load(spark, path).collect()] == ["a", "b"]
    for bad in (ledger_of(spark, entry("a"), entry("a")), ledger_of(spark, entry("a", status="odd"))):
        with pytest.raises(ValueError):
            ledger.save(bad, path)
    with pytest.raises(Exception, match="boom"):
        ledger.save(ledger_of(spark, entry("c")).withColumn("notes", F.raise_error(F.lit("boom"))), path)
    assert [r["ts"] for r in ledger.load(spark, path).collect()] == ["a", "b"]
    reader = ledger.load(spark, path)
    ledger.save(ledger.upsert(reader, ledger_of(spark, entry("c"), entry("a", status="verified"))), path)
    assert {r["ts"]: r["status"] for r in ledger.load(spark, path).collect()} == {"a": "verified", "b": "ported", "c": "ported"}
    assert reader.count() == 2  # whoever has opened the version before


def test_start_keeps_what_was_recorded(spark):
    entries = ledger_of(spark, entry("a", notes="n", blobs={"a": "1"}), entry("b", status="skipped", rust=None))
    edges = spark.createDataFrame([("a", "x"), ("c", "a"), ("c", "b")], "src string, dst string")
    units = spark.createDataFrame([("a", "a"), ("a2", "a"), ("c", "c"), ("x", "x")], "node string, unit string")
    args = spark.createDataFrame([("a",), ("c",)], "rel string")
    assert sorted(map(tuple, ledger.start_refusals(args, edges, units, entries).collect())) == [("a", "a2"), ("a", "x")]
    got = {r["ts"]: r for r in ledger.start(entries, args).collect()}
    assert {k: (r["status"], r["rust"], r["notes"]) for k, r in got.items()} == {"a": ("in_progress", "t.rs", "n"), "c": ("in_progress", None, None)}
    assert got["a"]["ts_blobs"] == {"a": "1"}


def test_done_records_symbols_tests_and_contents(spark):
    entries = ledger_of(spark, entry("a", tests=["old.test", "gone.test"], provenance=["far.test"], notes="keep"))
    args = spark.createDataFrame([("a",), ("b",)], "rel string")
    targets = spark.createDataFrame([("a", "a.rs", "c::a"), ("b", "b.rs", "c::b")], "rel string, rust string, module string")
    symbols = spark.createDataFrame([("a", "f", "c::a::f"), ("a", "g", None)], "rel string, name string, item string")
    covers = spark.createDataFrame([("old.test", "a"), ("new.test", "a")], "test string, rel string")
    given = spark.createDataFrame([("a", "new.test", False), ("b", "new.test", False), ("b", "extra.test", True)], "rel string, test string, provenance boolean")
    blobs = spark.createDataFrame([(p, f"id-{p}") for p in ("a", "b", "old.test", "new.test", "far.test")], "path string, blob string")
    got = {r["ts"]: r for r in ledger.done(entries, args, targets, symbols, covers, given, blobs, "r2", F.lit(NOW), notes=None).collect()}
    a, b = got["a"], got["b"]
    assert (a["status"], a["rust"], a["module"], a["ts_base"], a["notes"], a["ported_at"]) == ("ported", "a.rs", "c::a", "r2", "keep", NOW)
    assert a["symbols"] == {"f": "c::a::f"} and a["tests"] == ["new.test", "old.test"] and a["test_provenance"] == ["far.test", "gone.test"]
    assert set(a["ts_blobs"]) == {"a", "old.test", "new.test", "far.test"}
    assert b["tests"] == [] and b["test_provenance"] == ["extra.test"] and b["symbols"] == {} and b["ts_blobs"] == {"b": "id-b"}
    assert ledger.done(entries, args, targets, symbols, covers, given, blobs, "r2", F.lit(NOW), verified=True).first()["status"] == "verified"
    edges = spark.createDataFrame([("a", "b"), ("b", "x"), ("a", "y")], "src string, dst string")
    done = ledger_of(spark, entry("y"))
    assert [tuple(r) for r in ledger.done_refusals(args, edges, done).collect()] == [("b", "x")]
    tests = spark.createDataFrame([("src/a.test",)], "test string")
    existing = spark.createDataFrame([("src/b.test",), ("else/c.test",), ("src/d",)], "path string")
    asked = spark.createDataFrame([("src/a.test", False), ("src/z.test", False), ("src/b.test", True), ("else/c.test", True), ("src/d", True)], "test string, provenance boolean")
    assert sorted(r["test"] for r in ledger.unknown_tests(asked, tests, existing, "src", [".test"]).collect()) == ["else/c.test", "src/d", "src/z.test"]


def test_marks_leave_nothing_of_an_earlier_port(spark):
    entries = ledger_of(spark, entry("a", tests=["t"], symbols={"f": "g"}))
    blobs = spark.createDataFrame([("a", "1")], "path string, blob string")
    args = spark.createDataFrame([("a",), ("b",)], "rel string")
    got = {r["ts"]: r for r in ledger.mark(entries, args, "replaced", blobs, "r3", F.lit(NOW), module="other::m").collect()}
    assert (got["a"]["status"], got["a"]["rust"], got["a"]["module"], got["a"]["tests"], got["a"]["symbols"], got["a"]["ts_blobs"]) == ("replaced", None, "other::m", None, None, {"a": "1"})
    assert got["b"]["ts_blobs"] == {}
    assert ledger.mark(entries, args, "skipped", blobs, "r3", F.lit(NOW), reason="dead").first()["notes"] == "dead"
    with pytest.raises(ValueError):
        ledger.mark(entries, args, "ported", blobs, "r3", F.lit(NOW))


def test_staleness_looks_at_tracked_paths_only(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2x"), ("c", "3"), ("t1", "9"), ("new.test", "5")], "path string, blob string")
    entries = ledger_of(spark, entry("a", blobs={"a": "1", "old.test": "7"}), entry("b", blobs={"b": "2"}), entry("c", blobs={"c": "3", "t1": "8"}, tests=["t1"]), entry("d", blobs={"d": "4"}), entry("e", blobs={}, base="r0"), entry("a2", blobs={"a2": "1"}, tests=["new.test"], status="in_progress"), entry("z", status="in_progress", rust=None, blobs={"z": "0"}))
    snapshots = spark.createDataFrame([("r0", "e", "6")], "rev string, path string, blob string")
    got = {r["ts"]: r["paths"] for r in change.tracked_stale(entries, now, snapshots).collect()}
    assert got == {"b": ["b"], "c": ["t1"], "d": ["d"], "e": ["e"], "a2": ["a2", "new.test"]}
    stamped = {r["ts"]: r["ts_blobs"] for r in ledger.stamp_blobs(ledger_of(spark, entry("e", blobs={}, base="r0"), entry("f", blobs={"f": "1"}, base="r0")), snapshots).collect()}
    assert stamped == {"e": {"e": "6"}, "f": {"f": "1"}}


def test_gate_and_lost_entries(spark):
    names = ("fresh", "gone", "down", "again", "dead", "late")
    base = ledger_of(spark, *(entry(n) for n in names))
    head = ledger_of(spark, entry("fresh"), entry("down", status="in_progress", rust=None), entry("again", status="in_progress"), entry("late"))
    there = spark.createDataFrame([(n,) for n in names if n != "dead"], "path string")
    none = spark.createDataFrame([], "ts string, dep string")
    stale = lambda *x: spark.createDataFrame([(t, [t]) for t in x], "ts string, paths array<string>")
    bad = spark.createDataFrame([("fresh", "x"), ("late", "y")], "ts string, dep string")
    got = change.gate({"entries": base, "stale": stale("late"), "violations": bad.limit(1)}, {"entries": head, "stale": stale("fresh", "dead", "late"), "violations": bad}, there)
    assert sorted(map(tuple, got.collect())) == [("imports unported", "late", "y"), ("lost entry", "down", "now in_progress"), ("lost entry", "gone", "removed"), ("newly stale", "fresh", "fresh"), ("source deleted", "dead", "dead")]
    assert change.gate({"entries": base, "stale": stale("late"), "violations": none}, {"entries": base, "stale": stale("late"), "violations": none}, there).count() == 0


def test_all_findings(spark):
    entries = ledger_of(spark, entry("a", rust="a.rs", module="c::a", symbols={"f": "c::a::f", "g": "c::a::lost", "h": "-"}, tests=["a.test", "gone.test"]), entry("b", rust=None), entry("far"), entry("nowhere"), entry("s", status="skipped", rust=None, base=None))
    rels = spark.createDataFrame([("a",), ("b",), ("s",), ("x",)], "rel string")
    present = spark.createDataFrame([("a",), ("b",), ("s",), ("x",), ("far",), ("a.rs",)], "path string")
    edges = spark.createDataFrame([("a", "x"), ("a", "b")], "src string, dst string")
    targets = spark.createDataFrame([("a", "a.rs"), ("x", "a.rs")], "source string, path string")
    items = spark.createDataFrame([("a.rs", "c::a::f")], "path string, item string")
    exports = spark.createDataFrame([("a", n, k) for n, k in (("f", "function"), ("new", "const"), ("re", "reexport"))], "rel string, name string, kind string")
    tests = spark.createDataFrame([("a.test",)], "test string")
    uses = spark.createDataFrame([("a", "lodash"), ("b", "lodash"), ("a", "known")], "rel string, name string")
    rules = spark.createDataFrame([("known", "k")], "npm string, rust string")
    declared = spark.createDataFrame([("m",)], "module string")
    got = check.findings(entries, rels, present, edges, targets, items, exports, tests, uses, rules, declared)
    assert sorted((r["rule"], r["subject"], r["detail"]) for r in got.collect() if r["severity"] == "error") == sorted([
        ("imports unported", "a", "x"), ("source gone", "nowhere", None), ("no target", "b", None), ("target missing", "far", "t.rs"), ("target missing", "nowhere", "t.rs"),
        ("symbol not found", "a", "c::a::lost"), ("test not in graph", "a", "gone.test"), ("target collision", "a.rs", "a, x"), ("module not declared", "a", "c::a")])
    assert sorted((r["rule"], r["subject"], r["detail"]) for r in got.collect() if r["severity"] == "warning") == [("export unmapped", "a", "new"), ("external unmapped", "lodash", "2"), ("no base", "s", None), ("not reachable", "far", None)]
    assert not check.verdict(got).first()["passed"]
    names = spark.createDataFrame([("a", "x", "T"), ("a", "x", "U"), ("a", "s", "V"), ("b", "x", "T")], "rel string, dst string, name string")
    there = spark.createDataFrame([("x", "T")], "rel string, item string")
    assert [tuple(r) for r in check.missing_types(entries, names, there, spark.createDataFrame([("a",)], "rel string")).collect()] == [("a", "x", "U")]


# Process tests

PACKAGES = [("app", {"kit": "workspace:*", "pinned": "1.0", "sh": "npm:execa@9"}), ("kit", {}), ("pinned", {})]
IMPORTS = {
    "t/black.test.ts": [("execa", "value", ["execa"]), ("vitest", "value", []), ("node:fs", "value", []), ("events/x", "value", []), ("strip-ansi", "value", [])],
    "t/mixed.test.ts": [("child_process", "value", []), ("../src/a", "value", [])], "t/types.test.ts": [("node:child_process", "value", []), ("../src/a", "type", [])],
    "t/helped.test.ts": [("./run", "value", [])], "t/run.ts": [("zx", "value", []), ("kit/x", "value", [])], "t/plain.test.ts": [("../src/a", "value", [])],
    "t/bun.test.ts": [("bun", "value", ["$"])], "t/bun2.test.ts": [("bun", "value", ["file"])], "t/call.test.ts": [("../dist/a.js", "value", [])], "t/alias.test.ts": [("@/x", "value", []), ("sh", "value", [])],
    "t/pin.test.ts": [("pinned", "value", []), ("cross-spawn", "value", [])],
}


def test_process_tests_by_what_they_reach(spark):
    imports = spark.createDataFrame([(rel, s, k, n, "app") for rel, own in IMPORTS.items() for s, k, n in own], "rel string, specifier string, kind string, names array<string>, package string")
    texts = spark.createDataFrame([(rel, "await Bun.spawn(x)" if "call" in rel else "") for rel in IMPORTS], "rel string, content string")
    sources = spark.createDataFrame([("src/a.ts",)], "rel string")
    packages = spark.createDataFrame(PACKAGES, "name string, deps map<string,string>")
    got = {r["test"].split("/")[1].split(".")[0]: r for r in kinds.process_tests(imports, texts, sources, packages, F.col("test").contains("black")).collect()}
    assert {k: r["kind"] for k, r in got.items()} == {"black": "black_box", "mixed": "mixed", "types": "black_box", "helped": "mixed", "plain": "in_process", "bun": "black_box", "bun2": "in_process", "call": "mixed", "alias": "mixed", "pin": "mixed"}
    assert got["black"]["needs"] == ["strip-ansi"] and got["helped"]["sources"] == ["kit"] and got["call"]["sources"] == ["src/a.ts"] and got["pin"]["sources"] == ["pinned"]
    assert {k for k, r in got.items() if r["unmarked"]} == {"types", "bun"}
    counts = {r["kind"]: r["tests"] for r in kinds.group_counts(kinds.process_tests(imports, texts, sources, packages)).collect()}
    assert counts == {"black_box": 3, "mixed": 5, "in_process": 2}


# Footprints and waves


def test_footprints(spark):
    targets = spark.createDataFrame([(1, "c", "a/b/x.rs", True), (1, "c", "a/y/mod.rs", True), (2, "c", "t.rs", False), (2, "d", "lib.rs", True)], "batch long, crate string, path string, own boolean")
    existing = spark.createDataFrame([("c", "a.rs"), ("c", "q/mod.rs")], "crate string, path string")
    got = sorted(map(tuple, planning.footprint(targets, existing).collect()))
    assert got == sorted([(1, "c/a/b/x.rs", "writes"), (1, "c/a/y/mod.rs", "writes"), (1, "c/a/b/mod.rs", "registers"), (1, "c/a/mod.rs", "registers"), (2, "c/t.rs", "writes"), (2, "d/lib.rs", "writes"), (2, "d/lib.rs", "registers")])


def test_conflicts_equal_the_definition(spark):
    feet = [(1, "p", "registers"), (2, "p", "registers"), (3, "p", "writes"), (4, "q", "writes"), (5, "q", "writes"), (6, "q", "registers"), (7, "r", "writes")]
    got = sorted(map(tuple, planning.conflicts(spark.createDataFrame(feet, "batch long, path string, kind string")).collect()))
    want = sorted({(a, b) for a, p, k in feet for b, q, m in feet if a < b and p == q and not (k == m == "registers")})
    assert got == want


def test_first_difference_of_lines(spark):
    rows = [("same", "a\nb\n", "a\nb\n"), ("changed", "a\nb\n", "a\nc\n"), ("short", "a\nb\n", "a\n"), ("end", "a", "a\n"), ("crlf", "a\r\nb", "a\nb"), ("cr", "a\r", "a"), ("empty", "", "x"), ("blank", "", "\n")]
    got = {r["k"]: (r["line"], r["old_line"], r["new_line"]) for r in reconcile.first_difference(spark.createDataFrame(rows, "k string, old string, new string"), ["k"]).collect()}
    assert got == {"changed": (2, "b", "c"), "short": (2, "b", None), "end": (None, None, None), "crlf": (None, None, None), "cr": (1, "a\r", "a"), "empty": (1, None, "x"), "blank": (1, None, "")}
