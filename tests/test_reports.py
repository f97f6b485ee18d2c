"""Reports and briefs as text."""

import pytest

from ravelin.plans import brief, reconcile, reports
from ravelin.sources import processes


def rows(spark, data, ddl):
    return spark.createDataFrame(data, ddl)


def test_status_and_graph(spark):
    overall = rows(spark, [(4, 40, 1, 10, 25.0, 25.0)], "files long, lines long, done_files long, done_lines long, file_pct double, line_pct double")
    packages = rows(spark, [("b", 1, 0, 5, 0), ("a", 3, 1, 35, 10)], "package string, total long, done long, lines long, done_lines long")
    text = reports.status(overall, packages, rows(spark, [("ported", 1)], "status string, n long"), rows(spark, [(2, 3)], "available long, planned long"))
    assert text == "1 of 4 files (25.0 %), 10 of 40 lines (25.0 %)\n  a: 1/3 files, 10/35 lines\n  b: 0/1 files, 0/5 lines\nported: 1\nwidgets: 2 available, 3 planned\n"
    lost = rows(spark, [(f"f{i:02}", "./x") for i in range(23)], "rel string, specifier string")
    text = reports.graph(rows(spark, [("f", 3), ("g", 4)], "rel string, lines long"), rows(spark, [("f", 0), ("g", 1), ("h", 1)], "node string, level long"), rows(spark, [("f", 3, 2)], "unit string, files long, more long"), rows(spark, [("x", 1, None), ("y", 2, "why")], "name string, files long, mapping string"), lost, rows(spark, [(1, 2)], "binary long, module long"))
    assert text.startswith("2 files, 7 lines; 2 module tests, 1 binary tests\nlevels:\n  0: 1\n  1: 2\ncycles:\n  f and 2 more files\n  ... and 2 more cycles\nexternals:\n  y (2): why\n  x (1): NO MAPPING\nunresolved:\n  f00: ./x\n")
    assert text.endswith("  f19: ./x\n... and 3 more\n")


def test_comparison(spark):
    status = rows(spark, [("b", "same", 0), ("a", "differ", 2)], "case string, status string, differences long")
    found = rows(spark, [("a", "stdout", None), ("a", "file: only new", "x")], "case string, what string, path string")
    assert reports.comparison(status, found) == "differ: a\n  file: only new x\n  stdout\nsame: b\n1 differ, 1 same\n"


def test_all_sections_of_a_brief(spark):
    batches = rows(spark, [(1, "a.tsx"), (1, "b.ts")], "batch long, rel string")
    none = lambda ddl: rows(spark, [], ddl)
    edges = rows(spark, [("a.tsx", "d.ts", False, ["f", "T"])], "src string, dst string, type_only boolean, names array<string>")
    entries = rows(spark, [("d.ts", "ported", "d.rs", {"f": "m::f", "g": "m::g"})], "ts string, status string, rust string, symbols map<string,string>")
    found = brief.briefs(
        batches, none("rel string, path string"), none("rel string, name string, kind string"), edges, entries, none("rel string, name string, mapping string"), none("rel string, rule string, line long"), none("rel string, test string"),
        rows(spark, [("a.tsx", "./gone")], "rel string, specifier string"), rows(spark, [("a.tsx", "a.tsx"), ("b.ts", "a.tsx")], "node string, unit string"),
        rows(spark, [("a.tsx", "-x\n+y\n")], "path string, patch string"), rows(spark, [("a.tsx", "List", "ui::List", "available")], "rel string, name string, rust string, status string"),
    ).first()["brief"]
    for part in ("- `d.ts` -> `d.rs` (`f` is `m::f`)", "### Unresolved imports\n- `./gone`", "### In a cycle with\n- `b.ts`", "### Widgets\n- `List` -> `ui::List`, available", "### Changed since\n```diff\n-x\n+y\n```"):
        assert part in found
    assert "m::g" not in found


SPEC = """
old = ["sh", "-c", 'cat; cat seed; echo "$R $W" > "log-$$"; ln -s /tmp/7 link; exit 3', "x"]
new = ["sh", "-c", 'cat; cat seed; echo "$R $W" > "log-9"; ln -s /tmp/8 link; exit ${1:-3}']
timeout_secs = 20
env = { R = "{root}/r", W = "{work}/w" }
[[normalize]]
pattern = "[0-9]+"
replace = "N"
[[case]]
name = "same"
stdin = "hello 12"
fixture = "fix"
[[case]]
name = "known"
fixture = "fix"
args = ["zero", "4"]
accept = "why"
"""


def test_a_comparison_from_its_file_to_its_report(spark, tmp_path):
    (tmp_path / "fix").mkdir()
    (tmp_path / "fix/seed").write_text("seed\n")
    runs, cases, rules = processes.spec(spark, SPEC, str(tmp_path))
    seen = processes.observe(runs, root="/the/root").cache()
    one = seen.where("case = 'same' and side = 'new'").first()
    assert one["exit"] == "3" and one["stdout"] == "hello 12seed\n" and {f["path"]: f["value"] for f in one["files"]} == {"link": "/tmp/8", "log-9": "/the/root/r <WORK>/w\n", "seed": "seed\n"}
    found = reconcile.differences(*reconcile.normalised(seen, processes.observed_files(seen), rules)).cache()
    status = reconcile.statuses(cases, found)
    assert {r["case"]: r["status"] for r in status.collect()} == {"same": "same", "known": "accepted"}
    assert reports.comparison(status, found) == "accepted: known\n  exit\nsame: same\n1 accepted, 1 same\n"
    assert processes.spec(spark, SPEC, str(tmp_path), ["same"])[1].count() == 1
    for bad in (SPEC.replace('"known"', '"same"'), SPEC.replace('"known"', '".k"'), SPEC.replace("[0-9]+", "["), SPEC + 'more = 1\n', SPEC.replace("new = [", "newer = ["), SPEC.replace('"fix"', '"none"')):
        with pytest.raises(ValueError):
            processes.spec(spark, bad, str(tmp_path))
    with pytest.raises(ValueError):
        processes.spec(spark, SPEC, str(tmp_path), ["other"])
