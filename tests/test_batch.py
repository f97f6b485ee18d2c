"""Batches and their summaries against the definition; component tables; finding a configuration."""

import random
import subprocess

import pytest

from ravelin.plans import batch
from ravelin.sources import components, trees
from tests.test_sources import CONFIG


def test_summaries_equal_the_definition(spark):
    rng = random.Random(3)
    edges = {(a, b) for a in range(1, 30) for b in rng.sample(range(a), min(a, rng.choice([0, 1, 2])))}
    done = {n for n in range(30) if rng.random() < 0.3}
    members = {n: n % 4 for n in range(0, 30, 3)}
    files = {(n, f"f{n}{x}") for n in range(30) for x in ("a", "b")[: 1 + n % 2]}
    node = {f: n for n, f in files}
    recorded = {f for f in node if node[f] in done}
    tests = {f"t{i}": set(rng.sample(sorted(node), rng.choice([1, 2]))) for i in range(60)}
    binary, claimed = {f"t{i}" for i in range(0, 60, 7)}, {f"t{i}" for i in range(0, 60, 5)}
    returned = [("f0a", "t0"), ("f3a", "t7"), ("f3a", "gone")]
    frame = lambda rows, ddl: spark.createDataFrame(list(rows), ddl)
    m = frame([(b, n) for n, b in members.items()], "batch long, unit long")
    unit_of = frame([(f, n) for n, f in files], "node string, unit long")
    covered = batch.batch_tests(m, unit_of, frame([(t, d, t in binary) for t, own in tests.items() for d in own], "test string, dep string, is_binary boolean"), frame([(f,) for f in recorded], "node string"), frame([(t,) for t in claimed], "test string"), frame(returned, "rel string, test string"))
    lines = frame([(n, 10 * n, sum(k == n for k, _ in files)) for n in range(30)], "unit long, lines long, files long")
    progress = frame([(n, n in done, n in done, False) for n in range(30)], "unit long, done boolean, recorded boolean, claimed boolean")
    got = {r["batch"]: r for r in batch.summary(m, lines, frame(edges, "src long, dst long"), progress, covered).collect()}
    assert set(got) == {0, 1, 2, 3}
    for b, r in got.items():
        own = {n for n, k in members.items() if k == b}
        free = [d for d in range(30) if d not in own | done and any((d, x) in edges for x in own) and all(x in own | done for a, x in edges if a == d)]
        reached, todo = set(), [a for a, x in edges if x in own]
        while todo:
            a = todo.pop()
            if a not in own and a not in reached:
                reached.add(a)
                todo += [c for c, x in edges if x == a]
        mine = {f for f in node if node[f] in own}
        come = {t for t, deps in tests.items() if t not in binary | claimed and deps & mine and deps <= mine | recorded} | {t for f, t in returned if f in mine and t in tests}
        assert (r["units"], r["files"], r["lines"], r["unlocks"], r["downstream"], r["tests"]) == (len(own), len(mine), sum(10 * n for n in own), len(free), len(reached), len(come))
    picked = batch.of_files(frame([("f1a",), ("f1b",), ("f2a",)], "rel string"), unit_of).collect()
    assert sorted(map(tuple, picked)) == [(1, 1), (1, 2)]


def test_small_reports(spark):
    units = spark.createDataFrame([(i, i // 3) for i in range(40)], "node long, unit long")
    found = batch.cycles(units, 5).collect()
    assert [(r["unit"], r["files"], r["more"]) for r in found] == [(i, 3, 8) for i in range(5)]
    keys = lambda *x: spark.createDataFrame([(k,) for k in x], "ts string")
    there = spark.createDataFrame([("a",), ("c",)], "path string")
    assert sorted(r["ts"] for r in batch.keys_present(keys("a", "b"), keys("a", "c", "d"), there).collect()) == ["a", "c"]
    tests = spark.createDataFrame([("x", True), ("y", False), ("z", False)], "test string, is_binary boolean")
    assert tuple(batch.test_counts(tests).first()) == (1, 2)


TABLE = """
[library]
crate = "crates/ui"
crate_name = "ui"
goldens = "crates/ui/goldens"
golden_test = "t.test.tsx"
[[module]]
ts = "a.tsx"
rust = "a.rs"
[[widget]]
name = "List"
rust = "ui::list::List"
file = "list.rs"
from = ["a.tsx", "b.tsx"]
status = "available"
summary = "s"
[[widget]]
name = "Later"
rust = "ui::later::Later"
file = "later.rs"
status = "planned"
summary = "s"
[[ink]]
names = ["Box", "useInput"]
rust = "first"
[[ink]]
names = ["Box"]
rust = "second"
"""


def test_component_tables(spark):
    assert components.parse(spark, None) is None
    found = components.parse(spark, TABLE)
    assert found.library.ui_packages == ["ink", "react"] and found.modules.count() == 1
    assert tuple(components.widget_counts(found.widgets).first()) == (1, 1)
    names = spark.createDataFrame([("Box",), ("useInput",), ("Text",)], "name string")
    assert {r["name"]: r["rust"] for r in components.rule_of(names, found.rules).collect()} == {"Box": "first", "useInput": "first", "Text": None}
    files = spark.createDataFrame([("a.tsx",), ("b.tsx",), ("c.tsx",)], "rel string")
    assert sorted((r["rel"], r["name"]) for r in components.replaced_by(files, found.widgets).collect()) == [("a.tsx", "List"), ("b.tsx", "List")]
    edges = spark.createDataFrame([("b.tsx", "a.tsx"), ("c.jsx", "a.tsx"), ("d.ts", "a.tsx"), ("b.tsx", "a.tsx")], "src string, dst string")
    assert {r["rel"]: r["importers"] for r in components.importer_counts(files, edges).collect()} == {"a.tsx": 2, "b.tsx": 0, "c.tsx": 0}
    for bad in (TABLE + '[[module]]\nts = "a.tsx"\nrust = "x"\n', TABLE.replace("planned", "maybe"), TABLE + "other = 1\n", TABLE.replace('summary = "s"\n', "", 1), TABLE.replace('crate = "crates/ui"\n', "")):
        with pytest.raises(ValueError):
            components.parse(spark, bad)


def test_a_configuration_is_found(tmp_path):
    (tmp_path / "tool/deep/er").mkdir(parents=True)
    (tmp_path / "tool/port.toml").write_text(CONFIG)
    root, rel, found = trees.discover(str(tmp_path / "tool/deep/er"), "port.toml")
    assert (root, rel, found.rust_crate) == (str(tmp_path / "tool"), "port.toml", "c")
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    assert trees.discover(str(tmp_path / "tool/deep"), "port.toml")[:2] == (str(tmp_path), "tool/port.toml")
    assert trees.discover(str(tmp_path), "other.toml", "tool/port.toml")[:2] == (str(tmp_path), "tool/port.toml")
    with pytest.raises(FileNotFoundError):
        trees.discover(str(tmp_path / "tool"), "none.toml")
    assert trees.normal_argument("/r", "/r/a", "/r/b/../c.ts") == "c.ts" and trees.normal_argument("/r", "/r/a", "x.ts") == "a/x.ts"
    assert trees.crate_of("ui::x", found, ("ui", "crates/ui")) == "crates/ui" and trees.crate_of("app::x", found, ("ui", "crates/ui")) == "c"


def test_first_fit_equals_a_scan_and_grows_with_its_rows():
    import random
    import time

    import pandas as pd

    from ravelin.plans.planning import _first_fit

    rng = random.Random(6)

    def frame(n, files, lines):
        return pd.DataFrame([(i, 1000 + i, rng.randint(1, files), rng.randint(1, lines)) for i in rng.sample(range(n), n)], columns=["rank", "unit", "files", "lines"])

    for n, files, lines in ((60, 8, 130), (200, 3, 40), (1, 9, 9)):
        pdf, used, want = frame(n, files, lines), set(), []
        rows = sorted(pdf.itertuples(index=False))
        for seed in rows:
            if seed.rank not in used:
                f = m = 0
                for x in rows:
                    if x.rank >= seed.rank and x.rank not in used and (x is seed or (f < 6 and m < 100 and f + x.files <= 6 and m + x.lines <= 100)):
                        used.add(x.rank)
                        f, m = f + x.files, m + x.lines
                        want.append((x.rank, x.unit, seed.rank))
        assert sorted(_first_fit(6, 100)(pdf).itertuples(index=False, name=None)) == sorted(want)
    began = time.process_time()
    assert len(_first_fit(6, 100)(frame(40_000, 5, 1).assign(files=4))) == 40_000  # no two fit: a scan for each would take minutes
    assert time.process_time() - began < 20


def test_wave_makes_no_pairs(spark, monkeypatch):
    """In rounds and in one task, against a walk in order."""
    import random

    from ravelin.plans import planning

    rng = random.Random(9)
    feet = [(b, str(rng.randrange(30)) if rng.random() > 0.05 else None, rng.choice(["writes", "registers", "registers"])) for b in range(1, 40) for _ in range(rng.randrange(1, 4))]
    taken = []
    for b in range(1, 42):
        own = {(p, k) for x, p, k in feet if x == b and p is not None}
        if not any(p == q and "writes" in (k, m) for t in taken for p, k in t[1] for q, m in own):
            taken.append((b, own))
    frame = spark.createDataFrame(feet, "batch long, path string, kind string")
    monkeypatch.setattr(planning, "conflicts", None)
    for most in (planning.LOCAL_EDGES, 12):
        monkeypatch.setattr(planning, "LOCAL_EDGES", most)
        assert sorted(r["batch"] for r in planning.wave(spark.range(1, 42).withColumnRenamed("id", "batch"), frame).collect()) == [b for b, _ in taken]
