import json

import pytest

from ravelin.plans import brief, reconcile
from ravelin.sources import processes, sinks, trees
from ravelin.streaming import ledger as stream


def test_trees_prune_and_count(spark, tmp_path):
    for rel, text in {"a/x.ts": "1\n2\n", "a/y.d.ts": "z", "a/node_modules/q.ts": "n", "b/dist/w.ts": "n", "b/v.tsx": "t", "b/u.js": "j", "b/e.ts": "", "a b+c/k.ts": "é", "__tests__/_t.ts": "u\n", "b/.git/h.ts": "g", "target/i.ts": "i"}.items():
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_text(text)
    found = {r["rel"]: (r["content"], r["lines"]) for r in trees.source_files(spark, f"file://{tmp_path}", ["ts", "tsx"]).collect()}
    assert found == {"a/x.ts": ("1\n2\n", 2), "b/v.tsx": ("t", 1), "a b+c/k.ts": ("é", 1), "b/e.ts": ("", 0), "__tests__/_t.ts": ("u\n", 1)}


def test_packages_merge_their_dependencies(spark, tmp_path):
    for d, m in {"one": {"name": "@s/one", "exports": {"./h": "./dist/h.js"}, "dependencies": {"x": "1"}, "peerDependencies": {"x": "3", "z": "3"}, "devDependencies": {"x": "2", "y": "workspace:*"}}, "two": {"main": "m.js"}, "three": {"name": "three"}}.items():
        (tmp_path / "packages" / d).mkdir(parents=True)
        (tmp_path / "packages" / d / "package.json").write_text(json.dumps(m))
    found = {r["name"]: r for r in trees.packages(spark, f"file://{tmp_path}", "packages").collect()}
    assert set(found) == {"@s/one", "three"} and found["@s/one"]["dir"] == "packages/one"
    assert found["@s/one"]["deps"] == {"x": "1", "y": "workspace:*", "z": "3"} and json.loads(found["@s/one"]["exports"]) == {"./h": "./dist/h.js"}
    assert found["three"]["deps"] == {}


CONFIG = 'roots = ["r"]\npackages_dir = "p"\nprimary_package = "a"\nrust_crate = "c"\nrust_crate_name = "c"\n'


def test_config_and_rules(spark):
    assert trees.Config.parse(CONFIG + "[batch]\nmax_files = 2\n").batch == trees.Batch(2, 800) and trees.Config.parse(CONFIG).extensions == ["ts", "tsx"]
    for bad in (CONFIG + "other = 1\n", CONFIG + "[batch]\nsize = 1\n", 'roots = ["r"]\n'):
        with pytest.raises(ValueError):
            trees.Config.parse(bad)
    assert trees.state_path("tool/conf.toml", "../port/./x") == "port/x" and trees.state_path("conf.toml", ".") == "."
    construct, package = trees.rules(spark, '[[construct]]\nid = "a"\nquery = "q"\ntsx_only = true\n[[package]]\nnpm = "n"\nrust = "r"\n')
    assert construct.first()["tsx_only"] and package.first()["crates"] == []
    for bad in ('[[package]]\nnpm = "n"\n[[package]]\nnpm = "n"\n', '[[construct]]\nid = "a"\nmore = 1\n'):
        with pytest.raises(ValueError):
            trees.rules(spark, bad)


def test_processes_and_their_differences(spark, tmp_path):
    sh = lambda case, side, script: (case, side, ["sh", "-c", script], "in", {"V": "1"})
    rows = [sh("same", s, 'cat; echo "$V $PWD" > f; mkdir d; ln -s f l') for s in ("old", "new")]
    rows += [sh("kind", "old", "mkdir f"), sh("kind", "new", "printf '\\377' > f"), sh("signal", "old", "kill -9 $$"), sh("signal", "new", "kill -15 $$"), sh("hang", "old", "sleep 60"), sh("hang", "new", "sleep 60 & sleep 60")]
    seen = processes.observe(spark.createDataFrame(rows, "case string, side string, args array<string>, stdin string, env map<string,string>"), 2.0).cache()
    one = seen.where("case = 'same' and side = 'old'").first()
    assert (one["exit"], one["stdout"]) == ("0", "in") and [tuple(f) for f in one["files"]] == [("d", "dir", ""), ("f", "text", "1 <WORK>\n"), ("l", "symlink", "f")]
    found = {(r["case"], r["what"]) for r in reconcile.differences(seen.drop("files"), processes.observed_files(seen)).collect()}
    assert {c for c, _ in found} == {"kind", "signal", "hang"} and ("hang", "timeout") in found
    sinks.keep_outputs(seen, f"file://{tmp_path}/out")
    assert spark.read.json(f"file://{tmp_path}/out").count() == 8


def test_json_and_gate(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert json.loads(sinks.json_rows(df).first()["value"]) == {"a": 1, "b": None}
    assert not sinks.passes(df) and sinks.passes(df.where("a > 1"))


def test_briefs(spark, tmp_path):
    make = spark.createDataFrame
    found = brief.briefs(
        make([(1, "a.ts"), (1, "b.ts"), (2, "c.ts")], "batch int, rel string"),
        make([("a.ts", "a.rs")], "rel string, path string"),
        make([("a.ts", "doIt", "function"), ("a.ts", "default", "default"), ("a.ts", "MAX", "const")], "rel string, name string, kind string"),
        make([("a.ts", "z.ts", False), ("a.ts", "t.ts", True)], "src string, dst string, type_only boolean"),
        make([("z.ts", "ported", "z.rs")], "ts string, status string, rust string"),
        make([("b.ts", "chalk", None)], "rel string, name string, mapping string"),
        make([("b.ts", "throw", i) for i in range(1, 11)], "rel string, rule string, line long"),
        make([("a.ts", "a.test.ts")], "rel string, test string"),
    )
    text = {r["batch"]: r["brief"] for r in found.collect()}
    assert text[1] == "## `a.ts` -> `a.rs`\n\n### Exports\n- `MAX` -> `MAX`\n- `doIt` -> `do_it`\n\n### Imports that are done\n- `z.ts` -> `z.rs`\n\n### Types to declare first\n- `t.ts`\n\n### Tests\n- `a.test.ts`\n\n## `b.ts`\n\n### External packages\n- `chalk`: NO MAPPING\n\n### Constructs\n- `throw`, lines 1, 2, 3, 4, 5, 6, 7, 8 +2 more"
    assert text[2] == "## `c.ts`"
    sinks.write_briefs(found, f"file://{tmp_path}/briefs")
    assert len(spark.read.text(f"file://{tmp_path}/briefs", wholetext=True).collect()) == 2


def test_a_streamed_ledger_is_last_write_wins(spark, tmp_path):
    schema = "ts string, at timestamp, status string"
    rows = [[("a", "2026-01-01 00:00:00", "in_progress"), ("b", "2026-01-01 00:00:01", "ported")], [("a", "2026-01-02 00:00:00", "ported"), ("b", "2025-01-01 00:00:00", "skipped")]]
    for part in rows:
        spark.createDataFrame(part, "ts string, at string, status string").selectExpr("ts", "cast(at as timestamp) at", "status").write.mode("append").parquet(f"file://{tmp_path}/in")
        stream.keep(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in"), f"file://{tmp_path}/ledger", f"file://{tmp_path}/check", "ts", "at").awaitTermination()
    assert {r["ts"]: r["status"] for r in stream.read(spark, f"file://{tmp_path}/ledger", "ts", "at").collect()} == {"a": "ported", "b": "ported"}
