"""Runs commands and records what they leave, as the observations that reconcile.differences() compares.

A case runs in a folder of its own and in its own process group. Everything that is still alive when its command has
ended, or when its time is over, is killed. Cases are spread over tasks; a lost task runs its cases anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DDL = "case string, side string, exit string, stdout string, stderr string, files array<struct<path:string,kind:string,value:string>>"


def observe_one(args: list[str], stdin: str, env: dict[str, str], seconds: float, fixture: str | None = None, root: str = "") -> tuple[str, str, str, list[tuple[str, str, str]]]:
    """exit (a code, `signal N` or `timeout`), stdout, stderr and the files left (path, kind, value). {work} in an
    argument or a variable becomes the folder, {root} the root; in all outputs, the folder becomes <WORK>. The folder starts
    as a copy of the fixture."""
    import os
    import shutil
    import signal
    import subprocess
    import tempfile

    with tempfile.TemporaryDirectory() as top:
        work = os.path.realpath(os.path.join(top, "work"))
        shutil.copytree(fixture, work, symlinks=True) if fixture else os.mkdir(work)
        expand = lambda x: x.replace("{root}", root).replace("{work}", work)
        out, err = os.path.join(top, "out"), os.path.join(top, "err")
        with open(out, "wb") as o, open(err, "wb") as e:
            run = subprocess.Popen([expand(a) for a in args], cwd=work, stdin=subprocess.PIPE, stdout=o, stderr=e, env=os.environ | {k: expand(v) for k, v in env.items()}, start_new_session=True)
            try:
                run.communicate(stdin.encode(), timeout=seconds)
                how = str(run.returncode) if run.returncode >= 0 else f"signal {-run.returncode}"
            except subprocess.TimeoutExpired:
                how = "timeout"
            try:
                os.killpg(run.pid, signal.SIGKILL)
            except OSError:
                pass
            run.wait()
        clean = lambda b: b.decode("utf-8", "replace").replace(work, "<WORK>")
        found = []
        for folder, dirs, names in os.walk(work):
            for name in [*dirs, *names]:
                path = os.path.join(folder, name)
                rel = os.path.relpath(path, work).replace(work, "<WORK>")
                if os.path.islink(path):
                    found.append((rel, "symlink", os.readlink(path).replace(work, "<WORK>")))
                elif os.path.isdir(path):
                    found.append((rel, "dir", ""))
                else:
                    with open(path, "rb") as f:
                        data = f.read()
                    try:
                        found.append((rel, "text", data.decode().replace(work, "<WORK>")))
                    except UnicodeDecodeError:
                        found.append((rel, "binary", ""))
        with open(out, "rb") as o, open(err, "rb") as e:
            return how, clean(o.read()), clean(e.read()), sorted(found)


def observe(cases: DataFrame, seconds: float = 60.0, root: str = "") -> DataFrame:
    """cases (case, side, args array<string>, stdin, env map<string,string>; also, if they are there, fixture, a folder, and
    seconds, the case's own limit) with what each run left."""
    from pyspark.sql import functions as F
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(DDL))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                how, out, err, left = observe_one(r["args"], r["stdin"] or "", dict(r["env"] or []), r["seconds"] or seconds, r["fixture"], root)
                files = [{"path": p, "kind": k, "value": v} for p, k, v in left]
                yield pa.RecordBatch.from_pylist([{"case": r["case"], "side": r["side"], "exit": how, "stdout": out, "stderr": err, "files": files}], schema=schema)

    for name, kind in (("fixture", "string"), ("seconds", "double")):
        cases = cases.withColumn(name, F.col(name).cast(kind) if name in cases.columns else F.lit(None).cast(kind))
    return cases.select("case", "side", "args", "stdin", "env", "fixture", "seconds").mapInArrow(run, DDL)


SPEC = {"old", "new", "timeout_secs", "env", "normalize", "case"}
CASE = {"name", "args", "fixture", "stdin", "accept"}
NAME = r"[A-Za-z0-9_-][A-Za-z0-9._-]*"


def spec(spark: SparkSession, text: str, base: str, only: list[str] | None = None) -> tuple[DataFrame, DataFrame, list[tuple[str, str]]]:
    """Of a TOML text: the runs for observe(), the cases (name, accept), and the rules for reconcile.normalised().

    base: the folder that fixtures are relative to; only: the names of the cases to run. Unknown keys, no command, names
    that can't be a folder's or come twice, asked names that are none, and patterns that are none are errors."""
    import os
    import re
    import tomllib

    found = tomllib.loads(text)
    rows, names = found.get("case", []), [c.get("name", "") for c in found.get("case", [])]
    if more := (found.keys() - SPEC) | {k for c in rows for k in c.keys() - CASE} | {k for r in found.get("normalize", []) for k in r.keys() ^ {"pattern", "replace"}}:
        raise ValueError(f"unknown or missing keys: {', '.join(sorted(more))}")
    if not found.get("old") or not found.get("new"):
        raise ValueError("old and new must each name a command")
    if bad := [n for n in names if not re.fullmatch(NAME, n)] or [n for n in names if names.count(n) > 1]:
        raise ValueError(f"case {bad[0]!r}: not a name, or given twice")
    if none := set(only or []) - set(names):
        raise ValueError(f"no case named {', '.join(sorted(none))}")
    for r in found.get("normalize", []):
        try:
            re.compile(r["pattern"])
        except re.error as e:
            raise ValueError(f"pattern {r['pattern']!r}: {e}") from None
    mine = [c for c in rows if not only or c["name"] in only]
    for c in mine:
        if "fixture" in c and not os.path.isdir(os.path.join(base, c["fixture"])):
            raise ValueError(f"{c['fixture']} is no folder")
    seconds, env = float(found.get("timeout_secs", 60)), found.get("env", {})
    runs = [(c["name"], side, [*found[side], *c.get("args", [])], c.get("stdin"), env, os.path.join(base, c["fixture"]) if "fixture" in c else None, seconds) for c in mine for side in ("old", "new")]
    kind = "case string, side string, args array<string>, stdin string, env map<string,string>, fixture string, seconds double"
    return spark.createDataFrame(runs, kind), spark.createDataFrame([(c["name"], c.get("accept")) for c in mine], "name string, accept string"), [(r["pattern"], r["replace"]) for r in found.get("normalize", [])]


def observed_files(observed: DataFrame) -> DataFrame:
    """case, side, path, kind, value: a row for each file left."""
    return observed.select("case", "side", "files").selectExpr("case", "side", "inline(files)")
