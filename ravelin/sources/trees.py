"""Source trees as DataFrames: files with their content, package manifests, configuration and rule tables."""

from __future__ import annotations

import os
import re
import tomllib
from dataclasses import dataclass, field, fields
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.functions.paths import glob_regex, line_count
from ravelin.operators.predicates import is_source

PRUNED = ("node_modules", "dist", ".git", "target")  # directories never looked into
MANIFEST = "package.json"


def _walk(root: str, glob: re.Pattern) -> list[tuple[str]]:
    """The paths below root, relative to it, of regular files; pruned directories aren't looked into."""
    out = []
    for at, dirs, names in os.walk(root):
        dirs[:] = [d for d in dirs if d not in PRUNED]
        under = os.path.relpath(at, root).replace(os.sep, "/")
        own = [n for n in names if glob.fullmatch(n) and os.path.isfile(os.path.join(at, n)) and not os.path.islink(os.path.join(at, n))]
        out += [(n if under == "." else f"{under}/{n}",) for n in own]
    return sorted(out)


def _read(root: str):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for rel in batch.column(0).to_pylist():
                with open(os.path.join(root, rel), "rb") as f:
                    text = f.read().decode("utf-8", "replace")
                yield pa.RecordBatch.from_arrays([pa.array([rel]), pa.array([text])], names=["rel", "content"])

    return run


def files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """rel, content of every file below root whose name matches glob, without those below a pruned directory. Bytes that
    aren't UTF-8 are replaced.

    A tree in a mounted folder is listed on the driver, which doesn't look into pruned directories, and read by the tasks.
    In other stores Spark's file scan reads it; that has no rows for empty files, nor for names that start with _ or a dot.
    """
    where = re.match("([a-z][a-z0-9+.-]*):", root)
    if where is None or where[1] == "file":
        plain = re.sub("^file:(//)?", "", root)
        found = spark.createDataFrame(_walk(plain, re.compile(glob_regex(glob))), "rel string")
        return found.repartition("rel").mapInArrow(_read(plain), "rel string, content string")
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    rel = F.regexp_replace("path", "^.*?" + re.sub(r"([^\w/])", r"\\\1", root.split("://", 1)[1].rstrip("/")) + "/", "")
    found = read.select(rel.alias("rel"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    return found.where(~F.arrays_overlap(F.split("rel", "/"), F.array(*map(F.lit, PRUNED))))


def source_files(spark: SparkSession, root: str, extensions: list[str]) -> DataFrame:
    """rel, content, lines of the files with one of the extensions (declaration files are none)."""
    glob = "*.{" + ",".join(extensions) + "}"
    return files(spark, root, glob).where(is_source(F.col("rel"), extensions)).withColumn("lines", line_count(F.col("content")).cast("long"))


def packages(spark: SparkSession, root: str, packages_dir: str) -> DataFrame:
    """name, dir, main, exports (JSON), deps of every named manifest one level below packages_dir. A dependency takes its
    spec from dependencies, then devDependencies, then peerDependencies. Of equal names the last directory wins."""
    level = f"^{packages_dir.strip('/')}/[^/]+/package\\.json$"
    at = F.col("content")
    kind = "struct<name:string,main:string,exports:string,dependencies:map<string,string>,devDependencies:map<string,string>,peerDependencies:map<string,string>>"
    found = files(spark, root, MANIFEST).where(F.col("rel").rlike(level)).select(F.regexp_replace("rel", "/[^/]*$", "").alias("dir"), F.from_json(at, kind).alias("m"), F.get_json_object(at, "$.exports").alias("exports"))
    each = [F.transform(F.map_entries(F.coalesce(F.col(f"m.{k}"), F.create_map().cast("map<string,string>"))), lambda e, i=i: F.struct(e["key"].alias("k"), F.lit(i).alias("ord"), e["value"].alias("v"))) for i, k in enumerate(("dependencies", "devDependencies", "peerDependencies"))]
    every = F.array_sort(F.concat(*each))
    first = F.filter(every, lambda e, i: (i == 0) | (F.get(every, i - 1)["k"] != e["k"]))
    deps = F.map_from_entries(F.transform(first, lambda e: F.struct(e["k"], e["v"])))
    named = found.where("m.name is not null and m.name <> ''").select(F.col("m.name").alias("name"), "dir", F.col("m.main").alias("main"), "exports", deps.alias("deps"))
    return named.groupBy("name").agg(F.max_by(F.struct("dir", "main", "exports", "deps"), "dir").alias("p")).select("name", "p.*")


@dataclass(frozen=True)
class Batch:
    max_files: int = 6
    max_lines: int = 800


@dataclass(frozen=True)
class Config:
    """The settings of a source tree. Paths are relative to its root."""

    roots: list[str]
    packages_dir: str
    primary_package: str
    rust_crate: str
    rust_crate_name: str
    state_dir: str = "."
    upstream: str = "origin/main"
    conventions: str | None = None
    exclude: list[str] = field(default_factory=list)
    extensions: list[str] = field(default_factory=lambda: ["ts", "tsx"])
    test_markers: list[str] = field(default_factory=list)
    binary_test_markers: list[str] = field(default_factory=list)
    external_packages: list[str] = field(default_factory=list)
    batch: Batch = field(default_factory=Batch)

    @staticmethod
    def parse(text: str) -> Config:
        """From TOML; an unknown or missing key is an error."""
        found = tomllib.loads(text)
        for kind, own in ((Config, found), (Batch, found.get("batch", {}))):
            if more := own.keys() - {f.name for f in fields(kind)}:
                raise ValueError(f"unknown keys: {', '.join(sorted(more))}")
        try:
            return Config(**found | {"batch": Batch(**found.get("batch", {}))})
        except TypeError as e:
            raise ValueError(str(e)) from None


def _toplevel(folder: str) -> str | None:
    """The root of the work tree that a folder lies in."""
    import subprocess

    try:
        found = subprocess.run(["git", "rev-parse", "--show-toplevel"], cwd=folder, capture_output=True, text=True)
    except OSError:
        return None
    return found.stdout.strip() if found.returncode == 0 else None


def discover(start: str, name: str, config: str | None = None) -> tuple[str, str, Config]:
    """root, the configuration's path below it, and the configuration: the file that is named, else the nearest `name` in
    start or above it. The root is that of the work tree, else the file's folder; a file outside the root is an error."""
    if config is not None:
        file = os.path.realpath(os.path.join(start, config))
    else:
        at = os.path.realpath(start)
        while not os.path.isfile(os.path.join(at, name)):
            if os.path.dirname(at) == at:
                raise FileNotFoundError(f"no {name} in {start} or above")
            at = os.path.dirname(at)
        file = os.path.join(at, name)
    folder = os.path.dirname(file)
    root = os.path.realpath(_toplevel(folder) or folder)
    if os.path.commonpath([root, file]) != root:
        raise ValueError(f"{file} is outside {root}")
    with open(file, encoding="utf-8") as f:
        return root, os.path.relpath(file, root).replace(os.sep, "/"), Config.parse(f.read())


def normal_argument(root: str, here: str, path: str) -> str:
    """An argument as a path below root: absolute, relative to root if that exists, else relative to here."""
    if not os.path.isabs(path):
        path = os.path.join(root if os.path.exists(os.path.join(root, path)) else here, path)
    return os.path.relpath(os.path.normpath(path), root).replace(os.sep, "/")


def crate_of(module: str, config: Config, library: tuple[str, str] | None = None) -> str:
    """The folder of the crate that a module belongs to, by its first part. library: (name, folder) of the second crate."""
    first = module.split("::", 1)[0]
    return library[1] if library and library[0] == first else config.rust_crate


def state_path(config_path: str, state_dir: str) -> str:
    """The state directory, relative to the root: `..` and `.` are applied, and the root itself is `.`"""
    out: list[str] = []
    for part in (PurePosixPath(config_path).parent / state_dir).parts:
        if part == "..":
            if not out:
                raise ValueError(f"{state_dir} is outside the tree")
            out.pop()
        elif part != ".":
            out.append(part)
    return "/".join(out) or "."


RULE_KEYS = {"construct": {"id": "", "title": "", "query": "", "rust": "", "hazards": [], "tsx_only": False, "contains": None}, "package": {"npm": "", "rust": "", "crates": [], "notes": None}}
RULE_DDL = {"construct": "id string, title string, query string, rust string, hazards array<string>, tsx_only boolean, contains string", "package": "npm string, rust string, crates array<string>, notes string"}


def rules(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """The construct and package rules of a TOML text; an unknown key or a repeated id is an error."""
    found = tomllib.loads(text)
    out = []
    for kind, defaults in RULE_KEYS.items():
        rows = found.get(kind, [])
        for row in rows:
            if more := row.keys() - defaults.keys():
                raise ValueError(f"{kind} rule with unknown keys: {', '.join(sorted(more))}")
        key = next(iter(defaults))
        ids = [r.get(key) for r in rows]
        if len(set(ids)) < len(ids):
            raise ValueError(f"{kind} rules: a {key} occurs twice")
        out.append(spark.createDataFrame([tuple((defaults | r).values()) for r in rows], RULE_DDL[kind]))
    return out[0], out[1]
