"""Kinds of tests, by what they reach: spawned processes, source files, or both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.functions.names import package_of
from ravelin.functions.paths import directory, join
from ravelin.operators.graph import closure
from ravelin.operators.predicates import is_test_case
from ravelin.operators.resolve import BUILTINS, first_candidate, links, local_package, source_candidates

# Packages and calls that start a process, packages that every test has, and prefixes of path aliases.
SPAWNERS = ("child_process", "execa", "tinyexec", "nano-spawn", "cross-spawn", "zx", "node-pty", "@lydell/node-pty")
GLOBAL_CALLS = ("Bun.spawn", "Bun.$", "Deno.Command")
RUNNERS = ("vitest", "jest", "@jest/globals", "mocha", "chai", "ava", "tap", "bun:test", "test")
ALIASES = ("@/", "~/", "#")
SHELL_NAMES = ("$", "spawn", "spawnSync")  # of the package bun


def is_alias(specifier: Column) -> Column:
    out = F.lit(False)
    for a in ALIASES:
        out = out | specifier.startswith(a)
    return out


def reach_kind(specifier: Column, kind: Column, workspace: Column, names: Column | None = None, npm: Column | None = None) -> Column:
    """What an import of a test means: spawn, source, need (another package), or nothing: types, runners, built-ins.

    npm: the package that the importer's declaration names; names: what is imported."""
    name = package_of(specifier) if npm is None else npm
    source = specifier.startswith(".") | is_alias(specifier) | F.coalesce(workspace, F.lit(False))
    bare = F.when(specifier.startswith("node:"), F.substring(specifier, 6, 1 << 20)).otherwise(name)
    shell = F.lit(False) if names is None else (specifier == "bun") & F.coalesce(F.arrays_overlap(names, F.array(*map(F.lit, SHELL_NAMES))), F.lit(False))
    plain = specifier.startswith("node:") | (specifier == "bun") | specifier.isin(*BUILTINS, *RUNNERS) | name.isin(*BUILTINS, *RUNNERS)
    return F.when(kind == "type", "nothing").when(source, "source").when(bare.isin(*SPAWNERS) | shell, "spawn").when(plain, "nothing").otherwise("need")


def process_uses(imports: DataFrame, texts: DataFrame, sources: DataFrame, packages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What each test-marked file reaches itself: uses (rel, kind, value), and the helpers that it imports (src, dst).

    imports (rel, specifier, kind, names, package) of these files; texts (rel, content): these files; sources (rel): the
    files that are no tests. A relative path below dist/ stands for the source that it was compiled from."""
    spec = F.col("specifier")
    live = imports.where("kind <> 'type'")
    ways = [join(directory(F.col("rel")), w) for w in (spec, F.regexp_replace(spec, "/dist/", "/src/"))]
    near = live.where(spec.startswith(".") & ~is_alias(spec)).select("rel", "specifier", F.array_distinct(F.concat(*map(source_candidates, ways))).alias("candidates")).distinct()
    key = ["rel", "specifier"]
    helper = first_candidate(near, texts.select("rel"), key).withColumnRenamed("file", "helper")
    source = first_candidate(near, sources, key)
    both = helper.join(source, key)
    helpers = both.where("helper is not null").select(F.col("rel").alias("src"), F.col("helper").alias("dst"))
    files = both.where("helper is null and file is not null").select("rel", F.lit("source").alias("kind"), F.col("file").alias("value"))
    known = links(local_package(live.where(~spec.startswith(".")), packages), packages)
    inside = F.col("local").isNotNull() | (F.col("link_kind") == "workspace")
    what = reach_kind(spec, F.col("kind"), inside, F.col("names"), F.col("link"))
    value = F.when(is_alias(spec), spec).otherwise(F.coalesce("local", "link"))
    named = known.select("rel", what.alias("what"), value.alias("value")).where("what <> 'nothing'").select("rel", F.col("what").alias("kind"), "value")
    calls = F.lit(False)
    for c in GLOBAL_CALLS:
        calls = calls | F.col("content").contains(c)
    started = texts.where(calls).select("rel", F.lit("spawn").alias("kind"), F.lit("global").alias("value"))
    return files.unionByName(named).unionByName(started).distinct(), helpers.distinct()


def process_tests(imports: DataFrame, texts: DataFrame, sources: DataFrame, packages: DataFrame, markers: Column | None = None) -> DataFrame:
    """test, kind (black_box, mixed, in_process), sources, needs, unmarked: every test case by how it reaches the program.
    unmarked: a black box that no marker of binary tests names."""
    uses, helpers = process_uses(imports, texts, sources, packages)
    cases = texts.where(is_test_case(F.col("rel"))).select(F.col("rel").alias("test"))
    found = classify(cases, fold_helpers(cases, uses, helpers))
    marked = F.lit(False) if markers is None else markers
    return found.withColumn("unmarked", (F.col("kind") == "black_box") & ~marked)


def group_counts(found: DataFrame) -> DataFrame:
    """kind, tests: a row for each of the three kinds."""
    every = found.sparkSession.createDataFrame([("black_box",), ("mixed",), ("in_process",)], "kind string")
    return every.join(found.groupBy("kind").agg(F.count(F.lit(1)).alias("tests")), "kind", "left").na.fill(0, ["tests"])


def fold_helpers(tests: DataFrame, uses: DataFrame, helper_edges: DataFrame) -> DataFrame:
    """test with everything its helpers use. tests (test); uses (rel, kind, value); helper_edges (src, dst) from test
    files to helpers and on."""
    through = closure(helper_edges).withColumnRenamed("src", "test")
    own = tests.select("test", F.col("test").alias("dst")).unionByName(through.join(tests, "test", "left_semi").select("test", "dst")).distinct()
    return own.join(uses.withColumnRenamed("rel", "dst"), "dst").select("test", "kind", "value")


def classify(tests: DataFrame, reached: DataFrame) -> DataFrame:
    """test, kind, sources, needs: black_box spawns and reaches no source, mixed does both, in_process doesn't spawn."""
    x = tests.select("test").join(reached, "test", "left").groupBy("test").agg(
        F.coalesce(F.bool_or(F.col("kind") == "spawn"), F.lit(False)).alias("spawns"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == "source", F.col("value")))).alias("sources"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == "need", F.col("value")))).alias("needs"),
    )
    return x.select("test", F.when(~F.col("spawns"), "in_process").when(F.size("sources") == 0, "black_box").otherwise("mixed").alias("kind"), "sources", "needs")


def test_dependencies(tests: DataFrame, edges: DataFrame, helper_edges: DataFrame, inside: DataFrame, primary: DataFrame) -> DataFrame:
    """test, deps, helpers. tests (test); edges (src, dst) from test files and helpers to anything; inside (rel): files of
    the graph; primary (test): tests that may reach files outside. Tests without dependencies are left out."""
    through = closure(helper_edges).withColumnRenamed("src", "test").join(tests, "test", "left_semi")
    helpers = through.where("test <> dst").where(~(F.col("dst").contains(".test.") | F.col("dst").contains(".spec."))).groupBy("test").agg(F.array_sort(F.collect_set("dst")).alias("helpers"))
    own = tests.select("test", F.col("test").alias("src")).unionByName(through.select("test", F.col("dst").alias("src"))).distinct()
    known = inside.select(F.col("rel").alias("dst"), F.lit(True).alias("inside"))
    hit = own.join(edges, "src").join(helper_edges.select(F.col("dst")).distinct(), "dst", "left_anti").join(known, "dst", "left")
    deps = hit.groupBy("test").agg(F.array_sort(F.collect_set(F.when(F.col("inside"), F.col("dst")))).alias("deps"), F.bool_or(F.col("inside").isNull()).alias("outside"))
    kept = deps.join(primary.select("test").withColumn("primary", F.lit(True)), "test", "left").where("size(deps) > 0 and (not outside or primary)")
    return kept.join(helpers, "test", "left").select("test", "deps", F.coalesce("helpers", F.array().cast("array<string>")).alias("helpers"))
