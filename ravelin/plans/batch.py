"""Batches as they are handed out: what is in them, what they free, their tests; scopes; and how far catching up is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.operators.graph import reach_counts
from ravelin.plans.planning import ready_units


def of_files(files: DataFrame, unit_of: DataFrame, batch: int = 1) -> DataFrame:
    """batch, unit: an explicit batch of the units of some files (rel)."""
    return files.join(unit_of.withColumnRenamed("node", "rel"), "rel").select(F.lit(batch).cast("long").alias("batch"), "unit").distinct()


def in_package(units: DataFrame, unit_of: DataFrame, files: DataFrame, package: str) -> DataFrame:
    """The rows of units (unit, ...) with a file (rel, package) of the package."""
    own = unit_of.join(files.where(F.col("package") == package).select(F.col("rel").alias("node")), "node", "left_semi").select("unit").distinct()
    return units.join(own, "unit", "left_semi")


def batch_tests(members: DataFrame, unit_of: DataFrame, tests: DataFrame, recorded: DataFrame, claimed: DataFrame, returned: DataFrame) -> DataFrame:
    """batch, test. members (batch, unit); tests (test, dep, is_binary): those that are neither binary nor claimed (test),
    touch the batch and else only recorded files (node); and the tests recorded with its stale files (returned: rel, test),
    as far as the graph has them."""
    own = members.join(unit_of, "unit").select("batch", "node")
    free = tests.where("not is_binary").join(claimed.select("test"), "test", "left_anti").select("test", "dep").distinct()
    open_ = free.join(recorded.select(F.col("node").alias("dep")), "dep", "left_anti").groupBy("test").agg(F.count(F.lit(1)).alias("missing"))
    is_open = recorded.select("node", F.lit(True).alias("here"))
    touch = free.join(own.withColumnRenamed("node", "dep"), "dep").join(is_open.withColumnRenamed("node", "dep"), "dep", "left")
    held = touch.groupBy("batch", "test").agg(F.count_if(F.col("here").isNull()).alias("mine"))
    enabled = held.join(open_, "test", "left").where("mine = coalesce(missing, 0)").select("batch", "test")
    back = own.join(returned.withColumnRenamed("rel", "node"), "node").join(tests.select("test").distinct(), "test", "left_semi").select("batch", "test")
    return enabled.unionByName(back).distinct()


def summary(members: DataFrame, lines: DataFrame, value_edges: DataFrame, progress: DataFrame, tests: DataFrame | None = None) -> DataFrame:
    """batch, units, files, lines, unlocks, downstream, tests. members (batch, unit), no unit twice; lines (unit, lines,
    files). unlocks: units not done that wait for nothing but the batch; downstream: all that depend on it, directly or
    not. tests (batch, test)."""
    size = members.join(lines, "unit").groupBy("batch").agg(F.count(F.lit(1)).alias("units"), F.sum("files").alias("files"), F.sum("lines").alias("lines"))
    todo = progress.where(~F.col("done")).select("unit")
    waits = value_edges.join(todo.withColumnRenamed("unit", "src"), "src", "left_semi").join(todo.withColumnRenamed("unit", "dst"), "dst", "left_semi").distinct()
    inside = members.select(F.col("unit").alias("dst"), "batch")
    dep = value_edges.distinct().join(inside, "dst").select("batch", "src")
    mine = members.select("batch", F.col("unit").alias("src"))
    total = waits.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    held = waits.join(inside, "dst").groupBy("batch", "src").agg(F.count(F.lit(1)).alias("k"))
    near = dep.distinct().join(todo.withColumnRenamed("unit", "src"), "src", "left_semi").join(mine, ["batch", "src"], "left_anti")
    unlocks = near.join(total, "src", "left").join(held, ["batch", "src"], "left").where("coalesce(n, 0) = coalesce(k, 0)").groupBy("batch").agg(F.count(F.lit(1)).alias("unlocks"))
    back = value_edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    downstream = reach_counts(back, members.select(F.col("unit").alias("node"), F.col("batch").alias("label"))).select(F.col("label").alias("batch"), F.col("n").alias("downstream"))
    out = size.join(unlocks, "batch", "left").join(downstream, "batch", "left")
    n = members.select("batch").distinct().withColumn("tests", F.lit(0).cast("long")) if tests is None else tests.groupBy("batch").agg(F.count(F.lit(1)).alias("tests"))
    return out.join(n, "batch", "left").na.fill(0, ["unlocks", "downstream", "tests"]).select("batch", "units", "files", "lines", "unlocks", "downstream", "tests")


def catch_up_tallies(catching: DataFrame, progress: DataFrame, value_edges: DataFrame, unit_of: DataFrame, stale: DataFrame, added: DataFrame, done_files: DataFrame) -> DataFrame:
    """One row: stale files, new files that are caught up with, deferred ones (new, but on never-ported code), and of the
    units left how many are ready, claimed, or waiting. catching (unit); stale, added, done_files (rel)."""
    left = catching.select("unit").distinct().join(progress, "unit").where("not done")
    ready = ready_units(progress, value_edges).withColumn("ready", F.lit(True))
    units = left.join(ready, "unit", "left").agg(F.count(F.lit(1)).alias("units"), F.count_if("ready").alias("ready"), F.count_if("claimed").alias("claimed"))
    new = added.select(F.col("rel").alias("node")).distinct().join(unit_of, "node").join(done_files.select(F.col("rel").alias("node")), "node", "left_anti")
    caught = catching.select("unit", F.lit(True).alias("caught")).distinct()
    files = new.join(caught, "unit", "left").agg(F.count_if("caught").alias("new"), F.count_if(F.col("caught").isNull()).alias("deferred"))
    old = stale.agg(F.count(F.lit(1)).alias("stale"))
    return old.crossJoin(files).crossJoin(units).withColumn("waiting", F.col("units") - F.col("ready") - F.col("claimed"))  # one row each


def test_counts(tests: DataFrame) -> DataFrame:
    """One row: binary, module. tests (test, is_binary)."""
    return tests.agg(F.count_if("is_binary").alias("binary"), F.count_if(~F.col("is_binary")).alias("module"))


def cycles(unit_of: DataFrame, most: int = 10) -> DataFrame:
    """unit, files, more: the largest units of several files; more: how many further ones there are."""
    sizes = unit_of.groupBy("unit").agg(F.count(F.lit(1)).alias("files")).where("files > 1")
    n = sizes.agg(F.count(F.lit(1)).alias("all"))
    return sizes.orderBy(F.desc("files"), "unit").limit(most).crossJoin(F.broadcast(n)).select("unit", "files", F.greatest(F.col("all") - most, F.lit(0)).alias("more"))  # one row


def keys_present(base: DataFrame, head: DataFrame, there: DataFrame) -> DataFrame:
    """ts of either ledger whose file exists (there: path)."""
    return base.select("ts").union(head.select("ts")).distinct().join(there.select(F.col("path").alias("ts")), "ts", "left_semi")
