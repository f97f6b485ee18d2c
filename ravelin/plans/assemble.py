"""The dependency graph of a source tree: scan, facts, resolution, reachability, units, levels and tests, as relations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.common import settle
from ravelin.operators import graph, resolve
from ravelin.operators.predicates import excluded, has_marker, is_source, is_test_case
from ravelin.operators.scan_ts import exports_of, extract, hits_of, imports_of
from ravelin.plans.kinds import test_dependencies
from ravelin.sources import trees


@dataclass(frozen=True)
class SourceGraph:
    """files (rel, package, lines); exports; hits; edges (src, dst, type_only, names); externals (rel, name); unresolved
    (rel, specifier); tests (test, deps, helpers, is_binary, lines); unit_of (node, unit); unit_edges and unit_types
    (src, dst: by value, and by type only); levels (node, level); resolved (every import with its tag and value)."""

    files: DataFrame
    exports: DataFrame
    hits: DataFrame
    edges: DataFrame
    externals: DataFrame
    unresolved: DataFrame
    tests: DataFrame
    unit_of: DataFrame
    unit_edges: DataFrame
    unit_types: DataFrame
    levels: DataFrame
    resolved: DataFrame


def below(rels: DataFrame, dirs: DataFrame) -> DataFrame:
    """rels (rel) that lie below one of dirs (dir), by an equality join on their prefixes."""
    parts = F.split("rel", "/")
    up = rels.select("rel", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("dir"))
    return up.join(dirs.select("dir").distinct(), "dir", "left_semi").select("rel").distinct()


def assemble(sources: DataFrame, packages: DataFrame, config: trees.Config, rules: list[tuple[str, str, bool, str | None]] | None = None) -> SourceGraph:
    """sources: rel, content of the tree's files; packages: name, dir, main, exports, deps.

    A file is in the graph if a file below the roots reaches it, or a test of the primary package imports it. Only files
    of packages that aren't external are followed, no tests and nothing excluded. Tests are those of the packages that
    the graph touches; one of another package than the primary one counts only if it reaches nothing outside."""
    if not packages.where(F.col("name") == config.primary_package).take(1):
        raise ValueError(f"{config.primary_package} is not a workspace package")
    known = sources.where(is_source(F.col("rel"), config.extensions))
    facts = settle(extract(known, rules))
    named = resolve.owners(known.select("rel"), packages)
    inside = F.col("package").isNotNull() & (~F.col("package").isin(config.external_packages) if config.external_packages else F.lit(True))
    kinds = settle(named.select("rel", "package", has_marker(F.col("rel"), config.test_markers).alias("is_test"), excluded(F.col("rel"), config.exclude).alias("out"), inside.alias("inside")))
    imports = imports_of(facts)
    asked = imports.select("rel", "specifier").distinct().join(kinds.select("rel", "package"), "rel")
    resolved = settle(resolve.resolve(asked, known.select("rel"), packages, config.external_packages).select("rel", "specifier", "tag", "value"))
    links = imports.join(resolved, ["rel", "specifier"])
    to_file = links.where("tag = 'file'").select(F.col("rel").alias("src"), F.col("value").alias("dst"), "kind", "names")

    follow = kinds.where("not is_test and not out and inside").select(F.col("rel").alias("dst"))
    steps = settle(to_file.select("src", "dst").distinct().join(follow, "dst", "left_semi").join(kinds.where("not is_test").select(F.col("rel").alias("src")), "src", "left_semi"))
    roots = below(kinds.where("not is_test and not out").select("rel"), sources.sparkSession.createDataFrame([(r.strip("/"),) for r in config.roots], "dir string"))
    first = settle(graph.reachable(steps, roots.select(F.col("rel").alias("node"))))

    touched = first.join(named.withColumnRenamed("rel", "node"), "node").join(packages.select(F.col("name").alias("package"), "dir"), "package").select("dir")
    primary = packages.where(F.col("name") == config.primary_package).select("dir")
    test_files = settle(below(kinds.where("is_test and not out").select("rel"), touched))
    own = below(test_files, primary)
    more = to_file.join(own.withColumnRenamed("rel", "src"), "src", "left_semi").join(follow, "dst", "left_semi").select(F.col("dst").alias("node"))
    nodes = settle(graph.reachable(steps, first.unionByName(more)))

    rels = nodes.withColumnRenamed("node", "rel")
    files = rels.join(named, "rel").join(facts.select("rel", "lines"), "rel")
    within = to_file.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi")
    edges = settle(graph.dependency_edges(within.select("src", "dst", "kind", F.explode_outer("names").alias("name"))))
    value, types = edges.where("not type_only").select("src", "dst"), edges.where("type_only").select("src", "dst")
    unit_of = settle(nodes.join(graph.units(value), "node", "left").select("node", F.coalesce("unit", "node").alias("unit")))
    unit_edges = settle(graph.unit_edges(value, unit_of))
    unit_types = graph.unit_edges(types, unit_of).join(unit_edges, ["src", "dst"], "left_anti")
    levels = graph.levels(unit_edges, unit_of.select(F.col("unit").alias("node")))

    from_tests = to_file.join(test_files.withColumnRenamed("rel", "src"), "src", "left_semi").select("src", "dst").distinct().join(kinds.select(F.col("rel").alias("dst"), "is_test"), "dst")
    cases = test_files.where(is_test_case(F.col("rel"))).select(F.col("rel").alias("test"))
    helpers = settle(from_tests.where("is_test").select("src", "dst"))
    tests = test_dependencies(cases, from_tests.where("not is_test").select("src", "dst"), helpers, rels, own.select(F.col("rel").alias("test")))
    tests = tests.join(facts.select(F.col("rel").alias("test"), "lines"), "test").withColumn("is_binary", has_marker(F.col("test"), config.binary_test_markers))

    here = links.join(rels, "rel", "left_semi")
    return SourceGraph(
        files=files.select("rel", F.coalesce("package", F.lit("")).alias("package"), "lines"),
        exports=exports_of(facts).join(rels, "rel", "left_semi"),
        hits=hits_of(facts).join(rels, "rel", "left_semi"),
        edges=edges,
        externals=here.where("tag = 'external'").select("rel", F.col("value").alias("name")).distinct(),
        unresolved=here.where("tag = 'unresolved'").select("rel", "specifier").distinct(),
        tests=tests.select("test", "deps", "helpers", "is_binary", "lines"),
        unit_of=unit_of,
        unit_edges=unit_edges,
        unit_types=unit_types,
        levels=levels,
        resolved=resolved,
    )


def from_tree(spark: SparkSession, root: str, config: trees.Config, rules: list[tuple[str, str, bool, str | None]] | None = None) -> SourceGraph:
    """The graph of the tree below root."""
    glob = "*.{" + ",".join(config.extensions) + "}"
    return assemble(settle(trees.files(spark, root, glob)), settle(trees.packages(spark, root, config.packages_dir)), config, rules)
