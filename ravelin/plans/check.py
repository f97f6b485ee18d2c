"""Consistency rules over ledger, graph and targets: each a relation (rule, severity, subject, detail); and their union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.operators.predicates import has_target, is_done
from ravelin.operators.resolve import package_rule
from ravelin.plans.change import unported_imports


def _rows(df: DataFrame, rule: str, severity: str, subject: str, detail) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.col(subject).alias("subject"), (detail if detail is not None else F.lit(None)).cast("string").alias("detail"))


def target_collisions(targets: DataFrame) -> DataFrame:
    """path, sources: target files that several sources map to. targets (source, path)."""
    return targets.groupBy("path").agg(F.array_sort(F.collect_set("source")).alias("sources")).where("size(sources) > 1")


def unmapped_externals(uses: DataFrame, rules: DataFrame) -> DataFrame:
    """name, files: externals (uses: rel, name) without a package rule."""
    n = uses.groupBy("name").agg(F.count_distinct("rel").alias("files"))
    return package_rule(n, rules).where("rust is null").select("name", "files")


def externals_report(uses: DataFrame, rules: DataFrame) -> DataFrame:
    n = uses.groupBy("name").agg(F.count_distinct("rel").alias("files"))
    return package_rule(n, rules).select("name", "files", F.coalesce("rust", F.lit("NO MAPPING")).alias("mapping"))


def rule_hits(rules: DataFrame, hits: DataFrame) -> DataFrame:
    """id, occurrences, files; rules without a hit too. hits (rel, rule, line), one row each."""
    n = hits.dropDuplicates(["rel", "rule", "line"]).groupBy(F.col("rule").alias("id")).agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct("rel").alias("files"))
    return rules.select("id").join(n, "id", "left").na.fill(0, ["occurrences", "files"])


def missing_types(entries: DataFrame, type_names: DataFrame, items: DataFrame, batch: DataFrame) -> DataFrame:
    """rel, dst, name: names that files of the batch (rel) import type-only from files that are neither done nor in the
    batch, which their target has not declared yet. type_names (rel, dst, name), items (rel, item)."""
    done = entries.where(is_done(F.col("status"))).select(F.col("ts").alias("dst"))
    need = type_names.join(batch.select("rel"), "rel", "left_semi").join(done, "dst", "left_anti").join(batch.select(F.col("rel").alias("dst")), "dst", "left_anti")
    return need.join(items.select(F.col("rel").alias("dst"), F.col("item").alias("name")), ["dst", "name"], "left_anti").select("rel", "dst", "name").distinct()


def findings(entries: DataFrame, graph_files: DataFrame, present: DataFrame, value_edges: DataFrame, targets: DataFrame, items: DataFrame, exports: DataFrame, tests: DataFrame, uses: DataFrame, rules: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """All rules at once.

    entries: the ledger; graph_files (rel); present (path): files that exist; targets (source, path); items (path, item)
    of target files; exports (rel, name, kind); tests (test) of the graph; uses (rel, name) of externals; rules (npm,
    rust); declared (module): modules that their parent names."""
    done = entries.where(is_done(F.col("status")))
    ported = entries.where(has_target(F.col("status")))
    here = present.select(F.col("path").alias("ts"), F.lit(True).alias("here"))
    astray = entries.join(graph_files.select(F.col("rel").alias("ts")), "ts", "left_anti").join(here, "ts", "left")
    symbols = ported.select("ts", "rust", "module", F.explode("symbols").alias("name", "item"))
    own = symbols.where("item <> '-' and (module is null or startswith(item, module) or not contains(item, '::'))")
    kept = exports.where(~F.col("kind").isin("reexport", "default")).select(F.col("rel").alias("ts"), "name")
    rows = [
        _rows(unported_imports(entries, value_edges), "imports unported", "error", "ts", F.col("dep")),
        _rows(astray.where("here"), "not reachable", "warning", "ts", None),
        _rows(astray.where("here is null"), "source gone", "error", "ts", None),
        _rows(done.where("ts_base is null"), "no base", "warning", "ts", None),
        _rows(ported.where("rust is null"), "no target", "error", "ts", None),
        _rows(ported.where("rust is not null").join(present.select(F.col("path").alias("rust")), "rust", "left_anti"), "target missing", "error", "ts", F.col("rust")),
        _rows(own.join(items.select(F.col("path").alias("rust"), "item"), ["rust", "item"], "left_anti"), "symbol not found", "error", "ts", F.col("item")),
        _rows(kept.join(ported.select("ts"), "ts", "left_semi").join(symbols.select("ts", "name"), ["ts", "name"], "left_anti"), "export unmapped", "warning", "ts", F.col("name")),
        _rows(entries.select("ts", F.explode("tests").alias("test")).join(tests.select("test"), "test", "left_anti"), "test not in graph", "error", "ts", F.col("test")),
        _rows(target_collisions(targets).withColumn("d", F.concat_ws(", ", "sources")), "target collision", "error", "path", F.col("d")),
        _rows(unmapped_externals(uses, rules), "external unmapped", "warning", "name", F.col("files")),
    ]
    if declared is not None:
        rows.append(_rows(ported.where("module is not null and module <> ''").join(declared.select("module"), "module", "left_anti"), "module not declared", "error", "ts", F.col("module")))
    return reduce(DataFrame.unionByName, rows)


def widget_findings(modules: DataFrame, widgets: DataFrame, graph_files: DataFrame, present: DataFrame, items: DataFrame, goldens: DataFrame, sources: DataFrame, ported: DataFrame) -> DataFrame:
    """Rules for user-interface parts. modules (ts), widgets (name, file, item, golden, status, from_ts), goldens (name),
    sources (path, content) of targets, ported (ts, rust) of ported component files."""
    known = graph_files.select(F.col("rel").alias("ts"))
    free = widgets.where("status = 'available'")
    text = sources.select("path", "content")
    calls = text.select(F.explode(F.expr(r"regexp_extract_all(content, 'golden::[A-Za-z_]+\\(\\s*\"([^\"]+)\"', 1)")).alias("name")).distinct()
    rows = [
        _rows(modules.join(known, "ts", "left_anti"), "routed module not in graph", "error", "ts", None),
        _rows(widgets.select("name", F.explode("from_ts").alias("ts")).join(known, "ts", "left_anti"), "widget source not in graph", "error", "name", F.col("ts")),
        _rows(free.join(present.select(F.col("path").alias("file")), "file", "left_anti"), "widget file missing", "error", "name", F.col("file")),
        _rows(free.join(items.select(F.col("path").alias("file"), "item"), ["file", "item"], "left_anti"), "widget item missing", "error", "name", F.col("item")),
        _rows(free.join(goldens.select(F.col("name").alias("golden")), "golden", "left_anti"), "golden missing", "error", "name", F.col("golden")),
        _rows(goldens.join(calls, "name", "left_anti"), "golden not used", "error", "name", None),
        _rows(ported.join(text.where("contains(content, 'golden::')").select(F.col("path").alias("rust")), "rust", "left_anti"), "component without golden", "error", "ts", F.col("rust")),
    ]
    return reduce(DataFrame.unionByName, rows)


def verdict(found: DataFrame) -> DataFrame:
    """One row: errors, warnings, passed."""
    return found.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings")).withColumn("passed", F.col("errors") == 0)
