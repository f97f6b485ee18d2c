"""Briefs: a Markdown text for each batch, put together from its files' targets, exports, imports, rules and tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.functions.names import export_name

SHOWN_LINES = 8


def hit_lines(hits: DataFrame) -> DataFrame:
    """rel, rule, lines: the first lines of each rule in a file, and how many more there are."""
    every = hits.groupBy("rel", "rule").agg(F.array_sort(F.collect_set("line")).alias("all"))
    first = F.array_join(F.transform(F.slice("all", 1, SHOWN_LINES), lambda x: x.cast("string")), ", ")
    more = F.size("all") - SHOWN_LINES
    return every.select("rel", "rule", F.when(more > 0, F.concat(first, F.lit(" +"), more.cast("string"), F.lit(" more"))).otherwise(first).alias("lines"))


def _section(rows: DataFrame, key: str, title: str, ord_: int, line: Column) -> DataFrame:
    """One section of each file: its lines in order under a title."""
    text = F.concat(F.lit(f"### {title}\n"), F.array_join(F.array_sort(F.collect_set(line)), "\n"))
    return rows.groupBy(F.col(key).alias("rel")).agg(text.alias("text")).select("rel", F.lit(ord_).alias("ord"), "text")


def briefs(batches: DataFrame, targets: DataFrame, exports: DataFrame, edges: DataFrame, entries: DataFrame, externals: DataFrame, hits: DataFrame, tests: DataFrame, unresolved: DataFrame | None = None, unit_of: DataFrame | None = None, patches: DataFrame | None = None, widgets: DataFrame | None = None) -> DataFrame:
    """batch, brief.

    batches (batch, rel); targets (rel, path); exports (rel, name, kind); edges (src, dst, type_only); entries (ts, status,
    rust); externals (rel, name, mapping); hits (rel, rule, line); tests (rel, test). A dependency that is recorded is shown
    with its counterpart and, of its recorded symbols (entries with symbols, edges with names), those that the file
    imports; one that isn't, and is imported for its types only, is to be declared first. A file without rows for a section
    lacks that section. Given too: unresolved (rel, specifier); unit_of (node, unit), for the other files of a cycle; patches
    (path, patch), what changed since a stale file was recorded; widgets (rel, name, rust, status) that replace a file.
    """
    used = "symbols" in entries.columns and "names" in edges.columns
    done = entries.where("status <> 'in_progress'").select(F.col("ts").alias("d"), "rust", *(["symbols"] if used else []))
    own = F.transform(F.array_sort(F.map_entries(F.map_filter("symbols", lambda k, v: F.array_contains("names", k)))), lambda e: F.concat(F.lit("`"), e["key"], F.lit("` is `"), e["value"], F.lit("`"))) if used else None
    names = F.when(F.size(own) > 0, F.concat(F.lit(" ("), F.array_join(own, ", "), F.lit(")"))) if used else F.lit(None).cast("string")
    deps = edges.join(done, F.col("dst") == F.col("d"), "left")
    code = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    item = lambda *parts: F.concat(F.lit("- "), *parts)
    sections = [
        _section(exports.where("kind not in ('default', 'reexport')"), "rel", "Exports", 1, item(code(F.col("name")), F.lit(" -> "), code(export_name(F.col("name"), F.col("kind"))))),
        _section(deps.where("d is not null"), "src", "Imports that are done", 2, item(code(F.col("dst")), F.lit(" -> "), F.coalesce(code(F.col("rust")), F.lit("no counterpart")), F.coalesce(names, F.lit("")))),
        _section(deps.where("d is null and type_only"), "src", "Types to declare first", 3, item(code(F.col("dst")))),
        _section(externals, "rel", "External packages", 4, item(code(F.col("name")), F.lit(": "), F.coalesce("mapping", F.lit("NO MAPPING")))),
        _section(hit_lines(hits), "rel", "Constructs", 5, item(code(F.col("rule")), F.lit(", lines "), F.col("lines"))),
        _section(tests, "rel", "Tests", 6, item(code(F.col("test")))),
    ]
    if unresolved is not None:
        sections.append(_section(unresolved, "rel", "Unresolved imports", 7, item(code(F.col("specifier")))))
    if unit_of is not None:
        mates = unit_of.withColumnRenamed("node", "rel").join(unit_of.withColumnRenamed("node", "mate"), "unit").where("rel <> mate")
        sections.append(_section(mates, "rel", "In a cycle with", 8, item(code(F.col("mate")))))
    if widgets is not None:
        sections.append(_section(widgets, "rel", "Widgets", 9, item(code(F.col("name")), F.lit(" -> "), code(F.col("rust")), F.lit(", "), F.col("status"))))
    if patches is not None:
        sections.append(_section(patches, "path", "Changed since", 10, F.concat(F.lit("```diff\n"), F.col("patch"), F.lit("```"))))
    parts = sections[0]
    for s in sections[1:]:
        parts = parts.unionByName(s)
    below = parts.groupBy("rel").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda s: s["text"]), "\n\n").alias("below"))
    head = F.concat(F.lit("## "), code(F.col("rel")), F.coalesce(F.concat(F.lit(" -> "), code(F.col("path"))), F.lit("")))
    each = batches.select("batch", "rel").join(targets, "rel", "left").join(below, "rel", "left").select("batch", "rel", F.concat_ws("\n\n", head, "below").alias("text"))
    return each.groupBy("batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rel", "text"))), lambda s: s["text"]), "\n\n").alias("brief"))
