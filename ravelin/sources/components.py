"""The table of user-interface parts: routed modules, widgets, and what a framework's names become."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Library:
    crate: str
    crate_name: str
    goldens: str
    golden_test: str
    golden_command: str = "npx vitest run {test} -u"
    ui_packages: list[str] = field(default_factory=lambda: ["ink", "react"])


#: key: (name, default); a key without a default must be given
KEYS = {
    "module": {"ts": ..., "rust": ...},
    "widget": {"name": ..., "rust": ..., "file": ..., "from": [], "golden": None, "status": ..., "summary": ...},
    "ink": {"names": ..., "rust": ..., "hazards": []},
}
DDL = {
    "module": "ts string, rust string",
    "widget": "name string, rust string, file string, from_ts array<string>, golden string, status string, summary string",
    "ink": "names array<string>, rust string, hazards array<string>",
}
STATUSES = ("available", "planned")


@dataclass(frozen=True)
class Components:
    library: Library
    modules: DataFrame
    widgets: DataFrame
    rules: DataFrame


def parse(spark: SparkSession, text: str | None) -> Components | None:
    """From TOML; no text, no components. Unknown or missing keys, other states of widgets, and a module that is routed
    twice are errors."""
    if text is None:
        return None
    found = tomllib.loads(text)
    if more := found.keys() - {"library", *KEYS}:
        raise ValueError(f"unknown keys: {', '.join(sorted(more))}")
    if more := found.get("library", {}).keys() - {f.name for f in fields(Library)}:
        raise ValueError(f"library: unknown keys: {', '.join(sorted(more))}")
    tables = {}
    for kind, keys in KEYS.items():
        rows = found.get(kind, [])
        for row in rows:
            if wrong := (row.keys() - keys.keys()) | {k for k, v in keys.items() if v is ... and k not in row}:
                raise ValueError(f"{kind}: unknown or missing keys: {', '.join(sorted(wrong))}")
        tables[kind] = [tuple((keys | row).values()) for row in rows]
    if wrong := {r[5] for r in tables["widget"]} - set(STATUSES):
        raise ValueError(f"widgets can't be {', '.join(sorted(wrong))}")
    routed = [r[0] for r in tables["module"]]
    if len(set(routed)) < len(routed):
        raise ValueError("a module is routed twice")
    try:
        library = Library(**found.get("library", {}))
    except TypeError as e:
        raise ValueError(str(e)) from None
    return Components(library, *(spark.createDataFrame(tables[k], DDL[k]) for k in KEYS))


def rule_of(names: DataFrame, rules: DataFrame) -> DataFrame:
    """names (name) with the first rule that lists it: rust, hazards; null without one."""
    ordered = rules.withColumn("_at", F.monotonically_increasing_id())
    each = ordered.select(F.explode("names").alias("name"), "_at", "rust", "hazards").groupBy("name").agg(F.min_by(F.struct("rust", "hazards"), "_at").alias("r"))
    return names.join(each, "name", "left").select(*names.columns, "r.rust", "r.hazards")


def replaced_by(files: DataFrame, widgets: DataFrame) -> DataFrame:
    """rel, name, rust, status of the widgets that replace a file (rel), in whole or part."""
    each = widgets.select(F.explode("from_ts").alias("rel"), "name", "rust", "status")
    return files.select("rel").distinct().join(each, "rel")


def importer_counts(files: DataFrame, edges: DataFrame) -> DataFrame:
    """rel, importers: how many component files (.tsx, .jsx) depend on each file (rel). edges (src, dst)."""
    n = edges.where(F.col("src").rlike(r"\.[tj]sx$")).select("src", "dst").distinct().groupBy(F.col("dst").alias("rel")).agg(F.count(F.lit(1)).alias("importers"))
    return files.select("rel").join(n, "rel", "left").na.fill(0, ["importers"])


def widget_counts(widgets: DataFrame) -> DataFrame:
    """One row: available, planned."""
    return widgets.agg(F.count_if(F.col("status") == "available").alias("available"), F.count_if(F.col("status") == "planned").alias("planned"))
