"""Reports as text, from relations that are small once they are counted: a row for a package, a status, a shown item."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHOWN = 20


def first_lines(rows: DataFrame, line: F.Column, order: list, most: int = SHOWN) -> list[str]:
    """The first `most` rows as lines, and how many more there are."""
    n = rows.count()
    out = [r["line"] for r in rows.orderBy(*order).limit(most).select(line.alias("line")).collect()]
    return out + [f"... and {n - most} more"] if n > most else out


def status(overall: DataFrame, packages: DataFrame, statuses: DataFrame, widgets: DataFrame | None = None) -> str:
    """overall: one row of ledger.overall; packages: ledger.by_package; statuses: ledger.status_counts; widgets: one row of
    components.widget_counts."""
    o = overall.first()
    out = [f"{o['done_files']} of {o['files']} files ({o['file_pct']:.1f} %), {o['done_lines']} of {o['lines']} lines ({o['line_pct']:.1f} %)"]
    out += [f"  {r['package'] or '-'}: {r['done']}/{r['total']} files, {r['done_lines']}/{r['lines']} lines" for r in packages.orderBy("package").collect()]
    out += [f"{r['status']}: {r['n']}" for r in statuses.orderBy("status").collect()]
    if widgets is not None:
        w = widgets.first()
        out.append(f"widgets: {w['available']} available, {w['planned']} planned")
    return "\n".join(out) + "\n"


def graph(files: DataFrame, levels: DataFrame, cycles: DataFrame, externals: DataFrame, unresolved: DataFrame, tests: DataFrame) -> str:
    """files (rel, lines); levels (node, level); cycles (unit, files, more); externals (name, files, mapping); unresolved
    (rel, specifier); tests: one row of batch.test_counts."""
    f = files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines")).first()
    t = tests.first()
    out = [f"{f['n']} files, {f['lines']} lines; {t['module']} module tests, {t['binary']} binary tests", "levels:"]
    out += [f"  {r['level']}: {r['n']}" for r in levels.groupBy("level").agg(F.count(F.lit(1)).alias("n")).orderBy("level").collect()]
    loops = cycles.orderBy(F.desc("files"), "unit").collect()
    out += ["cycles:", *[f"  {r['unit']} and {r['files'] - 1} more files" for r in loops]] if loops else []
    out += [f"  ... and {loops[0]['more']} more cycles"] if loops and loops[0]["more"] else []
    out += ["externals:", *first_lines(externals, F.concat(F.lit("  "), "name", F.lit(" ("), F.col("files").cast("string"), F.lit("): "), F.coalesce("mapping", F.lit("NO MAPPING"))), [F.desc("files"), "name"])]
    lost = first_lines(unresolved, F.concat(F.lit("  "), "rel", F.lit(": "), "specifier"), ["rel", "specifier"])
    out += ["unresolved:", *lost] if lost else []
    return "\n".join(out) + "\n"


def comparison(statuses: DataFrame, differences: DataFrame) -> str:
    """A line for each case of reconcile.statuses, its differences below, and the tally."""
    what = F.array_sort(F.collect_set(F.concat_ws(" ", "what", "path"))).alias("what")
    rows = statuses.join(differences.groupBy("case").agg(what), "case", "left").orderBy("case").collect()  # a row for each case
    out = []
    for r in rows:
        out += [f"{r['status']}: {r['case']}", *[f"  {w}" for w in r["what"] or []]]
    n = {}
    for r in rows:
        n[r["status"]] = n.get(r["status"], 0) + 1
    return "\n".join([*out, ", ".join(f"{v} {k}" for k, v in sorted(n.items()))]) + "\n"
