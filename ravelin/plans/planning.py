"""What comes next: readiness, ranking, batches, waves, footprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ravelin.common import settle
from ravelin.functions.paths import directory, module_of
from ravelin.operators.graph import LOCAL_EDGES, downstream_counts, in_one_task
from ravelin.operators.predicates import is_done


def unit_progress(unit_of: DataFrame, entries: DataFrame, stale: DataFrame) -> DataFrame:
    """unit, done, recorded, claimed. unit_of (node, unit) of every file; a stale file is recorded but not done."""
    s = entries.select(F.col("ts").alias("node"), is_done(F.col("status")).alias("d"), (F.col("status") == "in_progress").alias("c"))
    x = unit_of.join(s, "node", "left").join(stale.select(F.col("ts").alias("node"), F.lit(True).alias("s")), "node", "left")
    d = F.coalesce("d", F.lit(False))
    return x.groupBy("unit").agg(F.bool_and(d & F.col("s").isNull()).alias("done"), F.bool_and(d).alias("recorded"), F.bool_or(F.coalesce("c", F.lit(False))).alias("claimed"))


def ready_units(progress: DataFrame, value_edges: DataFrame) -> DataFrame:
    """unit: not done, not claimed, and every value dependency done. Edges are between units."""
    open_ = progress.where(~F.col("done")).select(F.col("unit").alias("dst"))
    blocked = value_edges.join(open_, "dst", "left_semi").select(F.col("src").alias("unit"))
    return progress.where("not done and not claimed").select("unit").join(blocked, "unit", "left_anti")


def pending_types(units: DataFrame, type_edges: DataFrame, progress: DataFrame) -> DataFrame:
    """unit, pending_types: type dependencies that are not fully recorded."""
    open_ = progress.where(~F.col("recorded")).select(F.col("unit").alias("dst"))
    n = type_edges.join(open_, "dst", "left_semi").groupBy(F.col("src").alias("unit")).agg(F.count_distinct("dst").alias("pending_types"))
    return units.select("unit").join(n, "unit", "left").select("unit", F.coalesce("pending_types", F.lit(0)).alias("pending_types"))


def unlocks(units: DataFrame, value_edges: DataFrame, progress: DataFrame) -> DataFrame:
    """unit, unlocks: units not done whose only dependency that is not done is this unit."""
    todo = progress.where(~F.col("done")).select("unit")
    waits = value_edges.join(todo.select(F.col("unit").alias("src")), "src", "left_semi").join(todo.select(F.col("unit").alias("dst")), "dst", "left_semi")
    one = waits.groupBy("src").agg(F.count_distinct("dst").alias("n"), F.min("dst").alias("unit")).where("n = 1")
    n = one.groupBy("unit").agg(F.count(F.lit(1)).alias("unlocks"))
    return units.select("unit").join(n, "unit", "left").select("unit", F.coalesce("unlocks", F.lit(0)).alias("unlocks"))


def tests_enabled(units: DataFrame, tests: DataFrame, unit_of: DataFrame, recorded: DataFrame, claimed: DataFrame) -> DataFrame:
    """unit, test: tests (test, dep) not claimed that touch the unit and else only recorded files (node)."""
    deps = tests.join(claimed.select("test"), "test", "left_anti").join(unit_of.withColumnRenamed("node", "dep"), "dep")
    open_ = deps.join(recorded.withColumnRenamed("node", "dep"), "dep", "left_anti").groupBy("test").agg(F.count_distinct("unit").alias("n"), F.min("unit").alias("only"))
    touch = deps.select("test", "unit").distinct().join(units.select("unit"), "unit", "left_semi").join(open_, "test", "left")
    return touch.where("n is null or (n = 1 and only = unit)").select("unit", "test")


def _order():
    return ["pending_types", F.desc(F.least("tests_enabled", F.lit(1))), F.desc("unlocks"), F.desc("downstream"), F.desc("tests_enabled"), "lines", "unit"]


def rank(units: DataFrame, top: int | None = None) -> DataFrame:
    """units (unit, pending_types, tests_enabled, unlocks, downstream, lines) with `rank` from 1; the first `top` only, if
    given. All units are sorted by ranges, and each range is numbered from where the one before ends."""
    if top is not None:
        return units.orderBy(*_order()).limit(top).withColumn("rank", F.row_number().over(Window.orderBy(*_order())))  # top rows
    at = settle(units.orderBy(*_order()).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = at.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row for each range
    return at.join(before, part == F.col("_p")).withColumn("rank", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at", "_p", "_before")


def candidates(progress: DataFrame, value_edges: DataFrame, type_edges: DataFrame, lines: DataFrame, enabled: DataFrame | None = None, top: int | None = None) -> DataFrame:
    """The ready units, ranked, or the first `top` of them. lines (unit, lines); enabled (unit, test)."""
    ready = settle(ready_units(progress, value_edges))
    out = pending_types(ready, type_edges, progress).join(unlocks(ready, value_edges, progress), "unit").join(downstream_counts(value_edges, ready.select(F.col("unit").alias("node"))).select(F.col("node").alias("unit"), "downstream"), "unit", "left").join(lines, "unit", "left")
    if enabled is not None:
        out = out.join(enabled.groupBy("unit").agg(F.count_distinct("test").alias("tests_enabled")), "unit", "left")
    else:
        out = out.withColumn("tests_enabled", F.lit(0).cast("long"))
    return rank(out.na.fill(0, ["downstream", "lines", "tests_enabled"]), top)


BATCH = "rank long, unit {kind}, seed_rank long"


def _first_fit(max_files: int, max_lines: int):
    """Batches of one group: a seed takes the following units that still fit; one that does not fit is passed over.

    Units of one size wait in a queue. What a seed takes of a size is always the first in its queue: had one before it been
    passed over, the size would not fit any more. So a step looks at one unit of each size that can fit."""

    def pack(pdf):
        from collections import deque

        pdf = pdf.sort_values("rank")
        rows = list(pdf.itertuples(index=False))
        queues: dict = {}
        for i, r in enumerate(rows):
            queues.setdefault((r.files, r.lines), deque()).append(i)
        sizes = [(k, q) for k, q in queues.items() if k[0] <= max_files and k[1] <= max_lines]
        out = []
        for i, seed in enumerate(rows):
            own = queues[seed.files, seed.lines]
            if not own or own[0] != i:  # taken
                continue
            own.popleft()
            files, lines = seed.files, seed.lines
            out.append((seed.rank, seed.unit, seed.rank))
            while files < max_files and lines < max_lines:
                fits = [q for (f, n), q in sizes if q and files + f <= max_files and lines + n <= max_lines]
                if not fits:
                    break
                x = rows[min(fits, key=lambda q: q[0]).popleft()]
                files, lines = files + x.files, lines + x.lines
                out.append((x.rank, x.unit, seed.rank))
        return type(pdf)(out, columns=["rank", "unit", "seed_rank"])

    return pack


def batches(ranked: DataFrame, max_files: int, max_lines: int, count: int | None = None) -> DataFrame:
    """ranked (rank, unit, dir, stubs, is_update, files, lines) to rank, unit, seed_rank, batch (from 1, by seed).

    A batch only ever takes units of its seed's directory and kind, so each such group is packed by itself. A seed may
    be larger than the limits."""
    kind = ranked.schema["unit"].dataType.simpleString()
    packed = ranked.groupBy("dir", "stubs", "is_update").applyInPandas(_first_fit(max_files, max_lines), BATCH.format(kind=kind))
    out = packed.withColumn("batch", F.dense_rank().over(Window.orderBy("seed_rank")))
    return out.where(F.col("batch") <= count) if count is not None else out


def _accept(batch, path, kind):
    """batch: in order, each that neither writes what an accepted one has nor has what an accepted one writes."""
    feet: dict = {}
    for b, p, k in zip(batch, path, kind, strict=True):
        feet.setdefault(b, []).append((p, k))
    written, held = set(), set()
    for b in sorted(feet):
        own = [(p, k == "writes") for p, k in feet[b] if p is not None]
        if not any(p in written or (writes and p in held) for p, writes in own):
            held.update(p for p, _ in own)
            written.update(p for p, writes in own if writes)
            yield (b,)


def wave(batched: DataFrame, footprints: DataFrame, count: int | None = None) -> DataFrame:
    """batch: accepted in order if it conflicts with none accepted before, see conflicts(); the first `count`, if given.

    In each round all batches that wait for no earlier one are accepted, and those that conflict with them go. A round takes
    the first batches of each path, not the pairs; what is left of few rows is walked through in one task."""
    kind = batched.schema["batch"].dataType.simpleString()
    left = settle(batched.select("batch").distinct().join(footprints.select("batch", "path", "kind").distinct(), "batch", "left"))
    taken = left.select("batch").limit(0)
    while left.limit(LOCAL_EDGES + 1).count() > LOCAL_EDGES:
        writes = F.col("kind") == "writes"
        first = left.groupBy("path").agg(F.min("batch").alias("any"), F.min(F.when(writes, F.col("batch"))).alias("writer"))
        waits = F.coalesce(F.col("writer") < F.col("batch"), F.lit(False)) | (writes & (F.col("any") < F.col("batch")))
        free = left.join(first, "path", "left").groupBy("batch").agg(F.bool_or(F.coalesce(waits, F.lit(False))).alias("waits")).where("not waits").select("batch")
        free = settle(free)
        held = left.join(free, "batch", "left_semi").groupBy("path").agg(F.bool_or(writes).alias("written"))
        rest = left.join(free, "batch", "left_anti")
        gone = rest.join(held, "path").where(F.col("written") | writes).select("batch").distinct()
        taken = taken.unionByName(free)
        left = settle(rest.join(gone, "batch", "left_anti"))
    taken = taken.unionByName(in_one_task(left, _accept, f"batch {kind}"))
    return taken.orderBy("batch").limit(count) if count is not None else taken


def conflicts(footprints: DataFrame) -> DataFrame:
    """a, b: pairs of batches that can't be worked on at once: one writes what the other writes or registers. Joined from the
    side that writes, so a parent that many only register makes no pairs."""
    x = footprints.where("kind = 'writes'").select("path", F.col("batch").alias("x"))
    y = footprints.select("path", F.col("batch").alias("y"))
    return x.join(y, "path").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def footprint(targets: DataFrame, existing: DataFrame) -> DataFrame:
    """batch, path, kind. targets (batch, crate, path, own): files that a batch writes; own ones, not those in which it only
    declares types. It registers own files in their parents, up to the first one that exists (existing: crate, path); at
    the top that is lib.rs. Paths have their crate in front."""
    whole = lambda path: F.concat_ws("/", "crate", path)
    writes = targets.select("batch", whole("path").alias("path"), F.lit("writes").alias("kind")).distinct()
    parts = F.split(F.regexp_replace("path", r"(/mod)?\.rs$", ""), "/")
    n = F.size(parts) - 1  # directories above
    dirs = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.when(n - i <= 0, F.lit("")).otherwise(F.array_join(F.slice(parts, 1, F.greatest(n - i, F.lit(1))), "/")))
    up = targets.where("own").select("batch", "crate", F.col("path").alias("target"), F.posexplode(F.array_distinct(dirs)).alias("ord", "dir"))
    up = up.withColumn("path", F.when(F.col("dir") == "", "lib.rs").otherwise(F.concat("dir", F.lit("/mod.rs"))))
    there = existing.select("crate", F.regexp_replace("path", r"(/mod)?\.rs$", "").alias("dir")).distinct().withColumn("there", F.lit(True))
    stop = up.where("dir <> ''").join(there, ["crate", "dir"]).groupBy("batch", "crate", "target").agg(F.min("ord").alias("stop"))
    registers = up.join(stop, ["batch", "crate", "target"], "left").where("stop is null or ord <= stop").select("batch", whole("path").alias("path"), F.lit("registers").alias("kind")).distinct()
    return writes.unionByName(registers)


def unit_dir(unit_of: DataFrame) -> DataFrame:
    """unit, dir: the directory of its first file."""
    return unit_of.groupBy("unit").agg(F.min("node").alias("first")).select("unit", directory(F.col("first")).alias("dir"))


def modules(targets: DataFrame) -> DataFrame:
    return targets.withColumn("module", module_of(F.col("path")))
