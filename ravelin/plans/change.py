"""Change tracking: snapshots of content ids against what the ledger recorded."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.operators.ledger import tracked_paths
from ravelin.operators.predicates import has_target, is_done, is_tracked


def at(snapshots: DataFrame, rev: str) -> DataFrame:
    """path, blob of one revision of snapshots (rev, path, blob)."""
    return snapshots.where(F.col("rev") == rev).select("path", "blob")


def lookup(asked: DataFrame, snapshots: DataFrame) -> DataFrame:
    """asked (rev, path) with its blob; null where the path did not exist."""
    return asked.join(snapshots, ["rev", "path"], "left")


def exists(asked: DataFrame, snapshots: DataFrame) -> DataFrame:
    """asked (rev, path) with `there`: a file of that path, or below it."""
    files = snapshots.select("rev", "path")
    parts = F.split("path", "/")
    above = files.select("rev", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("path")).distinct()
    return asked.join(above.withColumn("there", F.lit(True)), ["rev", "path"], "left").withColumn("there", F.coalesce("there", F.lit(False)))


def changed(old: DataFrame, new: DataFrame, added_only: bool = False, under: str | None = None) -> DataFrame:
    """path: added, removed or with another content, without rename detection. old, new: path, blob."""
    if under is not None:
        old, new = (x.where(F.col("path").startswith(under.rstrip("/") + "/")) for x in (old, new))
    if added_only:
        return new.select("path").join(old.select("path"), "path", "left_anti")
    a, b = old.select("path", F.col("blob").alias("a")), new.select("path", F.col("blob").alias("b"))
    return a.join(b, "path", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("path")


def stale(entries: DataFrame, now: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """ts, paths: entries whose tracked paths have another content now (path, blob) than recorded, and which of them.

    A path that is missing on one side only differs; a recorded path that is no longer tracked doesn't count. Entries
    without recorded contents are compared with the snapshot of their base revision."""
    paths = tracked_paths(entries).join(entries.select("ts", "ts_base", "ts_blobs"), "ts")
    known = F.coalesce(F.size("ts_blobs") > 0, F.lit(False))
    recorded = entries.select("ts", F.explode("ts_blobs").alias("path", "old"))
    mine = paths.where(known).select("ts", "path").join(recorded, ["ts", "path"], "left")
    if snapshots is not None:
        base = paths.where(~known).select("ts", "path", F.col("ts_base").alias("rev")).join(snapshots, ["rev", "path"], "left").select("ts", "path", F.col("blob").alias("old"))
        mine = mine.unionByName(base)
    moved = mine.join(now, "path", "left").where(~F.col("old").eqNullSafe(F.col("blob")))
    return moved.groupBy("ts").agg(F.array_sort(F.collect_set("path")).alias("paths"))


def tracked_stale(entries: DataFrame, now: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    return stale(entries.where(is_tracked(F.col("status"), F.col("rust")) & F.col("ts_base").isNotNull()), now, snapshots)


def upstream_state(entries: DataFrame, oldest: DataFrame, now: DataFrame, under: str, snapshots: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Stale tracked ports; and files below `under` that were added since the oldest base and have no entry."""
    added = changed(oldest, now, added_only=True, under=under).join(entries.select(F.col("ts").alias("path")), "path", "left_anti")
    return tracked_stale(entries, now, snapshots), added


def drift(entries: DataFrame, now: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """ts, base, paths over all entries that are done, replaced and skipped ones too."""
    done = entries.where(is_done(F.col("status")) & F.col("ts_base").isNotNull())
    return stale(done, now, snapshots).join(done.select("ts", F.left("ts_base", F.lit(12)).alias("base")), "ts").select("ts", "base", "paths")


def unstamped(entries: DataFrame) -> DataFrame:
    return entries.where(is_done(F.col("status")) & F.col("ts_base").isNull()).select("ts")


def newly_stale(base: DataFrame, head: DataFrame) -> DataFrame:
    """Rows of head (ts, ...) whose key base lacks."""
    return head.join(base.select("ts"), "ts", "left_anti")


def newly_present(base: DataFrame, head: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of head that base lacks by keys; repeated rows of head stay."""
    return head.join(base.select(*keys).distinct(), keys, "left_anti")


def lost_entries(base: DataFrame, head: DataFrame, base_stale: DataFrame, there: DataFrame) -> DataFrame:
    """ts, reason: entries with a target that were fresh at the base, whose file still exists (there: path), and that the
    head dropped or no longer tracks."""
    fresh = base.where(has_target(F.col("status"))).select("ts").join(base_stale.select("ts"), "ts", "left_anti").join(there.select(F.col("path").alias("ts")), "ts", "left_semi")
    now = head.select("ts", "status", is_tracked(F.col("status"), F.col("rust")).alias("tracked"))
    out = fresh.join(now, "ts", "left").where(~F.coalesce("tracked", F.lit(False)))
    return out.select("ts", F.when(F.col("tracked").isNull(), "removed").otherwise(F.concat(F.lit("now "), F.col("status"))).alias("reason"))


def unported_imports(entries: DataFrame, value_edges: DataFrame) -> DataFrame:
    """ts, dep: done entries with a target that import, by value, something that is not done."""
    done = entries.where(is_done(F.col("status")))
    mine = done.where(has_target(F.col("status"))).select(F.col("ts").alias("src"))
    return value_edges.select("src", "dst").join(mine, "src", "left_semi").join(done.select(F.col("ts").alias("dst")), "dst", "left_anti").select(F.col("src").alias("ts"), F.col("dst").alias("dep")).distinct()


def gate(base: dict[str, DataFrame], head: dict[str, DataFrame], there: DataFrame) -> DataFrame:
    """rule, ts, detail: what a change makes worse. base and head hold `entries`, `stale` (ts, paths) and `violations`
    (ts, dep). No row: the change passes."""
    news = newly_stale(base["stale"], head["stale"]).join(there.select(F.col("path").alias("ts"), F.lit(True).alias("there")), "ts", "left")
    rows = [
        news.select(F.when(F.col("there"), "newly stale").otherwise("source deleted").alias("rule"), "ts", F.concat_ws(", ", "paths").alias("detail")),
        newly_present(base["violations"], head["violations"], ["ts", "dep"]).select(F.lit("imports unported").alias("rule"), "ts", F.col("dep").alias("detail")),
        lost_entries(base["entries"], head["entries"], base["stale"], there).select(F.lit("lost entry").alias("rule"), "ts", F.col("reason").alias("detail")),
    ]
    return reduce(DataFrame.unionByName, rows)


def lookup_blobs(asked: DataFrame, snapshots: DataFrame) -> DataFrame:
    """asked (rev, path) with its blob, null where the path did not exist. snapshots (rev, path, blob, kind); a path that is
    no file there raises."""
    found = asked.join(snapshots.select("rev", "path", "blob", F.col("kind").alias("_kind")), ["rev", "path"], "left")
    wrong = F.raise_error(F.concat_ws(" ", F.lit("not a file:"), "path", F.lit("is a"), "_kind"))
    return found.withColumn("blob", F.when(F.col("_kind").isNull() | (F.col("_kind") == "blob"), F.col("blob")).otherwise(wrong)).drop("_kind")


def kinds_at(asked: DataFrame, snapshots: DataFrame) -> DataFrame:
    """asked (rev, path) with its kind: blob, tree (something lies below it), or null."""
    parts = F.split("path", "/")
    above = snapshots.select("rev", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("path")).where("path <> ''").distinct()
    every = snapshots.select("rev", "path", F.lit("blob").alias("kind")).unionByName(above.withColumn("kind", F.lit("tree"))).groupBy("rev", "path").agg(F.min("kind").alias("kind"))
    return asked.join(every, ["rev", "path"], "left")


def patch(old: DataFrame, new: DataFrame, paths: DataFrame) -> DataFrame:
    """path, patch: the unified difference of two revisions' texts (path, content), of the paths whose texts differ."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def unified(path, a, b):
        import difflib

        side = lambda t: (t or "").splitlines(keepends=True)
        return path.__class__(["".join(x if x.endswith("\n") else f"{x}\n\\ No newline at end of file\n" for x in difflib.unified_diff(side(x), side(y), f"a/{p}", f"b/{p}")) for p, x, y in zip(path, a, b, strict=True)])

    both = old.select("path", F.col("content").alias("a")).join(new.select("path", F.col("content").alias("b")), "path", "full_outer").join(paths.select("path").distinct(), "path", "left_semi")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select("path", unified("path", "a", "b").alias("patch"))
