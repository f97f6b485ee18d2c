"""Two-sided reconciliation of observations: texts line by line, files by path and kind."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.functions.paths import clip


def normalise(text: Column, rules: list[tuple[str, str]], work: Column | None = None) -> Column:
    """The work directory becomes <WORK>; then the rules (pattern, replacement), each on the result of the one before."""
    if work is not None:
        text = F.replace(text, work, F.lit("<WORK>"))
    return reduce(lambda t, r: F.regexp_replace(t, r[0], r[1]), rules, text)


def normalised(observations: DataFrame, files: DataFrame, rules: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Both with the rules applied: to stdout and stderr, to the names of files, to texts, and to where links point."""
    clean = lambda c: normalise(F.col(c), rules).alias(c)
    left = files.select("case", "side", clean("path"), "kind", F.when(F.col("kind").isin("text", "symlink"), normalise(F.col("value"), rules)).otherwise(F.col("value")).alias("value"))
    return observations.select("case", "side", "exit", clean("stdout"), clean("stderr")), left


def first_difference(pairs: DataFrame, key: list[str], old: str = "old", new: str = "new") -> DataFrame:
    """key, line, old_line, new_line of the first line (from 1) that differs; a side that has ended is null, and line is
    null if only line ends differ. A carriage return before a line feed is part of the line's end. Equal texts give no row."""
    differ = pairs.where(~F.col(old).eqNullSafe(F.col(new)))
    ends = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\r?\n\z", "")
    lines = lambda c: F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(ends(c), r"\r?\n", -1))
    both = F.arrays_zip(lines(F.col(old)).alias("a"), lines(F.col(new)).alias("b"))
    x = differ.select(*key, F.posexplode(both).alias("pos", "l")).where(~F.col("l.a").eqNullSafe(F.col("l.b")))
    first = x.groupBy(*key).agg(F.min_by(F.struct((F.col("pos") + 1).alias("line"), F.col("l.a").alias("old_line"), F.col("l.b").alias("new_line")), "pos").alias("d"))
    return differ.select(*key).distinct().join(first, key, "left").select(*key, "d.line", clip(F.col("d.old_line"), 200).alias("old_line"), clip(F.col("d.new_line"), 200).alias("new_line"))


def file_kind(kind: Column, value: Column) -> Column:
    """A link's kind includes where it points."""
    return F.when(kind == "symlink", F.concat(F.lit("symlink to "), value)).otherwise(kind)


def file_differences(files: DataFrame) -> DataFrame:
    """case, path, what. files (case, side, path, kind, value): only on one side, of another kind, or another text.
    Binary files are compared by presence and kind only."""
    side = lambda s, p: files.where(F.col("side") == s).select("case", "path", file_kind(F.col("kind"), F.col("value")).alias(f"{p}k"), F.col("kind").alias(f"{p}b"), F.col("value").alias(f"{p}v"))
    x = side("old", "a").join(side("new", "b"), ["case", "path"], "full_outer")
    text = (F.col("ab") == "text") & (F.col("bb") == "text") & ~F.col("av").eqNullSafe(F.col("bv"))
    what = F.when(F.col("bk").isNull(), "only old").when(F.col("ak").isNull(), "only new").when(F.col("ak") != F.col("bk"), F.concat_ws(" became ", "ak", "bk")).when(text, "text")
    return x.select("case", "path", what.alias("what")).where("what is not null")


def differences(observations: DataFrame, files: DataFrame) -> DataFrame:
    """case, what, path. observations (case, side, exit, stdout, stderr); exit is a code, `signal N` or `timeout`. A
    timeout on any side is a difference, on both sides too."""
    a, b = (observations.where(F.col("side") == s).select("case", *[F.col(c).alias(f"{s}_{c}") for c in ("exit", "stdout", "stderr")]) for s in ("old", "new"))
    x = a.join(b, "case", "full_outer")
    late = F.coalesce(F.col("old_exit") == "timeout", F.lit(False)) | F.coalesce(F.col("new_exit") == "timeout", F.lit(False))
    ne = lambda c: ~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    what = F.array_compact(F.array(F.when(late, "timeout").when(ne("exit"), "exit"), F.when(ne("stdout"), "stdout"), F.when(ne("stderr"), "stderr")))
    own = x.select("case", F.explode(what).alias("what"), F.lit(None).cast("string").alias("path"))
    return own.unionByName(file_differences(files).select("case", F.concat(F.lit("file: "), F.col("what")).alias("what"), "path"))


def statuses(cases: DataFrame, found: DataFrame) -> DataFrame:
    """case, status, differences. cases (name, accept): same, differ, accepted, or stale (accepted, but equal now)."""
    n = found.groupBy("case").agg(F.count(F.lit(1)).alias("differences"))
    x = cases.select(F.col("name").alias("case"), F.col("accept").isNotNull().alias("ok")).join(n, "case", "left").na.fill(0, ["differences"])
    d = F.col("differences") > 0
    return x.select("case", F.when(d & F.col("ok"), "accepted").when(d, "differ").when(F.col("ok"), "stale").otherwise("same").alias("status"), "differences")


def tallies(status: DataFrame) -> DataFrame:
    return status.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
