"""The ledger: an append-only log of entries, of which the last one of each key holds."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.operators.predicates import has_target, is_done

SCHEMA = (
    "seq long, ts string, status string, rust string, module string, ported_at timestamp, ts_base string, "
    "ts_blobs map<string,string>, symbols map<string,string>, tests array<string>, test_provenance array<string>, notes string"
)
STATUSES = ("in_progress", "ported", "verified", "replaced", "skipped")


def current(log: DataFrame, key: str = "ts", order: list[str] | None = None) -> DataFrame:
    """The last row of each key. An aggregate, so that rows are reduced before the exchange."""
    last = F.max_by(F.struct(*log.columns), F.struct(*(order or ["seq"])))
    return log.groupBy(F.col(key).alias("_key")).agg(last.alias("_row")).select("_row.*")


POINTER = "current"  # names the folder that holds


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _version(spark: SparkSession, path: str) -> str | None:
    at, fs = _fs(spark, f"{path}/{POINTER}")
    if not fs.exists(at):
        return None
    with_lines = spark.sparkContext._jvm.java.io.BufferedReader(spark.sparkContext._jvm.java.io.InputStreamReader(fs.open(at), "UTF-8"))
    try:
        return with_lines.readLine()
    finally:
        with_lines.close()


def load(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at path; none there: an empty one. Keys may repeat in a log, never in a view of it."""
    at, fs = _fs(spark, path)
    if not fs.exists(at):
        return spark.createDataFrame([], SCHEMA)
    version = _version(spark, path)
    return spark.read.schema(SCHEMA).parquet(f"{path}/{version}" if version else path)


def save(entries: DataFrame, path: str) -> None:
    """Rewrites the ledger, sorted by key. The new version is a folder of its own; then the pointer to it replaces the old
    pointer at once. A failure before that leaves the old ledger as it was. The version before stays for its readers."""
    bad = entries.where(~F.col("status").isin(*STATUSES)).select("ts").limit(1).collect()
    twice = entries.groupBy("ts").count().where("count > 1").select("ts").limit(1).collect()
    if bad or twice:
        raise ValueError(f"ledger: {'unknown status' if bad else 'duplicate entry'} at {(bad or twice)[0]['ts']}")
    spark, jvm = entries.sparkSession, entries.sparkSession.sparkContext._jvm
    before, name = _version(spark, path), f"v-{uuid.uuid4().hex}"
    entries.orderBy("ts").write.parquet(f"{path}/{name}")
    new, fs = _fs(spark, f"{path}/{POINTER}.{name}")
    out = fs.create(new)
    out.write(bytearray(name.encode()))
    out.close()
    swap = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    swap[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    target = _fs(spark, f"{path}/{POINTER}")[0]
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(new, target, swap)
    for x in fs.listStatus(_fs(spark, path)[0]):
        if x.isDirectory() and x.getPath().getName() not in (name, before):
            fs.delete(x.getPath(), True)


def append(log: DataFrame, changes: DataFrame) -> DataFrame:
    """The log with changes behind it (columns that they lack keep the entry's last value when `current` is taken of
    complete rows; see merge)."""
    return log.unionByName(changes, allowMissingColumns=True)


def merge(entries: DataFrame, changes: DataFrame, keep: list[str]) -> DataFrame:
    """Rows of changes (ts and the new values), with the columns `keep` of the entry as it was where they are null."""
    old = entries.select("ts", *[F.col(c).alias(f"_old_{c}") for c in keep])
    out = changes.join(old, "ts", "left")
    for c in keep:
        out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"_old_{c}")) if c in changes.columns else F.col(f"_old_{c}"))
    return out.drop(*[f"_old_{c}" for c in keep])


def start_refusals(args: DataFrame, value_edges: DataFrame, unit_of: DataFrame, entries: DataFrame) -> DataFrame:
    """rel, needs: why args (rel) can't be started: a member of the same unit, or a value dependency, that is neither
    among the arguments nor done."""
    done = entries.where(is_done(F.col("status"))).select(F.col("ts").alias("needs"))
    mine = args.select("rel")
    mates = mine.join(unit_of.withColumnRenamed("node", "rel"), "rel").join(unit_of.select(F.col("node").alias("needs"), "unit"), "unit").where("needs <> rel").select("rel", "needs")
    deps = mine.join(value_edges.select(F.col("src").alias("rel"), F.col("dst").alias("needs")), "rel")
    return mates.unionByName(deps).distinct().join(done, "needs", "left_anti").join(mine.withColumnRenamed("rel", "needs"), "needs", "left_anti").select("rel", "needs")


def done_refusals(args: DataFrame, value_edges: DataFrame, entries: DataFrame) -> DataFrame:
    """rel, needs: value dependencies of args that are neither recorded as done nor recorded together with them."""
    done = entries.where(is_done(F.col("status"))).select(F.col("ts").alias("needs"))
    deps = args.select("rel").join(value_edges.select(F.col("src").alias("rel"), F.col("dst").alias("needs")), "rel")
    return deps.join(done, "needs", "left_anti").join(args.select(F.col("rel").alias("needs")), "needs", "left_anti").select("rel", "needs")


def upsert(entries: DataFrame, rows: DataFrame) -> DataFrame:
    """The entries with rows in the place of those of the same ts."""
    return entries.join(rows.select("ts"), "ts", "left_anti").unionByName(rows.select(*entries.columns))


def start(entries: DataFrame, args: DataFrame) -> DataFrame:
    """Entries of args (rel) as they are when work on them starts: in progress, with all that was recorded before. Ask
    start_refusals first."""
    old = entries.withColumnRenamed("ts", "rel")
    return args.select("rel").distinct().join(old, "rel", "left").withColumn("status", F.lit("in_progress")).withColumnRenamed("rel", "ts").select(*entries.columns)


def mark(entries: DataFrame, args: DataFrame, status: str, blobs: DataFrame, base: str, now: Column, module: str | None = None, reason: str | None = None) -> DataFrame:
    """Entries of args (rel) that are skipped (with a reason) or replaced (by a module): nothing of an earlier port stays.
    blobs (path, blob): contents now."""
    if status not in ("skipped", "replaced"):
        raise ValueError(f"{status} is not a mark")
    own = args.select(F.col("rel").alias("ts")).distinct().join(blobs.select(F.col("path").alias("ts"), "blob"), "ts", "left")
    given = {"status": F.lit(status), "module": F.lit(module), "ported_at": now, "ts_base": F.lit(base), "notes": F.lit(reason), "ts_blobs": F.when(F.col("blob").isNotNull(), F.create_map("ts", "blob")).otherwise(F.create_map())}
    return _filled(own, given, entries)


def done(entries: DataFrame, args: DataFrame, targets: DataFrame, symbols: DataFrame, covers: DataFrame, given: DataFrame, blobs: DataFrame, base: str, now: Column, verified: bool = False, notes: str | None = None) -> DataFrame:
    """Entries of args (rel) as ported or verified. Ask done_refusals, unknown_tests and check.missing_types first.

    targets (rel, rust, module); symbols (rel, name, item; see resolve.map_exports), null items left out; covers (test,
    rel) of the graph; given (rel, test, provenance): tests named now. Tests recorded before stay. A test that the graph
    doesn't show to cover the file is kept apart, and one named now as a test is dropped if it doesn't cover it."""
    mine = args.select("rel").distinct()
    shown = covers.select("rel", "test").distinct()
    named = given.join(mine, "rel", "left_semi").where("provenance").select("rel", "test").unionByName(given.where("not provenance").select("rel", "test").join(shown, ["rel", "test"], "left_semi"))
    tests = split_tests(mine, entries, covers, named).withColumnRenamed("rel", "ts")
    maps = symbols.where("item is not null").groupBy(F.col("rel").alias("ts")).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("name", "item")))).alias("symbols"))
    none = F.array().cast("array<string>")
    out = mine.withColumnRenamed("rel", "ts").join(targets.select(F.col("rel").alias("ts"), "rust", "module"), "ts", "left").join(tests, "ts", "left").join(maps, "ts", "left")
    out = out.withColumn("tests", F.coalesce("tests", none)).withColumn("test_provenance", F.coalesce("test_provenance", none)).withColumn("symbols", F.coalesce("symbols", F.create_map().cast("map<string,string>")))
    paths = tracked_paths(out).join(blobs, "path").groupBy("ts").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("path", "blob")))).alias("ts_blobs"))
    out = out.join(paths, "ts", "left").join(entries.select("ts", F.col("notes").alias("_notes")), "ts", "left")
    given_ = {"status": F.lit("verified" if verified else "ported"), "ported_at": now, "ts_base": F.lit(base), "notes": F.coalesce(F.lit(notes), F.col("_notes")), "ts_blobs": F.coalesce("ts_blobs", F.create_map().cast("map<string,string>"))}
    return _filled(out, given_, entries)


def _filled(rows: DataFrame, given: dict[str, Column], entries: DataFrame) -> DataFrame:
    """rows in the columns of entries: as given, else as they are in rows, else null."""
    kind = {f.name: f.dataType for f in entries.schema.fields}

    def own(c: str) -> Column:
        found = given.get(c, F.col(c) if c in rows.columns else None)
        if found is None:
            return F.lit(None).cast(kind[c])
        return found if isinstance(kind[c], (T.ArrayType, T.MapType)) else found.cast(kind[c])

    return rows.select(*[own(c).alias(c) for c in entries.columns])


def unknown_tests(given: DataFrame, tests: DataFrame, existing: DataFrame, packages_dir: str, markers: list[str]) -> DataFrame:
    """test, reason: of given (test, provenance), tests that the graph lacks, and provenance that is no existing test file
    of the workspace. tests (test) of the graph; existing (path)."""
    marked = reduce(lambda a, b: a | b, (F.col("test").contains(m) for m in markers), F.lit(False))
    off = given.where("not provenance").join(tests.select("test"), "test", "left_anti").select("test", F.lit("not a test of the graph").alias("reason"))
    here = existing.select(F.col("path").alias("test")).where(F.col("test").startswith(packages_dir.rstrip("/") + "/") & marked)
    return off.unionByName(given.where("provenance").join(here, "test", "left_anti").select("test", F.lit("not an existing test").alias("reason"))).distinct()


def split_tests(args: DataFrame, entries: DataFrame, covers: DataFrame, given: DataFrame) -> DataFrame:
    """rel, tests, test_provenance: the tests known for a file before and those given now (rel, test), split by whether
    the graph says that they cover it (covers: test, rel)."""
    before = entries.select(F.col("ts").alias("rel"), F.explode(F.array_union(F.coalesce("tests", F.array().cast("array<string>")), F.coalesce("test_provenance", F.array().cast("array<string>")))).alias("test"))
    every = before.unionByName(given).join(args.select("rel"), "rel", "left_semi").distinct().join(covers.select("rel", "test").distinct().withColumn("on", F.lit(True)), ["rel", "test"], "left")
    return every.groupBy("rel").agg(F.array_sort(F.collect_set(F.when(F.col("on"), F.col("test")))).alias("tests"), F.array_sort(F.collect_set(F.when(F.col("on").isNull(), F.col("test")))).alias("test_provenance"))


def tracked_paths(entries: DataFrame) -> DataFrame:
    """ts, path: the file of an entry and the tests recorded with it."""
    none = F.array().cast("array<string>")
    return entries.select("ts", F.explode(F.array_distinct(F.concat(F.array("ts"), F.coalesce("tests", none), F.coalesce("test_provenance", none)))).alias("path"))


def stamp_blobs(entries: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Done entries without content ids get those of their tracked paths at their base revision. snapshots (rev, path, blob)."""
    lacking = entries.where(is_done(F.col("status")) & F.col("ts_base").isNotNull() & (F.col("ts_blobs").isNull() | (F.size("ts_blobs") == 0)))
    found = tracked_paths(lacking).join(lacking.select("ts", F.col("ts_base").alias("rev")), "ts").join(snapshots, ["rev", "path"])
    maps = found.groupBy("ts").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("path", "blob")))).alias("_blobs"))
    return entries.join(maps, "ts", "left").withColumn("ts_blobs", F.coalesce("_blobs", "ts_blobs")).drop("_blobs")


def ported_tests(entries: DataFrame) -> DataFrame:
    return entries.where(is_done(F.col("status"))).select(F.explode("tests").alias("test")).distinct()


def percent(part: Column, whole: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0))


def overall(files: DataFrame, entries: DataFrame) -> DataFrame:
    """One row: files, lines, done files and lines, and their percentages. files (rel, lines)."""
    done = F.coalesce(is_done(F.col("status")), F.lit(False))
    x = files.join(entries.select(F.col("ts").alias("rel"), "status"), "rel", "left").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"), F.count_if(done).alias("done_files"), F.coalesce(F.sum(F.when(done, F.col("lines"))), F.lit(0)).alias("done_lines"))
    return x.withColumn("file_pct", percent(F.col("done_files"), F.col("files"))).withColumn("line_pct", percent(F.col("done_lines"), F.col("lines")))


def by_package(files: DataFrame, entries: DataFrame) -> DataFrame:
    """package, total, done, lines, done_lines. files (rel, package, lines)."""
    done = F.coalesce(is_done(F.col("status")), F.lit(False))
    return files.join(entries.select(F.col("ts").alias("rel"), "status"), "rel", "left").groupBy("package").agg(F.count(F.lit(1)).alias("total"), F.count_if(done).alias("done"), F.sum("lines").alias("lines"), F.coalesce(F.sum(F.when(done, F.col("lines"))), F.lit(0)).alias("done_lines"))


def status_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if(has_target(F.col("status"))).alias("with_target"))
