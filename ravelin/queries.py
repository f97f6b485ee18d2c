"""The library's operators on the driver's tables, each with equivalent SQL.

The tables hold no source trees, so they stand in for them, whole. A part depends on the next one of the same order;
lines that are not final (return flag N) are type imports. A row depends on the rows that it refers to: an order on its
parts, suppliers and customer, these on their nation, a nation on its region. For units, levels and planning, a file is
what a user does of one kind in six events one after the other, and depends on the next such file, by type only if the
event's value is below 20; the value of a file's last event is its status, files of six events belong to a test.
`events` is also the ledger's log: a user is an entry, an event type a status. `documents` at two revisions are
snapshots: at the head, English articles are edited, source src3 is gone and source src5 is new.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ravelin.common import settle
from ravelin.functions import names, paths
from ravelin.operators import graph, ledger, resolve
from ravelin.plans import batch, change, check, kinds, planning, reconcile, search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _imports(spark, d, key):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    x = table(spark, d, "lineitem").select(F.col(key).alias("src"), F.lead(key).over(order).alias("dst"), F.when(F.col("l_returnflag") == "N", "type").otherwise("value").alias("kind"), F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("name"))
    return x.where("src <> dst")


IMPORTS = """imports AS (
  SELECT * FROM (SELECT {key} AS src, lead({key}) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS dst,
    CASE WHEN l_returnflag = 'N' THEN 'type' ELSE 'value' END AS kind, l_linestatus || l_linenumber AS name FROM lineitem) WHERE src <> dst)"""
PART_EDGES = IMPORTS.format(key="l_partkey") + """,
part_edges AS (SELECT src, dst, bool_and(kind = 'type') AS type_only FROM imports GROUP BY src, dst)"""
REFERENCES = """value_edges AS (SELECT DISTINCT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst FROM lineitem UNION SELECT 'o' || l_orderkey, 's' || l_suppkey FROM lineitem
UNION SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"""
EVENTS = """numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events),
ev AS (SELECT *, user_id * 1000 + seq // 6 AS run, (user_id * 1000 + seq // 6) * 8 + CASE event_type WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 WHEN 'error' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS node FROM numbered),
steps AS (SELECT node AS src, lead(node) OVER (PARTITION BY user_id ORDER BY seq) AS dst, CASE WHEN value < 20 THEN 'type' ELSE 'value' END AS kind FROM ev),
edges AS (SELECT src, dst, bool_and(kind = 'type') AS type_only FROM steps WHERE src <> dst GROUP BY src, dst),
value_edges AS (SELECT src, dst FROM edges WHERE NOT type_only)"""
CLOSURE = "paths AS (SELECT src, dst FROM value_edges UNION SELECT p.src, e.dst FROM paths p JOIN value_edges e ON p.dst = e.src)"
UNITS = """nodes AS (SELECT src AS node FROM value_edges UNION SELECT dst FROM value_edges),
unit_of AS (SELECT n.node, least(n.node, coalesce(min(p.dst), n.node)) AS unit FROM nodes n
  LEFT JOIN (SELECT p.src, p.dst FROM paths p JOIN paths q ON p.src = q.dst AND p.dst = q.src) p ON p.src = n.node GROUP BY n.node)"""
UNIT_EDGES = "unit_edges AS (SELECT DISTINCT a.unit AS src, b.unit AS dst FROM value_edges e JOIN unit_of a ON e.src = a.node JOIN unit_of b ON e.dst = b.node WHERE a.unit <> b.unit)"
KINDS = ("click", "purchase", "error", "signup")  # any other: 4


def part_edges(spark, d):
    """src, dst, type_only."""
    return _imports(spark, d, "l_partkey").groupBy("src", "dst").agg(F.bool_and(F.col("kind") == "type").alias("type_only"))


def part_value_edges(spark, d):
    return part_edges(spark, d).where("not type_only").select("src", "dst")


def reference_edges(spark, d):
    """src, dst: which row refers to which, by their names; as often as it does."""
    pairs = (("lineitem", "o", "l_orderkey", "p", "l_partkey"), ("lineitem", "o", "l_orderkey", "s", "l_suppkey"), ("orders", "o", "o_orderkey", "c", "o_custkey"), ("customer", "c", "c_custkey", "n", "c_nationkey"), ("supplier", "s", "s_suppkey", "n", "s_nationkey"), ("nation", "n", "n_nationkey", "r", "n_regionkey"))
    name = lambda mark, key: F.concat(F.lit(mark), F.col(key).cast("string"))
    return reduce(DataFrame.unionByName, (table(spark, d, t).select(name(a, x).alias("src"), name(b, y).alias("dst")) for t, a, x, b, y in pairs))


def event_files(spark, d):
    """Every event with the file (node) and the run of six events that it belongs to, and its place in its user's."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.coalesce(*[F.when(F.col("event_type") == k, i) for i, k in enumerate(KINDS)], F.lit(len(KINDS)))
    x = table(spark, d, "events").withColumn("seq", F.row_number().over(order) - 1)
    x = x.withColumn("run", F.col("user_id") * 1000 + F.floor(F.col("seq") / 6))
    return x.withColumn("node", F.col("run") * 8 + kind)


def event_edges(spark, d):
    """src, dst, type_only between the files of event_files."""
    x = event_files(spark, d).select(F.col("node").alias("src"), F.lead("node").over(Window.partitionBy("user_id").orderBy("seq")).alias("dst"), (F.col("value") < 20).alias("type"))
    return x.where("src <> dst").groupBy("src", "dst").agg(F.bool_and("type").alias("type_only"))


def event_value_edges(spark, d):
    return event_edges(spark, d).where("not type_only").select("src", "dst")


@query(f"WITH {IMPORTS.format(key='l_partkey')} SELECT src, dst, bool_and(kind = 'type') AS type_only, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM imports GROUP BY src, dst")
def dep_edges(spark, d):
    return graph.dependency_edges(_imports(spark, d, "l_partkey")).withColumn("names", F.array_join("names", ","))


@query(f"WITH {PART_EDGES} SELECT src, dst FROM part_edges WHERE NOT type_only")
def value_edges(spark, d):
    return part_value_edges(spark, d)


@query(f"WITH {PART_EDGES} SELECT src, dst FROM part_edges WHERE type_only")
def type_only_edges(spark, d):
    return part_edges(spark, d).where("type_only").select("src", "dst")


@query(f"WITH RECURSIVE {REFERENCES}, {CLOSURE} SELECT src, dst FROM paths")
def transitive_closure(spark, d):
    return graph.closure(reference_edges(spark, d))


@query(f"WITH RECURSIVE {REFERENCES}, {CLOSURE} SELECT dst AS node, count(*) AS downstream FROM paths WHERE src <> dst GROUP BY dst")
def downstream_count(spark, d):
    return graph.downstream_counts(reference_edges(spark, d))


@query(f"WITH RECURSIVE {REFERENCES}, hit AS (SELECT DISTINCT src AS node FROM value_edges WHERE dst = 's1' UNION SELECT e.src FROM hit h JOIN value_edges e ON e.dst = h.node) SELECT node FROM hit WHERE node <> 's1'")
def downstream_of_one(spark, d):
    return graph.downstream_of(reference_edges(spark, d), spark.range(1).select(F.lit("s1").alias("node")))


@query(f"WITH RECURSIVE {REFERENCES}, seeds AS (SELECT 'o' || o_orderkey AS node FROM orders WHERE o_orderpriority = '1-URGENT'), hit AS (SELECT node FROM seeds UNION SELECT e.dst FROM hit h JOIN value_edges e ON e.src = h.node) SELECT node FROM hit")
def reachable_rows(spark, d):
    seeds = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node"))
    return graph.reachable(reference_edges(spark, d), seeds)


@query(f"WITH RECURSIVE {EVENTS}, {CLOSURE}, {UNITS} SELECT node, unit FROM unit_of")
def scc_units(spark, d):
    return graph.units(event_value_edges(spark, d))


@query(f"WITH RECURSIVE {EVENTS}, {CLOSURE}, {UNITS} SELECT unit, count(*) AS files FROM unit_of GROUP BY unit HAVING count(*) > 1 ORDER BY files DESC, unit LIMIT 10")
def cycle_report(spark, d):
    x = graph.units(event_value_edges(spark, d)).groupBy("unit").agg(F.count(F.lit(1)).alias("files")).where("files > 1")
    return x.orderBy(F.desc("files"), "unit").limit(10)


def _unit_graph(edges: DataFrame):
    unit_of = settle(graph.units(edges))
    return unit_of, settle(graph.unit_edges(edges, unit_of))


LEVELS = f"""WITH RECURSIVE {EVENTS}, {CLOSURE}, {UNITS}, {UNIT_EDGES},
climb AS (SELECT DISTINCT unit AS node, 0 AS level FROM unit_of UNION SELECT e.src, c.level + 1 FROM climb c JOIN unit_edges e ON e.dst = c.node),
levels AS (SELECT node, max(level) AS level FROM climb GROUP BY node)"""


@query(f"{LEVELS} SELECT node, CAST(level AS BIGINT) AS level FROM levels")
def unit_levels(spark, d):
    unit_of, edges = _unit_graph(settle(event_value_edges(spark, d)))
    return graph.levels(edges, unit_of.select(F.col("unit").alias("node")))


@query(f"{LEVELS} SELECT CAST(g.level AS BIGINT) AS level, count(l.node) AS units FROM (SELECT unnest(range(0, (SELECT max(level) + 1 FROM levels))) AS level) g LEFT JOIN levels l ON l.level = g.level GROUP BY g.level")
def level_histogram(spark, d):
    x = unit_levels(spark, d)
    every = x.agg(F.max("level").alias("top")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("top"))).alias("level"))
    return every.join(x.groupBy("level").agg(F.count(F.lit(1)).alias("units")), "level", "left").na.fill(0, ["units"])


# Ledger

STATUS = {"click": "in_progress", "purchase": "ported", "error": "skipped", "signup": "verified", "view": "replaced"}
STATUS_SQL = "CASE event_type WHEN 'click' THEN 'in_progress' WHEN 'purchase' THEN 'ported' WHEN 'error' THEN 'skipped' WHEN 'signup' THEN 'verified' WHEN 'view' THEN 'replaced' END"
ENTRIES = f"""entries AS (SELECT user_id AS ts, {STATUS_SQL} AS status, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1)"""


def entries_of(spark, d):
    status = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in STATUS.items()])
    x = ledger.current(table(spark, d, "events"), "user_id", ["ts", "event_id"])
    return x.select(F.col("user_id").alias("ts"), status.alias("status"), "value")


@query(f"WITH {ENTRIES} SELECT ts, status, value FROM entries")
def ledger_current(spark, d):
    return entries_of(spark, d)


@query(f"WITH {ENTRIES} SELECT status, count(*) AS n, count(*) FILTER (WHERE status IN ('ported', 'verified')) AS with_target FROM entries GROUP BY status")
def status_counts(spark, d):
    return ledger.status_counts(entries_of(spark, d))


def _files(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("rel"), F.col("p_brand").alias("package"), F.col("p_size").alias("lines"))


@query(f"WITH {ENTRIES} SELECT p_brand AS package, count(*) AS total, count(*) FILTER (WHERE status <> 'in_progress') AS done, CAST(sum(p_size) AS BIGINT) AS lines, CAST(coalesce(sum(p_size) FILTER (WHERE status <> 'in_progress'), 0) AS BIGINT) AS done_lines FROM part LEFT JOIN entries ON p_partkey = ts GROUP BY p_brand")
def per_package_progress(spark, d):
    return ledger.by_package(_files(spark, d), entries_of(spark, d))


@query(f"""WITH {ENTRIES}, t AS (SELECT count(*) AS files, CAST(sum(p_size) AS BIGINT) AS lines, count(*) FILTER (WHERE status <> 'in_progress') AS done_files, CAST(coalesce(sum(p_size) FILTER (WHERE status <> 'in_progress'), 0) AS BIGINT) AS done_lines FROM part LEFT JOIN entries ON p_partkey = ts)
SELECT *, done_files * 100.0::DOUBLE / files AS file_pct, done_lines * 100.0::DOUBLE / lines AS line_pct FROM t""")
def overall_progress(spark, d):
    return ledger.overall(_files(spark, d), entries_of(spark, d))


# Planning


FILE_STATUS = (("verified", 90), ("ported", 60), ("skipped", 50), ("in_progress", 40))  # from that value of the last event on


def event_entries(spark, d):
    """ts, status, value: the files that are recorded, by their last event."""
    last = event_files(spark, d).groupBy(F.col("node").alias("ts")).agg(F.max_by("value", "seq").alias("value"))
    return last.withColumn("status", F.coalesce(*[F.when(F.col("value") >= v, s) for s, v in FILE_STATUS])).where("status is not null")


def event_tests(spark, d):
    """test, dep: a run's clicks and purchases are covered by a test. Some tests are claimed, some are binary."""
    x = event_files(spark, d).where("event_type in ('click', 'purchase')").select(F.col("run").alias("test"), F.col("node").alias("dep")).distinct()
    return x.where("test % 7 <> 0"), x.where("test % 5 = 0").select("test").distinct()


def _plan(edges: DataFrame, files: DataFrame, entries: DataFrame, stale: DataFrame):
    edges = settle(edges)  # several operators read it
    unit_of_some, value = _unit_graph(edges.where("not type_only").select("src", "dst"))
    unit_of = settle(files.join(unit_of_some, "node", "left").select("node", F.coalesce("unit", "node").alias("unit")))
    types = graph.unit_edges(edges.where("type_only").select("src", "dst"), unit_of).join(value, ["src", "dst"], "left_anti")
    return unit_of, value, types, settle(planning.unit_progress(unit_of, entries, stale))


def _plan_inputs(spark, d):
    entries = settle(event_entries(spark, d))
    return _plan(event_edges(spark, d), event_files(spark, d).select("node").distinct(), entries, entries.where("value >= 60 and value < 65").select("ts"))


FILES = "files AS (SELECT node, count(*) * 10 AS lines, arg_max(value, seq) AS last FROM ev GROUP BY node)"
PLAN = f"""WITH RECURSIVE {EVENTS}, {CLOSURE}, {UNITS.replace('unit_of AS', 'linked AS')}, {FILES},
unit_of AS (SELECT f.node, coalesce(unit, f.node) AS unit FROM files f LEFT JOIN linked USING (node)), {UNIT_EDGES},
entries AS (SELECT node AS ts, last AS value, CASE WHEN last >= 90 THEN 'verified' WHEN last >= 60 THEN 'ported' WHEN last >= 50 THEN 'skipped' ELSE 'in_progress' END AS status FROM files WHERE last >= 40),
type_edges AS (SELECT DISTINCT a.unit AS src, b.unit AS dst FROM edges e JOIN unit_of a ON e.src = a.node JOIN unit_of b ON e.dst = b.node WHERE type_only AND a.unit <> b.unit EXCEPT SELECT src, dst FROM unit_edges),
progress AS (SELECT unit, bool_and(coalesce(status <> 'in_progress', false) AND NOT coalesce(value >= 60 AND value < 65, false)) AS done,
  bool_and(coalesce(status <> 'in_progress', false)) AS recorded, bool_or(coalesce(status = 'in_progress', false)) AS claimed FROM unit_of LEFT JOIN entries ON node = ts GROUP BY unit),
ready AS (SELECT unit FROM progress p WHERE NOT done AND NOT claimed AND NOT EXISTS (SELECT 1 FROM unit_edges e JOIN progress q ON e.dst = q.unit WHERE e.src = p.unit AND NOT q.done)),
pend AS (SELECT r.unit, count(DISTINCT q.unit) AS pending_types FROM ready r LEFT JOIN type_edges t ON t.src = r.unit LEFT JOIN progress q ON q.unit = t.dst AND NOT q.recorded GROUP BY r.unit),
waiting AS (SELECT e.src, min(e.dst) AS unit, count(DISTINCT e.dst) AS n FROM unit_edges e JOIN progress p ON p.unit = e.src AND NOT p.done JOIN progress q ON q.unit = e.dst AND NOT q.done GROUP BY e.src),
unl AS (SELECT r.unit, count(w.src) AS unlocks FROM ready r LEFT JOIN waiting w ON w.unit = r.unit AND w.n = 1 GROUP BY r.unit)"""


@query(f"{PLAN} SELECT unit, done, recorded, claimed FROM progress")
def unit_progress(spark, d):
    return _plan_inputs(spark, d)[3]


@query(f"{PLAN} SELECT unit FROM ready")
def ready_units(spark, d):
    _, value, _, progress = _plan_inputs(spark, d)
    return planning.ready_units(progress, value)


@query(f"{PLAN} SELECT unit, pending_types FROM pend")
def pending_types(spark, d):
    _, value, types, progress = _plan_inputs(spark, d)
    return planning.pending_types(planning.ready_units(progress, value), types, progress)


@query(f"{PLAN} SELECT unit, unlocks FROM unl")
def unlocks(spark, d):
    _, value, _, progress = _plan_inputs(spark, d)
    return planning.unlocks(planning.ready_units(progress, value), value, progress)


def _ranked(spark, d, top: int | None = None):
    unit_of, value, types, progress = _plan_inputs(spark, d)
    sizes = event_files(spark, d).groupBy("node").agg((F.count(F.lit(1)) * 10).alias("lines"))
    lines = settle(unit_of.join(sizes, "node").groupBy("unit").agg(F.sum("lines").alias("lines"), F.count(F.lit(1)).alias("files"), F.min("node").alias("first")))
    tests, claimed = event_tests(spark, d)
    recorded = event_entries(spark, d).where("status <> 'in_progress'").select(F.col("ts").alias("node"))
    enabled = planning.tests_enabled(progress.select("unit"), tests, unit_of, recorded, claimed)
    return unit_of, planning.candidates(progress, value, types, lines.select("unit", "lines"), enabled, top), lines


RANKED = f"""{PLAN}, unit_paths AS (SELECT src, dst FROM unit_edges UNION SELECT p.src, e.dst FROM unit_paths p JOIN unit_edges e ON p.dst = e.src),
down AS (SELECT dst AS unit, count(*) AS downstream FROM unit_paths GROUP BY dst),
tests AS (SELECT DISTINCT run AS test, e.node AS dep, unit, e.node IN (SELECT ts FROM entries WHERE status <> 'in_progress') AS recorded FROM ev e JOIN unit_of u ON u.node = e.node WHERE event_type IN ('click', 'purchase') AND run % 7 <> 0 AND run % 5 <> 0),
missing AS (SELECT test, count(DISTINCT unit) AS n, min(unit) AS unit FROM tests WHERE NOT recorded GROUP BY test),
enabled AS (SELECT t.unit, count(DISTINCT t.test) AS tests_enabled FROM tests t LEFT JOIN missing m USING (test) WHERE m.n IS NULL OR (m.n = 1 AND m.unit = t.unit) GROUP BY t.unit),
ranked AS (SELECT r.unit, pending_types, unlocks, coalesce(downstream, 0) AS downstream, lines, coalesce(tests_enabled, 0) AS tests_enabled,
  row_number() OVER (ORDER BY pending_types, least(coalesce(tests_enabled, 0), 1) DESC, unlocks DESC, coalesce(downstream, 0) DESC, coalesce(tests_enabled, 0) DESC, lines, r.unit) AS rank
  FROM ready r JOIN pend USING (unit) JOIN unl USING (unit) LEFT JOIN down USING (unit) LEFT JOIN enabled USING (unit) JOIN (SELECT unit, CAST(sum(lines) AS BIGINT) AS lines FROM unit_of JOIN files USING (node) GROUP BY unit) USING (unit))"""


@query(f"{RANKED} SELECT unit, pending_types, unlocks, downstream, lines, tests_enabled, rank FROM ranked")
def rank_next(spark, d):
    return _ranked(spark, d)[1].select("unit", "pending_types", "unlocks", "downstream", "lines", "tests_enabled", F.col("rank").cast("long").alias("rank"))


@query(f"{RANKED} SELECT unit, rank FROM ranked ORDER BY rank LIMIT 3")
def next_three(spark, d):
    return _ranked(spark, d, 3)[1].select("unit", F.col("rank").cast("long").alias("rank"))


def _batches(spark, d):
    _, ranked, lines = _ranked(spark, d)
    x = ranked.join(lines.select("unit", "files", (F.floor(F.col("first") / 8000) % 40).alias("dir")), "unit").select("rank", "unit", "dir", (F.col("pending_types") > 0).alias("stubs"), F.lit(False).alias("is_update"), "files", "lines")
    return planning.batches(settle(x), 6, 100)


@query()
def batches(spark, d):
    return _batches(spark, d)


@query()
def wave(spark, d):
    """Each batch writes a file for each of its units and registers it with its user."""
    feet = _batches(spark, d).select("batch", F.explode(F.array(F.struct((F.col("unit") % 4000).cast("string").alias("path"), F.lit("writes").alias("kind")), F.struct((F.floor(F.col("unit") / 8000) * 8).cast("string").alias("path"), F.lit("registers").alias("kind")))).alias("f")).select("batch", "f.*")
    feet = settle(feet)
    return planning.wave(feet.select("batch"), feet)


@query()
def catch_up_fixpoint(spark, d):
    stale = entries_of(spark, d).where("status <> 'in_progress' and value < 10").select("ts")
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("node"))
    _, value, _, progress = _plan(part_edges(spark, d), parts, entries_of(spark, d), stale)
    return _catch_up(value, progress)


def _catch_up(value, progress):
    wanted = progress.where("not done").select("unit", (~F.col("recorded")).alias("added"))
    return graph.catch_up(wanted, value, progress.where("recorded").select("unit"))


@query(f"""{PLAN}, wanted AS (SELECT unit, NOT recorded AS added FROM progress WHERE NOT done),
loose AS (SELECT DISTINCT e.src AS unit FROM unit_edges e WHERE e.dst NOT IN (SELECT unit FROM progress WHERE recorded) AND e.dst NOT IN (SELECT unit FROM wanted)),
gone AS (SELECT unit FROM wanted WHERE added AND unit IN (SELECT unit FROM loose) UNION SELECT w.unit FROM gone g JOIN unit_edges e ON e.dst = g.unit JOIN wanted w ON w.unit = e.src AND w.added)
SELECT unit, added FROM wanted WHERE unit NOT IN (SELECT unit FROM gone)""")
def catch_up_units(spark, d):
    """As catch_up_fixpoint, over the files of events."""
    _, value, _, progress = _plan_inputs(spark, d)
    return _catch_up(value, progress)


@query(f"""{RANKED}, members AS (SELECT unit % 97 AS batch, unit FROM ready WHERE unit % 3 <> 0),
own AS (SELECT m.batch, m.unit, u.node FROM members m JOIN unit_of u USING (unit)),
near AS (SELECT DISTINCT m.batch, e.src FROM members m JOIN unit_edges e ON e.dst = m.unit JOIN progress p ON p.unit = e.src AND NOT p.done WHERE NOT EXISTS (SELECT 1 FROM members x WHERE x.batch = m.batch AND x.unit = e.src)),
freed AS (SELECT n.batch, count(*) AS unlocks FROM near n WHERE NOT EXISTS (SELECT 1 FROM unit_edges f JOIN progress g ON g.unit = f.dst AND NOT g.done WHERE f.src = n.src AND f.dst NOT IN (SELECT unit FROM members x WHERE x.batch = n.batch)) GROUP BY n.batch),
far AS (SELECT batch, count(*) AS downstream FROM (SELECT DISTINCT m.batch, p.src FROM members m JOIN unit_paths p ON p.dst = m.unit) d WHERE NOT EXISTS (SELECT 1 FROM members x WHERE x.batch = d.batch AND x.unit = d.src) GROUP BY batch),
cover AS (SELECT DISTINCT o.batch, t.test FROM own o JOIN tests t ON t.dep = o.node WHERE NOT EXISTS (SELECT 1 FROM tests x WHERE x.test = t.test AND NOT x.recorded AND x.dep NOT IN (SELECT node FROM own y WHERE y.batch = o.batch)))
SELECT o.batch, count(DISTINCT o.unit) AS units, count(*) AS files, CAST(sum(f.lines) AS BIGINT) AS lines, coalesce(any_value(unlocks), 0) AS unlocks, coalesce(any_value(downstream), 0) AS downstream, (SELECT count(*) FROM cover c WHERE c.batch = o.batch) AS tests
FROM own o JOIN files f USING (node) LEFT JOIN freed USING (batch) LEFT JOIN far USING (batch) GROUP BY o.batch""")
def batch_summaries(spark, d):
    """Given batches of ready units: their sizes, what they free, and the tests that come with them."""
    unit_of, value, _, progress = _plan_inputs(spark, d)
    sizes = event_files(spark, d).groupBy("node").agg((F.count(F.lit(1)) * 10).alias("lines"))
    lines = unit_of.join(sizes, "node").groupBy("unit").agg(F.sum("lines").alias("lines"), F.count(F.lit(1)).alias("files"))
    members = settle(planning.ready_units(progress, value).where("unit % 3 <> 0").select((F.col("unit") % 97).alias("batch"), "unit"))
    tests, claimed = event_tests(spark, d)
    recorded = event_entries(spark, d).where("status <> 'in_progress'").select(F.col("ts").alias("node"))
    none = spark.range(0).select(F.col("id").alias("rel"), F.col("id").alias("test"))
    covered = batch.batch_tests(members, unit_of, tests.withColumn("is_binary", F.lit(False)), recorded, claimed, none)
    return batch.summary(members, lines, value, progress, covered)


@query(f"""{PLAN}, wanted AS (SELECT unit, NOT recorded AS added FROM progress WHERE NOT done),
loose AS (SELECT DISTINCT e.src AS unit FROM unit_edges e WHERE e.dst NOT IN (SELECT unit FROM progress WHERE recorded) AND e.dst NOT IN (SELECT unit FROM wanted)),
gone AS (SELECT unit FROM wanted WHERE added AND unit IN (SELECT unit FROM loose) UNION SELECT w.unit FROM gone g JOIN unit_edges e ON e.dst = g.unit JOIN wanted w ON w.unit = e.src AND w.added),
catching AS (SELECT unit FROM wanted WHERE unit NOT IN (SELECT unit FROM gone) AND unit % 5 <> 0), rest AS (SELECT p.*, p.unit IN (SELECT unit FROM ready) AS ready FROM catching c JOIN progress p USING (unit) WHERE NOT done),
fresh AS (SELECT u.unit FROM unit_of u WHERE u.node % 2 = 0 AND u.node NOT IN (SELECT ts FROM entries WHERE status <> 'in_progress'))
SELECT (SELECT count(*) FROM entries WHERE value >= 60 AND value < 65) AS stale, (SELECT count(*) FROM fresh WHERE unit IN (SELECT unit FROM catching)) AS new, (SELECT count(*) FROM fresh WHERE unit NOT IN (SELECT unit FROM catching)) AS deferred,
count(*) AS units, count(*) FILTER (WHERE ready) AS ready, count(*) FILTER (WHERE claimed) AS claimed, count(*) - count(*) FILTER (WHERE ready) - count(*) FILTER (WHERE claimed) AS waiting FROM rest""")
def catch_up_tallies(spark, d):
    unit_of, value, _, progress = _plan_inputs(spark, d)
    entries = event_entries(spark, d)
    added = unit_of.where("node % 2 = 0").select(F.col("node").alias("rel"))
    return batch.catch_up_tallies(_catch_up(value, progress).where("unit % 5 <> 0"), progress, value, unit_of, entries.where("value >= 60 and value < 65"), added, entries.where("status <> 'in_progress'").select(F.col("ts").alias("rel")))


@query(f"{PLAN} SELECT DISTINCT r.unit FROM ready r JOIN unit_of u USING (unit) WHERE u.node % 8 = 1")
def ready_in_package(spark, d):
    """The ready units that have a purchase."""
    unit_of, value, _, progress = _plan_inputs(spark, d)
    files = unit_of.select(F.col("node").alias("rel"), (F.col("node") % 8).cast("string").alias("package"))
    return batch.in_package(planning.ready_units(progress, value), unit_of, files, "1")


@query("""WITH tests AS (SELECT conv_id AS test, turn AS dep FROM conversations WHERE conv_id % 9 <> 0 AND conv_id % 4 <> 0), recorded AS (SELECT doc_id AS node FROM labels WHERE quality = 1)
SELECT DISTINCT t.test, t.dep AS unit FROM tests t WHERE NOT EXISTS (SELECT 1 FROM tests u WHERE u.test = t.test AND u.dep <> t.dep AND u.dep NOT IN (SELECT node FROM recorded))""")
def test_enablement(spark, d):
    every = table(spark, d, "conversations").select(F.col("conv_id").alias("test"), F.col("turn").alias("dep"))
    tests = every.where("test % 9 <> 0")  # the others are binary
    unit_of = tests.select(F.col("dep").alias("node"), F.col("dep").alias("unit")).distinct()
    recorded = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("node")).distinct()
    claimed = every.where("test % 4 = 0").select("test").distinct()
    return planning.tests_enabled(unit_of.select("unit").distinct(), tests, unit_of, recorded, claimed).select("test", "unit")


# Snapshots

PATH = "source || '/' || lang || '/' || doc_id"
BLOB = "sha1(encode('blob ' || octet_length(encode({0}))) || '\\x00'::BLOB || encode({0}))"
SNAPSHOTS = f"""docs AS (SELECT {PATH} AS path, source, lang, doc_id, text AS old, replace(text, ' the ', ' a ') AS new FROM documents),
base AS (SELECT path, {BLOB.format('old')} AS blob FROM docs WHERE source <> 'src5'),
head AS (SELECT path, {BLOB.format('new')} AS blob FROM docs WHERE source <> 'src3')"""


def _docs(spark, d):
    return table(spark, d, "documents").select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "source", "lang", "doc_id", F.col("text").alias("old"), F.replace("text", F.lit(" the "), F.lit(" a ")).alias("new"))


def _snapshots(spark, d):
    docs = _docs(spark, d)
    return docs.where("source <> 'src5'").select("path", paths.blob_id(F.col("old")).alias("blob")), docs.where("source <> 'src3'").select("path", paths.blob_id(F.col("new")).alias("blob"))


@query(f"WITH {SNAPSHOTS} SELECT path, blob FROM base")
def git_blob_ids(spark, d):
    return _snapshots(spark, d)[0]


@query(f"WITH {SNAPSHOTS} SELECT coalesce(b.path, h.path) AS path FROM base b FULL JOIN head h ON b.path = h.path WHERE b.blob IS DISTINCT FROM h.blob")
def changed_docs(spark, d):
    return change.changed(*_snapshots(spark, d))


@query(f"WITH {SNAPSHOTS} SELECT path FROM head WHERE path NOT IN (SELECT path FROM base)")
def added_docs(spark, d):
    return change.changed(*_snapshots(spark, d), added_only=True)


def _doc_entries(spark, d):
    """A ledger over documents: each records its own content at the base and, as a test, that of the next document of its
    source. Every eleventh recorded another content than the base has."""
    docs = _docs(spark, d).where("source <> 'src5'")
    after = Window.partitionBy("source").orderBy("doc_id", "path")
    docs = docs.withColumn("blob", paths.blob_id(F.col("old"))).withColumn("test", F.lead("path").over(after)).withColumn("tblob", F.lead("blob").over(after))
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    x = docs.join(labels, "doc_id")
    status = F.when(F.col("toxic") == 1, "skipped").when(F.col("quality") == 1, "ported").otherwise("in_progress")
    own = F.when(F.col("doc_id") % 11 == 0, paths.blob_id(F.concat("old", F.lit("x")))).otherwise(F.col("blob"))
    pairs = F.when(F.col("test").isNull(), F.array(F.struct(F.col("path").alias("k"), own.alias("v")))).otherwise(F.array(F.struct(F.col("path").alias("k"), own.alias("v")), F.struct(F.col("test").alias("k"), F.col("tblob").alias("v"))))
    symbols = F.create_map(F.lit("f"), F.lit("m::f"), F.lit("g"), F.lit("-"), F.lit("h"), F.concat(F.lit("n::h"), F.col("doc_id").cast("string")))
    return x.select(F.col("path").alias("ts"), "doc_id", "lang", status.alias("status"), F.when(F.col("quality") == 1, F.concat(F.lit("t/"), F.col("path"))).alias("rust"), F.concat(F.lit("m"), (F.col("doc_id") % 10).cast("string")).alias("module"),
        F.when(F.col("doc_id") % 13 != 0, "a base of sixteen").alias("ts_base"), F.map_from_entries(pairs).alias("ts_blobs"), symbols.alias("symbols"), F.array_compact(F.array("test")).alias("tests"), F.array().cast("array<string>").alias("test_provenance"))


def _doc_edges(spark, d):
    """Each document depends on the next one, whatever its source."""
    docs = _docs(spark, d).where("source <> 'src5'")
    return docs.select(F.col("path").alias("src"), F.lead("path").over(Window.orderBy("doc_id", "path")).alias("dst")).where("dst is not null")  # paths only


def _after(mine):
    """The ledger at the head: what is German was dropped, what is English is worked on again."""
    return mine.where("lang <> 'de'").withColumn("status", F.when(F.col("lang") == "en", "in_progress").otherwise(F.col("status"))).withColumn("rust", F.when(F.col("lang") != "en", F.col("rust")))


DOC_ENTRIES = f"""{SNAPSHOTS}, lab AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
tested AS (SELECT *, {BLOB.format('old')} AS b, lead(path) OVER w AS test, lead({BLOB.format('old')}) OVER w AS tblob FROM docs WHERE source <> 'src5' WINDOW w AS (PARTITION BY source ORDER BY doc_id, path)),
doc_entries AS (SELECT path AS ts, doc_id, lang, CASE WHEN toxic = 1 THEN 'skipped' WHEN quality = 1 THEN 'ported' ELSE 'in_progress' END AS status, CASE WHEN quality = 1 THEN 't/' || path END AS rust, 'm' || (doc_id % 10) AS module,
  CASE WHEN doc_id % 13 <> 0 THEN 'a base of sixteen' END AS ts_base, CASE WHEN doc_id % 11 = 0 THEN {BLOB.format("(old || 'x')")} ELSE b END AS blob, test, tblob FROM tested JOIN lab USING (doc_id)),
after AS (SELECT * REPLACE (CASE WHEN lang = 'en' THEN 'in_progress' ELSE status END AS status, CASE WHEN lang <> 'en' THEN rust END AS rust) FROM doc_entries WHERE lang <> 'de'),
doc_edges AS (SELECT * FROM (SELECT path AS src, lead(path) OVER (ORDER BY doc_id, path) AS dst FROM docs WHERE source <> 'src5') WHERE dst IS NOT NULL)"""
DOC_STALE = """{name} AS (SELECT e.*, list_sort(list_filter([CASE WHEN e.blob IS DISTINCT FROM s.blob THEN e.ts END, CASE WHEN e.test IS NOT NULL AND e.tblob IS DISTINCT FROM k.blob THEN e.test END], lambda x: x IS NOT NULL)) AS paths
  FROM {entries} e LEFT JOIN {at} s ON s.path = e.ts LEFT JOIN {at} k ON k.path = e.test WHERE ts_base IS NOT NULL AND len(paths) > 0)"""
TRACKED = "(status IN ('ported', 'verified') OR (status = 'in_progress' AND rust IS NOT NULL))"
BASE_STALE = DOC_STALE.format(name="base_stale", entries="doc_entries", at="base")
HEAD_STALE = DOC_STALE.format(name="head_stale", entries="doc_entries", at="head")
AFTER_STALE = DOC_STALE.format(name="after_stale", entries="after", at="head")
BAD = """SELECT src AS ts, dst AS dep FROM doc_edges JOIN {e} a ON a.ts = src AND a.status IN ('ported', 'verified') WHERE dst NOT IN (SELECT ts FROM {e} WHERE status <> 'in_progress')"""
LOST = f"""fresh AS (SELECT * FROM doc_entries WHERE status IN ('ported', 'verified') AND ts NOT IN (SELECT ts FROM base_stale WHERE {TRACKED}) AND ts IN (SELECT path FROM head)),
lost AS (SELECT f.ts, CASE WHEN a.ts IS NULL THEN 'removed' ELSE 'now ' || a.status END AS reason FROM fresh f LEFT JOIN after a ON a.ts = f.ts WHERE a.ts IS NULL OR NOT {TRACKED.replace('status', 'a.status').replace('rust', 'a.rust')})"""


@query(f"WITH {DOC_ENTRIES}, {HEAD_STALE} SELECT ts, array_to_string(paths, ',') AS paths FROM head_stale WHERE {TRACKED}")
def stale_docs(spark, d):
    return change.tracked_stale(_doc_entries(spark, d), _snapshots(spark, d)[1]).withColumn("paths", F.array_join("paths", ","))


@query(f"WITH {DOC_ENTRIES}, {HEAD_STALE} SELECT ts, 'a base of si' AS base, array_to_string(paths, ',') AS paths FROM head_stale WHERE status <> 'in_progress'")
def drift_report(spark, d):
    return change.drift(_doc_entries(spark, d), _snapshots(spark, d)[1]).withColumn("paths", F.array_join("paths", ","))


@query(f"WITH {DOC_ENTRIES} SELECT ts FROM doc_entries WHERE status <> 'in_progress' AND ts_base IS NULL")
def unstamped_docs(spark, d):
    return change.unstamped(_doc_entries(spark, d))


@query(f"WITH {DOC_ENTRIES}, {BASE_STALE}, {HEAD_STALE} SELECT ts FROM head_stale WHERE {TRACKED} AND ts NOT IN (SELECT ts FROM base_stale WHERE {TRACKED})")
def newly_stale(spark, d):
    base, head = _snapshots(spark, d)
    mine = _doc_entries(spark, d)
    return change.newly_stale(change.tracked_stale(mine, base), change.tracked_stale(mine, head)).select("ts")


@query(f"WITH {DOC_ENTRIES}, {BASE_STALE}, {LOST} SELECT ts, reason FROM lost")
def lost_entries(spark, d):
    base, head = _snapshots(spark, d)
    mine = _doc_entries(spark, d)
    return change.lost_entries(mine, _after(mine), change.tracked_stale(mine, base), head)


@query(f"WITH {PART_EDGES}, {ENTRIES} SELECT DISTINCT e.src AS ts, e.dst AS dep FROM part_edges e JOIN entries a ON a.ts = e.src WHERE a.status IN ('ported', 'verified') AND e.dst NOT IN (SELECT ts FROM entries WHERE status <> 'in_progress') AND NOT e.type_only")
def unported_imports(spark, d):
    return change.unported_imports(entries_of(spark, d), part_value_edges(spark, d))


@query(f"""WITH {DOC_ENTRIES}, {BASE_STALE}, {AFTER_STALE}, {LOST}
SELECT CASE WHEN ts IN (SELECT path FROM head) THEN 'newly stale' ELSE 'source deleted' END AS rule, ts, array_to_string(paths, ', ') AS detail FROM after_stale WHERE {TRACKED} AND ts NOT IN (SELECT ts FROM base_stale WHERE {TRACKED})
UNION ALL (SELECT 'imports unported', ts, dep FROM ({BAD.format(e='after')} EXCEPT {BAD.format(e='doc_entries')}))
UNION ALL SELECT 'lost entry', ts, reason FROM lost""")
def gate_findings(spark, d):
    base, head = _snapshots(spark, d)
    mine, edges = _doc_entries(spark, d), _doc_edges(spark, d)
    now = _after(mine)
    return change.gate(
        {"entries": mine, "stale": change.tracked_stale(mine, base), "violations": change.unported_imports(mine, edges)},
        {"entries": now, "stale": change.tracked_stale(now, head), "violations": change.unported_imports(now, edges)}, head)


@query(f"""WITH {DOC_ENTRIES}, present AS (SELECT path FROM head UNION SELECT rust FROM doc_entries WHERE rust IS NOT NULL AND doc_id % 3 <> 0),
links AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS name FROM pages), ported AS (SELECT * FROM doc_entries WHERE status IN ('ported', 'verified'))
SELECT 'imports unported' AS rule, 'error' AS severity, ts AS subject, dep AS detail FROM ({BAD.format(e='doc_entries')})
UNION ALL SELECT CASE WHEN ts IN (SELECT path FROM present) THEN 'not reachable' ELSE 'source gone' END, CASE WHEN ts IN (SELECT path FROM present) THEN 'warning' ELSE 'error' END, ts, NULL FROM doc_entries WHERE split_part(ts, '/', 1) = 'src2' OR doc_id % 17 = 0
UNION ALL SELECT 'no base', 'warning', ts, NULL FROM doc_entries WHERE status <> 'in_progress' AND ts_base IS NULL
UNION ALL SELECT 'no target', 'error', ts, NULL FROM ported WHERE rust IS NULL
UNION ALL SELECT 'target missing', 'error', ts, rust FROM ported WHERE rust NOT IN (SELECT path FROM present)
UNION ALL SELECT 'symbol not found', 'error', ts, 'm::f' FROM ported WHERE module IS NOT NULL AND doc_id % 2 = 1 AND starts_with('m::f', module)
UNION ALL SELECT 'symbol not found', 'error', ts, 'n::h' || doc_id FROM ported WHERE starts_with('n::h' || doc_id, module)
UNION ALL SELECT 'export unmapped', 'warning', ts, 'k' FROM ported WHERE doc_id % 5 = 0
UNION ALL SELECT 'test not in graph', 'error', e.ts, e.test FROM doc_entries e JOIN docs t ON t.path = e.test WHERE t.doc_id % 4 = 0
UNION ALL SELECT 'target collision', 'error', path, sources FROM (SELECT 'u/' || doc_id % 700 AS path, string_agg(path, ', ' ORDER BY path) AS sources FROM docs WHERE lang = 'en' GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'external unmapped', 'warning', name, CAST(count(DISTINCT page_id) AS VARCHAR) FROM links WHERE name NOT IN ('/The', '/Der', '/Les', '/Los', '/And') GROUP BY name
UNION ALL SELECT 'module not declared', 'error', ts, module FROM ported WHERE module > 'm4'""")
def check_findings(spark, d):
    """All rules of the check over documents: see the inputs of check.findings."""
    mine, docs = _doc_entries(spark, d), _docs(spark, d)
    head = _snapshots(spark, d)[1].select("path")
    present = head.unionByName(mine.where("rust is not null and doc_id % 3 <> 0").select(F.col("rust").alias("path"))).distinct()
    inside = docs.where("source <> 'src2' and doc_id % 17 <> 0").select(F.col("path").alias("rel"))
    rels = docs.select("doc_id", F.col("path").alias("rel"))
    exports = rels.select("doc_id", "rel", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("kind")) for n, k in (("f", "function"), ("k", "const"), ("d", "default"))])).alias("e")).select("rel", "e.*", "doc_id").where("name <> 'k' or doc_id % 5 = 0").drop("doc_id")
    items = mine.where("doc_id % 2 = 0").select(F.col("rust").alias("path"), F.lit("m::f").alias("item"))
    targets = docs.where("lang = 'en'").select(F.col("path").alias("source"), F.concat(F.lit("u/"), (F.col("doc_id") % 700).cast("string")).alias("path"))
    uses = _links(spark, d).select(F.col("page_id").alias("rel"), F.col("target").alias("name"))
    declared = spark.range(5).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("module"))
    return check.findings(mine, inside, present, _doc_edges(spark, d), targets, items, exports, docs.where("doc_id % 4 <> 0").select(F.col("path").alias("test")), uses, _package_rules(spark), declared)


@query(f"""WITH {DOC_ENTRIES}, args AS (SELECT ts FROM doc_entries WHERE doc_id % 3 = 0), done AS (SELECT ts FROM doc_entries WHERE status <> 'in_progress')
SELECT src AS rel, dst AS needs FROM doc_edges WHERE src IN (SELECT ts FROM args) AND dst NOT IN (SELECT ts FROM done) AND dst NOT IN (SELECT ts FROM args)""")
def done_refusals(spark, d):
    mine = _doc_entries(spark, d)
    return ledger.done_refusals(mine.where("doc_id % 3 = 0").select(F.col("ts").alias("rel")), _doc_edges(spark, d), mine)


@query(f"""{PLAN}, args AS (SELECT node AS rel, unit FROM unit_of WHERE node % 3 = 0), finished AS (SELECT ts FROM entries WHERE status <> 'in_progress'),
asked AS (SELECT a.rel, u.node AS needs FROM args a JOIN unit_of u USING (unit) WHERE u.node <> a.rel UNION SELECT a.rel, e.dst FROM args a JOIN value_edges e ON e.src = a.rel)
SELECT rel, needs FROM asked WHERE needs NOT IN (SELECT ts FROM finished) AND needs NOT IN (SELECT rel FROM args)""")
def start_refusals(spark, d):
    unit_of, *_ = _plan_inputs(spark, d)
    return ledger.start_refusals(unit_of.where("node % 3 = 0").select(F.col("node").alias("rel")), event_value_edges(spark, d), unit_of, event_entries(spark, d))


@query(f"""WITH {DOC_ENTRIES}, shown AS (SELECT test, ts AS rel FROM doc_entries WHERE test IS NOT NULL AND doc_id % 3 <> 1)
SELECT e.ts, CASE WHEN doc_id % 2 = 0 THEN 'verified' ELSE 'in_progress' END AS status, CASE WHEN doc_id % 2 = 0 THEN 'new/' || e.ts ELSE e.rust END AS rust, CASE WHEN doc_id % 2 = 0 THEN 'later' ELSE ts_base END AS ts_base,
  coalesce(CASE WHEN doc_id % 2 = 0 AND s.rel IS NULL THEN '' ELSE e.test END, '') AS tests, CASE WHEN doc_id % 2 = 0 AND s.rel IS NULL THEN coalesce(e.test, '') ELSE '' END AS provenance
FROM doc_entries e LEFT JOIN shown s ON s.rel = e.ts WHERE doc_id % 4 IN (0, 1)""")
def ledger_changes(spark, d):
    """Half of some entries are recorded as verified, half started again."""
    mine = _doc_entries(spark, d).withColumn("ported_at", F.lit(None).cast("timestamp")).withColumn("notes", F.lit(None).cast("string"))
    args = mine.where("doc_id % 4 = 0").select(F.col("ts").alias("rel"))
    targets = args.select("rel", F.concat(F.lit("new/"), F.col("rel")).alias("rust"), F.lit("m").alias("module"))
    covers = mine.where("size(tests) > 0 and doc_id % 3 <> 1").select(F.col("tests")[0].alias("test"), F.col("ts").alias("rel"))
    none = spark.range(0)
    symbols = none.select(F.lit("").alias("rel"), F.lit("").alias("name"), F.lit("").alias("item"))
    given = none.select(F.lit("").alias("rel"), F.lit("").alias("test"), F.lit(False).alias("provenance"))
    done = ledger.done(mine, args, targets, symbols, covers, given, _snapshots(spark, d)[1], "later", F.current_timestamp(), verified=True)
    begun = ledger.start(mine, mine.where("doc_id % 4 = 1").select(F.col("ts").alias("rel")))
    return done.unionByName(begun).select("ts", "status", "rust", "ts_base", F.array_join("tests", ",").alias("tests"), F.array_join("test_provenance", ",").alias("provenance"))


@query(f"WITH {SNAPSHOTS}, asked AS (SELECT path FROM docs UNION SELECT DISTINCT source FROM docs UNION SELECT DISTINCT source || '/' || lang FROM docs UNION SELECT 'no/' || source FROM docs) SELECT path, CASE WHEN path IN (SELECT path FROM head) THEN 'blob' WHEN path IN (SELECT split_part(path, '/', 1) FROM head) OR path IN (SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) FROM head) THEN 'tree' END AS kind FROM asked")
def object_kinds(spark, d):
    docs, head = _docs(spark, d), _snapshots(spark, d)[1].withColumn("rev", F.lit("head"))
    asked = reduce(DataFrame.unionByName, (docs.select(c.alias("path")) for c in (F.col("path"), F.col("source"), F.concat_ws("/", "source", "lang"), F.concat(F.lit("no/"), F.col("source"))))).distinct()
    return change.kinds_at(asked.withColumn("rev", F.lit("head")), head).select("path", "kind")


@query(f"WITH {SNAPSHOTS} SELECT coalesce(b.path, h.path) AS path FROM base b FULL JOIN head h ON b.path = h.path WHERE b.blob IS DISTINCT FROM h.blob AND starts_with(coalesce(b.path, h.path), 'src1/')")
def changed_below(spark, d):
    return change.changed(*_snapshots(spark, d), under="src1")


@query("""WITH RECURSIVE commits AS (SELECT p_partkey AS oid, p_partkey // 2 AS parent FROM part WHERE p_partkey > 1 UNION ALL SELECT p_partkey, p_partkey - 3 FROM part WHERE p_size > 40 AND p_partkey > 3),
reach AS (SELECT oid, parent FROM commits UNION SELECT r.oid, c.parent FROM reach r JOIN commits c ON r.parent = c.oid),
heads AS (SELECT unnest([max(p_partkey), max(p_partkey) - 1, max(p_partkey) // 2]) AS oid FROM part),
mine AS (SELECT oid AS head, oid FROM heads UNION SELECT h.oid, r.parent FROM heads h JOIN reach r ON r.oid = h.oid),
common AS (SELECT oid FROM mine GROUP BY oid HAVING count(DISTINCT head) = (SELECT count(*) FROM heads))
SELECT oid FROM common WHERE oid NOT IN (SELECT parent FROM reach WHERE oid IN (SELECT oid FROM common))""")
def merge_base(spark, d):
    part = table(spark, d, "part")
    k = F.col("p_partkey")
    commits = part.where(k > 1).select(k.alias("oid"), F.floor(k / 2).alias("parent")).unionByName(part.where((F.col("p_size") > 40) & (k > 3)).select(k.alias("oid"), (k - 3).alias("parent")))
    top = part.agg(F.max("p_partkey").alias("m"))
    heads = top.select(F.explode(F.array("m", F.col("m") - 1, F.floor(F.col("m") / 2))).alias("oid"))
    return graph.merge_bases(commits, heads)


# Resolution


@query("""SELECT rel, arg_max(name, length(dir)) AS package FROM (SELECT DISTINCT replace(p_name, ' ', '/') || '/' || p_partkey AS rel FROM part) f
LEFT JOIN (SELECT DISTINCT split_part(p_name, ' ', 1) AS dir, 'pkg-' || split_part(p_name, ' ', 1) AS name FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 1) || '/' || split_part(p_name, ' ', 2), 'sub-' || split_part(p_name, ' ', 2) FROM part WHERE p_name LIKE '% %' AND p_size > 25) p ON starts_with(rel, dir || '/') GROUP BY rel""")
def owner_longest_prefix(spark, d):
    part = table(spark, d, "part")
    words = F.split("p_name", " ")
    files = part.select(F.concat(F.replace("p_name", F.lit(" "), F.lit("/")), F.lit("/"), F.col("p_partkey").cast("string")).alias("rel")).distinct()
    one = part.select(words[0].alias("dir"), F.concat(F.lit("pkg-"), words[0]).alias("name")).distinct()
    two = part.where("contains(p_name, ' ') and p_size > 25").select(F.concat_ws("/", words[0], words[1]).alias("dir"), F.concat(F.lit("sub-"), words[1]).alias("name")).distinct()
    return resolve.owners(files, one.unionByName(two))


WORKSPACE = f"""{IMPORTS.format(key='l_partkey')},
pk AS (SELECT p_partkey AS k, lower(replace(p_brand, '#', '')) AS b, CAST(split_part(p_brand, '#', 2) AS INTEGER) AS n, p_size % 3 = 2 AS deep, 'src/' || lower(replace(p_brand, '#', '')) || '/src/p' || p_partkey || CASE p_size % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' ELSE '/index.ts' END AS rel FROM part),
asked AS (SELECT a.rel, a.b AS ab, a.deep, c.b, c.n, c.k, c.rel AS target, (a.k + c.k) % 6 AS v FROM (SELECT DISTINCT src, dst FROM imports) i JOIN pk a ON a.k = i.src JOIN pk c ON c.k = i.dst),
specs AS (SELECT *, CASE v WHEN 0 THEN './p' || k WHEN 1 THEN '../../' || b || '/src/p' || k WHEN 2 THEN '@x/' || b || '/p' || k WHEN 3 THEN '@x/' || b || '/lib/p' || k WHEN 4 THEN CASE WHEN k % 2 = 1 THEN 'node:fs' ELSE 'fs/promises' END ELSE CASE WHEN k % 2 = 1 THEN 'lodash/p' || k ELSE 'data/p' || k || '.json' END END AS specifier FROM asked)"""


def _workspace(spark, d):
    """Parts as source files of a package for each brand, and specifiers of all kinds for what they import."""
    brand = F.lower(F.replace("p_brand", F.lit("#"), F.lit("")))
    ends = F.when(F.col("p_size") % 3 == 0, ".ts").when(F.col("p_size") % 3 == 1, ".tsx").otherwise("/index.ts")
    files = table(spark, d, "part").select(F.col("p_partkey").alias("k"), brand.alias("b"), F.split("p_brand", "#")[1].cast("int").alias("n"), F.concat(F.lit("src/"), brand, F.lit("/src/p"), F.col("p_partkey").cast("string"), ends).alias("rel"))
    brands = files.select("b", "n").distinct()
    spec = F.when(F.col("n") % 10 == 4, F.concat(F.lit("npm:far-"), F.col("n").cast("string"), F.lit("@1.2"))).when(F.col("n") % 10 == 5, "^1").otherwise("workspace:*")
    deps = brands.agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("@x/"), F.col("b")), spec))).alias("deps"))
    exports = F.when(F.col("n") % 3 == 0, '{"./lib/*": {"types": {"x": "./no.d.ts"}, "default": "./dist/*.js"}}')
    packages = brands.select(F.concat(F.lit("@x/"), F.col("b")).alias("name"), F.concat(F.lit("src/"), F.col("b")).alias("dir"), F.lit(None).cast("string").alias("main"), exports.alias("exports")).crossJoin(F.broadcast(deps))  # one row
    x, y = (files.select(*[F.col(c).alias(f"{p}{c}") for c in files.columns]) for p in "ac")
    pairs = _imports(spark, d, "l_partkey").select("src", "dst").distinct().join(x, F.col("src") == F.col("ak")).join(y, F.col("dst") == F.col("ck"))
    k, odd, v = F.col("ck").cast("string"), F.col("ck") % 2 == 1, (F.col("ak") + F.col("ck")) % 6
    specifier = (
        F.when(v == 0, F.concat(F.lit("./p"), k))
        .when(v == 1, F.concat(F.lit("../../"), F.col("cb"), F.lit("/src/p"), k))
        .when(v == 2, F.concat(F.lit("@x/"), F.col("cb"), F.lit("/p"), k))
        .when(v == 3, F.concat(F.lit("@x/"), F.col("cb"), F.lit("/lib/p"), k))
        .when(v == 4, F.when(odd, "node:fs").otherwise("fs/promises"))
        .otherwise(F.when(odd, F.concat(F.lit("lodash/p"), k)).otherwise(F.concat(F.lit("data/p"), k, F.lit(".json"))))
    )
    imports = pairs.select(F.col("arel").alias("rel"), specifier.alias("specifier")).distinct()
    return files.select("rel"), packages, imports


@query(f"""WITH {WORKSPACE} SELECT DISTINCT rel, specifier, CASE WHEN v < 2 THEN CASE WHEN NOT deep AND (v = 1 OR ab = b) THEN 'file' ELSE 'unresolved' END WHEN v > 3 OR n % 10 IN (4, 5) OR b = 'brand11' THEN 'external' WHEN v = 2 OR n % 3 = 0 THEN 'file' ELSE 'unresolved' END AS tag,
CASE WHEN v < 2 THEN CASE WHEN NOT deep AND (v = 1 OR ab = b) THEN target ELSE specifier END WHEN v = 4 THEN CASE WHEN k % 2 = 1 THEN 'node:fs' ELSE 'node:fs/promises' END WHEN v = 5 THEN CASE WHEN k % 2 = 1 THEN 'lodash' ELSE 'json-asset' END
  WHEN n % 10 = 4 THEN 'far-' || n WHEN n % 10 = 5 OR b = 'brand11' THEN '@x/' || b WHEN v = 2 OR n % 3 = 0 THEN target ELSE specifier END AS value FROM specs""")
def resolve_imports(spark, d):
    files, packages, imports = _workspace(spark, d)
    return resolve.resolve(resolve.owners(files, packages).join(imports, "rel"), files, packages, ["@x/brand11"]).select("rel", "specifier", "tag", "value")


@query(f"WITH {WORKSPACE} SELECT DISTINCT rel, specifier, CASE WHEN v IN (2, 3) AND n % 10 <> 4 THEN '@x/' || b END AS local FROM specs WHERE v > 1")
def local_packages(spark, d):
    files, packages, imports = _workspace(spark, d)
    asked = resolve.owners(files, packages).join(imports, "rel").where("specifier not like '.%'")
    return resolve.local_package(asked, packages).select("rel", "specifier", "local")


@query(f"WITH {WORKSPACE}, linked AS (SELECT rel, CASE WHEN n % 10 NOT IN (4, 5) AND b <> 'brand11' AND (v = 2 OR (v = 3 AND n % 3 = 0)) OR (v < 2 AND NOT deep AND (v = 1 OR ab = b)) THEN target END AS target FROM specs) SELECT target AS file, count(DISTINCT rel) AS importers FROM linked WHERE target IS NOT NULL GROUP BY target")
def importer_counts(spark, d):
    x = resolve_imports(spark, d).where("tag = 'file'")
    return x.groupBy(F.col("value").alias("file")).agg(F.count_distinct("rel").alias("importers"))


@query("""WITH f AS (SELECT p_partkey, 'src/' || lower(split_part(p_brand, '#', 1)) || '/src/' || replace(p_name, ' ', '/') || CASE WHEN p_size % 4 = 0 THEN '/index.ts' WHEN p_size % 4 = 1 THEN '.tsx' ELSE '.ts' END AS rel, p_size % 2 = 0 AS main FROM part),
g AS (SELECT *, CASE WHEN main THEN '' ELSE 'kit/' END || regexp_replace(regexp_replace(rel, '^src/brand/src/', ''), '(/index)?[.]tsx?$', '') AS stem, ends_with(rel, '/index.ts') AS dir FROM f)
SELECT p_partkey, rel, stem || CASE WHEN dir THEN '/mod.rs' ELSE '.rs' END AS target, replace(stem, '/', '::') AS module FROM g""")
def target_files(spark, d):
    part = table(spark, d, "part")
    end = F.when(F.col("p_size") % 4 == 0, "/index.ts").when(F.col("p_size") % 4 == 1, ".tsx").otherwise(".ts")
    x = part.select("p_partkey", F.concat(F.lit("src/"), F.lower(F.split("p_brand", "#")[0]), F.lit("/src/"), F.replace("p_name", F.lit(" "), F.lit("/")), end).alias("rel"), (F.col("p_size") % 2 == 0).alias("main"))
    x = x.withColumn("target", paths.target_file(F.col("rel"), F.lit("src/brand"), F.lit("kit"), F.col("main")))
    return x.select("p_partkey", "rel", "target", paths.module_of(F.col("target")).alias("module"))


@query("SELECT doc_id, path FROM (SELECT doc_id, source || '/' || lang || '/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.test.ts' WHEN doc_id % 3 = 1 THEN '.d.ts' ELSE '.tsx' END AS path FROM documents) WHERE doc_id % 3 = 2 AND NOT regexp_matches(path, '^src[12]/') AND NOT regexp_matches(path, '^[^/]*/de/.*')")
def in_scope_files(spark, d):
    from ravelin.operators import predicates as p

    end = F.when(F.col("doc_id") % 3 == 0, ".test.ts").when(F.col("doc_id") % 3 == 1, ".d.ts").otherwise(".tsx")
    x = table(spark, d, "documents").select("doc_id", F.concat(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")), end).alias("path"))
    at = F.col("path")
    return x.where(p.is_source(at, ["ts", "tsx"]) & ~p.has_marker(at, ["/tests/", ".test."]) & ~p.excluded(at, ["src{1,2}/**", "*/de/**"]))


@query("""WITH feet AS (SELECT o_orderkey AS batch, 'c' || o_custkey AS path, 'registers' AS kind FROM orders WHERE o_orderstatus = 'P' UNION SELECT l_orderkey, 'p' || l_partkey, 'writes' FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus = 'P' WHERE l_linenumber = 1 UNION SELECT o_orderkey, 'c' || o_custkey, 'writes' FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 5 = 0)
SELECT DISTINCT least(x.batch, y.batch) AS a, greatest(x.batch, y.batch) AS b FROM feet x JOIN feet y ON x.path = y.path AND x.batch <> y.batch WHERE x.kind = 'writes'""")
def batch_conflicts(spark, d):
    orders = table(spark, d, "orders").where("o_orderstatus = 'P'")
    c = F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("path")
    first = table(spark, d, "lineitem").where("l_linenumber = 1").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    feet = orders.select(F.col("o_orderkey").alias("batch"), c, F.lit("registers").alias("kind")).unionByName(first.select(F.col("l_orderkey").alias("batch"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("path"), F.lit("writes").alias("kind"))).unionByName(orders.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("batch"), c, F.lit("writes").alias("kind")))
    return planning.conflicts(feet.distinct())


LINKS = "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target FROM pages"


def _links(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("target"))


@query(f"""WITH links AS ({LINKS}), files AS (SELECT DISTINCT p_brand || '.ts' AS rel FROM part UNION SELECT lang || '/' || source || '.ts' FROM documents),
asked AS (SELECT DISTINCT doc_id, [lang || '/' || source || '.tsx', lang || '/' || source || '.ts', source || '.ts'] AS c FROM documents),
each AS (SELECT doc_id, unnest(c) AS rel, unnest(range(1, 4)) AS ord FROM asked)
SELECT a.doc_id, (SELECT arg_min(rel, ord) FROM each e WHERE e.doc_id = a.doc_id AND rel IN (SELECT rel FROM files)) AS file FROM asked a""")
def first_candidate(spark, d):
    docs = table(spark, d, "documents")
    both = F.concat_ws("/", "lang", "source")
    files = table(spark, d, "part").select(F.concat("p_brand", F.lit(".ts")).alias("rel")).unionByName(docs.select(F.concat(both, F.lit(".ts")).alias("rel")))
    asked = docs.select("doc_id", F.array(F.concat(both, F.lit(".tsx")), F.concat(both, F.lit(".ts")), F.concat("source", F.lit(".ts"))).alias("candidates"))
    return resolve.first_candidate(asked, files, ["doc_id"])


@query(f"""WITH links AS ({LINKS}), rules AS (SELECT DISTINCT '/' || upper(left(l, 1)) || substr(l, 2) AS npm, lang AS rust FROM (SELECT lower(unnest(['the', 'der', 'les', 'los', 'and'])) AS l, unnest(['en', 'de', 'fr', 'es', 'en']) AS lang))
SELECT target AS name, count(DISTINCT page_id) AS files, coalesce(any_value(rust), 'NO MAPPING') AS mapping FROM links LEFT JOIN rules ON target = npm GROUP BY target""")
def externals_report(spark, d):
    return check.externals_report(_links(spark, d).select(F.col("page_id").alias("rel"), F.col("target").alias("name")), _package_rules(spark))


def _package_rules(spark):
    return spark.sql("SELECT * FROM VALUES ('/The', 'en'), ('/Der', 'de'), ('/Les', 'fr'), ('/Los', 'es'), ('/And', 'en') AS t(npm, rust)")


@query(f"WITH links AS ({LINKS}) SELECT target AS name, count(DISTINCT page_id) AS files FROM links WHERE target NOT IN ('/The', '/Der', '/Les', '/Los', '/And') GROUP BY target")
def unmapped_externals(spark, d):
    return check.unmapped_externals(_links(spark, d).select(F.col("page_id").alias("rel"), F.col("target").alias("name")), _package_rules(spark))


@query(f"WITH links AS ({LINKS}) SELECT target, count(DISTINCT page_id) AS files FROM links GROUP BY target ORDER BY files DESC, target LIMIT 10")
def topk_externals(spark, d):
    return _links(spark, d).groupBy("target").agg(F.count_distinct("page_id").alias("files")).orderBy(F.desc("files"), "target").limit(10)


@query("SELECT lower(replace(p_brand, '#', '_')) || '/' || lower(replace(p_type, ' ', '_')) || '.rs' AS path, string_agg(DISTINCT CAST(p_partkey AS VARCHAR), ',' ORDER BY CAST(p_partkey AS VARCHAR)) AS sources FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) > 1")
def target_collisions(spark, d):
    t = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("source"), F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit("/"), F.lower(F.replace("p_type", F.lit(" "), F.lit("_"))), F.lit(".rs")).alias("path"))
    return check.target_collisions(t).withColumn("sources", F.array_join("sources", ","))


RULES = {"pipe": r" \| ", "percent": "%%%", "license": "Licen[cs]ed under", "email": r"[a-z]+@[a-z]+\.[a-z]+", "never": "zzzqqqzzz"}


@query("WITH rules AS (SELECT unnest(['pipe', 'percent', 'license', 'email', 'never']) AS id, unnest([' \\| ', '%%%', 'Licen[cs]ed under', '[a-z]+@[a-z]+\\.[a-z]+', 'zzzqqqzzz']) AS pat), "
       "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents), "
       "hits AS (SELECT id, doc_id, line FROM lines, rules WHERE regexp_matches(l, pat)) "
       "SELECT r.id, count(h.doc_id) AS occurrences, count(DISTINCT h.doc_id) AS files FROM rules r LEFT JOIN hits h ON h.id = r.id GROUP BY r.id")
def rule_hits(spark, d):
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("rel"), F.posexplode(F.split("text", "\n", -1)).alias("line", "l"))
    found = F.array_compact(F.array(*[F.when(F.col("l").rlike(p), k) for k, p in RULES.items()]))
    hits = lines.select("rel", "line", F.explode(found).alias("rule"))
    rules = spark.createDataFrame([(k,) for k in RULES], "id string")
    return check.rule_hits(rules, hits)


# Functions


@query("""SELECT p_partkey, CASE WHEN s IN ('type', 'box', 'match') THEN s || '_' ELSE s END AS snake FROM (SELECT p_partkey, lower(regexp_replace(regexp_replace(regexp_replace(p_brand || '-' || replace(p_name, ' ', ''), '[-. ]', '_', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g')) AS s FROM part)""")
def snake_names(spark, d):
    return table(spark, d, "part").select("p_partkey", names.snake(F.concat("p_brand", F.lit("-"), F.replace("p_name", F.lit(" "), F.lit("")))).alias("snake"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(odd, '//+', '/', 'g'), '(^|/)(\./)+', '\1', 'g'), '[^/]+/\.\./', '', 'g'), '(^|/)(\./)+', '\1', 'g'), '^/', '') AS norm, regexp_replace(base || '/' || up, '[^/]+/\.\./', '') AS joined
FROM (SELECT doc_id, './' || source || '/..//' || lang || '/./y/../x' AS odd, source || '/a' AS base, '../' || lang AS up FROM documents)""")
def path_norm(spark, d):
    docs = table(spark, d, "documents")
    odd = F.concat(F.lit("./"), F.col("source"), F.lit("/..//"), F.col("lang"), F.lit("/./y/../x"))
    return docs.select("doc_id", paths.normal(odd).alias("norm"), paths.join(F.concat(F.col("source"), F.lit("/a")), F.concat(F.lit("../"), F.col("lang"))).alias("joined"))


@query(r"""SELECT page_id, regexp_extract(spec, '^(@[^/]+/[^/]+|[^@/][^/]*)', 1) AS name, nullif(regexp_extract(spec, '^(?:@[^/]+/[^/]+|[^@/][^/]*)/(.*)$', 1), '') AS sub, regexp_replace(regexp_replace(alias, '^npm:', ''), '(.)@[^@]*$', '\1') AS alias
FROM (SELECT page_id, base || CASE WHEN page_id > 10 THEN '/sub/x' ELSE '' END AS spec, 'npm:' || base || '@^1.2' AS alias FROM (SELECT page_id, '@' || split_part(url, '/', 3) || '/' || page_id AS base FROM pages))""")
def split_specifiers(spark, d):
    base = F.concat(F.lit("@"), F.split("url", "/")[2], F.lit("/"), F.col("page_id").cast("string"))
    spec = F.when(F.col("page_id") > 10, F.concat(base, F.lit("/sub/x"))).otherwise(base)
    return table(spark, d, "pages").select("page_id", names.package_of(spec).alias("name"), names.subpath_of(spec).alias("sub"), names.without_version(F.concat(F.lit("npm:"), base, F.lit("@^1.2"))).alias("alias"))


@query("SELECT doc_id, CASE WHEN text = '' THEN 0::BIGINT ELSE len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END END AS lines FROM documents")
def line_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", paths.line_count(F.col("text")).cast("long").alias("lines"))


@query("SELECT doc_id, CASE WHEN length(t) > 110 THEN left(t, 110) || '…' ELSE t END AS snippet FROM (SELECT doc_id, trim(string_split(text, chr(10))[1]) AS t FROM documents)")
def snippets(spark, d):
    return table(spark, d, "documents").select("doc_id", paths.snippet(F.col("text"), F.lit(1)).alias("snippet"))


# Reconciliation


@query("""WITH d AS (SELECT doc_id, text AS old, replace(text, ' the ', ' a ') AS new FROM documents), x AS (SELECT * FROM d WHERE old <> new),
l AS (SELECT doc_id, unnest(string_split(regexp_replace(old, chr(10) || '$', ''), chr(10))) AS a, unnest(string_split(regexp_replace(new, chr(10) || '$', ''), chr(10))) AS b, unnest(range(1, len(string_split(regexp_replace(old, chr(10) || '$', ''), chr(10))) + 1)) AS line FROM x),
f AS (SELECT doc_id, min(line) AS line, arg_min(a, line) AS a, arg_min(b, line) AS b FROM l WHERE a <> b GROUP BY doc_id)
SELECT doc_id, CAST(line AS INTEGER) AS line, CASE WHEN length(a) > 200 THEN left(a, 200) || '…' ELSE a END AS old_line, CASE WHEN length(b) > 200 THEN left(b, 200) || '…' ELSE b END AS new_line FROM f""")
def first_diff_line(spark, d):
    return reconcile.first_difference(_docs(spark, d).select("doc_id", "old", "new"), ["doc_id"])


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(replace(text, 'the', '<WORK>'), '[0-9]+', 'N', 'g'), 'N\.N', 'VERSION', 'g') AS clean FROM documents""")
def normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", reconcile.normalise(F.col("text"), [("[0-9]+", "N"), (r"N\.N", "VERSION")], F.lit("the")).alias("clean"))


def _observations(spark, d):
    docs = _docs(spark, d)
    case = F.col("doc_id").cast("string").alias("case")
    side = lambda s, text: docs.select(case, F.lit(s).alias("side"), F.when(F.col("source") == "src1", "timeout").otherwise("0").alias("exit"), F.col(text).alias("stdout"), F.lit("").alias("stderr"))
    files = docs.select(case, F.lit("old").alias("side"), F.col("source").alias("path"), F.lit("text").alias("kind"), F.col("lang").alias("value")).unionByName(docs.select(case, F.lit("new").alias("side"), F.when(F.col("source") == "src2", F.lit("moved")).otherwise(F.col("source")).alias("path"), F.when(F.col("source") == "src4", "dir").otherwise("text").alias("kind"), F.when(F.col("source") == "src6", "xx").otherwise(F.col("lang")).alias("value")))
    return side("old", "old").unionByName(side("new", "new")), files


DIFFERENCES = """d AS (SELECT CAST(doc_id AS VARCHAR) AS "case", source, lang, text AS old, replace(text, ' the ', ' a ') AS new FROM documents),
differences AS (SELECT "case", 'timeout' AS what, NULL AS path FROM d WHERE source = 'src1' UNION ALL SELECT "case", 'stdout', NULL FROM d WHERE old <> new
UNION ALL SELECT "case", 'file: only old', source FROM d WHERE source = 'src2' UNION ALL SELECT "case", 'file: only new', 'moved' FROM d WHERE source = 'src2'
UNION ALL SELECT "case", 'file: text became dir', source FROM d WHERE source = 'src4' UNION ALL SELECT "case", 'file: text', source FROM d WHERE source = 'src6' AND lang <> 'xx'),
status AS (SELECT d."case", CASE WHEN n > 0 AND lang = 'de' THEN 'accepted' WHEN n > 0 THEN 'differ' WHEN lang = 'de' THEN 'stale' ELSE 'same' END AS status, coalesce(n, 0) AS differences FROM d LEFT JOIN (SELECT "case", count(*) AS n FROM differences GROUP BY 1) x ON x."case" = d."case")"""


@query(f'WITH {DIFFERENCES} SELECT "case", what, path FROM differences')
def compare_differences(spark, d):
    return reconcile.differences(*_observations(spark, d))


def _statuses(spark, d):
    cases = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("name"), F.when(F.col("lang") == "de", "known").alias("accept"))
    return reconcile.statuses(cases, compare_differences(spark, d))


@query(f'WITH {DIFFERENCES} SELECT "case", status, differences FROM status')
def compare_status(spark, d):
    return _statuses(spark, d)


@query(f"WITH {DIFFERENCES} SELECT status, count(*) AS n FROM status GROUP BY status")
def compare_tallies(spark, d):
    return reconcile.tallies(_statuses(spark, d))


# Search and test kinds


@query("""WITH s AS (SELECT 'part' AS source, p_name AS name, p_brand AS detail FROM part UNION ALL SELECT 'customer', c_name, c_mktsegment FROM customer UNION ALL SELECT 'supplier', s_name, NULL FROM supplier UNION ALL SELECT 'nation', n_name, NULL FROM nation)
SELECT * FROM s WHERE contains(lower(name), 'an') OR coalesce(contains(lower(detail), 'an'), false)""")
def find_union(spark, d):
    sources = [("part", table(spark, d, "part"), "p_name", "p_brand"), ("customer", table(spark, d, "customer"), "c_name", "c_mktsegment")]
    for name in ("supplier", "nation"):
        sources.append((name, table(spark, d, name).withColumn("none", F.lit(None).cast("string")), f"{name[0]}_name", "none"))
    return search.find("AN", sources).select("source", "name", "detail")


@query("""WITH u AS (SELECT user_id AS test, event_type, CASE event_type WHEN 'purchase' THEN 'spawn' WHEN 'view' THEN 'source' WHEN 'click' THEN 'need' ELSE 'nothing' END AS kind FROM events WHERE value >= 50)
SELECT test, CASE WHEN NOT bool_or(kind = 'spawn') THEN 'in_process' WHEN NOT bool_or(kind = 'source') THEN 'black_box' ELSE 'mixed' END AS kind FROM u GROUP BY test""")
def test_kinds(spark, d):
    x = table(spark, d, "events").where("value >= 50")
    spec = F.when(F.col("event_type") == "purchase", "child_process").when(F.col("event_type") == "view", "./src").when(F.col("event_type") == "click", "lodash").otherwise("vitest")
    reached = x.select(F.col("user_id").alias("test"), kinds.reach_kind(spec, F.lit("value"), F.lit(False)).alias("kind"), spec.alias("value"))
    return kinds.classify(x.select(F.col("user_id").alias("test")).distinct(), reached).select("test", "kind")
