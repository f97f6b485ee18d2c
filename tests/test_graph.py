"""The graph operators in one task and by joins, on the same edges, against brute force."""

import pyarrow as pa
import pytest

from ravelin.operators import graph

EDGES = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 1), (7, 7), (8, 9), (5, 9)]


def test_results_leave_a_task_in_batches(monkeypatch):
    monkeypatch.setattr(graph, "OUT_ROWS", 3)
    asked = []
    rows = ((asked.append(i), i)[1:] + (i,) for i in range(10))
    out = graph._out(rows, pa.schema([("src", pa.int64()), ("dst", pa.int64())]))
    assert next(out).num_rows == 3 and len(asked) == 3
    assert [b.num_rows for b in out] == [3, 3, 1]


@pytest.mark.parametrize("local", [graph.LOCAL_EDGES, 0])
def test_both_branches_equal_brute_force(spark, monkeypatch, local):
    monkeypatch.setattr(graph, "LOCAL_EDGES", local)
    reach = set(EDGES)
    while more := {(a, d) for a, b in reach for c, d in EDGES if b == c} - reach:
        reach |= more
    nodes = {n for e in EDGES for n in e}
    unit = {n: min([n, *(m for m in nodes if (n, m) in reach and (m, n) in reach)]) for n in nodes}
    level, between = {}, {(unit[a], unit[b]) for a, b in EDGES if unit[a] != unit[b]}
    for _ in nodes:
        level = {u: max([level.get(b, 0) + 1 for a, b in between if a == u], default=0) for u in unit.values()}
    edges = spark.createDataFrame(EDGES, "src long, dst long")
    assert sorted(map(tuple, graph.closure(edges).collect())) == sorted(reach)
    unit_of = graph.units(edges)
    assert sorted(map(tuple, unit_of.collect())) == sorted(unit.items())
    found = graph.levels(spark.createDataFrame(sorted(between), "src long, dst long"), unit_of.select(unit_of["unit"].alias("node")))
    assert sorted(map(tuple, found.collect())) == sorted(level.items())
    down = {n: sum(1 for a, b in reach if b == n and a != n) for n in nodes}
    want = sorted((n, k) for n, k in down.items() if k)
    assert sorted(map(tuple, graph.downstream_counts(edges).collect())) == want
    of = spark.createDataFrame([(3,), (9,), (6,)], "node long")
    assert sorted(map(tuple, graph.downstream_counts(edges, of).collect())) == [x for x in want if x[0] in (3, 9, 6)]
    assert graph.units(edges.limit(0)).count() == 0


@pytest.mark.parametrize("local", [graph.LOCAL_EDGES, 0])
def test_random_graphs(spark, monkeypatch, local):
    import random

    monkeypatch.setattr(graph, "LOCAL_EDGES", local)
    rng = random.Random(4)
    some = [(rng.randrange(12), rng.randrange(12)) for _ in range(16)] + [(100 + i, 101 + i) for i in range(5)]
    reach = set(some)
    while more := {(a, d) for a, b in reach for c, d in some if b == c} - reach:
        reach |= more
    nodes = {n for e in some for n in e}
    unit = {n: min([n, *(m for m in nodes if (n, m) in reach and (m, n) in reach)]) for n in nodes}
    assert sorted(map(tuple, graph.units(spark.createDataFrame(some, "src long, dst long")).collect())) == sorted(unit.items())


def test_merge_bases(spark):
    """Against the definition: common ancestors that no other one descends from."""
    import random

    rng = random.Random(7)
    commits = [(i, p) for i in range(1, 40) for p in {rng.randrange(max(0, i - 6), i), rng.randrange(i)}]
    up = {}
    for i in range(40):
        up[i] = {i}.union(*(up[p] for c, p in commits if c == i))
    frame = spark.createDataFrame(commits, "oid long, parent long")
    for heads in ([39], [39, 38], [37, 30, 22], [5, 39]):
        common = set.intersection(*(up[h] for h in heads))
        want = {c for c in common if not any(c in up[d] and c != d for d in common)}
        found = graph.merge_bases(frame, spark.createDataFrame([(h,) for h in heads], "oid long"))
        assert {r["oid"] for r in found.collect()} == want


@pytest.mark.parametrize("local", [40, 7])
def test_pieces_are_dealt_to_tasks(spark, monkeypatch, local):
    """Pieces of up to 10 edges, with those of more than `local` left to joins; against one task, and without rounds of joins
    where no piece is that large."""
    import random

    rng = random.Random(8)
    some = [(100 * p + rng.randrange(6), 100 * p + rng.randrange(6)) for p in range(9) for _ in range(rng.randrange(1, 7))]
    some += [(900 + i, 901 + i) for i in range(8)] + [(905, 902), (5, 5)]
    edges = spark.createDataFrame(some, "src long, dst long")
    chain = spark.createDataFrame([(a, b) for a, b in some if a < b], "src long, dst long")
    seeds = spark.createDataFrame([(a, a % 5) for a, _ in some[::3]] + [(9999, 1)], "node long, label long")
    ask = {"units": lambda: graph.units(edges), "levels": lambda: graph.levels(chain), "counts": lambda: graph.reach_counts(edges, seeds)}
    if local > 10:
        ask |= {"closure": lambda: graph.closure(edges), "reachable": lambda: graph.reachable(edges, seeds), "pairs": lambda: graph.reach_pairs(edges, seeds), "downstream": lambda: graph.downstream_counts(edges, seeds)}
    want = {k: sorted(map(tuple, f().collect())) for k, f in ask.items()}
    monkeypatch.setattr(graph, "DEALT_EDGES", 9)
    monkeypatch.setattr(graph, "LOCAL_EDGES", local)
    if local > 10:
        monkeypatch.setattr(graph, "LOCAL_EDGES", min(local, len(some) // 2))
        for name in ("_closure_by_joins", "_reachable_by_joins", "_units_by_labels", "_levels_by_joins", "_labels_by_joins"):
            monkeypatch.setattr(graph, name, None)
    for k, f in ask.items():
        assert sorted(map(tuple, f().collect())) == want[k], k


def test_links_by_joins(spark, monkeypatch):
    import random

    rng = random.Random(3)
    links = [(a, b) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(25)) if a != b] + [(100 + i, 101 + i) for i in range(9)]
    monkeypatch.setattr(graph, "LOCAL_EDGES", 0)
    assert dict(map(tuple, graph._linked(spark.createDataFrame(links, "src long, dst long")).collect())) == graph._roots(*zip(*links, strict=True))


def test_candidates_meet_files_by_their_base(spark):
    """The first candidate in order, for every ending, against a scan; a plan without a row for each candidate."""
    from pyspark.sql import functions as F

    from ravelin.operators import resolve

    files = ["a/x.ts", "a/x.tsx", "a/x/index.ts", "a/y.d.ts", "a/y/index.tsx", "a/z.d/index.ts", "a/z.js", "a/index/index.ts", "a/w.ts.js", "a/v.json", "a/u", "src/d.ts", "a/x.jsx"]
    asked = ["a/x", "./a/x.js", "a/y", "a/y.d.ts", "a/z.d", "a/z", "a", "a/index", "a/w.ts.js", "a/v.json", "a/u", "dist/d.js", "a/none", "a/x.tsx"]
    t = F.col("t")
    rows = spark.createDataFrame([(x,) for x in asked], "t string").select("t", resolve.source_candidates(t).alias("candidates"), resolve.source_bases(t).alias("bases"))
    frame = spark.createDataFrame([(f,) for f in files], "rel string")
    want = {r["t"]: next((c for c in r["candidates"] if c in files), None) for r in rows.collect()}
    assert sum(v is not None for v in want.values()) == 9
    for some in (rows, rows.drop("bases")):
        found = resolve.first_candidate(some, frame, ["t"])
        assert dict(map(tuple, found.collect())) == want
        assert "posexplode" not in found._jdf.queryExecution().toString()


def test_loops_send_no_tables_through_the_driver(spark, monkeypatch):
    """However small a large piece's state looks, its joins are sorted: the plan of a round has no broadcast."""
    plans, keep = [], graph.settle
    monkeypatch.setattr(graph, "settle", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "src long, dst long")
    graph._units_by_labels(edges)
    assert len(plans) > 5 and not any("BroadcastHashJoin" in p for p in plans)
