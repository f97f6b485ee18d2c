"""Every query with SQL against that SQL in DuckDB, and the planning queries without SQL against their rules."""

import math

import duckdb
import pytest

from ravelin import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def ordered(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda x: f"{x:.9g}" if isinstance(x, float) and math.isfinite(x) else repr(x)
    return sorted(columns), sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_its_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    want = duck.execute(queries.ORACLES[name])
    assert ordered(df.collect(), df.columns) == ordered(want.fetchall(), [c[0] for c in want.description])


def test_batches_hold_every_ready_unit_once_within_the_caps(spark):
    found = queries.batches(spark, SF).collect()
    assert sorted(r["unit"] for r in found) == sorted(r["unit"] for r in queries.ready_units(spark, SF).collect())
    size = {}
    for r in found:
        size[r["batch"]] = size.get(r["batch"], 0) + 1
    assert max(size.values()) <= 6


def test_batches_and_wave_equal_a_walk_in_order(spark):
    """First fit in the order of ranks within a directory and kind; then each batch that conflicts with none before."""
    from ravelin.plans import planning

    _, ranked, lines = queries._ranked(spark, SF)
    size = {r["unit"]: r for r in lines.collect()}
    rows = [(r["rank"], r["unit"], size[r["unit"]]["first"] // 8000 % 40, r["pending_types"] > 0, size[r["unit"]]["files"], size[r["unit"]]["lines"]) for r in sorted(ranked.collect(), key=lambda r: r["rank"])]
    want, used = {}, set()
    for rank, unit, *kind, files, n in rows:
        if unit not in used:
            used.add(unit)
            want[unit] = rank
            for _, other, *k, f, m in rows:
                if other not in used and k == kind and files + f <= 6 and n + m <= 100:
                    used.add(other)
                    want[other] = rank
                    files, n = files + f, n + m
    found = queries.batches(spark, SF).collect()
    assert {r["unit"]: r["seed_rank"] for r in found} == want and len(set(want.values())) < len(want)
    number = {s: i for i, s in enumerate(sorted(set(want.values())), 1)}
    assert all(r["batch"] == number[r["seed_rank"]] for r in found)
    feet = {}
    for r in found:
        feet.setdefault(r["batch"], set()).update({(str(r["unit"] % 4000), "writes"), (str(r["unit"] // 8000 * 8), "registers")})
    taken, accepted = [], []
    for b in sorted(feet):
        if not any(p == q and "writes" in (k, m) for own in taken for p, k in own for q, m in feet[b]):
            taken.append(feet[b])
            accepted.append(b)
    assert sorted(r["batch"] for r in queries.wave(spark, SF).collect()) == accepted and len(accepted) < len(feet)
    some = spark.createDataFrame([(b, p, k) for b, own in feet.items() for p, k in own], "batch long, path string, kind string")
    assert [r["batch"] for r in planning.wave(some.select("batch"), some, 3).collect()] == accepted[:3]


def test_catch_up_takes_every_edge(spark, tmp_path):
    import random

    rng = random.Random(5)
    line = lambda o, k, p, flag: (o, k, p, 1, "1995-01-01", 1.0, flag, "O")
    lines = [line(o, k, p, rng.choice("NAR")) for o in range(70) for k, p in enumerate(rng.sample(range(1, 41), 2))]
    kinds = {p: (rng.choice([*queries.STATUS]), rng.choice([5.0, 50.0])) for p in rng.sample(range(1, 41), 24)}
    spark.createDataFrame(lines, "l_orderkey int, l_linenumber int, l_partkey int, l_suppkey int, l_shipdate string, l_extendedprice double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(p,) for p in range(1, 41)], "p_partkey int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(p, p, 1, t, v) for p, (t, v) in kinds.items()], "event_id int, user_id int, ts int, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")

    kind = {}
    for a, b in zip(lines[::2], lines[1::2], strict=True):
        kind.setdefault((a[2], b[2]), []).append(a[6] != "N")
    edges = {e for e, v in kind.items() if any(v)}
    reach = set(edges)
    while more := {(a, d) for a, b in reach for c, d in edges if b == c} - reach:
        reach |= more
    unit = {p: min([p, *(q for q in range(1, 41) if (p, q) in reach and (q, p) in reach)]) for p in range(1, 41)}
    recorded = {p for p, (t, _) in kinds.items() if queries.STATUS[t] != "in_progress"}
    done = {p for p in recorded if kinds[p][1] >= 10}
    whole = lambda s: {u for u in unit.values() if all(p in s for p in unit if unit[p] == u)}
    had = whole(recorded)
    now = {*unit.values()} - whole(done)
    waits = {(unit[a], unit[b]) for a, b in edges if unit[a] != unit[b]}
    while gone := {a for a, b in waits if a in now - had and b not in now | had}:
        now -= gone
    wanted = {(u, u not in had) for u in now}
    found = queries.catch_up_fixpoint(spark, str(tmp_path)).collect()
    assert {(r["unit"], r["added"]) for r in found} == wanted and len(found) == len(wanted)
