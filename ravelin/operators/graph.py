"""Dependency graphs: edges, closure, cycles, levels, merge bases.

Edges are rows (src, dst): src depends on dst. Graphs of up to LOCAL_EDGES edges are solved in one task, as a loop of
Spark jobs costs more than the graph. Larger ones fall into pieces that no edge links; pieces of up to LOCAL_EDGES edges are
dealt to tasks whole. Only pieces larger than that run as joins until nothing changes, with state in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import batched

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.common import settle

LOCAL_EDGES = 200_000  # a bound on what one task holds
OUT_ROWS = 50_000  # rows of a result that one task holds at a time
DEALT_EDGES = 50_000  # edges for each task; and from which it solves the pieces it has, before it reads more


def small(edges: DataFrame) -> bool:
    return edges.limit(LOCAL_EDGES + 1).count() <= LOCAL_EDGES


def dependency_edges(imports: DataFrame) -> DataFrame:
    """imports (src, dst, kind, name) to one row an edge: type-only if every import is, and the names in order."""
    return imports.groupBy("src", "dst").agg(F.bool_and(F.col("kind") == "type").alias("type_only"), F.array_sort(F.collect_set("name")).alias("names"))


def _out(rows: Iterable[tuple], schema):
    """Arrow batches of at most OUT_ROWS rows, taken from rows as they are asked for: a closure may be quadratic."""
    import pyarrow as pa

    for some in batched(rows, OUT_ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


def _arrow(ddl: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def in_one_task(rows: DataFrame, solve: Callable[..., Iterable[tuple]], ddl: str) -> DataFrame:
    """solve() takes the columns of rows as lists."""
    schema, width = _arrow(ddl), len(rows.columns)

    def run(batches):
        columns = [[] for _ in range(width)]
        for b in batches:
            for have, more in zip(columns, b.columns, strict=True):
                have += more.to_pylist()
        yield from _out(solve(*columns), schema)

    return rows.coalesce(1).mapInArrow(run, ddl)


def _in_tasks(rows: DataFrame, solve: Callable[..., Iterable[tuple]], ddl: str, tasks: int) -> DataFrame:
    """As in_one_task, for rows with a column piece at the end. A task solves some whole pieces at a time."""
    schema, width = _arrow(ddl), len(rows.columns) - 1

    def run(batches):
        columns, last = [[] for _ in range(width)], None
        for b in batches:
            *values, piece = (c.to_pylist() for c in b.columns)
            begun = 0
            for i, p in enumerate(piece):
                if p != last:
                    last = p
                    if len(columns[0]) + i - begun >= DEALT_EDGES:
                        for have, more in zip(columns, values, strict=True):
                            have += more[begun:i]
                        yield from _out(solve(*columns), schema)
                        columns, begun = [[] for _ in range(width)], i
            for have, more in zip(columns, values, strict=True):
                have += more[begun:]
        yield from _out(solve(*columns), schema)

    return rows.repartition(tasks, "piece").sortWithinPartitions("piece").mapInArrow(run, ddl)


def _roots(src: list, dst: list) -> dict:
    """The smallest node that each node is linked to. A row without a dst is a node of its own."""
    up: dict = {}

    def top(a):
        while (b := up[a]) != a:
            up[a] = a = up[b]
        return a

    for a, b in zip(src, dst, strict=True):
        up.setdefault(a, a)
        if b is not None:
            up.setdefault(b, b)
            a, b = top(a), top(b)
            if a < b:
                up[b] = a
            elif b < a:
                up[a] = b
    return {a: top(a) for a in up}


def _marked(src, dst, *more):
    root = _roots(src, dst)
    return zip(src, dst, *more, [root[a] for a in src], strict=True)


def _sorted(side: DataFrame) -> DataFrame:
    """A side of a join in a loop over a large piece: joined by sorting. By the bytes of its files it may look small, and then
    every round would send it through the driver."""
    return side.hint("merge")


def _hang(edges: DataFrame) -> DataFrame:
    """For each node u and neighbour v: the smaller of u and its smallest neighbour, as m."""
    low = edges.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("n"), F.least("u", "low").alias("m"))
    return edges.join(low, F.col("u") == F.col("n")).select("u", "v", "m")


def _linked(links: DataFrame) -> DataFrame:
    """root, piece: the smallest node that a node of the links (src, dst) is linked to, by large-star and small-star steps."""
    if small(links):
        return in_one_task(links, lambda src, dst: _roots(src, dst).items(), f"root {_kind(links)}, piece {_kind(links)}")
    now, seen = settle(links.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct()), None
    while True:
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (mark["n"], mark["h"]) == seen:
            break
        seen = mark["n"], mark["h"]
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hang(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        now = settle(_hang(large).select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))).where("u <> v").distinct())
    return now.select(F.col("u").alias("root"), F.col("v").alias("piece")).unionByName(now.select(F.col("v").alias("root"), F.col("v").alias("piece")).distinct())


def _pieces(rows: DataFrame, tasks: int) -> DataFrame:
    """rows (src, dst, ...) with `piece`, the smallest node that src is linked to either way. A row without a dst only has a
    node. Ranges of nodes are linked in tasks first, so only what crosses them is left to joins."""
    near = rows.repartitionByRange(tasks, F.least("src", "dst"), F.greatest("src", "dst"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    width, schema = len(rows.columns), _arrow(f"{ddl}, root {_kind(rows)}")

    def run(batches):
        columns = [[] for _ in range(width)]
        for b in batches:
            for have, more in zip(columns, b.columns, strict=True):
                have += more.to_pylist()
        yield from _out(_marked(*columns), schema)

    near = settle(near.mapInArrow(run, f"{ddl}, root {_kind(rows)}"))
    at = near.select(F.col("src").alias("node"), "root").unionByName(near.where("dst is not null").select(F.col("dst").alias("node"), "root"))
    several = at.groupBy("node").agg(F.collect_set("root").alias("roots")).where("size(roots) > 1")  # one for each task at most
    links = settle(several.select(F.explode("roots").alias("src"), F.array_min("roots").alias("dst")).where("src <> dst").distinct())
    return near.join(_linked(links), "root", "left").select(*rows.columns, F.coalesce("piece", "root").alias("piece"))


def _solve(rows: DataFrame, solve: Callable[..., Iterable[tuple]], ddl: str, joined: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What solve() gives for rows (src, dst, ...): in one task, or for each piece in a task, or by joined() for the rows of
    pieces with more than LOCAL_EDGES rows."""
    rows = settle(rows)
    n = rows.count()
    if n <= LOCAL_EDGES:
        return in_one_task(rows, solve, ddl)
    tasks = -(-n // DEALT_EDGES)
    dealt = settle(_pieces(rows, tasks))
    large = settle(dealt.groupBy("piece").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LOCAL_EDGES).select("piece"))  # one for each task at most
    if large.isEmpty():
        return _in_tasks(dealt, solve, ddl, tasks)
    rest = joined(settle(dealt.join(F.broadcast(large), "piece", "left_semi").drop("piece")))
    return _in_tasks(dealt.join(F.broadcast(large), "piece", "left_anti").select(*dealt.columns), solve, ddl, tasks).unionByName(rest)


def _kind(edges: DataFrame) -> str:
    return edges.schema["src"].dataType.simpleString()


def _inner(edges: DataFrame) -> DataFrame:
    """edges (src, dst) with `inner`: whether an edge leads to src, so that a path can go on with this one."""
    into = edges.select(F.col("dst").alias("src")).distinct().withColumn("inner", F.lit(True))
    return edges.join(into, "src", "left").select("src", "dst", F.coalesce("inner", F.lit(False)).alias("inner"))


def closure(edges: DataFrame) -> DataFrame:
    """src, dst: every pair with a path of one edge or more. Nodes to which no edge leads take part once, when the pairs of
    the others are there."""
    edges = edges.select("src", "dst")
    ddl = f"src {_kind(edges)}, dst {_kind(edges)}"
    if small(edges):
        return in_one_task(edges, _reach, ddl)
    known = settle(_inner(edges.repartition("src").distinct()))
    inside = settle(_solve(known.where("inner").select("src", "dst"), _reach, ddl, _closure_by_joins))
    top = known.where("not inner").select("src", "dst")
    far = top.join(inside.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").select("src", F.col("far").alias("dst"))
    return inside.unionByName(top.unionByName(far).distinct())


def _closure_by_joins(edges: DataFrame) -> DataFrame:
    """Each round joins the newest pairs with the edges."""
    seen = new = settle(edges.select("src", "dst").distinct())
    step = new.select(F.col("src").alias("dst"), F.col("dst").alias("far"))
    while not new.isEmpty():
        new = settle(new.join(_sorted(step), "dst").select("src", F.col("far").alias("dst")).distinct().join(_sorted(seen), ["src", "dst"], "left_anti"))
        seen = seen.unionByName(new)
    return seen


def _reach(src, dst):
    after: dict = {}
    for a, b in zip(src, dst, strict=True):
        after.setdefault(a, set()).add(b)
    for a in after:
        seen, todo = set(), [*after[a]]
        while todo:
            b = todo.pop()
            if b not in seen:
                seen.add(b)
                todo += after.get(b, ())
        for b in seen:
            yield a, b


def _walk(after: dict, todo: list) -> set:
    """What the nodes in todo lead to, themselves included."""
    seen = set()
    while todo:
        b = todo.pop()
        if b not in seen:
            seen.add(b)
            todo += after.get(b, ())
    return seen


def _from_seeds(src, dst):
    """src, dst as _reach, only of the seeds, which are the rows without a dst."""
    after: dict = {}
    seeds = {a for a, b in zip(src, dst, strict=True) if b is None}
    for a, b in zip(src, dst, strict=True):
        if b is not None:
            after.setdefault(a, []).append(b)
    for a in seeds:
        for b in _walk(after, [*after.get(a, ())]):
            yield a, b


def _count_from_seeds(src, dst, label):
    """label, n: how many nodes the seeds of a label lead to, those seeds not counted. Seeds are the rows without a dst."""
    after: dict = {}
    seeds: dict = {}
    for a, b, x in zip(src, dst, label, strict=True):
        if b is None:
            seeds.setdefault(x, set()).add(a)
        else:
            after.setdefault(a, []).append(b)
    for x, own in seeds.items():
        if n := len(_walk(after, [b for a in own for b in after.get(a, ())]) - own):
            yield x, n


def _all_from_seeds(src, dst):
    """node: what any seed reaches, and the seeds."""
    after: dict = {}
    for a, b in zip(src, dst, strict=True):
        if b is not None:
            after.setdefault(a, []).append(b)
    todo = [a for a, b in zip(src, dst, strict=True) if b is None]
    seen = set(todo)
    while todo:
        for b in after.get(todo.pop(), ()):
            if b not in seen:
                seen.add(b)
                todo.append(b)
    for b in seen:
        yield (b,)


def _with_seeds(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(seeds.select(F.col("node").cast(edges.schema["src"].dataType).alias("src"), F.lit(None).cast(edges.schema["dst"].dataType).alias("dst")).distinct())


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """node: all nodes that the seeds (column node) reach, themselves included."""
    if small(both := _with_seeds(edges, seeds)):
        return in_one_task(both, _all_from_seeds, f"node {_kind(edges)}")
    edges, own = edges.select("src", "dst"), seeds.select(F.col("node").cast(_kind(edges)).alias("node"))
    marks = own.withColumn("seed", F.lit(True)).unionByName(edges.select(F.col("dst").alias("node"), F.lit(False).alias("seed")).distinct())
    marks = marks.groupBy(F.col("node").alias("src")).agg(F.bool_or("seed").alias("seed"), F.bool_or(~F.col("seed")).alias("inner"))
    kept = settle(edges.join(marks, "src").select("src", "dst", "seed", "inner"))
    inner = kept.where("inner").select("src", "dst")
    first = settle(kept.where("seed").select(F.col("dst").alias("node")).distinct())
    inside = _with_seeds(inner, first.join(inner.select(F.col("src").alias("node")).distinct(), "node", "left_semi"))
    deeper = _solve(inside, _all_from_seeds, f"node {_kind(edges)}", _reachable_by_joins)
    return own.unionByName(first).unionByName(deeper).distinct()


def _reachable_by_joins(rows: DataFrame) -> DataFrame:
    """One join a layer; rows without a dst are the seeds."""
    step = rows.where("dst is not null").select(F.col("src").alias("node"), F.col("dst").alias("to"))
    seen = new = settle(rows.where("dst is null").select(F.col("src").alias("node")).distinct())
    while not new.isEmpty():
        new = settle(new.join(_sorted(step), "node").select(F.col("to").alias("node")).distinct().join(_sorted(seen), "node", "left_anti"))
        seen = seen.unionByName(new)
    return seen


def _components(src, dst):
    """Strongly connected components, without recursion: (node, smallest member)."""
    after: dict = {}
    for a, b in zip(src, dst, strict=True):
        after.setdefault(a, []).append(b)
        after.setdefault(b, [])
    number, low, on, stack = {}, {}, set(), []
    for root in after:
        if root in number:
            continue
        work = [(root, iter(after[root]))]
        number[root] = low[root] = len(number)
        stack.append(root)
        on.add(root)
        while work:
            a, rest = work[-1]
            for b in rest:
                if b not in number:
                    number[b] = low[b] = len(number)
                    stack.append(b)
                    on.add(b)
                    work.append((b, iter(after[b])))
                    break
                if b in on:
                    low[a] = min(low[a], number[b])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[a])
                if low[a] == number[a]:
                    own = []
                    while True:
                        own.append(stack.pop())
                        on.discard(own[-1])
                        if own[-1] == a:
                            break
                    unit = min(own)
                    yield from ((x, unit) for x in own)


def units(edges: DataFrame) -> DataFrame:
    """node, unit of every node of the edges: nodes on a common cycle share a unit, named by its smallest member."""
    return _solve(edges.select("src", "dst"), _components, f"node {_kind(edges)}, unit {_kind(edges)}", _units_by_labels)


def _spread(edges: DataFrame, start: DataFrame) -> DataFrame:
    """node, label: the smallest label among the nodes that reach a node (edges src to dst), by propagation."""
    now = settle(start)
    while True:
        more = edges.join(_sorted(now.select(F.col("node").alias("src"), "label")), "src").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("label"))
        after = settle(now.unionByName(more).groupBy("node").agg(F.min("label").alias("label")))
        same = after.select("node", "label").exceptAll(now.select("node", "label")).isEmpty()
        now = after
        if same:
            return now


def _units_by_labels(edges: DataFrame) -> DataFrame:
    """Colours by the smallest node that reaches a node; what reaches back to that node within its colour is its unit.

    Nodes without edges in or out are units of their own and go first, as long as that takes many edges away, so that a
    chain doesn't take a round for each of its links."""
    left = settle(edges.select("src", "dst").distinct())
    every = settle(left.select(F.col("src").alias("node")).unionByName(left.select(F.col("dst").alias("node"))).distinct())
    pending, n = every, left.count()
    while n:
        inner = left.where("src <> dst")
        both = inner.select(F.col("src").alias("node")).distinct().join(_sorted(inner.select(F.col("dst").alias("node")).distinct()), "node", "left_semi")
        pending = settle(both)
        left = settle(left.join(_sorted(pending.withColumnRenamed("node", "src")), "src", "left_semi").join(_sorted(pending.withColumnRenamed("node", "dst")), "dst", "left_semi"))
        before, n = n, left.count()
        if n > 0.9 * before:
            break
    found = every.join(pending, "node", "left_anti").select("node", F.col("node").alias("unit"))
    while not pending.isEmpty():
        colour = _spread(left, pending.withColumn("label", F.col("node")))
        inside = left.join(_sorted(colour.select(F.col("node").alias("src"), F.col("label").alias("a"))), "src").join(_sorted(colour.select(F.col("node").alias("dst"), F.col("label").alias("b"))), "dst").where("a = b")
        back = settle(inside.select("src", "dst", "a"))
        seen = new = settle(colour.where("node = label").select("node", F.col("label").alias("unit")))
        while not new.isEmpty():
            hop = back.join(_sorted(new.select(F.col("node").alias("dst"), "unit")), "dst").where("unit = a").select(F.col("src").alias("node"), "unit").distinct()
            new = settle(hop.join(_sorted(seen), "node", "left_anti"))
            seen = seen.unionByName(new)
        found = found.unionByName(seen)
        gone = seen.select("node")
        pending = settle(pending.join(_sorted(gone), "node", "left_anti"))
        left = settle(left.join(_sorted(gone.withColumnRenamed("node", "src")), "src", "left_anti").join(_sorted(gone.withColumnRenamed("node", "dst")), "dst", "left_anti"))
    return found


def unit_edges(edges: DataFrame, unit_of: DataFrame) -> DataFrame:
    """src, dst between units; edges inside a unit go. Nodes that unit_of lacks are units of their own."""
    a = unit_of.select(F.col("node").alias("src"), F.col("unit").alias("a"))
    b = unit_of.select(F.col("node").alias("dst"), F.col("unit").alias("b"))
    out = edges.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("a", "src").alias("src"), F.coalesce("b", "dst").alias("dst"))
    return out.where("src <> dst").distinct()


def _levels(src, dst):
    after: dict = {}
    waits: dict = {}
    for a, b in set(zip(src, dst, strict=True)):
        after.setdefault(b, []).append(a)
        waits[a] = waits.get(a, 0) + 1
        waits.setdefault(b, 0)
    level = {n: 0 for n, k in waits.items() if not k}
    todo = list(level)
    while todo:
        b = todo.pop()
        for a in after.get(b, ()):
            level[a] = max(level.get(a, 0), level[b] + 1)
            waits[a] -= 1
            if not waits[a]:
                todo.append(a)
    return level.items()


def levels(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, level over an acyclic graph: 0 without dependencies, else one more than the highest of them."""
    out = _solve(edges.select("src", "dst"), _levels, f"node {_kind(edges)}, level long", _levels_by_joins)
    if nodes is not None:
        out = nodes.select("node").distinct().join(out, "node", "left").select("node", F.coalesce("level", F.lit(0).cast("long")).alias("level"))
    return out


def _levels_by_joins(edges: DataFrame) -> DataFrame:
    out = settle(edges.select(F.col("dst").alias("node")).unionByName(edges.select(F.col("src").alias("node"))).distinct().withColumn("level", F.lit(0).cast("long")))
    new = out.select("node", "level")
    while not new.isEmpty():
        up = edges.join(_sorted(new.select(F.col("node").alias("dst"), "level")), "dst").groupBy(F.col("src").alias("node")).agg((F.max("level") + 1).alias("level"))
        after = settle(out.unionByName(up).groupBy("node").agg(F.max("level").alias("level")))
        new = after.join(out, ["node", "level"], "left_anti")
        out = after
    return out


def reach_pairs(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """seed, node: every node that a seed (column node) reaches by one edge or more. Only pairs of seeds are made."""
    return _solve(_with_seeds(edges, seeds), _from_seeds, f"seed {_kind(edges)}, node {_kind(edges)}", lambda rows: _labels_by_joins(rows.withColumn("label", F.col("src"))).withColumnRenamed("label", "seed"))


def _labels_by_joins(rows: DataFrame) -> DataFrame:
    """label, node: what the seeds of a label, which are the rows without a dst, reach by one edge or more."""
    step = rows.where("dst is not null").select(F.col("src").alias("node"), F.col("dst").alias("to"))
    first = rows.where("dst is null").select("label", F.col("src").alias("node")).join(step, "node").select("label", F.col("to").alias("node"))
    seen = new = settle(first.distinct())
    while not new.isEmpty():
        new = settle(new.join(_sorted(step), "node").select("label", F.col("to").alias("node")).distinct().join(_sorted(seen), ["label", "node"], "left_anti"))
        seen = seen.unionByName(new)
    return seen


def reach_counts(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """label, n: how many nodes the seeds (node, label) of a label reach, those seeds not counted. Labels that reach no other
    node have no row. Tasks count what they hold, so pairs are made for large pieces only."""
    kind = seeds.schema["label"].dataType
    own = seeds.select(F.col("node").cast(_kind(edges)).alias("src"), F.lit(None).cast(_kind(edges)).alias("dst"), "label").distinct()
    rows = edges.select("src", "dst", F.lit(None).cast(kind).alias("label")).unionByName(own)

    def joined(rows):
        mine = rows.where("dst is null").select("label", F.col("src").alias("node"))
        return _labels_by_joins(rows).join(mine, ["label", "node"], "left_anti").groupBy("label").agg(F.count(F.lit(1)).alias("n"))

    return _solve(rows, _count_from_seeds, f"label {kind.simpleString()}, n long", joined).groupBy("label").agg(F.sum("n").alias("n"))


def downstream_counts(edges: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """node, downstream: how many nodes depend on a node, directly or not, itself not counted; of all nodes, or of the nodes
    `of` (node). Nodes on which none depends have no row."""
    if of is None:
        return closure(edges).where("src <> dst").groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("downstream"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reach_counts(back, of.select("node", F.col("node").alias("label"))).select(F.col("label").alias("node"), F.col("n").alias("downstream"))


def downstream_of(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """node: all that depend on the seeds, without the seeds."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reachable(back, seeds).join(seeds.select("node"), "node", "left_anti")


def merge_bases(commits: DataFrame, heads: DataFrame) -> DataFrame:
    """oid of the best common ancestors of heads (column oid), over commits (oid, parent): those that all heads reach
    (themselves included) and that no other such commit descends from. A single head is its own base. The walk starts at
    the heads, so commits that none of them reaches cost nothing."""
    step = commits.where("parent is not null").select(F.col("oid").alias("src"), F.col("parent").alias("dst"))
    top = settle(heads.select("oid").distinct())
    mine = top.select(F.col("oid").alias("head"), "oid").unionByName(reach_pairs(step, top.withColumnRenamed("oid", "node")).select(F.col("seed").alias("head"), F.col("node").alias("oid"))).distinct()
    n = top.agg(F.count(F.lit(1)).alias("n"))
    common = settle(mine.groupBy("oid").agg(F.count(F.lit(1)).alias("k")).join(F.broadcast(n), F.col("k") == F.col("n")).select("oid"))  # one row
    above = common.join(step, F.col("oid") == F.col("src")).select(F.col("dst").alias("node"))
    return common.join(reachable(step, above).withColumnRenamed("node", "oid"), "oid", "left_anti")


def catch_up(candidates: DataFrame, edges: DataFrame, recorded: DataFrame) -> DataFrame:
    """The largest set of candidates (unit, added) that can be brought up to date now: an added unit goes as long as it
    depends on a unit that is neither recorded nor still in the set. So those go that depend on a unit in neither, and the
    added ones that depend on what goes."""
    now = settle(candidates.select("unit", "added"))
    fine = recorded.select("unit").unionByName(now.select("unit")).distinct()
    had = recorded.select(F.col("unit").alias("dst")).distinct()
    loose = settle(edges.select("src", "dst").join(now.where("added").select(F.col("unit").alias("src")), "src", "left_semi").join(had, "dst", "left_anti"))
    stuck = settle(loose.join(fine.withColumnRenamed("unit", "dst"), "dst", "left_anti").select(F.col("src").alias("node")).distinct())
    if stuck.isEmpty():
        return now
    gone = reachable(loose.select(F.col("dst").alias("src"), F.col("src").alias("dst")), stuck)
    return now.join(gone.withColumnRenamed("node", "unit"), "unit", "left_anti")
