"""Approximate nearest neighbours by learned partitions.

On a bounded sample a neighbour graph is built and cut into balanced parts; a small network learns to tell a vector's
part (and those of its neighbours) from the vector. It routes every vector of the table to its most probable part, and
a query to several. Parts of a large table are partitioned again, each by a network of its own, until they hold about
ROWS_PER_PART vectors, so their number grows with the table. The vectors of the parts that a query visits are ranked by
their cosine in double precision. The number of visits is the smallest that reaches TARGET recall for held-out vectors
of the sample.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ravelin.llm.common import stash, table
from ravelin.llm.embeddings import matrix, unit, usable

SAMPLE, GRAPH_K, HIDDEN, EPOCHS = 6_000, 10, 128, 25  # about so many vectors are sampled of what is partitioned at once
ROWS_PER_PART, MOST_PARTS = 400, 64  # parts made at once
LEAST_ROWS = 4  # fewer are one part
TILE, QUERIES, ROUTED = 4_096, 64, 65_536  # rows of a task's matrix; queries ranked, rows routed at once
TARGET, TOP = 0.95, 5


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    out = np.empty((len(x), k), dtype=np.int64)
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -2
        out[at : at + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    """Parts of nearly equal size that cut few edges: halves along main directions, then capacity-bound moves."""
    part = np.zeros(len(x), dtype=np.int64)

    def halve(own, first, n):
        if n == 1:
            part[own] = first
            return
        y = x[own] - x[own].mean(axis=0)
        axis = np.linalg.svd(y[:2000], full_matrices=False)[2][0]
        order, left = own[np.argsort(y @ axis)], n // 2
        cut = len(own) * left // n
        halve(order[:cut], first, left)
        halve(order[cut:], first + left, n - left)

    halve(np.arange(len(x)), 0, parts)
    most, size = int(np.ceil(1.05 * len(x) / parts)), np.bincount(part, minlength=parts)
    back = [[] for _ in range(len(x))]
    for i, row in enumerate(graph.tolist()):
        for j in row:
            back[j].append(i)
    near = [np.array(list({*graph[i].tolist(), *back[i][:50]})) for i in range(len(x))]
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(len(x)).tolist():
            votes = np.bincount(part[near[i]], minlength=parts)
            votes[size >= most] = -1
            best = int(votes.argmax())
            if votes[best] > np.count_nonzero(part[near[i]] == part[i]):
                size[part[i]] -= 1
                size[best] += 1
                part[i], moved = best, moved + 1
        if not moved:
            break
    return part


@dataclass
class Router:
    """Probabilities of the parts: one hidden layer."""

    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    d: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.a + self.b, 0) @ self.c + self.d


def train(x: np.ndarray, target: np.ndarray, rng: np.random.Generator) -> Router:
    """Cross-entropy against soft targets, by Adam."""
    dims, parts = x.shape[1], target.shape[1]
    w = [rng.standard_normal((dims, HIDDEN)) * (2 / dims) ** 0.5 * dims**0.25, np.zeros(HIDDEN), rng.standard_normal((HIDDEN, parts)) * HIDDEN**-0.5, np.zeros(parts)]
    m, v, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 256):
            i = order[at : at + 256]
            h = np.maximum(x[i] @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            e = (p / p.sum(axis=1, keepdims=True) - target[i]) / len(i)
            back = (e @ w[2].T) * (h > 0)
            step += 1
            for j, g in enumerate((x[i].T @ back, back.sum(0), h.T @ e, e.sum(0))):
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.999 * v[j] + 0.001 * g * g
                w[j] -= 0.003 * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)
    return Router(*w)


def fit(sample: np.ndarray, parts: int, target: float = TARGET, seed: int = 11) -> tuple[Router, int]:
    """The router, and the number of parts to visit. A tenth of the sample is held out to choose that number."""
    if parts == 1:
        return Router(np.zeros((sample.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)), 1
    rng = np.random.default_rng(seed)
    x = unit(sample)
    x = x[rng.permutation(len(x))]
    held = max(1, len(x) // 10)
    tests, x = x[:held], x[held:]
    graph = neighbour_graph(x, min(GRAPH_K, len(x) - 1))
    part = balanced_parts(x, graph, parts, rng)
    soft = np.zeros((len(x), parts))
    np.add.at(soft, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 1 / graph.shape[1])
    soft = 0.5 * soft + 0.5 * np.eye(parts)[part]
    router = train(x, soft, rng)
    homes = router.scores(x).argmax(axis=1)
    top = min(TOP, len(x) - 1)
    best = np.argpartition(-(tests @ x.T), top, axis=1)[:, :top]
    rank = np.argsort(np.argsort(-router.scores(tests), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(rank, homes[best], axis=1).ravel()) + 1
    return router, int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)])


def parts_of(rows: int) -> int:
    return 1 if rows < LEAST_ROWS else max(2, min(MOST_PARTS, rows // ROWS_PER_PART))


def levels_of(rows: int) -> int:
    """How often a table is partitioned. Not by the sizes that parts turn out to have: equal vectors can't be parted."""
    n = 1
    while rows > 2 * ROWS_PER_PART * MOST_PARTS**n:
        n += 1
    return n


def _fit(target: float):
    def run(key, rows):
        import pyarrow as pa

        router, visits = fit(matrix(rows.column("embedding")), rows.column("parts")[0].as_py(), target)
        return pa.table({"cell": pa.array([key[0].as_py()], pa.int64()), "visits": pa.array([visits], pa.int32()), "router": pa.array([pickle.dumps([w.astype(np.float32) for w in (router.a, router.b, router.c, router.d)])], pa.binary())})

    return run


ROUTED_COLUMNS = ("row", "vec_id", "embedding", "cell", "asks")


def _routed(rows, router: bytes, visits: int):
    """rows, every one in its most probable part; those that ask in as many as they visit. Parts number as cells."""
    import pyarrow as pa

    order = np.argsort(-Router(*pickle.loads(router)).scores(unit(matrix(rows.column("embedding")))), axis=1, kind="stable")
    asks = rows.column("asks").to_numpy(zero_copy_only=False)
    n = np.where(asks, min(visits, order.shape[1]), 1)
    row = np.repeat(np.arange(len(n)), n)
    rank = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    cell = rows.column("cell").to_numpy(zero_copy_only=False)[row] * (MOST_PARTS + 1) + order[row, rank] + 1
    out = rows.take(pa.array(row))
    return [out.column("row"), out.column("vec_id"), out.column("embedding"), pa.array(cell.astype(np.int64)), out.column("asks")]


def _route_all(routers: dict[int, tuple[bytes, int]], every: int):
    """The first partitioning: a vector as one to be found, and where its id is divisible, as one that asks."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            dims = batch.column("cell").to_numpy(zero_copy_only=False)
            for d in np.unique(dims).tolist():
                own = pa.Table.from_batches([batch.take(pa.array(np.flatnonzero(dims == d)))])
                asking = np.flatnonzero(own.column("vec_id").to_numpy() % every == 0)
                both = pa.concat_tables([own, own.take(pa.array(asking))]).append_column("asks", pa.array(np.arange(len(own) + len(asking)) >= len(own)))
                yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in _routed(both, *routers[d])], names=list(ROUTED_COLUMNS))

    return run


def _route_more(rows, routers):
    """Partitions a cell's rows again."""
    import pyarrow as pa

    rows = rows.select(ROUTED_COLUMNS)
    if not rows.num_rows or not routers.num_rows:
        return rows
    return pa.table(dict(zip(ROUTED_COLUMNS, _routed(rows, routers.column("router")[0].as_py(), routers.column("visits")[0].as_py()), strict=True)))


def _rank(top: int):
    def run(rows):
        import pyarrow as pa
        import pyarrow.compute as pc

        asks, found = rows.filter(rows.column("asks")), rows.filter(pc.invert(rows.column("asks")))
        out = []
        if asks.num_rows and found.num_rows:
            found = found.sort_by([("vec_id", "ascending"), ("row", "ascending")])
            q, x = matrix(asks.column("embedding")).astype(np.float64), matrix(found.column("embedding")).astype(np.float64)
            qid, qrow = asks.column("vec_id").to_numpy(), asks.column("row").to_numpy()
            # of equal vectors only the first can be among the nearest, and one of them may be the query itself
            kind = np.unique(x, axis=0, return_inverse=True)[1].ravel()
            order = np.argsort(kind, kind="stable")
            first = np.flatnonzero(np.diff(kind[order], prepend=-1))
            place = np.arange(len(order)) - np.repeat(first, np.diff(first, append=len(order)))
            keep = np.sort(order[place <= top])
            x, xid, xrow = x[keep], found.column("vec_id").to_numpy()[keep], found.column("row").to_numpy()[keep]
            qn, xn, qu, xu = np.sqrt((q * q).sum(1)), np.sqrt((x * x).sum(1)), unit(q), unit(x)
            k = min(top, len(x))
            for at in range(0, len(q), QUERIES):
                own = slice(at, at + QUERIES)
                s = qu[own] @ xu.T
                s[qrow[own, None] == xrow] = -np.inf
                least = np.partition(s, len(x) - k, axis=1)[:, len(x) - k]
                i, j = np.nonzero((s >= least[:, None] - 1e-9) & (s > -np.inf))
                exact = (x[j] * q[own][i]).sum(1) / (xn[j] * qn[own][i])
                best = np.lexsort((xid[j], -exact, i))
                starts = np.searchsorted(i[best], np.arange(len(s)))
                best = best[np.arange(len(best)) - starts[i[best]] < top]
                out.append((qrow[own][i[best]], qid[own][i[best]], xid[j[best]], exact[best]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.float64)]
        return pa.table(dict(zip(("row", "query_id", "vec_id", "score"), map(pa.array, cols), strict=True)))

    return run


def _tiles(rows: DataFrame, size: int, count: F.Column) -> DataFrame:
    """cell, and the number of tiles of about `size` of the rows that count counts."""
    return rows.groupBy(F.col("cell").alias("c")).agg(F.ceil(count / size).cast("int").alias("tiles"), count.alias("n"))


def index(vectors: DataFrame, every: int = 50) -> DataFrame:
    """The table dealt into cells: row, vec_id, embedding, cell, asks. A cell's number tells its part at each level."""
    live = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(usable("embedding") & F.col("vec_id").isNotNull())
    live = live.select(F.monotonically_increasing_id().alias("row"), "vec_id", "embedding", F.size("embedding").cast("long").alias("cell"))
    kind = f"row long, vec_id long, embedding {live.schema['embedding'].dataType.simpleString()}, cell long, asks boolean"
    found, levels, n = None, 1, None
    level = 0
    while level < levels:
        rows = live if level == 0 else found.where("not asks")
        sizes = rows.groupBy(F.col("cell").alias("c")).agg(F.count(F.lit(1)).alias("n"))
        if level == 0:
            n = {r["c"]: r["n"] for r in sizes.collect()}  # a row for each length that vectors have
            levels = levels_of(sum(n.values()))
            sizes = live.sparkSession.createDataFrame(sorted(n.items()), "c long, n long")
        else:
            sizes = stash(sizes.where(F.col("n") > 2 * ROWS_PER_PART), "sizes")
        parts = F.when(F.col("n") < LEAST_ROWS, 1).otherwise(F.greatest(F.lit(2), F.least(F.lit(MOST_PARTS), F.expr(f"n div {ROWS_PER_PART}")))).cast("int")
        some = F.pmod(F.xxhash64("row", "vec_id", F.lit(level)), F.lit(1 << 40)) < F.lit(float(1 << 40)) * SAMPLE / F.col("n")
        sample = rows.join(sizes, F.col("cell") == F.col("c")).where(some | (F.col("n") <= SAMPLE)).select("cell", parts.alias("parts"), "embedding")
        routers = sample.groupBy("cell").applyInArrow(_fit(TARGET ** (1 / levels)), "cell long, visits int, router binary")
        if level == 0:
            known = {r["cell"]: (bytes(r["router"]), r["visits"]) for r in routers.collect()}
            found = stash(live.mapInArrow(_route_all(known, every), kind), "routed")
        else:
            routers = stash(routers, "routers")
            tiled = _tiles(found, ROUTED, F.count(F.lit(1))).join(routers.select(F.col("cell").alias("rc")), F.col("c") == F.col("rc"), "left")
            dealt = found.join(tiled, F.col("cell") == F.col("c")).withColumn("tile", F.pmod(F.xxhash64("row"), F.col("tiles")).cast("int"))
            whole = dealt.where("rc is null").select(*ROUTED_COLUMNS)
            copies = tiled.where("rc is not null").select("rc", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
            copies = routers.join(copies, F.col("cell") == F.col("rc")).select("cell", "tile", "visits", "router")
            split = dealt.where("rc is not null").select(*ROUTED_COLUMNS, "tile").groupBy("cell", "tile").cogroup(copies.groupBy("cell", "tile")).applyInArrow(_route_more, kind)
            found = stash(whole.unionByName(split), "routed")
        level += 1
    return found


def nearest(vectors: DataFrame, every: int = 50, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score of the `top` nearest found for each query (row with vec_id divisible by `every`).

    Vectors that are null, empty, zero or have null or non-finite components, and null ids, take no part. Vectors are
    searched among those of their length. Rows with one vec_id are searched one by one, and each may find the others.
    """
    dealt = index(vectors, every)
    per = dealt.groupBy(F.col("cell").alias("c")).agg(F.ceil(F.count_if("asks") / TILE).cast("int").alias("qn"), F.ceil(F.count_if(~F.col("asks")) / TILE).cast("int").alias("xn")).where("qn > 0 and xn > 0")
    cut = dealt.join(per, F.col("cell") == F.col("c"))
    own = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    every_one = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asks = cut.where("asks").withColumn("qt", own("qn")).withColumn("xt", every_one("xn"))
    rest = cut.where("not asks").withColumn("xt", own("xn")).withColumn("qt", every_one("qn"))
    tiles = asks.unionByName(rest).select("cell", "qt", "xt", "row", "vec_id", "embedding", "asks")
    found = tiles.groupBy("cell", "qt", "xt").applyInArrow(_rank(top), "row long, query_id long, vec_id long, score double")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")  # a few rows for each tile that a query visits
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op5_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
