"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors are rotated and split into blocks. If two have cosine c or more, their squared distance is at most
2 - 2c, so in at least one block it is within that block's share of the budget. Each block is range-joined: every
vector lives in the cell of its nearest pivot and visits each cell of a higher number that its ball can reach; a cell's
visitors are compared with its residents. Only ids and the block's coordinates (in half precision, for which the budget
has room) travel. The candidates of all blocks form lots; a lot's vectors are fetched once, and every pair of a lot is
verified with the cosine in double precision. Cells and lots are cut into tiles, so their size has no limit.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ravelin.llm.common import stash, table
from ravelin.llm.components import components

COSINE, BLOCK_DIMS, TILE = 0.98, 16, 1024
ROWS_PER_PIVOT, LEAST_PIVOTS = 2_048, 4  # rows of the largest label
MAX_PIVOTS = 65_536  # what the driver holds and sends, 16 MB for 64 dimensions; beyond 134 million rows of one label cells grow
CELLS_AT_ONCE = 4_000_000  # distances of rows to pivots
SMALL_LOT = 64
SLACK, HALF = 1e-9, 2.0**-10  # HALF: how far rounding to half precision may move a coordinate, as a part of the largest


def usable(vector) -> F.Column:
    """Not null, not empty, every component finite, and not the zero vector."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def rotation(dims: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def unit(rows: np.ndarray) -> np.ndarray:
    x = rows.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def matrix(column) -> np.ndarray:
    """An Arrow list column whose lists are equally long."""
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(flat), -1)


def _edges(dims: int) -> list[int]:
    n = max(1, dims // BLOCK_DIMS)
    return [dims * i // n for i in range(n + 1)]


def _budget(dims: int, cosine: float) -> np.ndarray:
    """Squared distance allowed in each block, in proportion to its dimensions."""
    e = np.array(_edges(dims))
    return (2 - 2 * cosine) * np.diff(e) / dims + SLACK


def _visits(pivots: dict[int, np.ndarray], cosine: float):
    def run(batches):
        import pyarrow as pa

        turned = {d: unit(p) @ rotation(d) for d, p in pivots.items()}
        for batch in batches:
            dims = batch.column("dims").to_numpy(zero_copy_only=False)
            for d in np.unique(dims).tolist():
                every = np.flatnonzero(dims == d)
                most = max(64, CELLS_AT_ONCE // len(pivots[d]))
                for at in range(0, len(every), most):
                    own = batch.take(pa.array(every[at : at + most]))
                    yield from _cells(own, turned[d], d, cosine)

    return run


def _cells(own, p: np.ndarray, d: int, cosine: float):
    import pyarrow as pa

    edges, x = _edges(d), unit(matrix(own.column("embedding"))) @ rotation(d)
    places, radius = np.arange(len(x)), np.sqrt(_budget(d, cosine))
    for k in range(len(edges) - 1):
        a, b = x[:, edges[k] : edges[k + 1]], p[:, edges[k] : edges[k + 1]]
        inner = b @ b.T
        far = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T
        home = far.argmin(axis=1)
        norm = np.diag(inner)
        between = np.sqrt(np.maximum(norm[home][:, None] + norm - 2 * inner[home], 0))
        reach = far - far[places, home][:, None] <= 2 * between * radius[k] + SLACK  # distance to the plane between
        row, cell = np.nonzero(reach & (np.arange(len(p)) >= home[:, None]))
        n, half = len(row), a.astype(np.float16)
        width = half.shape[1] * 2
        part = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(half[row].tobytes())])
        label, rep = (own.column(c).take(pa.array(row)) for c in ("label", "rep"))
        yield pa.RecordBatch.from_arrays([label, pa.array(np.full(n, d, dtype=np.int32)), pa.array(np.full(n, k, dtype=np.int32)), pa.array(cell.astype(np.int32)), pa.array(home[row] == cell), rep, part], names=["label", "dims", "block", "cell", "resident", "rep", "part"])


def forest(mask: np.ndarray) -> list[tuple[int, int]]:
    """(row, column) entries of mask that connect all that its entries connect."""
    rows, cols = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    out, queue = [], []
    while len(rows) or queue:
        if not queue:
            queue.append((True, int(rows[0])))
            rows = rows[1:]
        is_row, at = queue.pop()
        if is_row:
            near = mask[at, cols]
            found, cols = cols[near], cols[~near]
            out += [(at, j) for j in found.tolist()]
        else:
            near = mask[rows, at]
            found, rows = rows[near], rows[~near]
            out += [(i, at) for i in found.tolist()]
        queue += [(not is_row, i) for i in found.tolist()]
    return out


def _coordinates(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float16).reshape(len(column), -1).astype(np.float64)


def _tile(cosine: float):
    def run(rows):
        """Links that connect all candidates of a tile."""
        import pyarrow as pa
        import pyarrow.compute as pc

        seen, homes = rows.filter(rows.column("visitor")), rows.filter(pc.invert(rows.column("visitor")))
        a = b = []
        if seen.num_rows and homes.num_rows:
            d, k = rows.column("dims")[0].as_py(), rows.column("block")[0].as_py()
            v, h = _coordinates(seen.column("part")), _coordinates(homes.column("part"))
            vid, hid = seen.column("rep").to_numpy(), homes.column("rep").to_numpy()
            moved = 2 * HALF * v.shape[1] ** 0.5  # of the distance, at most, as no coordinate is above 1
            most = (np.sqrt(_budget(d, cosine)[k]) + moved * min(1.0, np.abs(np.concatenate([v, h])).max() + HALF)) ** 2
            mask = ((v * v).sum(1)[:, None] + (h * h).sum(1) - 2 * v @ h.T <= most + SLACK) & (vid[:, None] != hid)
            found = forest(mask)
            a, b = [vid[i] for i, _ in found], [hid[j] for _, j in found]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _verify(cosine: float):
    def run(rows):
        """Of two tiles of a lot, or of many small lots: (a, null, n), the linked vectors of class a in the other; and links that connect them."""
        import pyarrow as pa
        import pyarrow.compute as pc

        one = rows.column("i")[0].as_py()
        same = one == rows.column("j")[0].as_py()
        first = rows.filter(pc.equal(rows.column("own"), one))
        second = first if same else rows.filter(pc.not_equal(rows.column("own"), one))
        a, b, n = [], [], []
        if first.num_rows and second.num_rows:
            vx, hx = matrix(first.column("embedding")).astype(np.float64), matrix(second.column("embedding")).astype(np.float64)
            vid, hid = first.column("rep").to_numpy(), second.column("rep").to_numpy()
            near = unit(vx) @ unit(hx).T
            mask = (near >= cosine - SLACK) & (vid[:, None] != hid) & (first.column("lot").to_numpy()[:, None] == second.column("lot").to_numpy())
            for i, j in np.argwhere(mask & (np.abs(near - cosine) <= SLACK)).tolist():  # decided by the measure itself
                mask[i, j] = (vx[i] * hx[j]).sum() / (np.sqrt((vx[i] * vx[i]).sum()) * np.sqrt((hx[j] * hx[j]).sum())) >= cosine
            for ids, counts in ((vid, mask @ second.column("size").to_numpy()), (hid, mask.T @ first.column("size").to_numpy()))[: 1 if same else 2]:
                own = np.flatnonzero(counts)
                a, b, n = a + ids[own].tolist(), b + [None] * len(own), n + counts[own].tolist()
            found = forest(mask)
            a, b, n = a + [vid[i] for i, _ in found], b + [hid[j] for _, j in found], n + [None] * len(found)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())})

    return run


def candidate_links(classes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """a, b: links that connect all pairs of classes (rep, label, dims, embedding) that are within a block's budget."""
    shape = {r["dims"]: (r["n"], r["most"]) for r in classes.groupBy("label", "dims").count().groupBy("dims").agg(F.sum("count").alias("n"), F.max("count").alias("most")).collect()}  # a row for each vector length
    if not shape:
        return classes.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0)
    want = {d: min(n, max(LEAST_PIVOTS, min(MAX_PIVOTS, most // ROWS_PER_PIVOT))) for d, (n, most) in shape.items()}
    wanted = classes.sparkSession.createDataFrame(sorted(want.items()), "d int, k int")
    share = F.col("k") * 4.0 / F.lit(sum(n for n, _ in shape.values()))  # a few rows for each pivot, of which the first are taken
    few = classes.join(wanted, F.col("dims") == F.col("d")).where((F.pmod(F.xxhash64("rep"), F.lit(1 << 40)) < F.lit(float(1 << 40)) * share) | (F.col("k") <= LEAST_PIVOTS * 4))
    order = Window.partitionBy("dims").orderBy(F.xxhash64("rep"))
    found = few.withColumn("r", F.row_number().over(order)).where("r <= k").select("dims", "embedding").collect()  # at most MAX_PIVOTS for each length
    pivots = {d: np.array([r["embedding"] for r in found if r["dims"] == d], dtype=np.float64) for d in want}
    kind = T.StructType([classes.schema["label"], *T._parse_datatype_string("dims int, block int, cell int, resident boolean, rep long, part binary").fields])
    visits = stash(classes.select("label", "dims", "rep", "embedding").mapInArrow(_visits(pivots, cosine), kind), "visits")
    cell = ["label", "dims", "block", "cell"]
    sizes = visits.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("vn"), F.ceil(F.count_if("resident") / TILE).cast("int").alias("hn"))
    sizes = sizes.select(*[F.col(c).alias(f"_{c}") for c in cell], "vn", "hn")
    cut = visits.join(sizes, [F.col(c) == F.col(f"_{c}") for c in cell])
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.greatest(F.col(n), F.lit(1)) - 1))
    keep = [*cell, "rep", "part"]
    guests = cut.where("hn > 0").withColumn("vt", own("vn")).withColumn("ht", every("hn")).select(*keep, "vt", "ht", F.lit(True).alias("visitor"))
    homes = cut.where("resident").withColumn("ht", own("hn")).withColumn("vt", every("vn")).select(*keep, "vt", "ht", F.lit(False).alias("visitor"))
    return guests.unionByName(homes).groupBy(*cell, "vt", "ht").applyInArrow(_tile(cosine), "a long, b long")


def near_pairs(classes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Of classes (rep, size, label, dims, embedding), rows of two kinds: (a, null, n), the linked vectors outside class
    a, in parts to be summed; and (a, b, null), links that connect the components."""
    lots = stash(components(candidate_links(classes, cosine), "a", "b"), "lots")
    sizes = lots.groupBy(F.col("component").alias("l")).agg(F.count(F.lit(1)).alias("k"))
    few = sizes.where(F.col("k") <= SMALL_LOT).agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n")).first()["n"]
    # small lots share groups, in which they are told apart by their number
    shared = F.when(F.col("k") <= SMALL_LOT, F.pmod(F.xxhash64("l"), F.lit(1 + few * 2 // TILE)))
    tiles = sizes.select("l", F.ceil(F.col("k") / TILE).cast("int").alias("tiles"), shared.alias("shared"))
    members = lots.join(classes.select("rep", "size", "embedding"), F.col("node") == F.col("rep")).select(F.col("component").alias("lot"), "rep", "size", "embedding")
    cut = members.join(tiles, F.col("lot") == F.col("l")).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    tiled = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiled = tiled.select(F.coalesce("shared", F.lit(-1)).alias("shared"), F.when(F.col("shared").isNull(), F.col("lot")).otherwise(0).alias("alone"), "lot", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.size("embedding").alias("dims"), "own", "rep", "size", "embedding")
    return tiled.groupBy("dims", "shared", "alone", "i", "j").applyInArrow(_verify(cosine), "a long, b long, n long")


def near_duplicate_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding, label).

    Rows with a null label, or a vector that is null, empty, zero or has null or non-finite components, link with
    nothing; so do vectors of unequal length. Equal vectors of a label are one class: they are linked with each other
    without being paired. A null vec_id keeps its row and stands for no component.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label").withColumn("ok", usable("embedding") & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    live = rows.where("ok").drop("ok")
    classes = stash(live.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size")).withColumn("dims", F.size("embedding")), "classes")
    found = stash(near_pairs(classes, cosine), "pairs")
    more = found.where("b is null").groupBy("a").agg(F.sum("n").alias("more")).withColumnRenamed("a", "ma")
    grouped = components(found.where("b is not null"), "a", "b")
    named = classes.join(more, F.col("rep") == F.col("ma"), "left").join(grouped, F.col("rep") == F.col("node"), "left")
    named = named.select(F.col("label").alias("l"), F.col("embedding").alias("e"), (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = live.join(named, (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e"))).select("vec_id", "n_links", "component_id")
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op2_embedding_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))
