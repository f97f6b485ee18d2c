"""Mixing sources to target weights by a proportionate-fair (Pfair) schedule.

Source i with integer weight w of a total H gets w of every H slots. Its block j (from 0) is released at slot
floor(jH/w) and due at ceil((j+1)H/w); in each slot the released block with the earliest deadline goes. No source is
ever a whole block ahead of or behind its share of the slots so far.

The k sources of one weight w are scheduled as one class of weight kw whose blocks they take in turn: the window of the
class's block jk+r lies within that of block j of its source r, so the bound holds for each of them. The schedule repeats
every H slots; it is computed for one period at most, and as far as the longest source needs.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator
from functools import reduce
from math import gcd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ravelin.llm.common import local_rows, mix_hash, note_path, numbered, shared_dir, stash, table

BLOCK_ROWS = 16
TARGET = {"src0": 4, "src1": 3, "src2": 2}  # weights of the production mix; any other source: 1
PIECE_SOURCES = 10_000  # sources of a weight that one task numbers
CHUNK_SLOTS = 200_000  # slots that the driver holds at once; a longer schedule is a written table
OUT = ("weight", "block", "slot", "place")


def schedule(weights: list[int], needed: list[int] | None = None) -> Iterator[tuple[int, int, int]]:
    """(slot, class, block) of a period in the order of slots, by earliest deadline among released blocks; ties to the
    lower index. It ends when every class has had its `needed` blocks."""
    total = sum(weights)
    most = weights if needed is None else [min(n, w) for n, w in zip(needed, weights, strict=True)]
    waiting = [(0, i, 0) for i in range(len(weights))]  # release, class, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    left = sum(most)
    for t in range(total):
        if not left:
            return
        while waiting and waiting[0][0] <= t:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // weights[i]), i, j))
        due, i, j = heapq.heappop(ready)
        assert t < due
        yield t, i, j
        left -= j < most[i]
        if j + 1 < weights[i]:
            heapq.heappush(waiting, ((j + 1) * total // weights[i], i, j + 1))


def period(weights: list[int]) -> list[int]:
    """The class of every slot of a period."""
    return [i for _, i, _ in schedule(weights)]


def _slots(spark: SparkSession, weights: list[int], needed: list[int]) -> DataFrame:
    """_rv_sc (class), _rv_sb (block of the period), _rv_st (slot). A long schedule is written in chunks."""
    kind, chunk, path = "_rv_sc int, _rv_sb long, _rv_st long", [], None

    def rows() -> DataFrame:
        return local_rows(spark, [{"_rv_sc": i, "_rv_sb": j, "_rv_st": t} for t, i, j in chunk], kind)

    for x in schedule(weights, needed):
        if len(chunk) == CHUNK_SLOTS:
            path = path or note_path(spark, f"{shared_dir(spark)}/schedule-{uuid.uuid4().hex}")
            rows().write.mode("append").parquet(path)
            chunk = []
        chunk.append(x)
    if path is None:
        return F.broadcast(rows())  # at most CHUNK_SLOTS rows
    rows().write.mode("append").parquet(path)
    return spark.read.schema(kind).parquet(path)  # Spark knows its size


def mix_sources(docs: DataFrame, weights: dict[str, int] | None = None, default: int = 1, block_rows: int = BLOCK_ROWS, seed: int = 4, out: tuple[str, ...] = OUT) -> DataFrame:
    """docs with (named by `out`) the weight, block (from 0 in its source), slot (from 0) and place (within the block).

    Every row is kept. The order is (slot, place). Slots of a source that has run out stay empty, so the others keep
    their proportions. A null source is a source of its own; sources of equal weight take turns in the order of their
    names. A source's rows go task by task, in random order within a task's input; equal rows are told apart by their
    position in a written copy. Columns of docs that are named as in `out` are replaced. No rows: no rows.
    """
    spark = docs.sparkSession
    weights = TARGET if weights is None else weights
    at, part = F.monotonically_increasing_id(), F.shiftright("_rv_at", 33)
    placed = docs.drop(*out).withColumn("_rv_at", at)
    rows = stash(placed.sortWithinPartitions("source", mix_hash(seed, "_rv_at"), "_rv_at").withColumn("_rv_at", at), "mix")
    # a row for each source of a task: where it starts there, and how many of the source's rows go before
    runs = rows.groupBy(part.alias("_rv_p"), F.col("source").alias("_rv_s")).agg(F.min("_rv_at").alias("_rv_from"), F.count(F.lit(1)).alias("_rv_size"))
    before = Window.partitionBy("_rv_s").orderBy("_rv_p").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_rv_before", F.coalesce(F.sum("_rv_size").over(before), F.lit(0)))
    given = local_rows(spark, [{"_rv_g": s, "_rv_gw": w} for s, w in weights.items()], "_rv_g string, _rv_gw long")
    sources = runs.groupBy("_rv_s").agg(F.sum("_rv_size").alias("_rv_n")).join(F.broadcast(given), F.col("_rv_s") == F.col("_rv_g"), "left")  # one row for each given weight
    sources = stash(sources.select("_rv_s", "_rv_n", F.coalesce("_rv_gw", F.lit(default)).cast("long").alias("_rv_w")), "sources")
    classes = sources.groupBy("_rv_w").agg(F.count(F.lit(1)).alias("k"), F.max("_rv_n").alias("n")).orderBy("_rv_w").collect()  # a row for each distinct weight
    if any(c["_rv_w"] < 1 for c in classes):
        raise ValueError("weights are positive integers")
    own = [c["k"] * c["_rv_w"] for c in classes]
    divisor = reduce(gcd, own, 0) or 1
    own = [w // divisor for w in own]
    needed = [-(-c["n"] // block_rows) * c["k"] for c in classes]
    plan = local_rows(spark, [{"_rv_cw": c["_rv_w"], "_rv_class": i, "_rv_k": c["k"], "_rv_width": own[i]} for i, c in enumerate(classes)], "_rv_cw long, _rv_class int, _rv_k long, _rv_width long")
    pieces = 1 + sum(c["k"] for c in classes) // PIECE_SOURCES
    piece = F.pmod(F.xxhash64("_rv_s"), F.lit(pieces)).cast("int")  # one piece up to PIECE_SOURCES: then the order is that of names
    turns = numbered(sources, ["_rv_w"], [F.col("_rv_s").asc_nulls_first()], piece, "_rv_turn")
    turns = turns.join(F.broadcast(plan), F.col("_rv_w") == F.col("_rv_cw")).select(F.col("_rv_s").alias("_rv_ts"), "_rv_w", "_rv_turn", "_rv_class", "_rv_k", "_rv_width")
    runs = runs.join(turns, F.col("_rv_s").eqNullSafe(F.col("_rv_ts")))
    found = rows.join(runs, (part == F.col("_rv_p")) & F.col("source").eqNullSafe(F.col("_rv_s")))  # Spark broadcasts the runs if they are small
    n = F.col("_rv_before") + F.col("_rv_at") - F.col("_rv_from")
    found = found.withColumn("_rv_block", F.floor(n / block_rows).cast("long")).withColumn("_rv_place", (n % block_rows).cast("int"))
    found = found.withColumn("_rv_q", F.col("_rv_block") * F.col("_rv_k") + F.col("_rv_turn"))
    found = found.join(_slots(spark, own, needed), (F.col("_rv_class") == F.col("_rv_sc")) & (F.col("_rv_q") % F.col("_rv_width") == F.col("_rv_sb")))
    slot = F.expr("_rv_q div _rv_width") * sum(own) + F.col("_rv_st")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in out]
    return found.select(*kept, F.col("_rv_w").alias(out[0]), F.col("_rv_block").alias(out[1]), slot.cast("long").alias(out[2]), F.col("_rv_place").alias(out[3]))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source")).select("doc_id", "source", "weight", "block", "slot", "place")
