"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Every task permutes its rows and writes them. The driver draws how many rows each written part sends to each shard (a
multivariate hypergeometric draw per part, so row and column sums are exact); a part's order is cut at the drawn counts,
the rows are exchanged, and every shard permutes what it got. Each permutation of the rows over the slots is equally
likely, up to the hash that stands for random numbers, and shard sizes differ by one at most.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm.common import local_rows, mix_hash, numbered, stash, table

MAX_PARTS = 65_536  # tasks of the first permutation; bounds the matrix: 8 shards take 4 MB of counts
NUMPY_MOST = 10**9  # numpy's generator takes populations below this; the draw from larger ones is by inversion


def hypergeometric(rng: np.random.Generator, free: int, rest: int, n: int) -> int:
    """How many of n rows drawn from free + rest are of the first kind."""
    low, high = max(0, n - rest), min(n, free)
    if low == high:
        return low
    if free + rest < NUMPY_MOST:
        return int(rng.hypergeometric(free, rest, n))
    return _by_inversion(rng, free, rest, n, low, high)


def _by_inversion(rng: np.random.Generator, free: int, rest: int, n: int, low: int, high: int) -> int:
    """The law itself, from the ratios of neighbouring probabilities; what lies 14 deviations from its mode weighs less
    than a double can tell."""
    total = free + rest
    share = free / total
    mode = min(max((n + 1) * (free + 1) // (total + 2), low), high)
    reach = 60 + int(14 * (n * share * (1 - share) * (total - n) / max(1, total - 1)) ** 0.5)
    k = np.arange(max(low, mode - reach), min(high, mode + reach) + 1, dtype=np.float64)
    steps = np.log((free - k[:-1]) / (k[:-1] + 1)) + np.log((n - k[:-1]) / (rest - n + k[:-1] + 1))
    log = np.concatenate([[0.0], np.cumsum(steps)])
    upto = np.cumsum(np.exp(log - log.max()))
    return int(k[np.searchsorted(upto, rng.random() * upto[-1], side="right").clip(0, len(k) - 1)])


def communication_matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows that each part sends to each shard. Shard sizes: sum(counts) // shards, one more for the first ones."""
    total, rng = sum(counts), np.random.default_rng(seed)
    left = [total // shards + (i < total % shards) for i in range(shards)]
    out = []
    for n in counts:
        rest, row = sum(left), []
        for i, free in enumerate(left):
            rest -= free
            row.append(hypergeometric(rng, free, rest, n))
            n -= row[i]
            left[i] -= row[i]
        out.append(row)
    return out


def shuffle_to_shards(df: DataFrame, shards: int = 8, seed: int = 20_001, rows_per_piece: int = 8_000) -> DataFrame:
    """df with `shard` int and `slot` long (gapless from 0 in each shard).

    Nulls, repeated rows and ties need no care: rows are told apart by their position in a written copy of df. An
    empty df gives an empty result. Columns named shard or slot in df are replaced; all others are kept.
    """
    spark = df.sparkSession
    at = F.monotonically_increasing_id()  # the task in the upper bits, the position in the lower 33
    placed = df.drop("shard", "slot").coalesce(MAX_PARTS).withColumn("_rv_at", at)
    rows = stash(placed.sortWithinPartitions(mix_hash(seed, "_rv_at"), "_rv_at").withColumn("_rv_at", at), "shards")
    part = F.shiftright("_rv_at", 33)
    found = {r["p"]: r["n"] for r in rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most MAX_PARTS
    names = sorted(found)
    ends = np.cumsum(np.array(communication_matrix([found[b] for b in names], shards, seed), dtype=np.int64).reshape(-1, shards), axis=1)
    matrix = local_rows(spark, [{"_rv_p": b, "_rv_ends": e} for b, e in zip(names, ends.tolist(), strict=True)], "_rv_p long, _rv_ends array<bigint>")
    place = F.col("_rv_at").bitwiseAND(F.lit((1 << 33) - 1))
    dealt = (
        rows.join(F.broadcast(matrix), part == F.col("_rv_p"))  # MAX_PARTS * shards counts at most
        .withColumn("shard", F.size(F.filter("_rv_ends", lambda e: e <= place)))
        .withColumn("_rv_h", mix_hash(seed + 2, "_rv_at"))
        .drop("_rv_p", "_rv_ends")
    )
    pieces = 1 + sum(found.values()) // (shards * rows_per_piece)
    return numbered(dealt, ["shard"], [F.col("_rv_h"), F.col("_rv_at")], F.pmod(F.shiftright("_rv_h", 16), F.lit(pieces)).cast("int"), "slot").drop("_rv_at", "_rv_h")


def op1_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
    )
    dealt = shuffle_to_shards(sized)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
