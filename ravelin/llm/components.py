"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import drop_stash, sorted_join, stash

SENT = 100_000  # edges of a graph whose nodes may be broadcast


def _hang(edges: DataFrame, large: bool) -> DataFrame:
    """For each node u (column u) and neighbour v: the smaller of u and its smallest neighbour, as m.

    The minimum is combined before the exchange; the join with it has one row a node on one side, so that Spark can
    split a hub with many neighbours.
    """
    low = edges.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("n"), F.least("u", "low").alias("m"))
    return edges.join(sorted_join(low) if large else low, F.col("u") == F.col("n")).select("u", "v", "m")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (smallest node reachable) of every node in edges. Loops and nulls are left out; no edges: no rows."""
    now = stash(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark["n"] == 0 or (mark["n"], mark["h"]) == seen:
            break
        seen = mark["n"], mark["h"]
        many = mark["n"] > SENT
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hang(both, many).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _hang(large, many).select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))).where("u <> v").distinct()
        after = stash(small, "edges")
        drop_stash(now)
        now = after
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    return sorted_join(found) if mark["n"] > SENT else found
