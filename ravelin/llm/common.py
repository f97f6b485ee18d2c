"""What the operators of this package share: shared storage, gapless numbering, slicing of Arrow batches."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ravelin.common import drop_path, drop_stash, mark, note_path, release, shared_dir, stash  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_rows(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """A small relation planned as a JSON literal, so that reading it runs no Python."""
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(ddl)])
    kind = T.ArrayType(T._parse_datatype_string(ddl))
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), kind)))


def mix_hash(seed: int, *cols: Column | str) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def numbered(df: DataFrame, groups: list[str], order: list[Column], fine: Column, out: str) -> DataFrame:
    """Adds `out`: a gapless number from 0 within `groups`, in the order of (`fine`, *order*).

    fine is an int that cuts every group into pieces. Only a piece is sorted in one task; the pieces' counts (a row
    for each group and piece) give the offsets. So a group may hold any share of the rows.
    """
    keys = ["_rv_fine"]
    df = df.withColumn("_rv_fine", fine)
    for i, g in enumerate(groups):  # never null, so that the window and the join agree on one exchange
        df = df.withColumn(f"_rv_k{i}", F.coalesce(F.col(g).cast("string"), F.lit(""))).withColumn(f"_rv_null{i}", F.col(g).isNull())
        keys += [f"_rv_k{i}", f"_rv_null{i}"]
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rv_size"))
    before = Window.partitionBy(*keys[1:]).orderBy("_rv_fine").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, F.coalesce(F.sum("_rv_size").over(before), F.lit(0)).alias("_rv_before"))
    ranked = df.withColumn("_rv_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.join(offsets, keys).withColumn(out, F.col("_rv_before") + F.col("_rv_rn") - 1).drop(*keys, "_rv_before", "_rv_rn")


def sorted_join(df: DataFrame) -> DataFrame:
    """For a side of a join that grows with the input: it is sorted, never sent whole to the driver. Spark plans by the bytes
    of compressed files, which rows that were exploded, or whose columns repeat, exceed by far."""
    return df.hint("merge")


def give_back() -> None:
    """Returns a worker's freed memory to the system: workers stay, and the next stage may be another one's."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def text_slices(batches, ids: int, text: int, most: int = 3_000_000):
    """(ids, texts) lists from Arrow batches, cut at about `most` bytes of text; null texts become ''."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(ends):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            part = batch.slice(at, stop - at)
            yield part.column(ids).to_pylist(), ["" if x is None else x for x in part.column(text).to_pylist()]
            at = stop
    give_back()
