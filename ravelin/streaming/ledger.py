"""A ledger kept from a stream of changes. An addition of this library: batch upserts are ledger.current()."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest(changes: DataFrame, key: str, order: str, delay: str | None = None) -> DataFrame:
    """The last change of every key, by `order`, then by the whole row; a streaming aggregation in update mode. With a
    delay, changes later than that are dropped and the state of old keys goes."""
    if delay is not None:
        changes = changes.withWatermark(order, delay)
    rest = [c for c in changes.columns if c not in (key, order)]
    return changes.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("last")).select(key, "last.*")


def keep(changes: DataFrame, path: str, checkpoint: str, key: str, order: str) -> StreamingQuery:
    """Writes each micro-batch's last change of every key under `path`/batch=<id>. A batch that is run again replaces its
    own folder, so each takes effect once. read() gives the view."""

    def put(batch: DataFrame, number: int) -> None:
        latest(batch, key, order).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read(spark, path: str, key: str, order: str) -> DataFrame:
    return latest(spark.read.option("basePath", path).parquet(path).drop("batch"), key, order)
