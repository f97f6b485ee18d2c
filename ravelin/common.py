"""Shared storage for iterative operators: tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and the
    master is local. Elsewhere executors would not see it, so it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = getattr(spark.sparkContext, "_ravelin_dir", None)
        if found is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            found = f"file://{tempfile.mkdtemp(prefix='ravelin-')}"
            spark.sparkContext._ravelin_dir = found
            spark.sparkContext.setCheckpointDir(found)
    return found


_written: list[str] = []  # folders of this session that release() deletes


def note_path(spark: SparkSession, path: str) -> str:
    _written.append(path)
    return path


def stash(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: the rows as a Parquet table in the shared folder. They survive the loss of any executor."""
    spark = df.sparkSession
    path = note_path(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_stash(df: DataFrame) -> None:
    """Deletes the files of a stash() that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        for path in [p for p in _written if folder.endswith("/" + p.rsplit("/", 1)[1])]:
            _delete(df.sparkSession, path)
            _written.remove(path)


def drop_path(spark: SparkSession, path: str) -> None:
    _delete(spark, path)
    if path in _written:
        _written.remove(path)


def mark() -> int:
    """For release(): what is written from here on."""
    return len(_written)


def release(spark: SparkSession, since: int = 0) -> None:
    """Deletes what this session has written to the shared folder since the mark. Results that read it, and were not
    written themselves, can't be read then."""
    for path in _written[since:]:
        _delete(spark, path)
    del _written[since:]


def settle(df: DataFrame) -> DataFrame:
    """stash() of a loop's state."""
    return stash(df, "state")
