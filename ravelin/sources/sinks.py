"""Where results go: JSON lines, one Markdown text a batch, normalised outputs by case and side, a verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_rows(df: DataFrame) -> DataFrame:
    """value: a JSON object for each row; nulls are written out."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    json_rows(df).write.mode("overwrite").text(path)


def write_briefs(briefs: DataFrame, path: str) -> None:
    """briefs (batch, brief): a folder for each batch with its text."""
    briefs.select("batch", F.col("brief").alias("value")).write.mode("overwrite").partitionBy("batch").text(path)


def keep_outputs(observations: DataFrame, path: str) -> None:
    observations.write.mode("overwrite").partitionBy("case", "side").json(path)


def passes(findings: DataFrame) -> bool:
    """Whether a gate has nothing to say."""
    return findings.isEmpty()
