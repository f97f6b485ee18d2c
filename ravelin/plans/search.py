"""One search over several relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.operators.predicates import mentions


def find(query: str, sources: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """source, name, detail: rows of every source (label, relation, name column, detail column) whose name or detail
    mentions the query. `place` keeps the order of the sources."""
    rows = []
    for i, (label, df, name, detail) in enumerate(sources):
        own = df.select(F.lit(i).alias("place"), F.lit(label).alias("source"), F.col(name).cast("string").alias("name"), F.col(detail).cast("string").alias("detail"))
        rows.append(own.where(mentions(F.col("name"), query) | F.coalesce(mentions(F.col("detail"), query), F.lit(False))))
    return reduce(DataFrame.unionByName, rows)
