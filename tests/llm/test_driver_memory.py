"""Sides of joins that grow with the input are never planned to pass through the driver."""

import pytest
from pyspark.sql import functions as F

from ravelin.llm import components, near, simhash


def planned(df):
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.fixture
def plans(monkeypatch):
    """The names and plans of what is written on the way."""
    found = []
    for module in (simhash, components, near):

        def noted(df, name, write=module.stash):
            found.append((name, planned(df)))
            return write(df, name)

        monkeypatch.setattr(module, "stash", noted)
    return found


def sorted_only(plans):
    return not any("Broadcast" in p for p in plans) and any("SortMergeJoin" in p for p in plans)


def test_keys_of_fingerprints_are_not_broadcast(spark, plans):
    classes = spark.range(2000).select((F.col("id") % 500 * 2**40 + F.col("id")).alias("fp"), F.col("id").alias("rep"))
    links = simhash.near_links(classes)
    assert sorted_only([p for _, p in plans]) and sorted_only([planned(links)])


def test_nodes_of_a_large_graph_are_not_broadcast(spark, plans):
    edges = spark.range(120_000).select("id", F.floor(F.col("id") / 1000).alias("hub"))
    found = components.components(edges, "id", "hub")
    assert sorted_only([p for _, p in plans])
    named = edges.join(found.withColumnRenamed("node", "m"), F.col("id") == F.col("m"), "left")
    assert sorted_only([planned(named)])
    assert found.select("component").distinct().collect()[0][0] == 0 and found.count() == 120_000


def test_classes_of_texts_are_not_broadcast(spark, plans):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.hash(F.lit(i), F.floor(F.col("id") / 3)) for i in range(60)], F.col("id") % 3).alias("text"))
    kept = near.keep_first(docs)
    banded = next(p for n, p in plans if n == "edges")
    assert "explode(bands" in banded and sorted_only([banded])
    assert sorted_only([next(p for n, p in plans if n == "lots")]) and sorted_only([planned(kept)])
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, 300, 3))
