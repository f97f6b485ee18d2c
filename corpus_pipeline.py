"""From raw documents to packed training sequences: toxicity, quality, near-duplicates, mixing, packing.

Every stage but the last returns the columns of its input. Each stage's result is written as Parquet to the shared
folder and read again, so a later stage starts from files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ravelin.llm.common import drop_path, mark, note_path, release, shared_dir, table
from ravelin.llm.mixing import mix_sources
from ravelin.llm.near import keep_first
from ravelin.llm.packing import pack_documents
from ravelin.llm.quality import keep_good
from ravelin.llm.toxicity import keep_clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain calls toxic go."""
    return keep_clean(docs, table(spark, sf_dir, "labels"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose compression score is below the threshold go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a Jaccard similarity of 0.8 or more (sets of five words) the one with the smallest id stays. SimHash
    proposes the pairs, with bands of MinHash values for those whose fingerprints differ in more bits."""
    return keep_first(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, sorted by their slot in the Pfair schedule: every run of rows has the sources in target proportion,
    as long as they last. Each written file holds one run, and the runs follow each other in the order of the files'
    names. The next stage packs the documents of a file, or of a part of one, together."""
    mixed = mix_sources(docs, out=("_rv_weight", "_rv_block", "_rv_slot", "_rv_place"))
    return mixed.orderBy("_rv_slot", "_rv_place").select(*[f"`{c}`" for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, taken in the order of the mix."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: Classifiers, tokens and the schedule have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage leaves in the shared folder goes as soon as its result is written."""
    base, docs = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", table(spark, sf_dir, "documents")
    before = None
    for name, function in STAGES:
        since = mark()
        result = function(spark, docs, sf_dir)
        result.write.parquet(f"{base}/{name}")
        release(spark, since)
        note_path(spark, f"{base}/{name}")  # goes after the next stage, or with release()
        if before:
            drop_path(spark, before)
        before = f"{base}/{name}"
        docs = spark.read.schema(result.schema).parquet(before)
    return docs
