"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked at a small Hamming distance.

The fingerprint is cut into 7 blocks. Two fingerprints that differ in at most 4 bits agree in at least 3 blocks, so
they meet under one of the 35 choices of 3 blocks (27 bits and more). Equal fingerprints are one class throughout.
Small buckets are joined on the blocks and every pair is verified; in a bucket of more than SMALL classes a breadth-
first search over the classes not yet reached finds a spanning forest of its links, in tiles of bounded size, so that
a group of thousands of near copies never turns into all its pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm.common import sorted_join, stash, table, text_slices
from ravelin.llm.components import components

SEED, SHINGLE, DISTANCE, BLOCKS, AGREE = 42, 4, 4, 7, 3
SMALL, TILE = 32, 2048


def shingle_hashes(data: bytes, shingle: int, most: int = 65_536):
    """The XXH64 values of the shingles of space-joined words, in arrays of at most `most`."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    blanks = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 32)
    ends = np.append(blanks, len(data))[shingle - 1 :]
    if not len(ends):
        ends = np.array([len(data)])
    starts = np.append(0, blanks + 1)[: len(ends)]
    for at in range(0, len(ends), most):
        pairs = zip(starts[at : at + most].tolist(), ends[at : at + most].tolist(), strict=True)
        yield np.array([digest(data[s:e], SEED) for s, e in pairs], dtype="<u8")


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of a whole text: 0 without words; the whole sequence is the shingle of a short text."""
    data = b" ".join(text.encode().lower().split())
    if not data:
        return 0
    n, votes = 0, np.zeros(64, dtype=np.int64)
    for hashes in shingle_hashes(data, shingle):
        n += len(hashes)
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def _prints(batches):
    import pyarrow as pa

    for docs, texts in text_slices(batches, 0, 1):
        yield pa.RecordBatch.from_arrays([pa.array(docs, type=pa.int64()), pa.array(np.array([fingerprint(x) for x in texts], dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long). A null text has no words."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_prints, "doc_id long, fp long")


def block_masks() -> list[int]:
    """The masks, as signed longs, of every choice of AGREE of the BLOCKS."""
    edges = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    masks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    chosen = [sum(c) for c in combinations(masks, AGREE)]
    return [x - (1 << 64) if x >> 63 else x for x in chosen]


def _forest(rows):
    """Links that connect what is connected within a tile: each fingerprint reached once."""
    import pyarrow as pa

    fp = rows.column("fp").to_numpy().view(np.uint64)
    rep = rows.column("rep").to_numpy()
    left, queue, a, b = np.arange(len(fp)), [], [], []
    while len(left) or queue:
        if not queue:
            queue.append(left[0])
            left = left[1:]
        at = queue.pop()
        near = np.bitwise_count(fp[left] ^ fp[at]) <= DISTANCE
        found = left[near]
        left = left[~near]
        queue += found.tolist()
        a += [rep[at]] * len(found)
        b += rep[found].tolist()
    return pa.table({"a": pa.array(a, type=pa.int64()), "b": pa.array(b, type=pa.int64())})


def near_links(classes: DataFrame) -> DataFrame:
    """a, b: links between classes (columns fp, rep) that suffice to connect all within DISTANCE bits of each other."""
    keyed = classes.select("fp", "rep", F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(block_masks())])).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumnRenamed("key", "k")
    shared = stash(keyed.join(sorted_join(sizes), F.col("key") == F.col("k")).drop("k"), "blocks")
    few = shared.where(F.col("n") <= SMALL)
    pairs = few.select("key", "fp", "rep").alias("x").join(sorted_join(few.select("key", "fp", "rep")).alias("y"), F.expr(f"x.key = y.key and x.fp < y.fp and bit_count(x.fp ^ y.fp) <= {DISTANCE}"))
    pairs = pairs.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    tiled = shared.where(F.col("n") > SMALL).withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int")).withColumn("own", F.pmod(F.xxhash64("fp", "key"), F.col("tiles")).cast("int"))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "rep")
    forest = tiled.groupBy("key", "i", "j").applyInArrow(_forest, "a long, b long")
    return pairs.unionByName(forest)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable over links of at most DISTANCE bits, itself included.

    A null text counts as one without words (fingerprint 0, linked like any other). Rows with a null doc_id keep
    their fingerprint; they link nothing, and take the component of an equal fingerprint if there is one.
    """
    marked = stash(fingerprints(docs), "fingerprints")
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    grouped = components(near_links(classes.where("rep is not null")), "a", "b")
    named = classes.join(grouped, F.col("rep") == F.col("node"), "left").select(F.col("fp").alias("f"), F.coalesce("component", "rep").alias("component_id"))
    return marked.join(named, F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """The row of docs with the smallest doc_id of each group. Of several rows with that id one stays: the first by its text
    and then by a hash of its columns. Rows without an id stay."""
    kept = near_duplicates(docs).where("doc_id = component_id").select(F.col("doc_id").alias("_rv_kept")).distinct()
    rest = [F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    every = [F.col(f"`{c}`") for c in docs.columns]
    named = docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_rv_id")).agg(F.min_by(F.struct(*every), F.struct("text", F.xxhash64(*rest))).alias("_rv_row"))
    named = named.join(kept, F.col("_rv_id") == F.col("_rv_kept"), "left_semi").select("_rv_row.*")
    return named.unionByName(docs.where("doc_id is null"))


def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
