"""The near-duplicate stage: SimHash candidates, and those that fingerprints can't show, verified exactly.

Texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more are linked. Candidates are those that
SimHash links (see simhash.py). Few pairs at 0.8 differ in as few bits, so classes that agree in a band of MinHash values
are candidates too (a pair at 0.8 is missed with probability 0.0004). Texts with equal sets are one class. Each connected
lot of candidates is searched breadth-first with the exact similarity, in tiles of bounded size, so that a group of
thousands of near copies never turns into all its pairs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import give_back, sorted_join, stash, text_slices
from ravelin.llm.components import components
from ravelin.llm.simhash import fingerprint, near_links, shingle_hashes
from ravelin.llm.tokens import gather

SHINGLE, BANDS, ROWS, SEED = 5, 20, 5, 42
TILE_ROWS, TILE_SHINGLES = 1024, 1_000_000
PIECE = 4096  # shingles of a text whose MinHash values are computed at once


def shingles(text: str, shingle: int) -> np.ndarray:
    """The sorted distinct hashes of the shingles of a whole text; the whole sequence is the shingle of a short text."""
    data = b" ".join(text.encode().lower().split())
    return np.unique(np.concatenate(list(shingle_hashes(data, shingle)))) if data else np.zeros(0, dtype=np.uint64)


def bands(found: np.ndarray) -> list[int]:
    """A hash of each band of MinHash values; none without shingles."""
    import xxhash

    if not len(found):
        return []
    rng = np.random.default_rng(SEED)
    a = rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), PIECE):
        part = (found[at : at + PIECE] ^ (found[at : at + PIECE] >> np.uint64(32)))[None, :] * a[:, None] + b[:, None]
        low = np.minimum(low, part.min(axis=1))
    return [xxhash.xxh64_intdigest(x.tobytes(), i) - (1 << 63) for i, x in enumerate(low.reshape(BANDS, ROWS))]


MARKED = "doc_id long, th long, fp long, key binary, n long, bands array<long>"


def _signatures(shingle: int):
    def run(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            at = 0
            for docs, texts in text_slices([batch], 0, 2):
                sets = [shingles(x, shingle) for x in texts]
                prints = np.array([fingerprint(x) for x in texts], dtype=np.uint64).view(np.int64)
                columns = [pa.array(docs, type=pa.int64()), batch.column(1).slice(at, len(docs)), pa.array(prints), pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], type=pa.binary()), pa.array([len(x) for x in sets], type=pa.int64()), pa.array([bands(x) for x in sets], type=pa.list_(pa.int64()))]
                at += len(docs)
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "fp", "key", "n", "bands"])

    return run


def _sets(shingle: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            at = 0
            for _, texts in text_slices([b], 0, 1):
                kept = b.slice(at, len(texts))
                at += len(texts)
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(2), kept.column(3), pa.array([shingles(x, shingle).tobytes() for x in texts], type=pa.binary())], names=["rep", "lot", "tiles", "hashes"])

    return run


def _forest(tenths: int):
    def run(rows):
        """Links that connect what is connected within a tile: each text reached once."""
        import pyarrow as pa

        rep, sets = rows.column("rep").to_numpy(), [np.frombuffer(x, dtype=np.uint64) for x in rows.column("hashes").to_pylist()]
        size = np.array([len(x) for x in sets], dtype=np.int64)
        names, flat = np.unique(np.concatenate(sets), return_inverse=True)
        starts, mark = np.cumsum(size) - size, np.zeros(len(names), dtype=bool)
        left, queue, a, b = np.arange(len(rep)), [], [], []
        while len(left) or queue:
            if not queue:
                queue.append(left[0])
                left = left[1:]
            at = queue.pop()
            own = flat[starts[at] : starts[at] + size[at]]
            some = left[(10 * size[left] >= tenths * size[at]) & (10 * size[at] >= tenths * size[left])]
            if not len(some):
                continue
            mark[own] = True
            ends = np.cumsum(size[some])
            both = np.add.reduceat(mark[gather(some, starts, size, flat)], ends - size[some], dtype=np.int64)
            mark[own] = False
            found = some[10 * both >= tenths * (size[some] + size[at] - both)]
            left = left[~np.isin(left, found)]
            queue += found.tolist()
            a += [rep[at]] * len(found)
            b += rep[found].tolist()
        del sets, names, flat
        give_back()
        return pa.table({"a": pa.array(a, type=pa.int64()), "b": pa.array(b, type=pa.int64())})

    return run


def _similar(sets: DataFrame, near: DataFrame, texts: DataFrame, shingle: int, tenths: int) -> DataFrame:
    """a, b: links that connect what is connected by pairs of a similarity of tenths / 10 or more. sets: node, doc_id,
    th, n, bands; near: further candidates a, b; texts: doc_id, th, text."""
    keyed = sets.select("node", F.explode("bands").alias("band"))
    low = keyed.groupBy("band").agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("k")).where("k > 1").select(F.col("band").alias("own"), "low")
    pairs = keyed.join(sorted_join(low), F.col("band") == F.col("own")).select(F.col("node").alias("a"), F.col("low").alias("b")).unionByName(near)
    lots = components(pairs, "a", "b").withColumnRenamed("node", "member")
    members = stash(lots.join(sorted_join(sets), F.col("member") == F.col("node")).select("node", F.col("component").alias("lot"), "n", F.col("doc_id").alias("d"), F.col("th").alias("t")), "lots")
    tiles = members.groupBy(F.col("lot").alias("l")).agg(F.ceil(F.greatest(F.count(F.lit(1)) / TILE_ROWS, F.sum("n") / TILE_SHINGLES)).cast("int").alias("tiles"))
    dealt = members.join(tiles, F.col("lot") == F.col("l")).select("node", "d", "t", "lot", "tiles")
    one = texts.join(dealt, (F.col("doc_id") == F.col("d")) & (F.col("th") == F.col("t"))).groupBy("node", "lot", "tiles").agg(F.min("text").alias("text"))
    known = one.select("node", "text", "lot", "tiles").mapInArrow(_sets(shingle), "rep long, lot long, tiles int, hashes binary").withColumn("own", F.pmod(F.xxhash64("rep", "lot"), F.col("tiles")).cast("int"))
    tiled = known.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("lot", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "hashes")
    return tiled.where(F.length("hashes") > 0).groupBy("lot", "i", "j").applyInArrow(_forest(tenths), "a long, b long")


def first_texts(docs: DataFrame, shingle: int = SHINGLE, tenths: int = 8) -> DataFrame:
    """doc_id, th (xxhash64 of the text, '' for null) of the first text of each group: that with the smallest doc_id, and
    of texts with that id the one with the smallest th. Texts without words are one group; a null doc_id has no part."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text").where("doc_id is not null")
    marked = texts.mapInArrow(_signatures(shingle), MARKED)
    classes = marked.groupBy("key", "fp").agg(F.min(F.struct("doc_id", "th")).alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = stash(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    least = lambda c: nodes.groupBy(F.col(c).alias("same")).agg(F.min("node").alias("low"))
    alike = lambda c: nodes.join(sorted_join(least(c)), F.col(c) == F.col("same")).where("node > low").select(F.col("node").alias("a"), F.col("low").alias("b"))
    near = near_links(least("fp").select(F.col("same").alias("fp"), F.col("low").alias("rep"))).unionByName(alike("fp"))
    links = _similar(nodes.select("node", "first.*", "n", "bands"), near, texts, shingle, tenths).unionByName(alike("key"))
    named = components(links, "a", "b").withColumnRenamed("node", "m")
    found = nodes.join(named, F.col("node") == F.col("m"), "left").groupBy(F.coalesce("component", "node").alias("c")).agg(F.min("first").alias("first"))
    return stash(found.select("first.*"), "kept")


def keep_first(docs: DataFrame) -> DataFrame:
    """The row of docs with the first text of each group, see first_texts(). Of rows with that id and text one stays, chosen
    by a hash of their other columns. Rows without an id stay."""
    kept = first_texts(docs).select(F.col("doc_id").alias("_rv_d"), F.col("th").alias("_rv_t"))
    rest = [c for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    named = docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_rv_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_rv_th"))
    named = named.agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.xxhash64(*[F.col(f"`{c}`") for c in rest])).alias("_rv_row"))
    named = named.join(sorted_join(kept), (F.col("_rv_id") == F.col("_rv_d")) & (F.col("_rv_th") == F.col("_rv_t")), "left_semi").select("_rv_row.*")
    return named.unionByName(docs.where("doc_id is null"))
