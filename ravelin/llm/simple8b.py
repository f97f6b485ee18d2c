"""Token ids in Simple-8b words, and the files that hold them.

A 64-bit word holds a selector in its top 4 bits and `count` values of `bits` bits below it, first value lowest.
Selector 0 is the escape: the following word is one value of up to 64 bits. A file is a Parquet table with a row for
each block of whole documents: `part`, `block`, `first` (ids of the part before it), `n_ids`, the documents' ids and
lengths, and `words`. `first` and the lengths are the offsets from which any document is found without decoding others.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ravelin.llm.common import shared_dir, table, text_slices
from ravelin.llm.tokens import WordPairs, shared

BITS = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], dtype=np.int64)
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], dtype=np.int64)
NARROW = ((np.arange((1 << 16) + 1) >> BITS[1:, None]) > 0).sum(axis=0).astype(np.int8)  # by value
BLOCK_IDS = 65_536
END_ID = 2
FILE_DDL = "part int, block int, first long, n_ids long, doc_ids array<bigint>, doc_lens array<bigint>, words binary"


def pack(values: np.ndarray) -> bytes:
    """Little-endian words. values: unsigned integers below 2**64; none gives no word."""
    v = np.asarray(values).astype(np.uint64)
    n = len(v)
    if not n:
        return b""
    need = NARROW[np.minimum(v, np.uint64(1 << 16)).astype(np.int32)]  # number of selectors that are too narrow
    large = np.flatnonzero(v >> np.uint64(16))
    need[large] = ((v[large] >> BITS[1:, None].astype(np.uint64)) > 0).sum(axis=0)
    best = np.where(need < 14, np.int8(14), np.int8(0))
    widest, size = [need], 1  # maxima over windows of 1, 2, 4, ... values
    while size * 2 <= min(60, n):
        x = widest[-1]
        widest.append(np.maximum(x[:-size], x[size:]))
        size *= 2
    for s in range(13, 0, -1):
        c = int(COUNTS[s])
        if c <= n:
            k = c.bit_length() - 1
            x, shift = widest[k], c - (1 << k)
            top = np.maximum(x[: n - c + 1], x[shift : shift + n - c + 1])
            best[: n - c + 1][top < s] = s
    step, at, places = COUNTS[best].tolist(), 0, []
    put = places.append
    while at < n:
        put(at)
        at += step[at]
    places = np.array(places, dtype=np.int64)
    sel = best[places]
    extra = sel == 0
    slot = np.arange(len(places)) + np.cumsum(extra) - extra
    out = np.zeros(len(places) + int(extra.sum()), dtype=np.uint64)
    for s in range(1, 15):
        own = np.flatnonzero(sel == s)
        if len(own):
            c = int(COUNTS[s])
            shifts = (np.arange(c) * BITS[s]).astype(np.uint64)
            out[slot[own]] = np.bitwise_or.reduce(v[places[own][:, None] + np.arange(c)] << shifts, axis=1) | np.uint64(s << 60)
    out[slot[extra] + 1] = v[places[extra]]
    return out.astype("<u8").tobytes()


def unpack(words: bytes) -> np.ndarray:
    w = np.frombuffer(words, dtype="<u8")
    sel = (w >> np.uint64(60)).astype(np.int64)
    zero = np.flatnonzero(sel == 0)
    raw = np.zeros(len(w), dtype=bool)
    if len(zero) or (len(w) and (sel > 14).any()):  # a value that follows an escape may look like anything
        at = 0
        starts = []
        codes = sel.tolist()
        while at < len(codes):
            starts.append(at)
            if codes[at] == 0:
                raw[at + 1] = True
                at += 1
            at += 1
        keep = np.array(starts, dtype=np.int64)
    else:
        keep = np.arange(len(w))
    counts = COUNTS[sel[keep]]
    first = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), dtype=np.uint64)
    for s in range(1, 15):
        own = np.flatnonzero(sel[keep] == s)
        if len(own):
            c = int(COUNTS[s])
            shifts = (np.arange(c) * BITS[s]).astype(np.uint64)
            out[first[own][:, None] + np.arange(c)] = (w[keep[own]][:, None] >> shifts) & np.uint64((1 << int(BITS[s])) - 1)
    own = np.flatnonzero(sel[keep] == 0)
    out[first[own]] = w[keep[own] + 1]
    return out


def _encoder(vocabulary: str, end_id: int, block_ids: int, specials: bool):
    def encode(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        coder, part = shared(WordPairs, vocabulary, specials), TaskContext.get().partitionId()
        first, block = 0, 0
        for docs, texts in text_slices(batches, 0, 1):
            ids, n = coder.encode(texts)
            ids = np.insert(ids, np.cumsum(n), end_id)
            n = n + 1
            upto = np.cumsum(n)
            at, i = 0, 0
            rows = []
            while i < len(docs):
                j = max(i + 1, int(np.searchsorted(upto, at + block_ids, side="right")))
                stop = int(upto[j - 1])
                rows.append((part, block, first, stop - at, docs[i:j], n[i:j].tolist(), pack(ids[at:stop])))
                first, block, at, i = first + stop - at, block + 1, stop, j
            yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()), strict=True)], names=["part", "block", "first", "n_ids", "doc_ids", "doc_lens", "words"])

    return encode


def _decode(batches):
    import pyarrow as pa

    for batch in batches:
        for row in batch.to_pylist():
            ids = unpack(row["words"]).astype("<u4")
            lens = np.array(row["doc_lens"], dtype=np.int64)
            ends = np.cumsum(lens)
            crcs = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends.tolist(), lens.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * len(lens), type=pa.int32()), pa.array(row["doc_ids"], type=pa.int64()), pa.array(ends - lens + row["first"]), pa.array(lens), pa.array(crcs, type=pa.int64())], names=["part", "doc_id", "at", "n_tokens", "ids_crc32"])


def write_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS, specials: bool = False) -> None:
    """Writes the ids of all texts in ascending doc_id order (nulls first; equal ids in the order read).

    A null text is empty; every document ends with end_id. Strings of special tokens are ordinary text, or with
    `specials` the tokens themselves. A range exchange on doc_id brings documents in order; no
    task holds more than a partition, in slices. The files are written by Spark, so a lost task is written again.
    """
    ordered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_rv_at"))
    ordered = ordered.repartitionByRange("doc_id", "_rv_at").sortWithinPartitions("doc_id", "_rv_at")
    ordered.select("doc_id", "text").mapInArrow(_encoder(vocabulary, end_id, block_ids, specials), FILE_DDL).write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the files."""
    files = spark.read.schema(FILE_DDL).parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each written part
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    found = files.mapInArrow(_decode, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return found.join(parts, F.col("part") == F.col("p")).select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op7_encode_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers

    path = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), specials=True)  # the tokenizer as loaded
    return read_ids(spark, path)
