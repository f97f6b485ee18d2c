"""Quality by compression: two zstandard dictionaries, one from good and one from bad labelled text.

A text is cut into pieces, and each is compressed with both dictionaries. The difference of the two total sizes over
their sum says which kind of text it resembles; a logistic fit on labelled texts that built no dictionary turns it,
with the text's plain compressed size and length, into a probability that the label is 1.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm.common import stash, table, text_slices
from ravelin.llm.linear import logistic_fit, sigmoid

SAMPLE = 3_000  # labelled texts of each kind, at most; they are used whole
DICT_PIECES, DICT_CHARS = 4_500, 2_000  # pieces that a dictionary is trained on,
TEXT_PIECES = 3  # so many of a text, drawn from all over it: long texts would crowd out the others
DICT_BYTES, PIECE, LEVEL, THRESHOLD = 65_536, 4_096, 1, 0.3


def held_out(n: int, doc_id: str = "doc_id") -> F.Column:
    """Whether crc32(doc_id as text) is divisible by n; a null doc_id isn't."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % n == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, n: int, most: int) -> DataFrame:
    """doc_id, text, y of at most `most` labelled texts of each kind, outside the held-out rows, chosen by a hash of
    doc_id; whole texts, in the shared folder. Of texts with one id the first in order counts, so repeats add nothing.
    """
    marks = labels.select(F.col("doc_id").alias("_l"), F.col(label).alias("y")).where(F.col("y").isin(0, 1) & ~held_out(n, "_l")).groupBy("_l").agg(F.max("y").cast("int").alias("y"))
    kind = lambda y: marks.where(F.col("y") == y).orderBy(F.xxhash64("_l"), "_l").limit(most)
    ids = F.broadcast(kind(0).unionByName(kind(1)))  # 2 * most rows at most
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(ids, F.col("doc_id") == F.col("_l"))
    return stash(found.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("text").alias("text"), F.max("y").alias("y")), "labelled")


class Compressors:
    def __init__(self, good: bytes, bad: bytes):
        import zstandard

        self.by = []
        for d in (good, bad):
            data = zstandard.ZstdCompressionDict(d) if d else None
            if data is not None:
                data.precompute_compress(level=LEVEL)
            self.by.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False))
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)

    def features(self, text: str) -> list[float]:
        data = text.encode()
        good = bad = plain = 0
        worst = 0.0
        for at in range(0, len(data), PIECE):
            piece = data[at : at + PIECE]
            g, b = (len(c.compress(piece)) for c in self.by)
            good, bad, worst = good + g, bad + b, min(worst, (b - g) / (b + g))
            plain += len(self.plain.compress(piece))
        size = max(1, len(data))
        gap = (bad - good) / max(1, good + bad)
        return [10 * gap, 10 * abs(gap), 10 * worst, plain / size, good / size, min(1.0, 100 / size)]


def _pieces(batches):
    """TEXT_PIECES pieces of each text, drawn by a hash; the smallest hashes of all go into a dictionary."""
    import pyarrow as pa
    import xxhash

    for batch in batches:
        for doc, text, y in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            drawn = sorted((xxhash.xxh64_intdigest(f"{doc} {i}") >> 1, i) for i in range(0, len(text), DICT_CHARS))[:TEXT_PIECES]
            at, own = [h for h, _ in drawn], [text[i : i + DICT_CHARS].encode() for _, i in drawn]
            yield pa.RecordBatch.from_arrays([pa.array([y] * len(own), pa.int32()), pa.array(at, pa.int64()), pa.array(own, pa.binary())], names=["y", "at", "piece"])


def _dictionary(pieces: DataFrame, y: int) -> bytes:
    """Trained on pieces of texts; where there are too few to train on, their text itself."""
    import zstandard

    own = [bytes(r["piece"]) for r in pieces.where(F.col("y") == y).orderBy("at", "piece").limit(DICT_PIECES).collect()]
    try:
        return zstandard.train_dictionary(DICT_BYTES, own, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(own)[-DICT_BYTES:]


def _features(good: bytes, bad: bytes):
    def run(batches):
        import pyarrow as pa

        c = Compressors(good, bad)
        for batch in batches:
            x = [c.features(t) for _, texts in text_slices([batch], 0, 1) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame) -> tuple[bytes, bytes, np.ndarray]:
    """Both dictionaries from half of the labelled texts, the calibration from the other half. Texts stay on the executors: the driver gets pieces for the dictionaries, and numbers."""
    rows = labelled(docs, labels, "quality", 5, SAMPLE)
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    pieces = rows.where(half).mapInArrow(_pieces, "y int, at long, piece binary")
    good, bad = (_dictionary(pieces, y) for y in (1, 0))
    for own in (~half, F.lit(True)):  # all of them where the other half has none
        found = sorted(rows.where(own).mapInArrow(_features(good, bad), "doc_id long, y int, x array<double>").collect())
        if found:
            return good, bad, logistic_fit(np.array([r["x"] for r in found]), np.array([r["y"] for r in found]))
    return good, bad, np.zeros(7)


def _scorer(good: bytes, bad: bytes, weights: np.ndarray):
    def run(batches):
        import pyarrow as pa

        c = Compressors(good, bad)
        for docs, texts in text_slices(batches, 0, 1):
            x = np.array([c.features(t) for t in texts])
            yield pa.RecordBatch.from_arrays([pa.array(docs, type=pa.int64()), pa.array(sigmoid(x @ weights[:-1] + weights[-1]))], names=["doc_id", "score"])

    return run


def _filter(good: bytes, bad: bytes, weights: np.ndarray, at: int):
    def run(batches):
        import pyarrow as pa

        c = Compressors(good, bad)
        for batch in batches:
            keep = [float(sigmoid(np.array(c.features(t)) @ weights[:-1] + weights[-1])) >= THRESHOLD for _, texts in text_slices([batch], at, at) for t in texts]
            yield batch.filter(pa.array(keep, type=pa.bool_()))

    return run


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose text quality_scores() would predict as 1."""
    model = fit(docs, labels)
    return docs.mapInArrow(_filter(*model, docs.columns.index("text")), docs.schema)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from THRESHOLD on).

    Fitted on at most SAMPLE whole labelled texts of each kind outside the held-out fifth. Null and empty texts get the score
    of a text without bytes. Without labels every score is 0.5. Rows with equal doc_ids are scored one by one.
    """
    model = fit(docs, labels)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scorer(*model), "doc_id long, score double")
    return scored.select("doc_id", held_out(5).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op3_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
