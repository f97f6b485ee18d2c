"""Toxicity by a classifier chain.

The labels know one category, so the others are found in the labelled toxic texts themselves: they are clustered by
the words and word beginnings that mark them. A chain of linear models predicts the clusters one after the other and,
last, toxicity as labelled; each model sees the probabilities of those before it, out-of-fold ones while it is trained.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm.common import table, text_slices
from ravelin.llm.linear import Rows, sigmoid, sparse_fit
from ravelin.llm.quality import labelled

SAMPLE = 3_000  # labelled texts of each kind, at most; they are used whole
SPACE = 1 << 22  # feature numbers
FEATURES, LEAST_Z, LEAST_DOCS, LEAST_SHARE = 2_000, 7.0, 4, 0.02  # a feature is in so many documents, and in so large a share of one kind
CATEGORIES, FOLDS, RIDGE = 3, 5, 0.005
THRESHOLDS, FALSE_ALARMS = (0.2, 0.5), 0.002  # the lowest threshold in the range with so few false alarms out of fold
SPREAD = 60
EDGES = ".,;:!?'\"()[]{}<>%$#*&|-_`~…«»„“”"


def word_features(word: str) -> list[int]:
    """A word, and its beginnings of 3 to 6 letters, by number."""
    word = word.strip(EDGES)
    names = ["=" + word, *("^" + word[:k] for k in range(3, min(7, len(word) + 1)))] if word else []
    return [zlib.crc32(n.encode()) % SPACE for n in names]


def text_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The feature numbers of a text in order, and how much of each: see amount()."""
    words = text.lower().encode().split()
    found = Counter(f for w, n in Counter(words).items() for f in word_features(w.decode()) * n)
    names = np.array(sorted(found), dtype=np.int64)
    return names, amount(np.array([found[f] for f in names.tolist()], dtype=np.float64), len(words))


def amount(count, words):
    """About 1 for a feature that one word in SPREAD has; a very short text counts as a somewhat longer one."""
    return SPREAD * count / (words + SPREAD / 3)


@dataclass
class Chain:
    vocabulary: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))  # sorted feature numbers
    threshold: float = THRESHOLDS[1]
    links: list[np.ndarray] = field(default_factory=list)  # sparse weights, one for each earlier probability, intercept

    def run(self, x: Rows) -> np.ndarray:
        """A column of probabilities for each link; without links one of zeros."""
        size, out = 2 * len(self.vocabulary), np.zeros((x.n, 0))
        for w in self.links:
            z = x.dot(w[:size]) + np.column_stack([out, np.ones(x.n)]) @ w[size:]
            out = np.column_stack([out, sigmoid(z)])
        return out if self.links else np.zeros((x.n, CATEGORIES + 1))


def _occurrences(batches):
    """The number of texts of each kind that have a feature."""
    import pyarrow as pa

    for batch in batches:
        n = {}
        for y, text in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True):
            n.setdefault(y, Counter()).update(text_features(text)[0].tolist())
        for y, own in n.items():
            yield pa.RecordBatch.from_arrays([pa.array([y] * len(own), pa.int32()), pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.int64())], names=["y", "f", "n"])


def _select(f: np.ndarray, a: np.ndarray, b: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """The features whose share differs most between the kinds, in standard errors. f: features in order, of which a
    toxic and b clean texts have one."""
    share_a, share_b = a / toxic, b / clean
    p = (a + b + 1) / (toxic + clean + 2)
    z = np.abs(share_a - share_b) / np.sqrt(p * (1 - p) * (1 / toxic + 1 / clean))
    z[(a + b < LEAST_DOCS) | (np.maximum(share_a, share_b) < LEAST_SHARE)] = 0  # what only a few copies share says nothing
    best = np.argsort(-z, kind="stable")[:FEATURES]
    return np.sort(f[best[z[best] >= LEAST_Z]])


def _counted(rows: DataFrame, toxic: int, clean: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """f, a and b of _select, without those that it leaves out for their small shares: as each text has its words only,
    1 / LEAST_SHARE times as many as a mean text of each kind has."""
    kind = lambda y: F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0))
    n = rows.mapInArrow(_occurrences, "y int, f long, n long").groupBy("f").agg(kind(1).alias("a"), kind(0).alias("b"))
    some = n.where((F.col("a") + F.col("b") >= LEAST_DOCS) & (F.greatest(F.col("a") / toxic, F.col("b") / clean) >= LEAST_SHARE))
    found = np.array(sorted(map(tuple, some.select("f", "a", "b").collect())), dtype=np.int64).reshape(-1, 3)
    return found[:, 0], found[:, 1].astype(np.float64), found[:, 2].astype(np.float64)


def _places(vocabulary: np.ndarray):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            own = [places(text_features(t), vocabulary) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x for x, _ in own], pa.list_(pa.int64())), pa.array([m for _, m in own], pa.list_(pa.float64()))], names=["doc_id", "y", "at", "much"])

    return run


def _clusters(m: np.ndarray, k: int) -> np.ndarray:
    """k-means over unit rows, started from far-apart rows."""
    x = m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-9)
    centres = [x[0]]
    for _ in range(k - 1):
        centres.append(x[int(np.max(x @ np.array(centres).T, axis=1).argmin())])
    c = np.array(centres)
    for _ in range(20):
        own = (x @ c.T).argmax(axis=1)
        c = np.array([x[own == i].sum(0) if (own == i).any() else c[i] for i in range(k)])
        c /= np.maximum(np.sqrt((c * c).sum(1, keepdims=True)), 1e-9)
    return own


def rows_of(found: list[tuple[np.ndarray, np.ndarray]], size: int) -> Rows:
    """Rows with two columns for each place in the vocabulary: whether a text has it, and how much of it."""
    return Rows([(np.concatenate([own, own + size]), np.concatenate([np.ones(len(own)), much])) for own, much in found])


def places(found: tuple[np.ndarray, np.ndarray], vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers that are in the vocabulary, as places in it."""
    own, much = found
    at = np.minimum(np.searchsorted(vocabulary, own), max(0, len(vocabulary) - 1))
    here = vocabulary[at] == own if len(vocabulary) else np.zeros(len(own), dtype=bool)
    return at[here], much[here]


def fit(rows: list[tuple[str, int]]) -> Chain:
    """The chain of a few texts that are here."""
    y = np.array([k for _, k in rows], dtype=np.int64)
    if not len(y) or y.min() == y.max():
        return Chain()
    found = [text_features(t) for t, _ in rows]
    n = [Counter(f for (own, _), k in zip(found, y.tolist(), strict=True) if k == kind for f in own.tolist()) for kind in (1, 0)]
    f = np.array(sorted({*n[0], *n[1]}), dtype=np.int64)
    a, b = (np.array([c[i] for i in f.tolist()], dtype=np.float64) for c in n)
    vocabulary = _select(f, a, b, int(y.sum()), int((1 - y).sum()))
    return _chain(vocabulary, [places(own, vocabulary) for own in found], y)


def fit_on(docs: DataFrame, labels: DataFrame) -> Chain:
    """The chain of labelled documents. Texts stay on the executors: the driver gets counts of features, and each sampled
    text's part in the vocabulary."""
    rows = labelled(docs, labels, "toxic", 5, SAMPLE)
    kinds = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(kinds) < 2:
        return Chain()
    vocabulary = _select(*_counted(rows, kinds[1], kinds[0]), kinds[1], kinds[0])
    sample = sorted(rows.mapInArrow(_places(vocabulary), "doc_id long, y int, at array<long>, much array<double>").collect())
    return _chain(vocabulary, [(np.array(r["at"], dtype=np.int64), np.array(r["much"], dtype=np.float64)) for r in sample], np.array([r["y"] for r in sample], dtype=np.int64))


def _chain(vocabulary: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> Chain:
    """Of texts given by their places in the vocabulary."""
    size, toxic = 2 * len(vocabulary), np.flatnonzero(y)
    dense = np.zeros((len(toxic), max(1, len(vocabulary))))
    for i, j in enumerate(toxic.tolist()):
        dense[i, found[j][0]] = 1
    kind = np.full(len(y), -1)
    kind[toxic] = _clusters(dense, min(CATEGORIES, len(toxic)))
    fold = np.arange(len(y)) % FOLDS
    pick = lambda keep: rows_of([f for f, k in zip(found, keep.tolist(), strict=True) if k], len(vocabulary))
    x, chain, before = pick(fold >= 0), Chain(vocabulary), np.zeros((len(y), 0))
    for target in [*((kind == k).astype(np.int64) for k in range(CATEGORIES)), y]:
        held = np.zeros(len(y))
        for k in range(FOLDS):
            inside = fold != k
            w = sparse_fit(pick(inside), before[inside], target[inside], size, RIDGE, 60)
            held[~inside] = sigmoid(pick(~inside).dot(w[:size]) + np.column_stack([before[~inside], np.ones((~inside).sum())]) @ w[size:])
        chain.links.append(sparse_fit(x, before, target, size, RIDGE, 100))
        before = np.column_stack([before, held])
    clean = np.sort(held[y == 0])
    allowed = clean[len(clean) - 1 - int(FALSE_ALARMS * len(clean))]  # at most so many clean texts lie above it
    chain.threshold = float(np.clip(np.nextafter(allowed, 1), *THRESHOLDS))
    return chain


def probabilities(chain: Chain, texts: list[str]) -> np.ndarray:
    """A row for each text, from its distinct words that have a feature; zeros for a text without words."""
    import pyarrow as pa
    import pyarrow.compute as pc

    place = {f: i for i, f in enumerate(chain.vocabulary.tolist())}.get
    words = pc.ascii_split_whitespace(pa.array([t.lower().strip(" \t\n\r\v\f") for t in texts], type=pa.large_string()))
    coded = words.flatten().dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False)
    own = [[i for i in map(place, word_features(w)) if i is not None] for w in coded.dictionary.to_pylist()]
    some = np.array([bool(r) for r in own], dtype=bool)
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
    hit = some[index] if len(index) else np.zeros(0, dtype=bool)
    pairs, counts = np.unique(np.array([(d, f) for d, w in zip(doc[hit].tolist(), index[hit].tolist(), strict=True) for f in own[w]], dtype=np.int64).reshape(-1, 2), axis=0, return_counts=True)
    x, n = Rows([]), pc.list_value_length(words).to_numpy(zero_copy_only=False)
    much = amount(counts.astype(np.float64), n[pairs[:, 0]])
    x.n, x.row = len(texts), np.concatenate([pairs[:, 0], pairs[:, 0]])
    x.col, x.val = np.concatenate([pairs[:, 1], pairs[:, 1] + len(chain.vocabulary)]), np.concatenate([np.ones(len(pairs)), much])
    p = chain.run(x)
    p[[not t.strip(" \t\n\r\v\f") for t in texts]] = 0
    return p


def _scorer(chain: Chain):
    def run(batches):
        import pyarrow as pa

        for docs, texts in text_slices(batches, 0, 1):
            p = probabilities(chain, texts)
            yield pa.RecordBatch.from_arrays([pa.array(docs, type=pa.int64()), *(pa.array(np.ascontiguousarray(p[:, i])) for i in range(p.shape[1]))], names=["doc_id", *(f"p_kind{i + 1}" for i in range(CATEGORIES)), "p_toxic"])

    return run


def _filter(chain: Chain, at: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keep = [p[-1] < chain.threshold for _, texts in text_slices([batch], at, at) for p in probabilities(chain, texts)]
            yield batch.filter(pa.array(keep, type=pa.bool_()))

    return run


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose text toxicity_scores() would not call toxic."""
    chain = fit_on(docs, labels)
    return docs.mapInArrow(_filter(chain, docs.columns.index("text")), docs.schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, p_kind1.., p_toxic (the end of the chain), toxic (1 from the chain's threshold on).

    Fitted on at most SAMPLE whole labelled texts of each kind, none of them in the held-out fifth (see quality.held_out).
    Null and empty texts, and those of white space, get 0 throughout. Labels of one kind only: every probability is 0.
    """
    chain = fit_on(docs, labels)
    kind = "doc_id long, " + "".join(f"p_kind{i + 1} double, " for i in range(CATEGORIES)) + "p_toxic double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scorer(chain), kind).withColumn("toxic", (F.col("p_toxic") >= chain.threshold).cast("int"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
