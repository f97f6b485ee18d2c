"""Language-model scores by context-tree weighting over bytes.

A text is its lower-cased words, one blank between them and a line feed at the end. Each byte is coded as eight binary
decisions; every decision (the bits of the byte so far) has a context tree over the DEPTH bytes before it. A node mixes
its Krichevsky-Trofimov estimate with the product of its children, half and half, at every depth; so a prediction is a
mixture of the estimates of all depths, weighted by how well each has coded the training texts.

All that a score needs of a byte is its gram: the context and the byte. Documents are cut into blocks; each block sends
its distinct grams, packed by buckets of the nearest context bytes. A bucket's counts are added up over the blocks in
rounds of FAN at a time, so a task holds distinct grams only, however many blocks share them. Each bucket's log
probabilities are then computed once and sent back for what the blocks asked, for SLICE blocks at a time. The number of
buckets is bounded, so rows grow with the blocks. So the statistics cover all documents, grow with them, and are never
on the driver: only the nodes of depth 1 are (at most 256 contexts of 255 nodes). Word counts take the same way.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm.common import stash, table
from ravelin.llm.quality import held_out

DEPTH, SPLIT = 5, 3  # bytes of context; depth at which buckets take over from the driver
BLOCK_BYTES, CHUNK_BYTES = 12_000_000, 1_000_000
FAN, SLICE = 64, 1_024  # blocks whose counts are added up in one task, and that are answered in one
MOST_SHARES, MOST_WORD_BUCKETS = 64, 4_096  # of each nearest byte; of words
LOG_HALF = np.log(0.5)
END = "\n"


def canonical(text: str | None) -> bytes:
    return b" ".join((text or "").encode().lower().split())


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A key for each byte of the texts and their ends: nearest context byte highest, the byte itself lowest. And the
    number of bytes of each text. The context of a text's first bytes is filled with line feeds."""
    pad = b"\n" * DEPTH
    data = np.frombuffer(pad + b"".join(t + b"\n" + pad for t in texts), dtype=np.uint8).astype(np.int64)
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    n = len(data) - DEPTH
    key = np.zeros(n, dtype=np.int64)
    for back in range(1, DEPTH + 1):
        key = key << 8 | data[DEPTH - back : DEPTH - back + n]
    key = key << 8 | data[DEPTH:]
    keep = np.ones(n, dtype=bool)
    ends = np.cumsum(sizes + DEPTH)
    for i in range(1, DEPTH + 1):
        keep[ends - i] = False  # the filling between texts
    return key[keep], sizes


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x > 0, by Stirling's series eight steps up."""
    y = x + 8
    low = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - low


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log probability that the estimator gives a sequence with a zeros and b ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - np.log(np.pi)


def _sums(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of values."""
    if not len(key):
        return key, *values
    order = np.argsort(key, kind="stable")
    k = key[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], *(np.add.reduceat(v[order], first) for v in values)


def bit_nodes(key: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted (context, byte) keys: the nodes of the k-th bit, as context and k bits, with their zeros and ones."""
    bit = key >> (7 - k) & 1
    return _sums(key >> (8 - k), (n * (1 - bit)).astype(np.float64), (n * bit).astype(np.float64))


def weigh(node, zeros, ones, child, child_log, k: int):
    """Log of the weighted probability of nodes, and the share of their own estimate in it."""
    own = LOG_HALF + log_kt(zeros, ones)
    below = np.zeros(len(node))
    if len(child):
        parent = (child >> (8 + k)) << k | (child & ((1 << k) - 1))
        below = np.bincount(np.searchsorted(node, parent), child_log, minlength=len(node))
    log = np.logaddexp(own, LOG_HALF + below)
    return log, np.exp(own - log)


def lower_tree(key: np.ndarray, n: np.ndarray) -> list[list[tuple]]:
    """[depth - SPLIT][k] -> (node, zeros, ones, log, share) for depths SPLIT to DEPTH of the grams key with counts n."""
    tree: list[list[tuple]] = []
    for depth in range(DEPTH, SPLIT - 1, -1):
        cut = 8 * (DEPTH - depth)
        k_d, n_d = _sums((key >> (cut + 8)) << 8 | (key & 255), n) if cut else (key, n)
        level = []
        for k in range(8):
            node, zeros, ones = bit_nodes(k_d, n_d, k)
            if depth == DEPTH:
                level.append((node, zeros, ones, log_kt(zeros, ones), np.ones(len(node))))
            else:
                child = tree[-1][k]
                level.append((node, zeros, ones, *weigh(node, zeros, ones, child[0], child[3], k)))
        tree.append(level)
    return tree[::-1]


def upper_level(below: list[tuple], k: int) -> tuple:
    """The nodes one depth up from (node, zeros, ones, log) of one bit."""
    node, zeros, ones, log = below[:4]
    parent = (node >> (8 + k)) << k | (node & ((1 << k) - 1))
    up, a, b = _sums(parent, zeros, ones)
    return (up, a, b, *weigh(up, a, b, node, log, k))


def log10_probabilities(key: np.ndarray, tree: list[list[tuple]], upper: list[list[tuple]]) -> np.ndarray:
    """Of each gram of the tree: the log10 of the probability of its byte in its context."""
    out = np.zeros(len(key))
    levels = [*upper, *tree]  # by depth
    for k in range(8):
        bit = key >> (7 - k) & 1
        bits = (key & 255) >> (8 - k)
        p = np.full(len(key), 0.5)
        for depth in range(DEPTH, -1, -1):
            node, zeros, ones, _, share = levels[depth][k]
            i = np.searchsorted(node, (key >> 8 * (DEPTH - depth + 1)) << k | bits)
            a, b = zeros[i], ones[i]
            p = share[i] * ((np.where(bit, b, a) + 0.5) / (a + b + 1)) + (1 - share[i]) * p
        out += np.log10(p)
    return out


# Packing


def _zip(a: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def _unzip(b: bytes, dtype) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=dtype)


def _zip_words(words) -> bytes:
    return _zip(np.frombuffer(b" ".join(words), dtype=np.uint8))


class Block:
    """Documents with what they ask for: distinct grams and words, in an order that a second look finds again."""

    def __init__(self, texts: list[bytes], train: np.ndarray, shares: int, word_buckets: int):
        import pyarrow as pa
        import pyarrow.compute as pc

        self.texts, self.train = texts, train
        found = []
        for i, j in self._chunks():
            key, sizes = grams(texts[i:j])
            code = np.sort(key << 1 | np.repeat(train[i:j], sizes))
            first = np.flatnonzero(np.concatenate([[True], (code[1:] >> 1) != (code[:-1] >> 1)])) if len(code) else np.zeros(0, dtype=np.int64)
            found.append((code[first] >> 1, np.add.reduceat(code & 1, first) if len(code) else code))
        self.key, self.n = _sums(np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found]))
        near = (self.key >> 8 * (DEPTH + 1 - SPLIT)).astype(np.uint64)
        share = ((near * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(shares)
        bucket = (self.key >> 8 * DEPTH) * shares + share.astype(np.int64)  # of one nearest byte, and some of the two behind it
        self.order = np.argsort(bucket, kind="stable")  # by bucket, then by key
        self.ends = np.searchsorted(bucket[self.order], np.arange(256 * shares + 1))
        lists = pc.split_pattern(pa.array([t.decode() for t in texts], type=pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()
        self.words = coded.dictionary.to_pylist()
        self.index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        some = np.array([len(t) > 0 for t in texts], dtype=bool)  # the split of an empty text has one empty word
        if not some.all():
            self.index = self.index[np.repeat(some, self.counts)]
            self.counts = np.where(some, self.counts, 0)
        self.words.append(END)
        self.word_n = np.bincount(self.index, np.repeat(train, self.counts), minlength=len(self.words)).astype(np.int64)
        self.word_n[-1] = train.sum()
        place = np.fromiter((zlib.crc32(w.encode()) for w in self.words), dtype=np.int64, count=len(self.words)) % word_buckets
        self.word_order = np.argsort(place, kind="stable")
        self.word_ends = np.searchsorted(place[self.word_order], np.arange(word_buckets + 1))

    def _chunks(self):
        at = size = 0
        for i, t in enumerate(self.texts):
            size += len(t)
            if size >= CHUNK_BYTES:
                yield at, i + 1
                at, size = i + 1, 0
        if at < len(self.texts):
            yield at, len(self.texts)

    def asks(self):
        """(kind, bucket, data, counts) for every bucket that the block needs."""
        for b in np.flatnonzero(np.diff(self.ends)).tolist():
            own = self.order[self.ends[b] : self.ends[b + 1]]
            yield 1, b, _zip(np.diff(self.key[own], prepend=0)), _zip(self.n[own])
        for b in np.flatnonzero(np.diff(self.word_ends)).tolist():
            own = self.word_order[self.word_ends[b] : self.word_ends[b + 1]]
            yield 2, b, _zip_words(self.words[i].encode() for i in own.tolist()), _zip(self.word_n[own])

    def answer(self, logs: dict[int, np.ndarray], known: dict[int, np.ndarray], total: int, kinds: int):
        """n_tokens, n_known, base_score and score of every document."""
        log = np.empty(len(self.key))
        for b, x in logs.items():
            log[self.order[self.ends[b] : self.ends[b + 1]]] = x
        c = np.empty(len(self.words))
        for b, x in known.items():
            c[self.word_order[self.word_ends[b] : self.word_ends[b + 1]]] = x
        score = np.zeros(len(self.texts))
        for i, j in self._chunks():
            key, sizes = grams(self.texts[i:j])
            score[i:j] = np.add.reduceat(log[np.searchsorted(self.key, key)], np.cumsum(sizes) - sizes)
        base = np.log10((c + 0.1) / (total + 0.1 * (kinds + 1)))
        doc = np.repeat(np.arange(len(self.texts)), self.counts)
        n = len(self.texts)
        return self.counts + 1, np.bincount(doc, c[self.index] > 0, minlength=n).astype(np.int64) + int(c[-1] > 0), np.bincount(doc, base[self.index], minlength=n) + base[-1], score


KIND = "block long, kind int, bucket int, data binary, counts binary, docs binary, sizes binary, ids array<bigint>"


def _blocks(shares: int, word_buckets: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        names = [x.split()[0] for x in KIND.split(", ")]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        base = TaskContext.get().partitionId() << 24

        def flush(number, ids, texts, train):
            block = Block(texts, np.array(train, dtype=np.int64), shares, word_buckets)
            rows = [(base + number, 0, None, None, _zip(block.train), _zip(np.frombuffer(b"".join(texts), dtype=np.uint8)), _zip(np.array([len(t) for t in texts], dtype=np.int64)), ids)]
            rows += [(base + number, kind, b, data, n, None, None, None) for kind, b, data, n in block.asks()]
            del block
            pa.default_memory_pool().release_unused()
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        number, size, ids, texts, train = 0, 0, [], [], []
        for batch in batches:
            for key, held, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids.append(key)
                train.append(not held)
                texts.append(canonical(text))
                size += len(texts[-1]) + 1
                if size >= BLOCK_BYTES:
                    yield flush(number, ids, texts, train)
                    number, size, ids, texts, train = number + 1, 0, [], [], []
        if ids:
            yield flush(number, ids, texts, train)

    return run


def _grams_of(rows):
    """The distinct keys of packed grams in order, and their counts."""
    keys = np.concatenate([np.cumsum(_unzip(x, np.int64)) for x in rows.column("data").to_pylist()])
    return _sums(keys, np.concatenate([_unzip(x, np.int64) for x in rows.column("counts").to_pylist()]))


def _add_grams(rows):
    import pyarrow as pa

    key, n = _grams_of(rows)
    return pa.table({"bucket": rows.column("bucket").slice(0, 1), "part": rows.column("part").slice(0, 1), "data": pa.array([_zip(np.diff(key, prepend=0))], pa.binary()), "counts": pa.array([_zip(n)], pa.binary()), "tokens": pa.array([0], pa.int64()), "distinct": pa.array([0], pa.int64())})


def _words_of(rows):
    """The distinct words as an Arrow array, and their counts."""
    import pyarrow as pa

    words = pa.array([w for x in rows.column("data").to_pylist() for w in _unzip(x, np.uint8).tobytes().split(b" ")], type=pa.large_binary())
    n = np.concatenate([_unzip(x, np.int64) for x in rows.column("counts").to_pylist()])
    coded = words.dictionary_encode()
    return coded.dictionary, np.bincount(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), n).astype(np.int64)


def _add_words(rows):
    import pyarrow as pa

    words, n = _words_of(rows)
    return pa.table({"bucket": rows.column("bucket").slice(0, 1), "part": rows.column("part").slice(0, 1), "data": pa.array([_zip_words(words.to_pylist())], pa.binary()), "counts": pa.array([_zip(n)], pa.binary()), "tokens": pa.array([int(n.sum())], pa.int64()), "distinct": pa.array([int((n > 0).sum())], pa.int64())})


def _added(asked: DataFrame, blocks: int, add) -> DataFrame:
    """A row for each bucket: its packed keys and their counts over all blocks, FAN at a time."""
    now = asked.select("bucket", F.xxhash64("block").alias("part"), "data", "counts")
    kind = "bucket int, part long, data binary, counts binary, tokens long, distinct long"
    while blocks > FAN:
        blocks = -(-blocks // FAN)
        part = F.pmod("part", F.lit(blocks)).alias("part")
        now = stash(now.select("bucket", part, "data", "counts").groupBy("bucket", "part").applyInArrow(add, kind), "added")
    one = now.select("bucket", F.lit(0).cast("long").alias("part"), "data", "counts")
    return stash(one.groupBy("bucket").applyInArrow(add, kind), "added")


def _split_nodes(shares: int):
    def run(rows):
        """The nodes of depth SPLIT of a bucket."""
        import pyarrow as pa

        level = lower_tree(*_grams_of(rows))[0]
        out = [_zip(np.concatenate([node.astype(np.float64), zeros, ones, log])) for node, zeros, ones, log, _ in level]
        return pa.table({"near": pa.array([rows.column("bucket")[0].as_py() // shares], pa.int32()), "nodes": pa.array([out], pa.list_(pa.binary()))})

    return run


def _join_nodes(rows):
    """The nodes of depth 1 and 2 below one nearest byte, each with its eight bits."""
    import pyarrow as pa

    parts, packed = rows.column("nodes").to_pylist(), [[] for _ in range(SPLIT - 1)]
    for k in range(8):
        found = [_unzip(p[k], np.float64).reshape(4, -1) for p in parts]
        node, zeros, ones, log = np.concatenate(found, axis=1)
        order = np.argsort(node, kind="stable")
        level = (node[order].astype(np.int64), zeros[order], ones[order], log[order])
        for depth in range(SPLIT - 1, 0, -1):
            level = upper_level(level, k)
            packed[depth - 1].append(_zip(np.concatenate([level[0].astype(np.float64), *level[1:]])))
    return pa.table({"near": rows.column("near").slice(0, 1), "first": pa.array([packed[0]], pa.list_(pa.binary())), "second": pa.array([packed[1]], pa.list_(pa.binary()))})


def _level(packed: list[bytes]) -> list[tuple]:
    """The nodes of one depth, by bit."""
    out = []
    for x in packed:
        node, *rest = _unzip(x, np.float64).reshape(5, -1)
        out.append((node.astype(np.int64), *rest))
    return out


def _root(rows: list[list[bytes]]) -> list[tuple]:
    """The nodes of depth 0, from those of depth 1 of each nearest byte."""
    levels, out = [_level(r) for r in rows], []
    for k in range(8):
        node, zeros, ones, log = (np.concatenate([level[k][i] for level in levels]) for i in range(4))
        order = np.argsort(node, kind="stable")
        out.append(upper_level((node[order], zeros[order], ones[order], log[order]), k))
    return out


def _model(root):
    def run(rows, upper):
        """The log10 probabilities of a bucket's grams."""
        import pyarrow as pa

        key, n = _grams_of(rows)
        levels = [root, _level(upper.column("first")[0].as_py()), _level(upper.column("second")[0].as_py())]
        log = log10_probabilities(key, lower_tree(key, n), levels)
        return pa.table({"bucket": rows.column("bucket").slice(0, 1), "data": pa.array([_zip(np.diff(key, prepend=0))], pa.binary()), "counts": pa.array([_zip(log)], pa.binary())})

    return run


ANSWER = "block long, kind int, bucket int, data binary"


def _answer_grams(asked, model):
    import pyarrow as pa

    key, log = np.cumsum(_unzip(model.column("data")[0].as_py(), np.int64)), _unzip(model.column("counts")[0].as_py(), np.float64)
    out = [_zip(log[np.searchsorted(key, np.cumsum(_unzip(x, np.int64)))]) for x in asked.column("data").to_pylist()]
    return pa.table({"block": asked.column("block"), "kind": asked.column("kind"), "bucket": asked.column("bucket"), "data": pa.array(out, pa.binary())})


def _answer_words(asked, model):
    import pyarrow as pa
    import pyarrow.compute as pc

    words, n = _words_of(model)
    out = []
    for x in asked.column("data").to_pylist():
        own = pa.array(_unzip(x, np.uint8).tobytes().split(b" "), type=pa.large_binary())
        out.append(_zip(n[pc.index_in(own, value_set=words).to_numpy(zero_copy_only=False)]))
    return pa.table({"block": asked.column("block"), "kind": asked.column("kind"), "bucket": asked.column("bucket"), "data": pa.array(out, pa.binary())})


def _answered(asked: DataFrame, model: DataFrame, blocks: int, answer) -> DataFrame:
    """What each block asked of each bucket; a bucket's model meets SLICE blocks at a time."""
    slices = -(-blocks // SLICE)
    models = model.select(F.col("bucket").alias("b"), "data", "counts", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("s"))
    asked = asked.select("block", "kind", "bucket", "data", F.pmod(F.xxhash64("block"), F.lit(slices)).cast("int").alias("slice"))
    return asked.groupBy("bucket", "slice").cogroup(models.groupBy("b", "s")).applyInArrow(answer, ANSWER)


def _scores(shares: int, word_buckets: int, total: int, kinds: int):
    def run(rows):
        import pyarrow as pa

        docs, logs, known = None, {}, {}
        for row in rows.to_pylist():
            if row["kind"] == 0:
                docs = row
            elif row["kind"] == 1:
                logs[row["bucket"]] = _unzip(row["data"], np.float64)
            else:
                known[row["bucket"]] = _unzip(row["data"], np.int64)
        data, sizes, train = _unzip(docs["docs"], np.uint8).tobytes(), _unzip(docs["sizes"], np.int64), _unzip(docs["counts"], np.int64)
        ends = np.cumsum(sizes).tolist()
        block = Block([data[e - s : e] for e, s in zip(ends, sizes.tolist(), strict=True)], train, shares, word_buckets)
        n, k, base, score = block.answer(logs, known, total, kinds)
        return pa.table({"doc_id": pa.array(docs["ids"], pa.int64()), "held_out": pa.array(train == 0), "n_tokens": pa.array(n), "n_known": pa.array(k), "train_tokens": pa.array(np.full(len(n), total)), "base_score": pa.array(base), "score": pa.array(score)})

    return run


def ctw_scores(docs: DataFrame, n: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    score is the log10 probability of the whole lower-cased word sequence with its end. Statistics come from all
    documents that are not held out (crc32 of doc_id as text divisible by n); a null doc_id is not held out, a null
    text is empty. Equal rows are scored one by one. Without training documents every bit has probability 1/2.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"] // BLOCK_BYTES
    shares, word_buckets = min(MOST_SHARES, 1 + size // 24), min(MOST_WORD_BUCKETS, 1 + size)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(n).alias("held"), "text")
    blocks = stash(named.mapInArrow(_blocks(shares, word_buckets), KIND), "blocks")
    many = blocks.where("kind = 0").count()
    ready = blocks.where("kind = 0").select("block", "kind", "bucket", "data", "counts", "docs", "sizes", "ids")
    asked, words, total = blocks.where("kind = 1"), blocks.where("kind = 2"), {"t": 0, "d": 0}
    if many:
        counts = _added(asked, many, _add_grams)
        split = counts.groupBy("bucket").applyInArrow(_split_nodes(shares), "near int, nodes array<binary>")
        upper = stash(split.groupBy("near").applyInArrow(_join_nodes, "near int, first array<binary>, second array<binary>"), "upper")
        root = _root([r["first"] for r in upper.select("first").collect()])  # at most 256 rows of 255 nodes
        own = counts.select("bucket", F.expr(f"bucket div {shares}").alias("c")).join(upper, F.col("c") == F.col("near")).select(F.col("bucket").alias("b"), "first", "second")
        model = counts.groupBy("bucket").cogroup(own.groupBy("b")).applyInArrow(_model(root), "bucket int, data binary, counts binary")
        known = _added(words, many, _add_words)
        total = known.agg(F.sum("tokens").alias("t"), F.sum("distinct").alias("d")).first()
        ready = ready.unionByName(_answered(asked, model, many, _answer_grams), allowMissingColumns=True)
        ready = ready.unionByName(_answered(words, known, many, _answer_words), allowMissingColumns=True)
    kind = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return ready.groupBy("block").applyInArrow(_scores(shares, word_buckets, total["t"], total["d"]), kind)


def op9_ctw_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw_scores(table(spark, sf_dir, "documents"))
