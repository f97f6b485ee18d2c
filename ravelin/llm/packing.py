"""Packing documents into windows of a fixed number of tokens by the online sum-of-squares rule.

A level array counts the open windows by fill. A document's whole windows are cut off; what remains goes to the fill
level (or to a new window) that leaves the smallest sum of squared counts. What is in windows that are open when a task's
input ends is placed once more by the rule, together with that of other tasks, the longest first. What is open then is
laid end to end and cut, and the last tokens go to windows whose lengths are powers of two, so no token is padding.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm.common import stash, table, text_slices
from ravelin.llm.tokens import BytePairs, shared

WINDOW = 1024
END_ID = 0
OPEN_WINDOWS = 20_000  # the documents of about so many open windows are packed on in one group
DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, closed string"


class SumOfSquares:
    """Items: (key, start, ids, total). Full windows leave by `out` as (sequence number, items, what closed them).

    The number of open windows grows with the root of the number of documents of a task."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.count = np.zeros(window + 1, dtype=np.int64)  # open windows by fill; 0 and `window` stay 0
        self.open: list[list[list]] = [[] for _ in range(window + 1)]
        self.sequences, self.out = 0, []

    def level(self, size: int) -> int:
        """The fill to which an item goes; 0: a new window. Ties go to the fullest."""
        w, n = self.window, self.count
        change = 2 * (n[size : w + 1] - n[: w + 1 - size]) + 2
        change[-1] = 1 - 2 * n[w - size]  # it gets full
        change[0] = 2 * n[size] + 1
        change[1:][n[1 : w + 1 - size] == 0] = np.iinfo(np.int64).max
        return len(change) - 1 - int(np.argmin(change[::-1]))

    def add(self, key, ids: np.ndarray) -> None:
        w, total = self.window, len(ids)
        whole = total - total % w
        for at in range(0, whole, w):
            self._emit([(key, at, ids[at : at + w], total)], "whole")
        if total > whole:
            self.place([(key, whole, ids[whole:].astype(np.int32), total)], total - whole)

    def place(self, items: list, size: int) -> None:
        """Items of together `size` tokens, fewer than a window, by the rule."""
        h = self.level(size)
        own = self.open[h].pop() if h else []
        self.count[h] -= h > 0
        own += items
        if h + size == self.window:
            self._emit(own, "rule")
        else:
            self.open[h + size].append(own)
            self.count[h + size] += 1

    def _emit(self, items: list, closed: str) -> None:
        self.out.append((self.sequences, items, closed))
        self.sequences += 1

    def take_open(self) -> list[list]:
        """The open windows, which are then no longer here."""
        out = [own for windows in self.open for own in windows]
        self.open = [[] for _ in range(self.window + 1)]
        self.count[:] = 0
        return out

    def close(self) -> None:
        """Lays the items of all open windows end to end."""
        items = [x for own in self.take_open() for x in own]
        left = sum(len(x[2]) for x in items)
        room, own = self._room(left), []
        for key, start, ids, total in items:
            while len(ids):
                if room == 0:
                    self._emit(own, "cut")
                    room, own = self._room(left), []
                k = min(room, len(ids))
                own.append((key, start, ids[:k], total))
                start, ids, room, left = start + k, ids[k:], room - k, left - k
        if own:
            self._emit(own, "cut")

    def _room(self, left: int) -> int:
        return self.window if left >= self.window else 1 << (left.bit_length() - 1) if left else 0

    def rows(self, base: int):
        """A row of DDL for each piece of the windows in `out`, which is empty then."""
        out, self.out = self.out, []
        for seq, items, closed in out:
            offset = 0
            for key, start, ids, total in items:
                yield key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, base + seq, offset, closed
                offset += len(ids)


def _table(rows: list[tuple], more=()):
    """rows of DDL, and of further columns."""
    import pyarrow as pa

    cols = list(zip(*rows, strict=True)) or [()] * (8 + len(more))
    kinds = [*[pa.int64()] * 7, pa.string(), *(k for _, k in more)]
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True)], names=[*(x.split()[0] for x in DDL.split(", ")), *(n for n, _ in more)])


def _packer(vocabulary: str, end_id: int, window: int, specials: bool):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        coder, packer = shared(BytePairs, vocabulary, specials), SumOfSquares(window)
        base = TaskContext.get().partitionId() << 33
        more = [("ids", pa.binary())]
        for docs, texts in text_slices(batches, 0, 1):
            ids, n = coder.encode(texts)
            ids = np.insert(ids, np.cumsum(n), end_id)
            ends = np.cumsum(n + 1)
            for key, stop, size in zip(docs, ends.tolist(), (n + 1).tolist(), strict=True):
                packer.add(key, ids[stop - size : stop])
            yield _table([(*r, None) for r in packer.rows(base)], more)
        left = [(key, start, len(ids), None, total, base + i, 0, None, ids.astype("<u4").tobytes()) for i, own in enumerate(packer.take_open()) for key, start, ids, total in own]
        for at in range(0, len(left), 2_000):
            yield _table(left[at : at + 10_000], more)

    return run


def _joiner(window: int):
    def run(key, rows):
        import pyarrow as pa

        packer = SumOfSquares(window)
        for r in rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")]).to_pylist():
            packer.place([(r["doc_id"], r["start"], np.frombuffer(r["ids"], dtype="<u4").astype(np.int32), r["doc_tokens"])], r["length"])
        packer.close()
        return pa.Table.from_batches([_table(list(packer.rows((1 << 62) + (key[0].as_py() << 33))))])

    return run


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = END_ID, window: int = WINDOW, specials: bool = False) -> DataFrame:
    """A row for each piece; closed tells whether its window is a document's own ("whole"), was filled by the rule
    ("rule") or by cutting what was left ("cut").

    A null text is empty (its end id alone); repeated doc_ids are packed as separate documents. Strings of special
    tokens are ordinary text, or with `specials` the tokens themselves. Documents are taken in the order in which a
    task reads them; only the open windows at its end are exchanged. sequence_id tells the task in its upper bits.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = stash(text.mapInArrow(_packer(vocabulary, end_id, window, specials), f"{DDL}, ids binary"), "packing")
    left = first.where("closed is null")
    groups = 1 + left.select("sequence_id").distinct().count() // OPEN_WINDOWS
    joined = left.withColumn("g", F.pmod(F.xxhash64("sequence_id"), F.lit(groups))).groupBy("g").applyInArrow(_joiner(window), DDL)
    return first.where("closed is not null").drop("ids").unionByName(joined)


def op8_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), specials=True)  # the tokenizer as loaded
