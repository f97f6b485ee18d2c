import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ravelin.llm import packing, simple8b, tokens

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, ids_crc32 string"
ODD = ["", None, " ", "\n\n", "a", "a\n", " a", "a  b", "a\tb", "it's DON'T we'll", "<|endoftext|> x <|startoftext|>", "\x02a\x02 b", "é é  x y", "Ǆ ß İ ﬁ 漢字かな", "x\x1cy\x85z", "١٢3 4½", "a.b,c!! $$5 '' 's", "\0 \r\n x", "🙂👍🏽 ok", "word " * 3000]


def library(path, texts, end):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [[*e.ids, end] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def noise(n):
    rng = random.Random(3)
    letters = "abcdeABZ019 ..,'!-_\n\n  \t" + "éßñÅçİıſK" + "́  \x85\x1f​漢א١½Ⅷ🙂\x02\0"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize(("kind", "path"), [(tokens.BytePairs, BYTES), (tokens.WordPairs, WORDS)])
def test_ids_equal_the_library(kind, path):
    texts = [x or "" for x in ODD] + noise(3000)
    coder, want = kind(path), library(path, texts, 7)
    for at in range(0, len(texts), 500):
        ids, n = coder.encode(texts[at : at + 500])
        ends = np.cumsum(n)
        for text, e, k, w in zip(texts[at : at + 500], ends, n, want[at : at + 500], strict=True):
            assert ids[e - k : e].tolist() == w[:-1], repr(text)
    assert len(coder.encode([])[0]) == 0


@pytest.mark.parametrize("top", [2, 64, 1 << 15, 1 << 20, 1 << 60, 1 << 64])
def test_simple8b_round_trip(top):
    rng = np.random.default_rng(1)
    for n in (0, 1, 59, 60, 61, 5000):
        values = np.array([int(x) % top for x in rng.integers(0, 1 << 63, n, dtype=np.uint64)], dtype=np.uint64)
        if n:
            values[-1] = top - 1
        words = simple8b.pack(values)
        assert len(words) % 8 == 0 and (simple8b.unpack(words) == values).all()
    mixed = np.array([0] * 100 + [2**64 - 1, 2**60, 1] + list(range(300)) + [2**63] * 3, dtype=np.uint64)
    assert (simple8b.unpack(simple8b.pack(mixed)) == mixed).all()


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.mark.parametrize("block", [65_536, 50])
def test_files_hold_all_ids_in_order(spark, tmp_path, block):
    rows = [(i * 7 % 101, t) for i, t in enumerate([*ODD, *noise(60)])]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(5)
    simple8b.write_ids(df, f"file://{tmp_path}/ids", WORDS, block_ids=block)
    found = {r["doc_id"]: r for r in simple8b.read_ids(spark, f"file://{tmp_path}/ids").collect()}
    rows.sort()
    start = 0
    for (key, _), ids in zip(rows, library(WORDS, [t for _, t in rows], 2), strict=True):
        r = found[key]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), crc(ids))
        start += len(ids)
    assert len(found) == len(rows)


def test_files_of_an_empty_table_and_repeated_rows(spark, tmp_path):
    simple8b.write_ids(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/none", WORDS)
    assert simple8b.read_ids(spark, f"file://{tmp_path}/none").count() == 0
    simple8b.write_ids(spark.createDataFrame([(1, "a", ""), (1, "a", ""), (None, "b c", "")], SCHEMA), f"file://{tmp_path}/same", WORDS)
    assert sorted((r["doc_id"] or 0, r["start"], r["n_tokens"]) for r in simple8b.read_ids(spark, f"file://{tmp_path}/same").collect()) == [(0, 0, 3), (1, 3, 2), (1, 5, 2)]


def test_pieces_hold_every_id_once_in_full_windows(spark):
    rows = [(i, t) for i, t in enumerate([*ODD, *noise(400)])]
    found = packing.pack_documents(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3), BYTES, window=64).collect()
    pieces, windows = {}, {}
    for r in found:
        pieces.setdefault(r["doc_id"], []).append(r)
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for (key, _), ids in zip(rows, library(BYTES, [t for _, t in rows], 0), strict=True):
        at = 0
        for r in sorted(pieces[key], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == crc(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    for own in windows.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= 64 and at & (at - 1) == 0
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), BYTES).count() == 0


LONG = [" " * 2_000_000, "\n" * 2_000_000, "a" * 300_000, "x " * 400_000 + "  y"]
SPECIAL = ["a <|endoftext|> b", "<|endoftext|>", "x<|startoftext|>y", "<|EndOfText|> z", "  <|endoftext|>\n\n", "plain"]


def test_queries_take_the_tokenizer_as_loaded(spark, tmp_path):
    """Very long runs, and strings of special tokens, against a tokenizer on which nothing was set."""
    rows = list(enumerate([*SPECIAL, *LONG, *ODD]))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")

    def loaded(path, text, end):
        return [*Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids, end]

    start = 0
    found = {r["doc_id"]: r for r in simple8b.op7_encode_ids(spark, str(tmp_path)).collect()}
    for key, text in rows:
        ids, r = loaded(WORDS, text, 2), found[key]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), crc(ids)), text and text[:30]
        start += len(ids)
    pieces = {}
    for r in packing.op8_pack_documents(spark, str(tmp_path)).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
    for key, text in rows:
        ids, at = loaded(BYTES, text, 0), 0
        for r in sorted(pieces[key], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == crc(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)


def test_the_rule_closes_most_windows(spark):
    """8 tasks of 1,250 documents: as much as the rule reaches in one task of 10,000; the share grows with the documents."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").repartition(8)
    found = packing.pack_documents(docs, BYTES).select("sequence_id", "closed").distinct().groupBy("closed").count().collect()
    n = {r["closed"]: r["count"] for r in found}
    assert n["rule"] > 0.8 * (n["rule"] + n["cut"]) and sum(n.values()) > 9_000


def test_the_rule_closes_nearly_all_windows_of_a_larger_input():
    sizes = np.maximum(1, np.random.default_rng(0).lognormal(5.6, 1.0, 60_000).astype(int))
    packers = []
    for own in np.array_split(sizes, 16):
        packers.append(packing.SumOfSquares())
        for key, size in enumerate(own.tolist()):
            packers[-1].add(key, np.zeros(size, dtype=np.int32))
    left = sorted((x for p in packers for own in p.take_open() for x in own), key=lambda x: -len(x[2]))
    packers.append(packing.SumOfSquares())
    for x in left:
        packers[-1].place([x], len(x[2]))
    packers[-1].close()
    closed = [c for p in packers for _, _, c in p.out]
    assert closed.count("rule") > 0.95 * (closed.count("rule") + closed.count("cut"))
    assert sum(len(x[2]) for p in packers for _, own, _ in p.out for x in own) == sizes.sum()


def test_sum_of_squares_chooses_the_best_level():
    rng = np.random.default_rng(2)
    packer = packing.SumOfSquares(16)
    for key in range(500):
        size = int(rng.integers(1, 16))
        n = packer.count.copy()
        after = {}
        for h in [0, *np.flatnonzero(n).tolist()]:
            if h + size <= 16:
                m = n.copy()
                if h:
                    m[h] -= 1
                if h + size < 16:
                    m[h + size] += 1
                after[h] = int((m * m).sum())
        assert after[packer.level(size)] == min(after.values())
        packer.add(key, np.zeros(size, dtype=np.int64))
