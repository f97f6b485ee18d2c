import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from ravelin.llm import ctw

SCHEMA = "doc_id long, text string, extra int"


def brute(rows):
    """Scores by the recursion of the definition, over dictionaries of contexts."""
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 10 == 0
    texts = [(k, b" ".join((t or "").encode().lower().split()) + b"\n") for k, t in rows]
    counts = defaultdict(lambda: [0, 0])
    children = defaultdict(set)

    def decisions(text):
        data = b"\n" * ctw.DEPTH + text
        for i in range(ctw.DEPTH, len(data)):
            bits = ""
            for k in range(7, -1, -1):
                bit = data[i] >> k & 1
                yield data[i - ctw.DEPTH : i], bits, bit
                bits += str(bit)

    for k, text in texts:
        if not held(k):
            for context, bits, bit in decisions(text):
                for d in range(ctw.DEPTH + 1):
                    s = context[len(context) - d :]
                    counts[s, bits][bit] += 1
                    if d:
                        children[s[1:], bits].add(s)
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    memo = {}

    def weighted(s, bits):
        if (s, bits) not in memo:
            own = kt(*counts[s, bits])
            if len(s) < ctw.DEPTH:
                a, b = math.log(0.5) + own, math.log(0.5) + sum(weighted(c, bits) for c in children[s, bits])
                own = max(a, b) + math.log1p(math.exp(-abs(a - b)))
            memo[s, bits] = own
        return memo[s, bits]

    def probability(context, bits, bit):
        p = 0.5
        for d in range(ctw.DEPTH, -1, -1):
            s = context[len(context) - d :]
            zeros, ones = counts[s, bits] if (s, bits) in counts else (0, 0)
            own = ((ones if bit else zeros) + 0.5) / (zeros + ones + 1)
            share = 1.0 if d == ctw.DEPTH else 0.5 * math.exp(kt(zeros, ones) - (weighted(s, bits) if (s, bits) in counts else 0))
            p = share * own + (1 - share) * p
        return p

    train = Counter()
    for k, text in texts:
        if not held(k):
            train.update([*text.split(), b"\n"])
    total, kinds = sum(train.values()), len(train)
    out = {}
    for k, text in texts:
        tokens = [*text.split(), b"\n"]
        base = sum(math.log10((train[t] + 0.1) / (total + 0.1 * (kinds + 1))) for t in tokens)
        score = sum(math.log10(probability(*x)) for x in decisions(text))
        out[k] = held(k), len(tokens), sum(train[t] > 0 for t in tokens), total, base, score
    return out


@pytest.mark.parametrize(("block", "fan"), [(16_000_000, 64), (300, 64), (100, 3)])
def test_equals_the_recursion(spark, monkeypatch, block, fan):
    monkeypatch.setattr(ctw, "BLOCK_BYTES", block)
    monkeypatch.setattr(ctw, "FAN", fan)  # 3: counts are added up in several rounds, answers sent in slices
    monkeypatch.setattr(ctw, "SLICE", fan)
    monkeypatch.setattr(ctw, "CHUNK_BYTES", 100)
    rng = random.Random(5)
    words = ["the", "cat", "Sat", "on", "mat", "élan", "a"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 25)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, " \t\n"), (63, rows[0][1]), (64, "the " * 500), (65, "nul\0byte x y"), (None, "the cat")]
    found = ctw.ctw_scores(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)).collect()
    assert len(found) == len(rows)
    want = brute(rows)
    for r in found:
        w = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4]
        assert r["base_score"] == pytest.approx(w[4], rel=1e-9)
        assert r["score"] == pytest.approx(w[5], rel=1e-8)


def test_probabilities_of_a_byte_add_up_to_one():
    import numpy as np

    key, _ = ctw.grams([b"abracadabra abracadabra", b"banana"])
    context = key[7] >> 8
    asked = context << 8 | np.arange(256)
    keys, n = ctw._sums(np.concatenate([key, asked]), np.concatenate([np.ones(len(key), dtype=np.int64), np.zeros(256, dtype=np.int64)]))
    tree = ctw.lower_tree(keys, n)
    upper, level = [None] * ctw.SPLIT, tree[0]
    for d in range(ctw.SPLIT - 1, -1, -1):
        upper[d] = level = [ctw.upper_level(level[k], k) for k in range(8)]
    p = 10 ** ctw.log10_probabilities(keys, tree, upper)
    assert p[np.isin(keys, asked)].sum() == pytest.approx(1)


def test_no_rows_and_no_training_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ctw.ctw_scores(empty).count() == 0
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    row = ctw.ctw_scores(spark.createDataFrame([(held, "ab", 1)], SCHEMA)).first()
    assert row["held_out"] and row["n_known"] == 0 and row["train_tokens"] == 0
    assert row["score"] == pytest.approx(24 * math.log10(0.5), rel=1e-6)
