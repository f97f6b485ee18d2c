"""The pipeline's near-duplicates against all pairs."""

import itertools
import random

import pytest

import corpus_pipeline
from ravelin.llm import near

rng = random.Random(11)


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def some_docs():
    rows, at = [], 0
    for _ in range(12):
        base = [f"w{rng.randrange(900)}" for _ in range(rng.randrange(150, 400))]
        for changes in (0, 0, 1, 2, 3, 4, 5, 6, 8, 12):
            words = [*base]
            for i in rng.sample(range(len(words)), changes):
                words[i] = f"x{rng.randrange(900)}"
            rows.append((at, " ".join(words)))
            at += 1
    rows += [(at, ""), (at + 1, None), (at + 2, "One two"), (at + 3, " one\tTWO "), (at + 4, "one"), (at + 4, "one"), (None, "one"), (None, "")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("tile", [near.TILE_ROWS, 3])
def test_stage_keeps_one_text_of_each_group_at_similarity_08(spark, monkeypatch, tile):
    monkeypatch.setattr(near, "TILE_ROWS", tile)
    rows = some_docs()
    sets = {k: grams(t) for k, t in rows if k is not None}
    parent = {k: k for k in sets}

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(sorted(sets), 2):
        both, every = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if 10 * both >= 8 * every:
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    want = sorted({top(k) for k in sets})
    docs = spark.createDataFrame([(k, t, "s") for k, t in rows], "doc_id long, text string, source string")
    found = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in found if r["doc_id"] is not None) == want and 20 < len(want) < 100
    assert sum(r["doc_id"] is None for r in found) == 2


def test_no_rows(spark):
    assert near.keep_first(spark.createDataFrame([], "doc_id long, text string")).count() == 0
