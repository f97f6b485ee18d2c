"""Small fixtures with nulls, ties, repeated rows, long texts, clashing columns and no rows, against brute force."""

import itertools
import random
import zlib

import numpy as np
import pytest

from ravelin.llm import ann, components, embeddings, mixing, quality, sharding, simhash, toxicity

DOCS = "doc_id long, text string, lang string, source string, slot int, shard string"
rng = random.Random(8)
WORDS = ["alpha", "Beta", "gamma", "délta", "eps", "zeta", "eta", "theta", "iota", "kappa"]


def sentence(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame([(k, t, "en", s, 1, "x") for k, t, s in rows], DOCS)


def some_docs():
    rows = [(i, sentence(rng.randrange(1, 60)), rng.choice(["a", "a", "a", "b", None])) for i in range(80)]
    return [*rows, (80, None, "a"), (81, "", "b"), (82, " \n ", None), (83, rows[0][1], "a"), (83, rows[0][1], "a"), (None, "x", "c"), (84, "long " * 30_000, "a")]


# Sharding


def test_shards_are_equal_and_slots_gapless(spark):
    rows = some_docs()
    found = sharding.shuffle_to_shards(docs(spark, rows).repartition(5), shards=8, rows_per_piece=7).collect()
    assert sorted((r["doc_id"] or -1, r["text"] or "", r["source"] or "") for r in found) == sorted((k or -1, t or "", s or "") for k, t, s in rows)
    slots = {s: sorted(r["slot"] for r in found if r["shard"] == s) for s in range(8)}
    assert all(x == list(range(len(x))) for x in slots.values()) and {len(x) for x in slots.values()} <= {len(rows) // 8, len(rows) // 8 + 1}
    assert sharding.shuffle_to_shards(docs(spark, [])).count() == 0
    assert sharding.shuffle_to_shards(docs(spark, rows[:3])).count() == 3


def test_communication_matrix_has_exact_sums_and_fair_counts():
    counts = [0, 5, 1000, 1, 333]
    total = np.zeros((5, 4))
    for seed in range(200):
        m = np.array(sharding.communication_matrix(counts, 4, seed))
        assert m.sum(axis=1).tolist() == counts and m.sum(axis=0).max() - m.sum(axis=0).min() <= 1
        total += m
    assert np.abs(total[2] / 200 - 250).max() < 5


def test_draws_from_large_populations_follow_the_law():
    """By inversion as by numpy: the same means and deviations; exact sums where numpy takes no population."""
    for free, rest, n in ((40, 60, 30), (5_000, 995_000, 2_000), (3, 900, 450)):
        own, far = (np.array([f(np.random.default_rng(i)) for i in range(4_000)]) for f in (
            lambda g: sharding._by_inversion(g, free, rest, n, max(0, n - rest), min(n, free)), lambda g: g.hypergeometric(free, rest, n)))
        spread = (n * free / (free + rest) * rest / (free + rest)) ** 0.5
        assert abs(own.mean() - far.mean()) < 0.1 * spread and abs(own.std() - far.std()) < 0.07 * spread
    counts = [10**10, 7, 3 * 10**9 + 1, 0, 10**6]
    m = np.array(sharding.communication_matrix(counts, 8, 1))
    assert m.sum(axis=1).tolist() == counts and m.sum(axis=0).max() - m.sum(axis=0).min() <= 1 and (m >= 0).all()
    assert np.abs(m[0] - 10**10 / 8).max() < 6 * (10**10 / 8) ** 0.5


def test_op1_against_its_law(spark, tmp_path):
    rows = some_docs()
    docs(spark, rows).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    found = sharding.op1_shard_documents(spark, str(tmp_path)).collect()
    own = lambda k, t: (k or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in found) == sorted(own(k, t) for k, t, _ in rows)
    assert {(r["law"], r["grown_shard"]) for r in found} == {("rows", None)}
    sizes = [sum(r["shard"] == s for r in found) for s in range(8)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
    assert all(sorted(r["slot"] for r in found if r["shard"] == s) == list(range(sizes[s])) for s in range(8))
    again = sharding.op1_shard_documents(spark, str(tmp_path)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


# Mixing


def test_a_period_is_pfair():
    for weights in ([4, 3, 2], [1], [5, 1, 1, 7], [1] * 6):
        slots, total = mixing.period(weights), sum(weights)
        for t, i in itertools.product(range(1, total + 1), range(len(weights))):
            assert abs(slots[:t].count(i) - weights[i] * t / total) < 1


def test_mixing_keeps_every_row_in_a_slot_of_its_own(spark):
    rows = some_docs()
    mixed = mixing.mix_sources(docs(spark, rows), {"a": 6, "b": 3}, block_rows=4)
    assert mixed.count() == len(rows) and mixed.select("slot", "place").distinct().count() == len(rows)
    found = mixed.collect()
    for s in {r["source"] for r in found}:
        own = sorted((r["block"], r["place"]) for r in found if r["source"] == s)
        assert own == [(i // 4, i % 4) for i in range(len(own))]
        by_block = {}
        for r in found:
            if r["source"] == s:
                by_block.setdefault(r["block"], set()).add(r["slot"])
        assert all(len(x) == 1 for x in by_block.values())
        assert [min(by_block[b]) for b in sorted(by_block)] == sorted(min(x) for x in by_block.values())
    assert mixing.mix_sources(docs(spark, [])).count() == 0


def lags(found, weights, default, block_rows):
    """The largest distance of any source from its share of the slots so far, until its last block."""
    weight = lambda s: weights.get(s, default)
    total, worst = sum(weight(s) for s in {r["source"] for r in found}), 0
    slots = {}
    for r in found:
        slots.setdefault(r["source"], {})[r["block"]] = r["slot"]
        assert r["weight"] == weight(r["source"])
    for s, own in slots.items():
        assert sorted(own) == list(range(len(own)))
        for j in range(len(own)):  # before its slot block j is missing, behind it it is there
            share = weight(s) / total
            worst = max(worst, share * own[j] - j, j + 1 - share * (own[j] + 1))
    assert len({(r["slot"], r["place"]) for r in found}) == len(found)
    taken = {}
    for r in found:
        assert taken.setdefault(r["slot"], (r["source"], r["block"])) == (r["source"], r["block"]) and 0 <= r["place"] < block_rows
    return worst


@pytest.mark.parametrize(("weights", "default"), [({"s0": 999_999, "s1": 2}, 1), ({"s0": 700_001, "s1": 400_003, "s2": 7}, 13), ({"s0": 40, "s1": 3}, 1)])
def test_any_weights_are_kept_within_a_block(spark, monkeypatch, weights, default):
    monkeypatch.setattr(mixing, "CHUNK_SLOTS", 20 if sum(weights.values()) < 100 else 400_000)
    rows = [(i, "t", f"s{min(i % 31, (i * i) % 7)}") for i in range(1_500)]
    found = mixing.mix_sources(docs(spark, rows).repartition(5), weights, default, block_rows=2).collect()
    assert len(found) == len(rows) and lags(found, weights, default, 2) < 1


def test_thousands_of_sources_of_equal_weight(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PIECE_SOURCES", 500)
    rows = [(i, "t", f"s{i % 3_000}") for i in range(9_000)]
    found = mixing.mix_sources(docs(spark, rows).repartition(3), {"s0": 5, "s7": 900}, 1, block_rows=1).collect()
    assert len(found) == len(rows) and lags(found, {"s0": 5, "s7": 900}, 1, 1) < 1


def test_the_schedule_is_the_earliest_deadline_first():
    """Against a search over all blocks in every slot."""
    for weights in ([4, 3, 2], [1, 1, 8, 3], [7]):
        total, done, want = sum(weights), [0] * len(weights), []
        for t in range(total):
            ready = [(-(-(done[i] + 1) * total // w), i) for i, w in enumerate(weights) if done[i] < w and done[i] * total // w <= t]
            want.append(min(ready)[1])
            done[want[-1]] += 1
        assert mixing.period(weights) == want


# SimHash


def brute_print(text):
    import xxhash

    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(keys, linked):
    parent = {k: k for k in keys}
    for _ in keys:
        for a, b in linked:
            parent[a] = parent[b] = min(parent[a], parent[b])
    return parent


@pytest.mark.parametrize("small", [simhash.SMALL, 2])
def test_simhash_groups_equal_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "TILE", 16)
    base = [sentence(400) for _ in range(6)]
    rows = [(i, b, "a") for i, b in enumerate(base)]
    for i in range(6, 90):
        words = rng.choice(base).split()
        words[rng.randrange(len(words))] = f"w{i % 7}"
        rows.append((i, " ".join(words), "a"))
    rows += [(90, None, "a"), (91, "", "a"), (92, "one", "a"), (93, " ONE\t", "a"), (94, "a b c d e", "b"), (94, "a b c d e", "b")]
    prints = {k: brute_print(t) for k, t, _ in rows}
    linked = [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 4]
    want = brute_groups(prints, linked)
    found = simhash.near_duplicates(docs(spark, rows)).collect()
    assert len(found) == len(rows) and len({*want.values()}) < 60
    for r in found:
        assert r["fp"] % (1 << 64) == prints[r["doc_id"]] and r["component_id"] == want[r["doc_id"]]
    kept = simhash.keep_first(docs(spark, [*rows, (None, "q", "a")]))
    assert kept.columns == docs(spark, []).columns and sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect()) == [-1, *sorted({*want.values()})]
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_block_choices_cover_every_four_bits():
    masks = [m % (1 << 64) for m in simhash.block_masks()]
    for bits in itertools.islice(itertools.combinations(range(0, 64, 3), 4), 3000):
        flipped = sum(1 << b for b in bits)
        assert any(not m & flipped for m in masks)


def test_components_of_a_chain_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(5, 5), (None, 3)]
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert found == {**dict.fromkeys(range(100, 141), 100), **dict.fromkeys([7, *range(200, 260)], 7)}


# Vectors


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n_links string")


def odd_vectors(at):
    nan, inf = float("nan"), float("inf")
    return [(at, None, 1, "x"), (at + 1, [0.0] * 32, 1, "x"), (at + 2, [nan] + [1.0] * 31, 1, "x"), (at + 3, [inf] + [1.0] * 31, 1, "x"), (at + 4, [None] + [1.0] * 31, 1, "x"), (at + 5, [1.0] * 32, None, "x"), (at + 6, [], 1, "x"), (at + 7, [1.0, 2.0], 1, "x")]


def near_vectors(n, spread):
    g = np.random.default_rng(4)
    centres = g.standard_normal((12, 32))
    return [(i, (centres[i % 12] + spread * g.standard_normal(32)).astype(np.float32).tolist(), i % 2, "x") for i in range(n)]


@pytest.mark.parametrize("tile", [embeddings.TILE, 8])
def test_near_vectors_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(embeddings, "TILE", tile)
    rows = near_vectors(240, 0.1)
    rows += [(300 + i, rows[3][1], 1, "x") for i in range(5)] + [(310, rows[0][1], 1, "x")]
    live = {r[0]: (np.array(r[1], dtype=np.float64), r[2]) for r in rows}
    cosine = lambda a, b: (a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum())
    linked = [(a, b) for a, b in itertools.combinations(live, 2) if live[a][1] == live[b][1] and cosine(live[a][0], live[b][0]) >= 0.98]
    want, n = brute_groups(live, linked), dict.fromkeys(live, 0)
    for a, b in linked:
        n[a], n[b] = n[a] + 1, n[b] + 1
    assert linked and len({*want.values()}) > 12
    odd = odd_vectors(400)
    found = embeddings.near_duplicate_vectors(vectors(spark, [*rows, *odd])).collect()
    assert len(found) == len(rows) + len(odd)
    for r in found:
        k = r["vec_id"]
        assert (r["n_links"], r["component_id"], r["kept"]) == ((n[k], want[k], k == want[k]) if k in live else (0, k, True))
    assert embeddings.near_duplicate_vectors(vectors(spark, [])).count() == 0


@pytest.mark.parametrize("per_part", [ann.ROWS_PER_PART, 150])
def test_nearest_vectors_reach_the_recall(spark, monkeypatch, per_part):
    monkeypatch.setattr(ann, "ROWS_PER_PART", per_part)
    rows = near_vectors(900, 0.4)
    rows += [(1000 + i, rows[50][1], 0, "x") for i in range(3)]
    live = {r[0]: np.array(r[1], dtype=np.float64) for r in rows}
    found = {}
    for r in ann.nearest(vectors(spark, [*rows, *odd_vectors(2000)])).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    queries = [k for k in live if k % 50 == 0]
    for k in queries:
        q = live[k]
        s = {j: (x * q).sum() / (np.sqrt((x * x).sum()) * np.sqrt((q * q).sum())) for j, x in live.items() if j != k}
        best = sorted(s, key=lambda j: (-s[j], j))[:5]
        own = sorted(found[k])
        assert [r for r, _, _ in own] == [1, 2, 3, 4, 5] and all(s[j] == pytest.approx(x, abs=1e-12) for _, j, x in own)
        assert [x for _, _, x in own] == sorted((x for _, _, x in own), reverse=True)
        hits += len({j for _, j, _ in own} & {*best})
    assert hits >= (0.9 if per_part < 900 else 1) * 5 * len(queries)
    assert ann.nearest(vectors(spark, [])).count() == 0 and ann.nearest(vectors(spark, odd_vectors(50)[:3])).count() == 0
    few = ann.nearest(vectors(spark, rows[:3])).collect()
    assert [(r["query_id"], r["rank"]) for r in few] == [(0, 1), (0, 2)]


def brute_nearest(rows, every=50):
    """(query row, [(score, vec_id)]) over every row but the query's own."""
    x = [(k, np.array(v, dtype=np.float64)) for k, v in rows]
    cosine = lambda a, b: (a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))
    for i, (k, q) in enumerate(x):
        if k % every == 0:
            yield k, sorted(((-cosine(q, y), j) for m, (j, y) in enumerate(x) if m != i and len(y) == len(q)))[:5]


def test_repeated_ids_and_mixed_lengths(spark):
    g = np.random.default_rng(9)
    rows = [(i % 25 * 10, g.standard_normal(2 if i % 3 else 3).astype(np.float32).tolist()) for i in range(60)]
    rows += [(50, [1.0, 0.5]), (50, [1.0, 0.5]), (100, [1.0] * 4), (200, [2.0] * 5), (201, [1.0] * 5), *[(300 + i, [3.0, 4.0]) for i in range(20)]]
    found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)).collect()
    want = sorted((k, r, j, round(-s, 9)) for k, own in brute_nearest(rows) for r, (s, j) in enumerate(own, 1))
    assert sum(r["query_id"] == 50 for r in found) == 5 * sum(k == 50 for k, _ in rows)
    assert len(found) == len(want)
    hits = len({(q, j) for q, _, j, _ in want} & {(r["query_id"], r["vec_id"]) for r in found})
    assert hits >= 0.9 * len({(q, j) for q, _, j, _ in want})
    twins = [r for r in found if r["query_id"] == 50 and r["rank"] == 1]
    assert sum(r["vec_id"] == 50 and abs(r["score"] - 1) < 1e-12 for r in twins) >= 2


def test_parts_of_parts(spark, monkeypatch):
    """A table that is partitioned three times."""
    monkeypatch.setattr(ann, "ROWS_PER_PART", 20)
    monkeypatch.setattr(ann, "MOST_PARTS", 4)
    monkeypatch.setattr(ann, "ROUTED", 100)
    rows = [(k, v) for k, v, *_ in near_vectors(2_000, 0.4)] + [(5_000 + i, [1.0] * 32) for i in range(300)]
    assert ann.levels_of(len(rows)) == 3
    data = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    cells = {r["cell"]: r["n"] for r in ann.index(data).where("not asks").groupBy("cell").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert len(cells) > 30 and sum(cells.values()) == len(rows)
    found = {}
    for r in ann.nearest(data).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = {k: own for k, own in brute_nearest(rows[:2_000])}
    assert sum(len({j for _, j in own} & found[k]) for k, own in want.items()) >= 0.9 * 5 * len(want)
    assert found[5_000] == {5_001, 5_002, 5_003, 5_004, 5_005} and found[5_100] == {5_000, 5_001, 5_002, 5_003, 5_004}


# Classifiers


def labelled_docs(spark):
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = "buy cheap pills now !!! " * rng.randrange(2, 9) + f"{i}" if bad else sentence(rng.randrange(20, 60))
        rows.append((i, text, "a"))
        labels.append((i, int(not bad), int(bad), "x"))
    odd = [(500, None, "a"), (501, "", "a"), (502, " ", "a"), (503, rows[0][1], "a"), (503, rows[0][1], "a"), (None, rows[1][1], "b"), (504, "x" * 300_000, "a")]
    return docs(spark, [*rows, *odd]), spark.createDataFrame([*labels, (None, 1, 0, "x"), (3, None, None, "x")], "doc_id long, quality int, toxic int, text string"), len(rows) + len(odd)


def test_quality_separates_held_out_rows(spark):
    d, labels, n = labelled_docs(spark)
    found = quality.quality_scores(d, labels).collect()
    assert len(found) == n and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found)
    for r in found:
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
            if r["doc_id"] < 400:
                assert r["predicted"] == int(r["doc_id"] % 4 != 0)
    kept = quality.keep_good(d, labels)
    assert kept.columns == d.columns and kept.count() == sum(r["predicted"] for r in found)
    none = quality.quality_scores(d, labels.where("false")).collect()
    assert {r["score"] for r in none} == {0.5} and quality.quality_scores(docs(spark, []), labels).count() == 0


def test_toxicity_separates_held_out_rows(spark):
    d, labels, n = labelled_docs(spark)
    found = toxicity.toxicity_scores(d, labels).collect()
    assert len(found) == n
    for r in found:
        if r["doc_id"] is not None and r["doc_id"] < 400:
            assert r["toxic"] == int(r["doc_id"] % 4 == 0)
        if r["doc_id"] in (500, 501, 502):
            assert r["toxic"] == 0
    kept = toxicity.keep_clean(d, labels)
    assert kept.columns == d.columns and kept.count() == sum(1 - r["toxic"] for r in found)
    assert {r["toxic"] for r in toxicity.toxicity_scores(d, labels.where("toxic = 0")).collect()} == {0}
    assert toxicity.toxicity_scores(docs(spark, []), labels).count() == 0


def test_later_links_see_earlier_probabilities():
    words = lambda *w: toxicity.text_features(" ".join(w))
    rows = [(f"{rng.choice(['stupid', 'filthy'])} {sentence(12)}" if i % 2 else sentence(12), i % 2) for i in range(200)]
    chain = toxicity.fit(rows)
    size = 2 * len(chain.vocabulary)
    assert [len(w) - size - 1 for w in chain.links] == list(range(toxicity.CATEGORIES + 1))
    assert {f for f in chain.vocabulary.tolist()} >= {words("stupid")[0].tolist()[0]}
    p = toxicity.probabilities(chain, ["stupid alpha eta", "alpha eta gamma", "", "STUPID!"])
    assert p[0, -1] > 0.5 > p[1, -1] and p[3, -1] > 0.5 > p[2, -1]


def late_docs(spark, bad_part):
    """Texts of over 40,000 characters; what tells the kinds apart comes behind all that."""
    rows, labels = [], []
    for i in range(160):
        bad = i % 2 == 0
        rows.append((i, sentence(7_000) + " " + (bad_part if bad else "calm and useful prose about gardens ") * 150, "a"))
        labels.append((i, int(not bad), int(bad)))
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_the_end_of_long_texts_counts_for_both_classifiers(spark):
    d, labels = late_docs(spark, "buy cheap pills now !!! ")
    found = {r["doc_id"]: r for r in quality.quality_scores(d, labels).collect()}
    assert sum(r["predicted"] == k % 2 for k, r in found.items() if r["held_out"]) >= 0.9 * sum(r["held_out"] for r in found.values())
    d, labels = late_docs(spark, "stupid filthy idiots ")
    found = {r["doc_id"]: r["toxic"] for r in toxicity.toxicity_scores(d, labels).collect()}
    assert all(v == int(k % 2 == 0) for k, v in found.items())


def test_the_distributed_fit_equals_that_of_the_same_texts(spark):
    d, labels, _ = labelled_docs(spark)
    rows = sorted(map(tuple, quality.labelled(d, labels, "toxic", 5, 3_000).collect()))
    assert len({k for k, _, _ in rows}) == len(rows) and all(zlib.crc32(str(k).encode()) % 5 for k, _, _ in rows)
    own, far = toxicity.fit([(t, y) for _, t, y in rows]), toxicity.fit_on(d, labels)
    assert own.vocabulary.tolist() == far.vocabulary.tolist() and own.threshold == far.threshold
    assert all(np.array_equal(a, b) for a, b in zip(own.links, far.links, strict=True))
    found = {r["doc_id"]: r["p_toxic"] for r in toxicity.toxicity_scores(d.where("doc_id < 40"), labels).collect()}
    # the chain, link by link, on one text at a time
    few = toxicity.fit([(t, y) for k, t, y in rows if k < 40])
    size = 2 * len(few.vocabulary)
    for k, text in ((r["doc_id"], r["text"]) for r in d.where("doc_id < 40").collect()):
        before = []
        at, much = toxicity.places(toxicity.text_features(text), few.vocabulary)
        for w in few.links:
            z = w[at].sum() + (w[at + len(few.vocabulary)] * much).sum() + sum(a * b for a, b in zip(w[size:], [*before, 1.0], strict=True))
            before.append(1 / (1 + np.exp(-z)))
        assert abs(found[k] - before[-1]) < 1e-9
    good, bad, weights = quality.fit(d, labels)
    c = quality.Compressors(good, bad)
    scores = {r["doc_id"]: r["score"] for r in quality.quality_scores(d, labels).collect()}
    for r in d.where("doc_id < 30").collect():
        assert abs(scores[r["doc_id"]] - 1 / (1 + np.exp(-(np.array(c.features(r["text"])) @ weights[:-1] + weights[-1])))) < 1e-9
