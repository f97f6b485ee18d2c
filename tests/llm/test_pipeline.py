"""The pipeline as it is run, stage by stage against what each operator says of every row, and the tokens of its end."""

import itertools

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from ravelin.llm import common, mixing, quality, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with columns that clash with the operators' own, nulls, repeated rows, and ids that two texts share."""
    path = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300")
    first = docs.where("doc_id < 3")
    odd = spark.createDataFrame([(900, None, "en", None), (901, "", "en", "src0"), (902, "word " * 30_000, "en", "src1"), (None, "text without an id", "en", "src2")], "doc_id long, text string, lang string, source string")
    same = docs.where("doc_id in (200, 201)").selectExpr("200L as doc_id", "text", "lang", "source")
    every = docs.select("doc_id", "text", "lang", "source").unionByName(first.select("doc_id", "text", "lang", "source")).unionByName(odd).unionByName(same)
    every.selectExpr("*", "'mine' as slot", "7 as weight", "'b' as block", "'p' as place").repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


def rows(df):
    return sorted(map(repr, df.collect()))


def test_every_stage_does_what_its_operator_says(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    chain = toxicity.fit_on(docs, labels)
    kept = stages["toxicity"](spark, docs, tables)
    clean = [r for r in docs.collect() if toxicity.probabilities(chain, [r["text"] or ""])[0, -1] < chain.threshold]
    assert rows(kept) == sorted(map(repr, clean)) and 0 < docs.count() - len(clean) < 60
    model = quality.fit(docs, labels)
    c = quality.Compressors(*model[:2])
    score = lambda t: 1 / (1 + 2.718281828459045 ** -(sum(a * b for a, b in zip(c.features(t or ""), model[2], strict=False)) + model[2][-1]))
    good = [r for r in docs.collect() if score(r["text"]) >= quality.THRESHOLD]
    assert rows(stages["quality"](spark, docs, tables)) == sorted(map(repr, good)) and 0 < docs.count() - len(good) < 150
    mixed = stages["mixing"](spark, docs, tables)
    assert mixed.columns == docs.columns and rows(mixed) == rows(docs)
    order = [r["source"] for r in mixed.collect()]
    runs = [(s, len(list(g))) for s, g in itertools.groupby(order)]
    assert all(n <= mixing.BLOCK_ROWS * 2 for _, n in runs[:10])
    for n in (64, 128):  # as long as no source has run out
        share = order[:n].count("src0") / n
        weights = [mixing.TARGET.get(s, 1) for s in set(order)]
        assert abs(share - 4 / sum(weights)) * n < 2 * mixing.BLOCK_ROWS


def test_rows_with_one_id_and_two_texts_stay(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    kept = corpus_pipeline.near_duplicates(spark, docs, tables)
    assert kept.columns == docs.columns
    found = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(found) == len(set(found))  # repeated rows stay once
    texts = {t for k, t in found if k == 200}
    assert len(texts) == len({r["text"] for r in docs.where("doc_id = 200").collect()}) == 2
    assert rows(corpus_pipeline.near_duplicates(spark, docs.repartition(7), tables)) == rows(kept)


def test_the_whole_run(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    want = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        want = common.stash(stage(spark, want, tables), name)
        assert want.columns == docs.columns
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    tokens = sorted((r["doc_id"] is not None, r["doc_id"] or 0, len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1) for r in want.collect())
    found = corpus_pipeline.run(spark, tables).collect()
    assert sum(r["length"] for r in found) == sum(n for *_, n in tokens)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["doc_tokens"]) for r in found if r["start"] == 0) == tokens
    windows = {}
    for r in found:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in windows.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 1024


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
