from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_decontaminate import brute as brute_contamination
from test_near_copies import brute as brute_near_copies

import corpus_pipeline
from tallycast.llm import bpe, pii, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """The rows after each stage, each stage on the written rows of the one before."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "rows")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_columns_stay_until_the_last_stage(kept):
    assert all(df.columns == kept[0].columns for df in kept[1:-1])
    assert all(dict(df.dtypes) == dict(kept[0].dtypes) for df in kept[1:-1])


def test_quality_stage_keeps_what_the_classifier_accepts(spark, kept):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    want = {r.doc_id for r in quality.classify(kept[0], labels).collect() if r.predicted}
    assert {r.doc_id for r in kept[1].collect()} == want
    clean = {r.doc_id for r in labels.where("quality = 1").collect()} & {r.doc_id for r in kept[0].collect()}
    assert len(clean & want) >= 0.95 * len(clean)


def test_near_duplicate_stage_keeps_one_of_each_group(kept):
    want = set(brute_near_copies([(r.doc_id, r.text) for r in kept[1].collect()]).values())
    assert sorted(r.doc_id for r in kept[2].collect()) == sorted(want)


def test_decontamination_stage(spark, kept):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = {r.doc_id: r.text for r in kept[2].collect()}
    found = brute_contamination(list(rows.items()), items)
    assert {r.doc_id for r in kept[3].collect()} == {i for i in rows if not found[i][4]}


def test_masking_and_encoding_stages(kept):
    before = {r.doc_id: r for r in kept[3].collect()}
    after = {r.doc_id: r for r in kept[4].collect()}
    assert before.keys() == after.keys()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    last = {r.doc_id: r for r in kept[5].collect()}
    for i, r in before.items():
        text = pii.masked(r.text, pii.scan(r.text))
        assert after[i].text == text and after[i].n_chars == len(text)
        ids = library.encode_ordinary(text)
        assert (last[i].n_tokens, last[i].ids_sha256, last[i].decoded_sha256) == (
            len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_run_equals_the_stages(spark, kept):
    assert sorted(corpus_pipeline.run(spark, SF).collect()) == sorted(kept[5].collect())


def test_stages_on_nulls_repeats_and_no_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "a b c d e f g", "en", "s", 1), (None, "a b c d e f g", "en", "s", 1), (None, "other words here", None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    groups = corpus_pipeline.STAGES[1][1](spark, docs, SF)
    assert sorted(((r.doc_id, r.text) for r in groups.collect()), key=str) == sorted([(1, None), (None, "a b c d e f g"), (None, "other words here")], key=str)
    for name, stage in corpus_pipeline.STAGES:
        if name != "near_duplicates":
            out = stage(spark, docs, SF)
            assert out.count() <= 6 and (name == "byte_bpe" or out.columns == docs.columns)
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.STAGES[2][1](spark, docs, SF).where(F.col("doc_id").isNull()).count() == 3
