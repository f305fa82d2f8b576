"""Rows of nulls alone pass every operator on documents."""

import public_tokenizers as P
from pyspark.sql import functions as F

import corpus_pipeline
from folioflow.llm import op1_quality, op2_bpe, op3_simhash, op4_suffixes, op5_urls, op6_hnsw, op7_packing, op10_toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_null_rows(spark):
    docs = spark.createDataFrame([(None,) * 5, (None,) * 5, (1, "a b c d e", "en", "s", 9)], DOCS)
    labels = spark.createDataFrame([(None, None, None), (1, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert op1_quality.judge_quality(docs, labels).count() == 3
    assert op2_bpe.encode_documents(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 3
    assert op3_simhash.near_duplicates(docs).count() == 3
    assert op4_suffixes.dedup_suffixes(docs).count() == 3
    assert op7_packing.pack_documents(docs, P.path("word_bpe_49k.json")).agg(F.sum("length")).first()[0] == 8
    assert op10_toxicity.judge_toxicity(docs, labels).count() == 3
    pages = spark.createDataFrame([(None, None)], "page_id long, url string")
    assert op5_urls.judge_urls(pages, op5_urls.trained(spark)).count() == 1
    vectors = spark.createDataFrame([(None, None, None), (None, [1.0], 1), (2, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert op6_hnsw.near_duplicates(vectors).count() == 3
    assert corpus_pipeline.simhash_dedup(spark, docs, "").count() == 3
