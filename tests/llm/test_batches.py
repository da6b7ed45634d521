"""The pipeline hands whole texts to Python in small batches."""

import corpus_pipeline
import pandas as pd


def largest_batch(rows):
    sizes = rows.mapInPandas(lambda batches: (pd.DataFrame({"n": [len(b)]}) for b in batches), "n long")
    return sizes.agg({"n": "max"}).first()[0]


def test_texts_go_to_python_in_small_batches(spark):
    before = {key: spark.conf.get(key) for key in corpus_pipeline.BATCH}
    docs = spark.createDataFrame([(1, "one two three four five six", "en", "web", 27)], "doc_id long, text string, lang string, source string, n_chars int")
    many = spark.range(20_000, numPartitions=1)
    long = many.limit(200).coalesce(1).selectExpr("repeat('x', 1 << 20) AS text")
    try:
        for stage in (corpus_pipeline.quality_rules, corpus_pipeline.simhash_neardup, corpus_pipeline.sentencepiece):
            for key, value in before.items():
                spark.conf.set(key, value)
            stage(spark, docs, "")
            assert largest_batch(many) == 1000, stage
            assert largest_batch(long) <= 8, stage
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_run_leaves_the_session_as_it_was(spark):
    before = {key: spark.conf.get(key) for key in corpus_pipeline.BATCH}
    corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {key: spark.conf.get(key) for key in before} == before
