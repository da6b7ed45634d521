"""Toxicity: held-out accuracy on given tables, the noisy-or and its descent against plain arithmetic, odd rows."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadmill.llm import toxicity

SF = "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, score string, row string, told string, whole string"


def docs_of(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in zip(ids or range(len(texts)), texts, strict=False)], SCHEMA)


def labelled(n, seed):
    """Clean sentences, and in every fifth text one that holds a bad word or a made-up word with a bad beginning."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 7)))
    texts, toxic = [], []
    for k in range(n):
        lines = [" ".join(word() for _ in range(8)).capitalize() + "." for _ in range(r.randint(1, 9))]
        if k % 5 == 0:
            lines.insert(r.randint(0, len(lines)), f"{word()} {r.choice(['zunk', 'Zorrible', 'zyx' + word()])}, {word()}!")
        texts.append(r.choice([" ", "\n"]).join(lines))
        toxic.append(int(k % 5 == 0))
    return texts, toxic


@pytest.fixture(scope="module")
def model(spark):
    texts, toxic = labelled(600, 1)
    return toxicity.train(docs_of(spark, texts), spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int"))


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.score(docs, toxicity.train(docs, labels), keep_text=False)
    told = found.join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").groupBy("toxic").agg(F.avg("predicted").alias("p"), F.count("*").alias("n")).collect()
    share = {r["toxic"]: r["p"] for r in told}
    assert share[1] >= 0.85 and share[0] <= 0.02, share
    assert found.count() == docs.count()


def test_sentences_are_found_by_labels_of_documents(spark, model):
    texts, toxic = labelled(300, 2)
    docs = docs_of(spark, texts)
    found = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    right = sum(found[k]["predicted"] == y for k, y in enumerate(toxic))
    assert right >= 0.97 * len(texts)
    for r in toxicity.offending_sentences(docs, model).collect():
        assert "z" in r["sentence"].lower() and texts[r["doc_id"]][r["start"] : r["end"]] == r["sentence"]
        assert r["sentence_score"] >= 0.5 and found[r["doc_id"]]["predicted"] == 1
    assert sum(r["n_offending"] for r in found.values()) >= 0.95 * sum(toxic)


def test_noisy_or_by_plain_arithmetic(model):
    scorer = toxicity.Scorer(*model.plain())
    text = "Some zunk here. Nothing!\nA zorrible thing, zunk? And more"
    one = lambda cues: 1 / (1 + math.exp(-model.bias - sum(model.weights[c] for c in cues))) if cues else 0.0
    spared = 1 - model.leak
    for part in ("Some zunk here.", " Nothing!\n", "A zorrible thing, zunk?", " And more"):
        spared *= 1 - one({model.cues[p] for w in toxicity.WORDS.findall(part.lower()) for p in toxicity.parts_of(w) if p in model.cues})
    assert scorer.text(text)[0] == pytest.approx(1 - spared, abs=1e-12)
    assert scorer.text(text)[1] == 4
    # length alone is not toxic
    assert scorer.text("Nothing here. " * 200_000)[0] == pytest.approx(model.leak)


def test_descent_reaches_a_minimum():
    r = random.Random(4)
    bags = [(int(r.random() < 0.5), [sorted(r.sample(range(6), r.randint(1, 3))) for _ in range(r.randint(0, 4))]) for _ in range(200)]
    w, bias, leak = toxicity.fit(bags, 6, rounds=3000, rate=0.02)

    def loss(w, bias, hazard):
        total = 0.0
        for y, sentences in bags:
            s = hazard + sum(math.log1p(math.exp(bias + sum(w[c] for c in x))) for x in sentences)
            total += -math.log(-math.expm1(-s)) if y else s
        return (total + 1e-3 * sum(x * x for x in w) / 2) / len(bags)

    hazard = -math.log1p(-leak)
    least = loss(w, bias, hazard)
    for k in range(6):
        for d in (-0.05, 0.05):
            assert loss(w + d * (np.arange(6) == k), bias, hazard) >= least - 1e-7
    assert loss(w, bias + 0.05, hazard) >= least - 1e-7 and loss(w, bias, hazard * 1.1) >= least - 1e-7


def test_odd_rows(spark, model):
    texts = [None, "", " \n", "...", "zunk", "ZUNK!", "x" * 100_000, "zunk " * 50_000, "ß ü 12 \x00", None]
    ids = [0, 1, 2, 3, 4, 5, None, 7, 7, 2**60]
    docs = docs_of(spark, texts, ids)
    found = toxicity.score(docs, model, keep_text=False)
    assert found.columns == ["doc_id", "row", "told", "whole", *toxicity.RESULT]
    rows = found.collect()
    assert len(rows) == 10
    for r in rows:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["score"] == by[1]["score"] == pytest.approx(model.leak) and by[0]["n_sentences"] == 0 and by[4]["predicted"] == by[5]["predicted"] == 1
    assert toxicity.score(docs_of(spark, []), model).count() == 0


def test_labels_of_one_kind_none_and_repeated(spark):
    docs = docs_of(spark, ["a", "b"] * 20)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.train(docs, none).leak == 0.5
    assert toxicity.train(docs, spark.createDataFrame([(k, 0) for k in range(40)], "doc_id long, toxic int")).leak == 0.0
    assert {r["score"] for r in toxicity.score(docs, toxicity.train(docs, spark.createDataFrame([(k, 1) for k in range(40)], "doc_id long, toxic int"))).collect()} <= {1.0, 1 - 1e-12}
    mixed = spark.createDataFrame([(None, 1), (3, None), *[(k, y) for k in range(40) for y in (0, 1)]], "doc_id long, toxic int")
    assert toxicity.train(docs, mixed).leak == 1.0


def test_held_out_labels_train_nothing(spark):
    texts, toxic = labelled(200, 3)
    labels = [(k, y) for k, y in enumerate(toxic)]
    turned = [(k, 1 - y if zlib.crc32(str(k).encode()) % 5 == 0 else y) for k, y in labels]
    a, b = (toxicity.train(docs_of(spark, texts), spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, turned))
    assert a.cues == b.cues and np.array_equal(a.weights, b.weights) and a.leak == b.leak
