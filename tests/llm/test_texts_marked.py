"""op8: texts without repeats stay in their place; a bitmap of documents never loses one."""

from pyspark.sql import functions as F

from leadmill.llm import substrings


def test_marks_hold_all_documents(spark):
    rows = spark.range(3000).select(F.xxhash64("id").alias("g"), "id")
    marks = substrings._marks(rows.where("id % 10 = 0").withColumnRenamed("g", "g2"))
    may, not_ = ({r.id for r in substrings._marked(rows, marks, wanted).collect()} for wanted in (True, False))
    assert may >= set(range(0, 3000, 10)) and len(may) < 310
    assert not may & not_ and may | not_ == set(range(3000))


def test_documents_without_marks(spark):
    marks = substrings._marks(spark.createDataFrame([], "g2 long"))
    assert substrings._marked(spark.createDataFrame([(5,)], "g long"), marks, False).count() == 1


def test_texts_without_repeats_are_not_shuffled(spark):
    # small tables are joined without a shuffle anyway, so that is turned off
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        check_texts_stay(spark)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def check_texts_stay(spark):
    texts = [(n, " ".join(f"{n}a{k}" for k in range(2000))) for n in range(40)]
    texts += [(100, " ".join(f"c{k}" for k in range(40))), (101, "x " + " ".join(f"c{k}" for k in range(40)))]
    out = substrings.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string"))
    rows = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in out.collect()}
    assert rows == {n: (2000, 0, t) for n, t in texts[:40]} | {100: (40, 40, ""), 101: (41, 40, "x")}
    nodes, moved = [out._jdf.queryExecution().executedPlan()], 0
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
        elif node.nodeName() in ("ShuffleQueryStage", "BroadcastQueryStage", "ResultQueryStage"):
            nodes.append(node.plan())
        else:
            if node.nodeName() == "Exchange":
                moved += node.metrics().apply("dataSize").value()
            nodes += [node.children().apply(k) for k in range(node.children().size())]
    assert moved < 100_000
