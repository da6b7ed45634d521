"""Texts aren't shuffled beside few lines or rows that go."""

from leadmill.llm import lines, similar


def test_texts_stay_in_place(spark):
    notice = "This notice stands in every one of these documents"
    rows = [(i, f"{c * 5} {c * 4} {c * 6}\n{notice}") for i, c in enumerate("abcdefghij")]
    docs = spark.createDataFrame([*rows, (10, rows[0][1])], "doc_id long, text string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cut, kept = lines.drop_recurring(docs), similar.representatives(docs)
        assert "Exchange hashpartitioning" not in cut._jdf.queryExecution().executedPlan().toString()
        assert {r["doc_id"]: notice in r["text"] for r in cut.collect()} == {i: False for i in range(11)}
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert sorted(r["doc_id"] for r in kept.collect()) == list(range(10))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
