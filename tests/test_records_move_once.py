"""Review of registry records: records move once, all that is done by lead stays there, and written tables leave no shuffle files."""

import time

from leadmill.operators import linkage, review
from leadmill.operators.shared import CLEANUP, materialise
from leadmill.plans import review_queries
from leadmill.sources.domain import table
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_records_move_once(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("r13_candidate_summaries", "m11_reviews", "m11_batch_outcomes"):
            plan = review_queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
            moved = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
            assert sum("REPARTITION_BY_COL" in x and "lead_id" in x for x in moved) == 1
            assert not any("(record_id" in x for x in moved)
            assert "l_linenumber" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_summaries_with_facts_beside_and_looked_up(spark):
    leads, records = table(spark, SF, "leads"), linkage.kept_records(table(spark, SF, "registry"))
    beside = review.summaries(linkage.compared_kept(leads, records, review.FACTS))
    looked_up = review.summaries(linkage.compared_kept(leads, records), records)
    assert beside.schema == looked_up.schema
    rows = [sorted(x.select("lead_id", F.to_json("candidates")).collect()) for x in (beside, looked_up)]
    assert rows[0] == rows[1] and rows[0]


def test_written_tables_leave_no_shuffle_files(spark):
    held = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    set_before, files = spark.conf.get(CLEANUP), held()
    tables = [materialise(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts") for _ in range(3)]
    for _ in range(50):
        if held() <= files:
            break
        time.sleep(0.2)
    assert held() <= files and spark.conf.get(CLEANUP) == set_before
    assert [t.count() for t in tables] == [7, 7, 7]


def test_records_of_reviews_are_made_once(spark):
    for name in ("m11_reviews", "m11_batch_outcomes"):
        plan = review_queries.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "l_orderkey" not in plan
