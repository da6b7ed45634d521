"""Texts are worked out once and in all tasks, whatever file they come from."""

from leadmill.functions.text import blank_to_null, domain_of, normalize_text
from leadmill.operators.activities import activity_hint
from leadmill.operators.linkage import person_like
from leadmill.operators.name_variants import of_names
from leadmill.sources.domain import table
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_a_text_is_worked_out_once(spark):
    for f in (blank_to_null, normalize_text, domain_of, activity_hint, lambda c: normalize_text(normalize_text(c))):
        assert str(f(F.col("told"))).count("told") == 1


def test_rows_of_one_row_group_are_dealt(spark):
    for name in ("leads", "contacts"):
        assert table(spark, SF, name).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_names_are_dealt(spark):
    rows = spark.createDataFrame([(f"Nome {k}", "x") for k in range(40)], "business_name string, category string")
    used = of_names(rows).select(F.spark_partition_id().alias("p")).distinct().count()
    assert used == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_folding_of_ascii_and_other_texts(spark):
    rows = spark.createDataFrame([("  A--b ",), ("\u00c9t\u00e9 n\u00ba 5",), ("",), (None,), ("!!",), ("\u6f22 x",)], "c string")
    assert [r[0] for r in rows.select(normalize_text(F.col("c"))).collect()] == ["a b", "ete no 5", None, None, None, "x"]


def test_persons(spark):
    names = ["maria da silva", "maria", "jose oficina me", "a b c d e f", "joao s a lima", "loja 5", None]
    rows = spark.createDataFrame([(x,) for x in names], "c string")
    assert [r[0] for r in rows.select(person_like(F.col("c"))).collect()] == [True, False, False, False, True, False, False]
