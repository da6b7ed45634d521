"""Merged previews: items are worked out over all tasks, and a text that is alone is not made plain for the fold."""

from contextlib import redirect_stdout
from io import StringIO

from pyspark.sql import functions as F

from leadmill.operators.folds import folded, richer_of
from leadmill.plans import merge_queries

SF = "/root/testdata/sf0.001"


def plan_of(df):
    with redirect_stdout(StringIO()) as told:
        df.explain()
    return told.getvalue()


def test_items_are_dealt(spark):
    assert "RoundRobinPartitioning" in plan_of(merge_queries._items(spark, SF))


def test_texts_alone_pass_the_fold(spark):
    rows = spark.createDataFrame([(1, 1, "Casa", None), (1, 2, "CASA Longa", "x"), (1, 3, "Casa", None), (2, 1, " Só ", ""), (3, 1, None, None), (4, 1, "b", "y"), (4, 2, "a", "y")], "g long, place long, name string, city string")
    out = folded(rows, "g", F.col("place"), ["name", "city"], richer_of)
    assert sorted(map(tuple, out.collect())) == [(1, "CASA Longa", "x"), (2, "Só", None), (4, "b", "y")]
    assert "isnotnull(before" in plan_of(out) or "isnull(before" in plan_of(out)
