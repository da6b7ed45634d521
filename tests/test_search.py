"""Searches over related names, measured broadcasts and containment in both ways, on literal cases."""

import pytest
from pyspark.sql import functions as F

from leadmill.operators import containment, filters, rules, shared
from leadmill.operators.filters import LeadFilters
from leadmill.sources.domain import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def leads(spark):
    plain = table(spark, SF, "leads").where("lead_id BETWEEN 1 AND 4").drop(*filters.SEARCHED, *[own for own, _ in filters.RELATED.values()], "is_blocked")
    return plain.select(
        "*", *[(F.when(F.col("lead_id") == 4, "ANA Ltda") if c == "legal_name" else F.lit(None).cast("string")).alias(c) for c in filters.SEARCHED],
        F.when(F.col("lead_id") < 3, F.col("lead_id")).alias("sales_region_id"), F.lit(7).alias("market_segment_id"), F.lit(None).cast("long").alias("market_subsegment_id"), F.col("lead_id").alias("assigned_sales_rep_id"), F.lit(False).alias("is_blocked"),
    )


def related(spark, reps):
    named = lambda key, rows: spark.createDataFrame(rows, f"{key} long, name string")
    return {"sales_regions": named("region_id", [(1, "Sul"), (2, None)]), "market_segments": named("segment_id", [(7, "Lojas"), (None, "ana")]), "market_subsegments": named("subsegment_id", []), "sales_reps": named("sales_rep_id", reps)}


@pytest.mark.parametrize(("term", "found"), [("ana", [2, 3, 4]), (" SUL ", [1]), ("loja", [1, 2, 3, 4]), ("nobody", []), ("%", [1, 2, 3, 4])])
def test_search_over_related_names(spark, leads, term, found):
    tables = related(spark, [(3, "Mariana"), (3, "Ana"), (2, "ana"), (9, "Ana"), (None, "Ana"), (1, "")])
    rows = filters.filtered(leads, LeadFilters(search=term), tables)
    assert rows.columns == leads.columns
    assert sorted(r["lead_id"] for r in rows.collect()) == found


def test_without_related_tables_only_own_columns(spark, leads):
    assert [r["lead_id"] for r in filters.filtered(leads, LeadFilters(search="ana")).collect()] == [4]
    assert filters.filtered(leads, LeadFilters(search="  "), related(spark, [])).count() == 4


def test_measured(spark):
    df = spark.range(10).selectExpr("id", "repeat('x', 100) AS t", "CAST(NULL AS STRING) AS n")
    plan = lambda d: spark.range(5).join(d, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(shared.measured(df)) and "broadcast" not in plan(shared.measured(df, 1000))
    assert "broadcast" in plan(shared.measured(df.where("id + length(t) < 0"), 0))


@pytest.mark.parametrize("few", [256, 0])
def test_containment_in_one_pass_or_by_runs(spark, monkeypatch, few):
    monkeypatch.setattr(containment, "FEW", few)
    texts = spark.createDataFrame([(1, "oficina sao jose"), (1, "oficina sao jose"), (2, None), (3, ""), (4, "a"), (5, "padaria jose")], "k long, t string")
    patterns = spark.createDataFrame([("jose",), ("jose",), ("a",), (None,), ("",), ("sao jose",), ("none",)], "p string")
    found = sorted((r["k"], r["pattern"]) for r in containment.with_contained(texts, "t", patterns, "p").collect())
    assert found == sorted([(1, p) for p in ("jose", "a", "sao jose")] * 2 + [(4, "a"), (5, "a"), (5, "jose")])
    assert containment.with_contained(texts, "t", patterns.where("false"), "p").count() == 0


def test_exclusion_reads_the_website_too(spark):
    leads = spark.createDataFrame([(1, "x", None, "other.com", "https://www.shop.acme.com/a"), (2, "y", None, None, None), (3, "z", None, "acme.com", "https://acme.com")], "lead_id long, business_name string, category string, domain string, website string").withColumn("normalized_business_name", F.col("business_name"))
    found = rules.exclusion_matches(leads, spark.createDataFrame([(5, "domain", "acme.com"), (6, "domain", "shop.acme.com")], "rule_id long, rule_type string, normalized_pattern string"))
    assert sorted(map(tuple, found.collect())) == [(1, 5), (3, 5)]
