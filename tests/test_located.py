"""Addresses of linkage are taken apart once each, whatever places and postal codes stand beside them."""

from leadmill.functions.address import split_address
from leadmill.functions.text import normalize_text
from leadmill.operators import linkage
from leadmill.plans import review_queries
from pyspark.sql import functions as F

FIELDS = ("address", "neighborhood", "city", "state", "postal")
LINES = [
    "Rua Peru, 5, Lima", "Rua Peru, 5, LIMA - SP", "Rua Peru 5,  Sao   Paulo , sp", "Endereço: Rua A, 10, Centro, São Paulo, Brasil", "Av. Central, 10 - 13000-000", "Rua B, 7, 123-A",
    "Lima", "Al. Santos, 3, SE", "Rua C\t9, Vila\tNova", "", " , ", "Rua Ünsal, s/n, İzmir", "Rua D, 4, São Paulo", "Rua E, 12/b, Bahia, BA", None,
]
PLACES = [
    (None, None, None, None), ("Centro", "Lima", "SP", "13000-000"), ("Vila Nova", "Sao Paulo", "São Paulo", " 123-A "), ("", " lima ", "BA", "5"), ("vila  nova", "São Paulo", "Bahia", ""), ("7", "İzmir", "sergipe", "12/b"),
]


def test_located_as_row_by_row(spark):
    rows = spark.createDataFrame([(k, x, *p) for k, (x, p) in enumerate((x, p) for x in LINES for p in PLACES)], "k long, " + ", ".join(f"{c} string" for c in FIELDS))
    for fields in (FIELDS, ("address", "", *FIELDS[2:])):
        split = split_address(*[F.col(c) if c else F.lit(None).cast("string") for c in fields])
        plain = rows.select("k", split.alias("s")).select("k", normalize_text(F.col("s.street")).alias("street"), F.col("s.number").alias("number"))
        found = linkage.located(rows, *fields)
        assert found.columns == [*rows.columns, "street", "number"]
        assert sorted(found.select("k", "street", "number").collect()) == sorted(plain.collect())


def test_places_that_an_address_does_not_name_make_no_further_address(spark, monkeypatch):
    written = {}

    def kept(df, name):
        written[name] = df.count()
        return df

    monkeypatch.setattr(linkage, "materialise", kept)
    rows = spark.createDataFrame([("Rua Peru, 5", None, f"Cidade {k}", "Bahia", f"{k:08}") for k in range(50)], ", ".join(f"{c} string" for c in FIELDS))
    assert linkage.located(rows, *FIELDS).where("street = 'rua peru' and number = '5'").count() == 50
    assert written == {"addresses": 1}


def test_records_of_summaries_are_made_once(spark):
    plan = review_queries.QUERIES["r13_candidate_summaries"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_linenumber" not in plan
