"""Registry ids of leads: the check of an id is made for leads alone, records of other ids go before they are grouped."""

from contextlib import redirect_stdout
from io import StringIO

from leadmill.operators.registry_search import known_id_outcome

VALID, OTHER, WRONG = "11222333000181", "00000000000191", "11222333000180"


def test_records_are_not_checked(spark):
    leads = spark.createDataFrame([(1, VALID), (2, OTHER), (3, WRONG), (4, None), (5, VALID)], "lead_id long, cnpj string")
    records = spark.createDataFrame([(10, VALID, 2), (11, VALID, 1), (12, VALID, 1), (13, WRONG, 1), (14, "x", 1), (15, None, 1)], "record_id long, cnpj string, candidate_pos int")
    out = known_id_outcome(leads, records)
    assert sorted(map(tuple, out.collect())) == [(1, 11, "matched", 1.0), (2, None, "not_found", 0.0), (5, 11, "matched", 1.0)]
    with redirect_stdout(StringIO()) as told:
        out.explain()
    assert "RLIKE" not in told.getvalue()
