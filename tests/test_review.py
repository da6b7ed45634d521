"""Review of registry records on literal cases."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from leadmill.operators import review

NOW = datetime(2024, 2, 15)
SUMMARY = "struct<record_id long, cnpj string, legal_name string, match_confidence double, approvable boolean>"
LEAD = f"lead_id long, cnpj string, legal_name string, cnpj_match_status string, cnpj_match_confidence double, candidates array<{SUMMARY}>, candidate {SUMMARY}"
DECISION = "lead_id long, action string, target string, at timestamp"
A, B, C = "17247065000139", "37335118000180", "11222333000181"


def one(cnpj, name="Casa Falci Ltda", sure=0.7, ok=True, record=1):
    return (record, cnpj, name, sure, ok)


def lead(key, candidates, candidate=None, status="needs_review", cnpj=None):
    return (key, cnpj, "Antes", status, 0.3, candidates, candidate)


@pytest.mark.parametrize(
    ("many", "single", "wanted"),
    [
        (None, None, []),
        ([], one(A), [A]),
        (None, one(None), [None]),
        ([one(A), None, one(B)], None, [A, B]),
        ([one(A), one(B)], one("37.335.118/0001-80"), [A, B]),
        ([one(A)], one(B), [B, A]),
        ([one(A)], one("12"), [A]),
        ([one(None)], one(A), [A, None]),
    ],
)
def test_listed(spark, many, single, wanted):
    df = spark.createDataFrame([lead(1, many, single)], LEAD)
    assert [x["cnpj"] for x in df.select(review.listed(F.col("candidates"), F.col("candidate"))).first()[0]] == wanted


def test_reviewable_and_chosen(spark):
    df = spark.createDataFrame([lead(1, [one("12"), one(A), one(B, record=2), one(B, record=3)]), lead(2, [one(A)], status="matched"), lead(3, [])], LEAD)
    ids = lambda c: [None if r[0] is None else r[0]["record_id"] for r in df.orderBy("lead_id").select(c).collect()]
    assert ids(review.reviewable(F.col("cnpj_match_status"), F.col("candidates"))) == [1, None, None]
    assert ids(review.chosen(F.col("candidates"), F.lit("37.335.118/0001-80"))) == [2, None, None]
    assert ids(review.chosen(F.col("candidates"), F.lit(None).cast("string"))) == [1, 1, None]
    assert ids(review.chosen(F.col("candidates"), F.lit("12"))) == [None, None, None]


def test_approval_and_rejection(spark):
    leads = spark.createDataFrame(
        [lead(1, [one(A), one(B, name="  ", sure=1.7)]), lead(2, [one(A), one(B)]), lead(3, None), lead(4, [one(A, ok=False)]), lead(5, [one("12")]), lead(6, [one(A, sure=None, ok=None)]), lead(8, [one("12", ok=False)])], LEAD
    )
    said = [(1, "approve", B, NOW), (2, "reject", None, NOW), (2, "approve", None, NOW - timedelta(1)), (3, "approve", None, NOW), (4, "approve", A, NOW), (5, "approve", None, NOW), (6, "approve", None, NOW), (6, "approve", None, NOW), (7, "reject", None, NOW), (8, "reject", None, NOW)]
    done = review.reviewed(leads, spark.createDataFrame(said, DECISION), NOW)
    rows = {r["lead_id"]: r for r in done.collect()}
    assert {k: r["outcome"] for k, r in rows.items()} == {1: "approved", 2: "rejected", 3: "no_candidate", 4: "not_approvable", 5: "not_approvable", 6: "approved", 7: "no_lead", 8: "rejected"}
    values = lambda k: tuple(rows[k][c] for c in ("cnpj", "legal_name", "cnpj_match_status", "cnpj_match_confidence", "previous_status"))
    assert values(1) == (B, "Antes", "matched", 1.0, "needs_review")
    assert values(2) == (None, "Antes", "not_found", None, "needs_review")
    assert values(4) == (None, "Antes", "needs_review", 0.3, "needs_review")
    assert values(6) == (A, "Casa Falci Ltda", "matched", 0.3, "needs_review")
    assert rows[1]["candidate"]["cnpj"] == B and len(rows[1]["candidates"]) == 2 and rows[4]["candidate"] is None
    log = {r["lead_id"]: r for r in review.review_log(done, "ana").collect()}
    assert sorted(log) == [1, 2, 6, 8] and log[2]["message"] == "CNPJ candidate rejected manually." and '"approval_action":"rejected"' in log[2]["metadata"]


def test_batch(spark):
    leads = spark.createDataFrame(
        [lead(1, [one(A)]), lead(2, [one(A), one(B)]), lead(3, [one(A), one(B, ok=False)]), lead(4, [one(A, sure=0.49)]), lead(5, [one(A, sure=None)]), lead(6, []), lead(7, [one(A)], status="matched", cnpj=C), lead(8, [one(A)], one(B)), lead(9, None, one(A), status="matched")], LEAD
    )
    asked = spark.createDataFrame([(k,) for k in (*range(1, 11), 1)], "lead_id long")
    rows = {r["lead_id"]: (r["outcome"], r["cnpj"]) for r in review.batch_outcomes(leads, asked).collect()}
    none = ((2, "ambiguous"), (4, "low_confidence"), (5, "low_confidence"), (6, "no_candidate"), (7, "already_matched"), (8, "ambiguous"), (10, "no_lead"))
    assert rows == {1: ("approved", A), 3: ("approved", A), 9: ("approved", A), **{k: (o, None) for k, o in none}}
    assert review.batch_outcomes(leads.limit(0), asked.limit(0)).count() == 0


COMPARED = (
    "record_id long, lead_id long, candidate_pos int, cnpj string, full_cnpj boolean, person_like boolean, same_domain boolean, same_phone boolean, same_area boolean, alias_match string, legal_match string, brand_in_legal string, "
    "brand_in_alias boolean, same_street boolean, number_match string, same_postal boolean, same_neighborhood boolean, city_match string, state_match string, same_activity boolean"
)


def compared(record, lead_id, pos, cnpj=A, full=True, person=False, domain=False, alias="none", postal=False, city="missing", state="missing"):
    return (record, lead_id, pos, cnpj, full, person, domain, False, False, alias, "none", "none", False, False, "missing", postal, False, city, state, False)


def test_summaries(spark):
    here = {"city": "equal", "state": "equal"}
    rows = [
        compared(1, 1, 0, alias="equal", **here), compared(2, 1, 1, alias="equal", person=True, **here), compared(3, 1, 2, cnpj="12", alias="equal", **here),  # 50 each; the last has no id
        compared(4, 2, 0, domain=True, postal=True, **here), compared(5, 2, 1, domain=True, alias="equal", **here), compared(6, 2, 2, domain=True, state="equal"),  # 90, 90, 50: two strong ones
        compared(7, 3, 0, domain=True, postal=True, alias="equal", city="different"), compared(8, 4, 0, full=False, domain=True, postal=True),
        *[compared(10 + k, 5, k, domain=True, **here) for k in range(7)],
    ]
    facts = spark.createDataFrame([(r[0], *["x"] * len(review.FACTS)) for r in rows], "record_id long, " + ", ".join(f"{c} string" for c in review.FACTS))
    found = {r["lead_id"]: r["candidates"] for r in review.summaries(spark.createDataFrame(rows, COMPARED), facts).collect()}
    ids = {k: [x["record_id"] for x in v] for k, v in found.items()}
    assert ids == {1: [1, 2], 2: [4, 5], 4: [8], 5: [10, 11, 12, 13, 14]}
    first, person = found[1]
    assert (first["match_confidence"], first["candidate_count"], first["evidence"], first["blocked_reason"], first["approvable"], first["legal_name_note"]) == (0.5, 3, ["city", "state"], review.BELOW, True, None)
    assert person["legal_name_note"] == review.PERSON_NOTE and first["review_reason"] == review.REASONS[review.BELOW]
    assert {x["blocked_reason"] for x in found[2]} == {review.AMBIGUOUS} and found[2][0]["evidence"] == ["domain_or_email", "postal_code", "city", "state"]
    assert not found[4][0]["approvable"] and found[5][0]["candidate_count"] == 7
