"""Queries of the review of registry records, and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadmill.operators import linkage, review
from leadmill.operators.review import AMBIGUOUS, BELOW, IDENTITY, MOST, PENALTIES, PLACES
from leadmill.plans.lead_queries import _EV, NOW
from leadmill.sources.domain import oracle, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_SHOWN = ("record_id", "cnpj", "legal_name", "trade_name", "score", "match_confidence", "candidate_count", "blocked_reason", "approvable")


def _records(s: SparkSession, d: str) -> DataFrame:
    """The records, made and written once."""
    return linkage.kept_records(table(s, d, "registry"))


def _candidates(s: SparkSession, d: str, records: DataFrame) -> DataFrame:
    """The summaries of all leads; what a summary shows stays beside what is compared."""
    return review.summaries(linkage.compared_kept(table(s, d, "leads"), records, review.FACTS))


def _leads(s: SparkSession, d: str, records: DataFrame) -> DataFrame:
    """Leads with their review state: every fifth has its last summary as its single one, every seventh only that."""
    kept = table(s, d, "leads").select("lead_id", "cnpj", "legal_name", "cnpj_match_status", F.lit(None).cast("double").alias("cnpj_match_confidence"))
    met = kept.join(_candidates(s, d, records), "lead_id", "left")
    alone = F.when(F.expr("lead_id % 5 = 0 OR lead_id % 7 = 0"), F.element_at("candidates", -1))
    return met.withColumn("candidate", alone).withColumn("candidates", F.when(F.expr("lead_id % 7 <> 0"), F.col("candidates")))


def _summaries(s: SparkSession, d: str) -> DataFrame:
    each = _candidates(s, d, _records(s, d)).select("lead_id", F.posexplode("candidates").alias("place", "x"))
    return each.select("lead_id", (F.col("place") + 1).alias("place"), *[f"x.{c}" for c in _SHOWN], *[F.array_join(f"x.{c}", "|").alias(c) for c in ("evidence", "penalties")])


def _reviews(s: SparkSession, d: str) -> DataFrame:
    """Two decisions for every lead, of which the later counts: by the id of some record, by none, or a rejection."""
    leads, records = table(s, d, "leads").select("lead_id"), _records(s, d)
    ids = records.groupBy("lead_id").agg(F.min("cnpj").alias("some"))
    asked = leads.join(ids, "lead_id", "left").select("lead_id", F.expr("CASE lead_id % 3 WHEN 2 THEN 'reject' ELSE 'approve' END").alias("action"), F.expr("CASE lead_id % 4 WHEN 1 THEN some WHEN 3 THEN '12' END").alias("target"), F.lit(NOW).alias("at"))
    before = asked.select("lead_id", F.lit("reject").alias("action"), F.lit("0").alias("target"), (F.col("at") - F.expr("INTERVAL 1 DAY")).alias("at"))
    done = review.reviewed(_leads(s, d, records), asked.unionByName(before), NOW)
    return done.select("lead_id", "outcome", "previous_status", "cnpj", "legal_name", "cnpj_match_status", "cnpj_match_confidence", F.size("candidates").alias("n_candidates"), F.col("candidate.record_id").alias("record_id"))


def _batch(s: SparkSession, d: str) -> DataFrame:
    """All leads twice, and ids that no lead has."""
    asked = table(s, d, "leads").select("lead_id")
    return review.batch_outcomes(_leads(s, d, _records(s, d)), asked.unionByName(asked).unionByName(asked.select((-1 - F.col("lead_id")).alias("lead_id"))))


_SAID = lambda names: "concat_ws('|', " + ", ".join(f"CASE WHEN {fact} THEN '{n}' END" for n, fact in names.items()) + ")"
_SUMMARIES = f""",
ranked AS (SELECT sc.*, cmp.* EXCLUDE (record_id, lead_id, candidate_pos, cnpj, full_cnpj), first(score) OVER w AS top, first(conflict) OVER w AS top_conflict, nth_value(score, 2) OVER w AS second, count(*) OVER w AS candidate_count
  FROM sc JOIN cmp ON sc.record_id = cmp.record_id WINDOW w AS (PARTITION BY sc.lead_id ORDER BY score DESC, sc.candidate_pos, sc.record_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
told AS (SELECT *, top >= 80 AND NOT top_conflict AND coalesce(top - second < 10, false) AS close FROM ranked),
kept AS (SELECT *, row_number() OVER (PARTITION BY lead_id ORDER BY score DESC, candidate_pos, record_id) AS place FROM told WHERE length(cnpj) = 14 AND NOT conflict AND CASE WHEN close THEN score >= 80 AND top - score < 10 ELSE score >= 50 END),
summ AS (SELECT k.lead_id, k.place, k.record_id, k.cnpj, r.legal_name, r.trade_name, k.score, CAST(round(least(k.score, 100) / 100.0, 2) AS DOUBLE) AS match_confidence, k.candidate_count, CASE WHEN close THEN '{AMBIGUOUS}' ELSE '{BELOW}' END AS blocked_reason,
  k.full_cnpj AND (({' AND '.join(PLACES.values())} AND (alias_match <> 'none' OR legal_match <> 'none' OR brand_in_legal <> 'none')) OR {' OR '.join(IDENTITY.values())}) AS approvable, {_SAID({**IDENTITY, **PLACES})} AS evidence, {_SAID(PENALTIES)} AS penalties
  FROM kept k JOIN registry r ON k.record_id = r.record_id WHERE place <= {MOST})"""
# the single summary is a lead's last one; where it is all there is, the list is that one
_STATE = """,
mine AS (SELECT lead_id, place, cnpj, legal_name, record_id, match_confidence, approvable, row_number() OVER (PARTITION BY lead_id ORDER BY place DESC) AS from_last FROM summ),
state AS (SELECT lead_id, CASE WHEN lead_id % 7 = 0 THEN 1 ELSE place END AS place, cnpj, legal_name, record_id, match_confidence, approvable, from_last FROM mine WHERE lead_id % 7 <> 0 OR from_last = 1)"""
_BASE = oracle("", "leads", "registry").rstrip() + ",\n" + _EV + _SUMMARIES
QUERIES["r13_candidate_summaries"] = _summaries
ORACLE_SQL["r13_candidate_summaries"] = _BASE + f" SELECT lead_id, place, {', '.join(_SHOWN)}, evidence, penalties FROM summ"
QUERIES["m11_reviews"] = _reviews
ORACLE_SQL["m11_reviews"] = _BASE + _STATE + """,
asked AS (SELECT l.*, CASE lead_id % 3 WHEN 2 THEN 'reject' ELSE 'approve' END AS action, CASE lead_id % 4 WHEN 1 THEN (SELECT min(cnpj) FROM registry r WHERE r.lead_id = l.lead_id) WHEN 3 THEN '12' END AS target FROM leads l),
pick AS (SELECT a.lead_id, first(s ORDER BY s.place) AS p FROM asked a JOIN state s ON a.lead_id = s.lead_id AND (a.target IS NULL OR a.target = s.cnpj) GROUP BY a.lead_id),
o AS (SELECT a.*, p, CASE WHEN p IS NULL THEN 'no_candidate' WHEN action = 'reject' THEN 'rejected' WHEN NOT p.approvable THEN 'not_approvable' ELSE 'approved' END AS outcome FROM asked a LEFT JOIN pick ON a.lead_id = pick.lead_id)
SELECT lead_id, outcome, cnpj_match_status AS previous_status, CASE WHEN outcome = 'approved' THEN p.cnpj ELSE cnpj END AS cnpj, CASE WHEN outcome = 'approved' THEN coalesce(p.legal_name, legal_name) ELSE legal_name END AS legal_name,
 CASE outcome WHEN 'approved' THEN 'matched' WHEN 'rejected' THEN 'not_found' ELSE cnpj_match_status END AS cnpj_match_status, CASE WHEN outcome = 'approved' THEN p.match_confidence END AS cnpj_match_confidence, (SELECT count(*) FROM state s WHERE s.lead_id = o.lead_id) AS n_candidates,
 CASE WHEN outcome IN ('approved', 'rejected') THEN p.record_id ELSE (SELECT s.record_id FROM state s WHERE s.lead_id = o.lead_id AND from_last = 1 AND (s.lead_id % 5 = 0 OR s.lead_id % 7 = 0)) END AS record_id FROM o"""
QUERIES["m11_batch_outcomes"] = _batch
ORACLE_SQL["m11_batch_outcomes"] = _BASE + _STATE + """,
n AS (SELECT lead_id, count(*) AS n, min(cnpj) AS sole, max(match_confidence) AS confidence FROM state WHERE approvable GROUP BY lead_id),
o AS (SELECT l.lead_id, sole, CASE WHEN cnpj_match_status = 'matched' AND coalesce(cnpj, '') <> '' THEN 'already_matched' WHEN n IS NULL THEN 'no_candidate' WHEN n > 1 THEN 'ambiguous' WHEN confidence < 0.5 THEN 'low_confidence' ELSE 'approved' END AS outcome FROM leads l LEFT JOIN n ON l.lead_id = n.lead_id)
SELECT lead_id, outcome, CASE WHEN outcome = 'approved' THEN sole END AS cnpj FROM o UNION ALL SELECT -1 - lead_id, 'no_lead', NULL FROM leads"""
