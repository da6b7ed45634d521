"""Queries of assignment, of its report, and of the lists and lookups around leads."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadmill.functions import text
from leadmill.operators import assignment, filters, importing, matching, reports, rules, scoring
from leadmill.operators.filters import LeadFilters
from leadmill.plans.lead_queries import _N1, _PAIRS, IDS, ORACLE_SQL, QUERIES, add, leads_query
from leadmill.sources.domain import oracle, table


def _taxonomy(s, d):
    return table(s, d, "taxonomy").withColumn("keywords", F.split("keywords", r"\|"))


def _suggested(s, d):
    return assignment.suggestions(table(s, d, "leads"), table(s, d, "sales_regions"), _taxonomy(s, d), table(s, d, "assignment_rules"))


_W8 = f"""kw AS (SELECT subsegment_id, segment_id, name, sort_order, k.place, k.keyword, {_N1('k.keyword')} AS pattern FROM taxonomy, unnest(string_split(keywords, '|')) WITH ORDINALITY AS k(keyword, place)),
lt AS (SELECT lead_id, {_N1("concat_ws(' ', business_name, normalized_business_name, category, website, domain)")} AS text FROM leads),
seg AS (SELECT lead_id, subsegment_id, segment_id, name AS subsegment, string_agg(keyword, '|' ORDER BY place) AS keywords, sort_order FROM lt JOIN kw ON contains(text, pattern) GROUP BY lead_id, subsegment_id, segment_id, name, sort_order
  QUALIFY row_number() OVER (PARTITION BY lead_id ORDER BY sort_order, name, subsegment_id) = 1)"""
add("w8_subsegment", lambda s, d: assignment.matching_subsegment(table(s, d, "leads"), _taxonomy(s, d)).withColumn("keywords", F.array_join("keywords", "|")))
ORACLE_SQL["w8_subsegment"] = oracle("", "leads", "taxonomy").rstrip() + ",\n" + _W8 + " SELECT lead_id, subsegment_id, segment_id, subsegment, keywords FROM seg"
_E8 = _W8 + ",\nreg AS (SELECT lead_id, region_id FROM (" + ORACLE_SQL["e8_region"].split("\nSELECT lead_id, region_id, step", 1)[1].join(["SELECT lead_id, region_id, step", ""]) + """)),
pl AS (SELECT l.lead_id, region_id AS sales_region_id, segment_id AS market_segment_id, subsegment_id AS market_subsegment_id, subsegment, keywords FROM leads l LEFT JOIN reg ON l.lead_id = reg.lead_id LEFT JOIN seg ON l.lead_id = seg.lead_id),
ru AS (SELECT lead_id, rule_id, sales_rep_id FROM pl JOIN assignment_rules r ON (r.region_id IS NULL OR r.region_id = sales_region_id) AND (r.segment_id IS NULL OR r.segment_id = market_segment_id)
  AND (r.subsegment_id IS NULL OR r.subsegment_id = market_subsegment_id) QUALIFY row_number() OVER (PARTITION BY lead_id ORDER BY priority, rule_id) = 1),
sg AS (SELECT pl.*, rule_id, sales_rep_id FROM pl LEFT JOIN ru ON pl.lead_id = ru.lead_id)"""
_E8 = oracle("", "leads", "taxonomy", "sales_regions", "assignment_rules").rstrip() + ",\n" + _E8
_SUGGESTED = ("lead_id", "sales_region_id", "market_segment_id", "market_subsegment_id", "rule_id", "sales_rep_id")
add("e8_suggestion", lambda s, d: _suggested(s, d).select(*_SUGGESTED))
ORACLE_SQL["e8_suggestion"] = _E8 + f" SELECT {', '.join(_SUGGESTED)} FROM sg"
_BROAD = "(SELECT string_agg(DISTINCT k, '|' ORDER BY k) FROM unnest(string_split(coalesce(keywords, ''), '|')) u(w), (SELECT " + _N1("w") + f" AS k) WHERE k IN ({', '.join(repr(k) for k in assignment.BROAD_KEYWORDS)}))"
_E9 = _E8 + f""",
rr AS (SELECT l.lead_id, l.assigned_sales_rep_id, l.sales_region_id, l.market_segment_id, l.market_subsegment_id, CASE WHEN l.assigned_sales_rep_id IS NOT NULL THEN NULL WHEN sg.sales_rep_id IS NOT NULL THEN 'assignment_available_not_committed'
  WHEN l.sales_region_id IS NULL THEN CASE WHEN {_N1('city')} = 'sao paulo' THEN 'sao_paulo_missing_zone_signal' ELSE 'no_sales_region_matched' END WHEN l.market_subsegment_id IS NULL THEN 'no_market_subsegment_matched'
  WHEN l.market_segment_id IS NOT NULL THEN 'no_assignment_rule_matched' ELSE 'unassigned_unknown' END AS unassigned_reason, coalesce('broad_keyword:' || {_BROAD}, '') AS suspicious FROM leads l JOIN sg ON l.lead_id = sg.lead_id)"""
_rows = lambda s, d: assignment.report_rows(table(s, d, "leads"), _suggested(s, d))
add("e9_report_rows", _rows)
ORACLE_SQL["e9_report_rows"] = _E9 + " SELECT * FROM rr"
add("a9_report", lambda s, d: assignment.report(_rows(s, d)))
ORACLE_SQL["a9_report"] = _E9 + " SELECT count(*) AS processed, count(assigned_sales_rep_id) AS assigned, count(*) - count(assigned_sales_rep_id) AS unassigned, round(count(assigned_sales_rep_id) * 100 / count(*), 2) AS assignment_rate, count(*) FILTER (suspicious <> '') AS suspicious FROM rr"
add("a9_unassigned_reasons", lambda s, d: assignment.reason_counts(_rows(s, d)))
ORACLE_SQL["a9_unassigned_reasons"] = _E9 + " SELECT unassigned_reason, count(*) AS leads FROM rr WHERE unassigned_reason IS NOT NULL GROUP BY unassigned_reason"

_E7 = ORACLE_SQL["e7_exclusion"]
add("a14_exclusion_summary", lambda s, d: assignment.transitions(rules.apply_exclusion(table(s, d, "leads"), table(s, d, "exclusion_rules"))))
_HEAD, _BODY = _E7.split("\nSELECT l.lead_id", 1)
ORACLE_SQL["a14_exclusion_summary"] = f"{_HEAD},\nap AS (SELECT l.lead_id{_BODY}) SELECT count(*) AS evaluated, count(*) FILTER (changed AND blocked_now) AS blocked, count(*) FILTER (changed AND NOT blocked_now) AS unblocked, count(*) FILTER (NOT changed) AS unchanged FROM ap"
leads_query("a1_filtered_count", lambda df: reports.count_with(df, LeadFilters(city="nation_1%", score_min=30, search="loja")), "SELECT count(*) AS leads FROM leads WHERE NOT is_blocked AND city ILIKE 'nation_1%' AND lead_score >= 30 AND (" + " OR ".join(f"coalesce({c} ILIKE '%loja%', false)" for c in filters.SEARCHED) + ")")
leads_query("r33_filter_options", reports.filter_options, " UNION ALL ".join(f"SELECT '{c}' AS field, {c} AS value, count(*) AS leads FROM leads WHERE NOT is_blocked AND coalesce({c}, '') <> '' GROUP BY {c}" for c in ("city", "state", "category", "status")))
leads_query("a10_top_categories", lambda df: reports.most_common(df.groupBy("city").agg(F.count("*").alias("leads")), "city", "leads"), "SELECT city, count(*) AS leads FROM leads GROUP BY city ORDER BY leads DESC, city LIMIT 5")
_ASKED = [9, 3, 44, 3, 101, 7, 99999999]
leads_query("src2_by_ids", lambda df: filters.by_ids(df, _ASKED).select(*IDS.split(", ")), f"SELECT {IDS} FROM leads WHERE lead_id IN (9, 3, 44, 101, 7)")
leads_query("src3_export_by_ids", lambda df: filters.by_ids(df, _ASKED, "exclude", True).select(*IDS.split(", ")), f"SELECT {IDS} FROM leads WHERE NOT is_blocked AND lead_id IN (9, 3, 44, 101, 7)")
add("j3_raw_history", lambda s, d: reports.raw_history(table(s, d, "raw_records"), table(s, d, "leads")), "SELECT lead_id, raw_id, batch_id, CAST(row_number() OVER (PARTITION BY lead_id ORDER BY created_at, raw_id) AS INT) AS place FROM raw_records WHERE lead_id IN (SELECT lead_id FROM leads)", "raw_records", "leads")
add("j1_batches_with_leads", lambda s, d: reports.batches_with_leads(table(s, d, "batches"), table(s, d, "raw_records"), table(s, d, "leads")).select("batch_id", "completed_at"), "SELECT batch_id, completed_at FROM batches WHERE status = 'completed' AND batch_id IN (SELECT batch_id FROM raw_records WHERE lead_id IN (SELECT lead_id FROM leads))", "batches", "raw_records", "leads")
add("o5_pairs_in_order", lambda s, d: filters.page(matching.duplicate_pairs(table(s, d, "leads")).orderBy(*matching.pair_order()), 200))
ORACLE_SQL["o5_pairs_in_order"] = oracle("", "leads").rstrip() + ",\n" + _PAIRS + " SELECT lead_a, lead_b, mask, CAST(confidence AS DOUBLE) AS confidence FROM q ORDER BY confidence DESC, bit_count(mask) DESC, lead_a, lead_b LIMIT 200"
# business kinds that reach every trade and the large chains
_KINDS = ("Loja online", "Distribuidora de peças", "Atacado", "Fábrica", "Boutique", "Consultório", "Hipermercado", "Carrefour")
_KIND = "CASE lead_id % 8 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS)) + " END"
_WORD = lambda ws: "(" + " OR ".join(f"contains(' ' || t || ' ', ' {w} ')" for w in ws) + ")"
_TRADE = f"SELECT *, CASE {' '.join(f'WHEN {_WORD(ws)} THEN {n!r}' for n, ws in scoring.TRADES)} ELSE 'unknown' END AS trade FROM (SELECT *, {_N1(f"concat_ws(' ', business_name, {_KIND}, domain)")} AS t, " + " + ".join(f"CAST(coalesce({c}, '') <> '' AS INT)" for c in ("email", "phone", "whatsapp")) + " + CAST(coalesce(website, '') <> '' OR coalesce(domain, '') <> '' AS INT) AS c FROM leads)"
_SIZE = f"CASE WHEN {_WORD(scoring.LARGE_CHAINS)} OR {_WORD(scoring.LARGE_CATEGORIES)} THEN 'large_enterprise' WHEN c >= 2 THEN 'ideal_sme' WHEN (market_segment_id IS NOT NULL OR market_subsegment_id IS NOT NULL) AND c >= 1 THEN 'ideal_sme' ELSE 'possible_sme' END"
leads_query("e11_trades_of_kinds", lambda df: scoring.classify(df.withColumn("category", F.expr(_KIND))), f"SELECT lead_id, {_SIZE} AS size_fit, trade FROM ({_TRADE})")
leads_query("m10_applied_quality", lambda df: importing.applied_quality(df, scoring.classify(df.withColumn("category", F.expr(_KIND)))), f"SELECT lead_id, CASE WHEN company_size_fit = 'unknown' THEN {_SIZE} ELSE company_size_fit END AS company_size_fit, CASE WHEN trade_type = 'unknown' THEN trade ELSE trade_type END AS trade_type FROM ({_TRADE})")
leads_query("m13_job_keys", lambda df: df.select("lead_id", importing.job_key("enrich", F.col("lead_id"), F.col("city")).alias("key")), "SELECT lead_id, 'enrich:' || substr(sha256('{\"lead_id\":' || CAST(lead_id AS VARCHAR) || ',\"city\":\"' || city || '\"}'), 1, 32) AS key FROM leads")
leads_query("n35_json_signature", lambda df: df.select("lead_id", text.signature(F.col("city"), F.col("lead_id")).alias("signature")), "SELECT lead_id, sha256('{\"city\":\"' || city || '\",\"lead_id\":' || CAST(lead_id AS VARCHAR) || '}') AS signature FROM leads")
leads_query("m7_updated_leads", lambda df: assignment.updated(df, df.where("lead_id % 4 < 2").select("lead_id", F.when(F.col("lead_id") % 8 == 0, "do_not_contact").when(F.col("lead_id") % 8 == 1, "reviewed").alias("status"), F.when(F.col("lead_id") % 3 == 0, F.col("updated_at").cast("date")).alias("follow_up_date"), F.when(F.col("lead_id") % 5 == 0, F.col("lead_id") % 2 == 0).alias("do_not_contact"))), """
SELECT lead_id, s AS status, f AS follow_up_date, n AS do_not_contact, concat_ws('|', CASE WHEN s IS DISTINCT FROM status THEN 'status' END, CASE WHEN f IS DISTINCT FROM follow_up_date THEN 'follow_up_date' END, CASE WHEN n IS DISTINCT FROM do_not_contact THEN 'do_not_contact' END) AS changed FROM (
SELECT *, CASE WHEN d THEN 'do_not_contact' WHEN NOT n AND coalesce(w, status) = 'do_not_contact' THEN 'reviewed' ELSE coalesce(w, status) END AS s FROM (
SELECT *, CASE WHEN w = 'do_not_contact' THEN true ELSE coalesce(d, do_not_contact) END AS n FROM (
SELECT *, CASE WHEN lead_id % 8 = 0 THEN 'do_not_contact' WHEN lead_id % 8 = 1 THEN 'reviewed' END AS w, CASE WHEN lead_id % 4 < 2 AND lead_id % 5 = 0 THEN lead_id % 2 = 0 END AS d,
  CASE WHEN lead_id % 4 < 2 AND lead_id % 3 = 0 THEN CAST(updated_at AS DATE) ELSE follow_up_date END AS f FROM leads)))""")
__all__ = ["ORACLE_SQL", "QUERIES"]
