"""Queries over the lead domain and over free texts, each beside the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadmill.functions import text
from leadmill.operators import activities, filters, linkage, matching, reports, rules, scoring
from leadmill.operators.filters import LeadFilters
from leadmill.plans.variant_queries import variant_steps
from leadmill.sources.domain import oracle, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
TODAY, NOW, BATCH = date(2024, 2, 15), datetime(2024, 2, 15), 199507


def add(name: str, query: Query, sql: str | None = None, *tables: str) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = oracle(sql, *tables) if tables else sql


def leads_query(name: str, f: Callable[[DataFrame], DataFrame], sql: str) -> None:
    add(name, lambda spark, d: f(table(spark, d, "leads")), sql, "leads")


#: The columns by which a filter's rows are compared.
IDS = "lead_id, business_name, city, lead_score"
_has = lambda c: f"coalesce({c}, '') <> ''"
_any = f"({_has('email')} OR {_has('whatsapp')} OR {_has('phone')})"
_direct = f"({_has('email')} OR {_has('whatsapp')})"


def filter_query(name: str, f: LeadFilters, where: str) -> None:
    leads_query(name, lambda df: filters.filtered(df, f).select(*IDS.split(", ")), f"SELECT {IDS} FROM leads WHERE {where}")


filter_query("f1_tenant_strict", LeadFilters(organization_id=2, blocked="include"), "organization_id = 2")
filter_query("f1_tenant_with_shared", LeadFilters(organization_id=2, with_shared=True, blocked="include"), "organization_id = 2 OR organization_id IS NULL")
filter_query("f2_blocked_exclude", LeadFilters(), "NOT is_blocked")
filter_query("f2_blocked_only", LeadFilters(blocked="only"), "is_blocked")
filter_query("f3_city_state", LeadFilters(city="nation_1%", state="AM_RICA"), "NOT is_blocked AND city ILIKE 'nation_1%' AND state ILIKE 'AM_RICA'")
filter_query("f4_category", LeadFilters(category="MACHIN"), "NOT is_blocked AND category ILIKE '%MACHIN%'")
filter_query("f5_search", LeadFilters(search=" LOJA12"), "NOT is_blocked AND (" + " OR ".join(f"coalesce({c} ILIKE '%LOJA12%', false)" for c in filters.SEARCHED) + ")")
_search = lambda term: " OR ".join(f"coalesce({c} ILIKE '%{term}%', false)" for c in filters.SEARCHED)
_related = lambda s, d: {t: table(s, d, t) for t in filters.RELATED}
for _n, _t in (("f5_search_related", "ation_2"), ("f5_search_representative", "equipe NATION_1"), ("f5_search_segment", "Segmento A")):
    add(_n, lambda s, d, t=_t: filters.filtered(table(s, d, "leads"), LeadFilters(search=t), _related(s, d)).select(*IDS.split(", ")),
        f"SELECT {IDS} FROM leads WHERE NOT is_blocked AND ({_search(_t)} OR " + " OR ".join(f"coalesce({own} IN (SELECT {key} FROM {t} WHERE name ILIKE '%{_t}%'), false)" for t, (own, key) in filters.RELATED.items()) + ")", "leads", *filters.RELATED)
filter_query("f6_status_registry", LeadFilters(status="approved", cnpj_match_status="unknown", lead_source_type="website", do_not_contact=False), "NOT is_blocked AND status = 'approved' AND cnpj_match_status = 'unknown' AND lead_source_type = 'website' AND NOT do_not_contact")
filter_query("f6c_assignment", LeadFilters(sales_region_id=2, market_segment_id=1, assigned=True, company_size_fit="possible_sme"), "NOT is_blocked AND sales_region_id = 2 AND market_segment_id = 1 AND assigned_sales_rep_id IS NOT NULL AND company_size_fit = 'possible_sme'")
filter_query("f7_score_range", LeadFilters(score_min=40, score_max=60), "NOT is_blocked AND lead_score BETWEEN 40 AND 60")
filter_query("f8_contact_flags", LeadFilters(has_email=False, has_whatsapp=True, has_instagram=False), f"NOT is_blocked AND NOT ({_has('email')}) AND {_has('whatsapp')} AND NOT ({_has('instagram')})")
add("f9_in_batch", lambda s, d: filters.in_batch(table(s, d, "leads"), table(s, d, "raw_records"), BATCH).select(*IDS.split(", ")), f"SELECT {IDS} FROM leads WHERE lead_id IN (SELECT lead_id FROM raw_records WHERE batch_id = {BATCH})", "leads", "raw_records")

_LANES = {
    "action_queue": ("Action queue", f"status IN ('new', 'reviewed', 'approved') AND NOT do_not_contact AND {_any} AND lead_score >= 70"),
    "ready_for_outreach": ("Ready for outreach", f"status IN ('new', 'reviewed', 'approved', 'contacted', 'replied', 'interested') AND NOT do_not_contact AND {_direct} AND lead_score >= 70"),
    "needs_enrichment": ("Needs enrichment", "status IN ('new', 'reviewed', 'approved', 'contacted', 'replied', 'interested') AND NOT do_not_contact AND last_enriched_at IS NULL"),
    "follow_up_due": ("Follow-up due", "status IN ('contacted', 'replied', 'interested') AND NOT do_not_contact AND follow_up_date <= DATE '2024-02-15'"),
}
for _key, (_lane, _where) in _LANES.items():
    leads_query(f"f10_{_key}", lambda df, lane=_lane: df.where(~F.col("is_blocked") & filters.lane(lane, TODAY)).select(*IDS.split(", "), "status"), f"SELECT {IDS}, status FROM leads WHERE NOT is_blocked AND {_where}")
leads_query("f11_quick_filters", lambda df: df.where(filters.quick(True, True, True, True)).select(*IDS.split(", ")), f"SELECT {IDS} FROM leads WHERE NOT is_duplicate AND {_any} AND lead_score >= 70 AND status IN ('new', 'reviewed', 'approved') AND last_contacted_at IS NULL")
_HAY = " || ' ' || ".join(f"coalesce({c}, '')" for c in filters.HAYSTACK)
leads_query("f12_workspace_search", lambda df: df.where(filters.matches(" NATION_1 america ")).select(*IDS.split(", ")), f"SELECT {IDS} FROM leads WHERE contains(lower({_HAY}), 'nation_1 america')")
leads_query("f13_queue", lambda df: filters.queue(df, "Action queue", "loja", "highest_priority", TODAY, hide_duplicates=True).select(*IDS.split(", ")), f"SELECT {IDS} FROM leads WHERE {_LANES['action_queue'][1]} AND NOT is_duplicate AND contains(lower({_HAY}), 'loja')")
leads_query("o1_list_page", lambda df: filters.page(df.where("NOT is_blocked").orderBy(*filters.list_order("lead_score")), 50, 25).select(*IDS.split(", ")), f"SELECT {IDS} FROM leads WHERE NOT is_blocked ORDER BY lead_score DESC, lead_id DESC LIMIT 50 OFFSET 25")
leads_query("o3_follow_up_order", lambda df: filters.page(df.orderBy(*filters.queue_order("follow_up_date")), 100).select(*IDS.split(", ")), f"SELECT {IDS} FROM leads ORDER BY follow_up_date ASC NULLS LAST, lead_score DESC, lower(business_name), lead_id LIMIT 100")
for _k in ("created_at", "assigned_at", "trade_type"):
    leads_query(f"o1_by_{_k}", lambda df, k=_k: filters.page(df.where(F.col(k).isNotNull()).orderBy(*filters.list_order(k, False)), 40, 10).select("lead_id", k), f"SELECT lead_id, {_k} FROM leads WHERE {_k} IS NOT NULL ORDER BY {_k}, lead_id LIMIT 40 OFFSET 10")
leads_query("o6_recent_leads", lambda df: filters.page(df.orderBy(*filters.list_order("updated_at")), 10).select("lead_id", "updated_at"), "SELECT lead_id, updated_at FROM leads ORDER BY updated_at DESC, lead_id DESC LIMIT 10")

leads_query("a2_overview", reports.overview, f"SELECT count(*) AS leads, count(*) FILTER ({_has('email')}) AS with_email, count(*) FILTER ({_has('whatsapp')}) AS with_whatsapp, count(*) FILTER (do_not_contact) AS do_not_contact FROM leads")
leads_query("a3_by_organization", reports.by_organization, "SELECT organization_id, count(*) AS leads FROM leads GROUP BY organization_id")
leads_query("a4_distinct_postal_codes", lambda df: reports.distinct_values(df, "postal_code"), f"SELECT DISTINCT postal_code AS value FROM leads WHERE NOT is_blocked AND {_has('postal_code')}")
leads_query("a5_queue_stats", lambda df: reports.queue_stats(df, TODAY), f"SELECT count(*) AS queue_size, count(*) FILTER ({_any}) AS any_contact, count(*) FILTER (last_enriched_at IS NULL AND NOT do_not_contact) AS needs_enrichment, count(*) FILTER (coalesce(follow_up_date <= DATE '2024-02-15', false)) AS follow_up_due FROM leads")
leads_query("a6_export_metadata", reports.export_metadata, "SELECT state, count(*) AS leads, min(lead_score) AS least, round(avg(lead_score), 2) AS mean, max(lead_score) AS greatest FROM leads GROUP BY state")
_A9 = [("rep", "assigned_sales_rep_id", "Unmatched"), ("region", "sales_region_id", "Unmatched"), ("segment", "market_segment_id", "Unclassified"), ("subsegment", "market_subsegment_id", "Unclassified")]
leads_query("a9_assignment_counts", reports.assignment_counts, " UNION ALL ".join(f"SELECT '{k}' AS kind, coalesce(CAST({c} AS VARCHAR), '{n}') AS label, count(*) AS leads FROM leads GROUP BY {c}" for k, c, n in _A9))
add("a8_batch_summary", lambda s, d: reports.batch_summary(table(s, d, "raw_records"), table(s, d, "leads")), "SELECT batch_id, count(*) AS records, count(r.lead_id) AS with_lead, " + ", ".join(f"count(*) FILTER (cnpj_match_status = '{x}') AS {x}" for x in ("matched", "needs_review", "not_found", "error", "unknown")) + " FROM raw_records r LEFT JOIN leads l ON r.lead_id = l.lead_id GROUP BY batch_id", "leads", "raw_records")
add("w9_latest_batch", lambda s, d: reports.latest_batch(table(s, d, "batches")), "SELECT batch_id, completed_at FROM batches WHERE status = 'completed' ORDER BY completed_at DESC, batch_id DESC LIMIT 1", "batches")
add("j2_first_in_batch", lambda s, d: reports.first_in_batch(table(s, d, "raw_records"), BATCH), f"SELECT lead_id, raw_id AS first_raw_id FROM raw_records WHERE batch_id = {BATCH} AND lead_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lead_id ORDER BY created_at, raw_id) = 1", "raw_records")
add("j4_used_regions", lambda s, d: table(s, d, "sales_regions").join(table(s, d, "leads"), F.col("region_id") == F.col("sales_region_id"), "left_semi").select("region_id", "name"), "SELECT DISTINCT region_id, name FROM sales_regions JOIN leads ON region_id = sales_region_id", "sales_regions", "leads")
add("j14_missing_ids", lambda s, d: table(s, d, "raw_records").where("lead_id is not null").select("lead_id").distinct().join(table(s, d, "leads").where("NOT is_blocked"), "lead_id", "left_anti"), "SELECT DISTINCT lead_id FROM raw_records WHERE lead_id IS NOT NULL AND lead_id NOT IN (SELECT lead_id FROM leads WHERE NOT is_blocked)", "raw_records", "leads")
for _name, _export, _order in (("w1_canonical_contact", False, "confidence DESC, is_primary DESC"), ("w2_export_contact", True, "is_primary DESC, confidence DESC")):
    add(_name, lambda s, d, e=_export: reports.best_contact(table(s, d, "contacts"), e), f"SELECT lead_id, contact_type, contact_id FROM contacts QUALIFY row_number() OVER (PARTITION BY lead_id, contact_type ORDER BY {_order}, updated_at DESC, contact_id DESC) = 1", "contacts")
_OK = lambda c: f"(regexp_full_match({c}, '[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{{2,}}') AND NOT {c} LIKE '%.example.com')"
add("p3_export_email", lambda s, d: reports.export_email(table(s, d, "leads"), table(s, d, "contacts")), f"""
SELECT l.lead_id, coalesce(b.v, CASE WHEN {_OK('l.email')} THEN l.email END) AS export_email FROM leads l LEFT JOIN (
  SELECT lead_id, v FROM (SELECT *, coalesce(normalized_value, raw_value) AS v FROM contacts WHERE contact_type = 'email') WHERE {_OK('v')}
  QUALIFY row_number() OVER (PARTITION BY lead_id ORDER BY is_primary DESC, confidence DESC, updated_at DESC, contact_id DESC) = 1) b ON l.lead_id = b.lead_id""", "leads", "contacts")
leads_query("p1_crm_rows", reports.crm_rows, """
SELECT lead_id, business_name, category, CASE WHEN cnpj_match_status = 'matched' THEN cnpj END AS cnpj, CASE WHEN cnpj_match_status = 'matched' THEN legal_name END AS legal_name,
  nullif(split_part(address, ', ', 1), '') AS street, nullif(split_part(address, ', ', 2), '') AS number, nullif(address, '') AS street_address, neighborhood, city, state, postal_code, 'Brasil' AS country, phone, whatsapp,
  website AS site, replace(lead_source_type, '_', ' ') AS source, coalesce(owner, 'id:' || CAST(assigned_sales_rep_id AS VARCHAR)) AS owner, status, lead_score FROM leads""")
add("j7_nested_contacts", lambda s, d: reports.nested_contacts(table(s, d, "leads"), table(s, d, "contacts")), "SELECT l.lead_id, CAST(count(contact_id) AS INT) AS n_contacts, coalesce(string_agg(CAST(contact_id AS VARCHAR), '|' ORDER BY is_primary DESC, contact_type, confidence DESC, contact_id), '') AS contact_ids FROM leads l LEFT JOIN contacts c ON l.lead_id = c.lead_id GROUP BY l.lead_id", "leads", "contacts")

leads_query("e10_score", lambda df: scoring.score(df, NOW), f"""
SELECT lead_id, least(100, has_email + has_phone + has_whatsapp + has_website + has_address + has_map_listing + location_completeness + core_field_completeness + source_reliability + freshness + reputation_signals + not_duplicate) AS score, * EXCLUDE (lead_id) FROM (
SELECT lead_id, CASE WHEN {_has('email')} THEN 14 ELSE 0 END AS has_email, CASE WHEN {_has('phone')} THEN 14 ELSE 0 END AS has_phone, CASE WHEN {_has('whatsapp')} THEN 9 ELSE 0 END AS has_whatsapp,
  CASE WHEN site THEN 12 ELSE 0 END AS has_website, CASE WHEN {_has('address')} THEN 10 ELSE 0 END AS has_address, CASE WHEN listing THEN 8 ELSE 0 END AS has_map_listing,
  CASE WHEN {_has('city')} AND {_has('state')} THEN 4 ELSE 0 END + CASE WHEN {_has('postal_code')} THEN 1 ELSE 0 END + CASE WHEN {_has('neighborhood')} THEN 1 ELSE 0 END AS location_completeness,
  least(8, {' + '.join(f"CAST({_has(c)} AS INT)" for c in ('business_name', 'category', 'city', 'state', 'address', 'phone', 'email', 'whatsapp'))} + CAST(site AS INT) + CAST(listing AS INT)) AS core_field_completeness,
  CASE lead_source_type WHEN 'google_places' THEN CASE WHEN listing THEN 5 ELSE 3 END WHEN 'website' THEN CASE WHEN site THEN 5 ELSE 3 END WHEN 'manual_import' THEN 4 WHEN 'merged' THEN 4 WHEN 'demo_seed' THEN 1 ELSE 0 END AS source_reliability,
  CASE WHEN age <= 30 THEN 4 WHEN age <= 180 THEN 2 ELSE 0 END AS freshness, 0 AS reputation_signals, CASE WHEN is_duplicate THEN 0 ELSE 6 END AS not_duplicate
FROM (SELECT *, {_has('website')} OR {_has('domain')} AS site, {_has('google_maps_url')} OR {_has('google_place_id')} AS listing, greatest(0, date_diff('day', CAST(last_enriched_at AS DATE), DATE '2024-02-15')) AS age0, CASE WHEN last_enriched_at IS NULL THEN NULL ELSE greatest(0, date_diff('day', CAST(last_enriched_at AS DATE), DATE '2024-02-15')) END AS age FROM leads))""")
_N1 = lambda c: f"nullif(trim(regexp_replace(lower(regexp_replace(strip_accents({c}), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g')), '')"
leads_query("e11_size_and_trade", scoring.classify, f"""
SELECT lead_id, CASE WHEN c >= 2 THEN 'ideal_sme' WHEN k AND c >= 1 THEN 'ideal_sme' ELSE 'possible_sme' END AS size_fit, 'unknown' AS trade FROM (
SELECT lead_id, CAST({_has('email')} AS INT) + CAST({_has('phone')} AS INT) + CAST({_has('whatsapp')} AS INT) + CAST({_has('website')} OR {_has('domain')} AS INT) AS c, market_segment_id IS NOT NULL OR market_subsegment_id IS NOT NULL AS k FROM leads)""")
leads_query("p5_contact_state", scoring.contact_state, f"""
SELECT lead_id, e AS has_email, p AS has_phone, w AS has_whatsapp, e OR w AS has_direct_channel, e OR w OR p AS has_any_contact, CAST(e AS INT) + CAST(p AS INT) + CAST(w AS INT) AS contact_count, CAST(e AS INT) + CAST(w AS INT) AS direct_channel_count
FROM (SELECT lead_id, {_has('email')} AS e, {_has('phone')} AS p, {_has('whatsapp')} AS w FROM leads)""")
leads_query("p6_next_action", lambda df: df.select("lead_id", scoring.next_action(TODAY).alias("next_action"), scoring.default_template(("cold_email", "cold_whatsapp", "follow_up_email", "follow_up_whatsapp")).alias("template")), f"""
SELECT lead_id, CASE WHEN do_not_contact THEN 'blocked' WHEN status = 'new' THEN 'review' WHEN last_enriched_at IS NULL THEN 'enrich' WHEN follow_up_date <= DATE '2024-02-15' THEN 'follow_up' WHEN {_direct} THEN 'draft' WHEN {_any} THEN 'phone_only' ELSE 'note' END AS next_action,
  CASE WHEN status IN ('contacted', 'replied', 'interested') THEN CASE WHEN {_has('email')} THEN 'follow_up_email' WHEN {_has('whatsapp')} THEN 'follow_up_whatsapp' ELSE 'cold_email' END WHEN {_has('email')} THEN 'cold_email' WHEN {_has('whatsapp')} THEN 'cold_whatsapp' ELSE 'cold_email' END AS template FROM leads""")

add("e7_exclusion", lambda s, d: rules.apply_exclusion(table(s, d, "leads"), table(s, d, "exclusion_rules")), """
SELECT l.lead_id, r.rule_id IS NOT NULL AS blocked_now, r.rule_id, coalesce(r.reason, 'rule ' || CAST(r.rule_id AS VARCHAR)) AS reason, (r.rule_id IS NOT NULL) <> is_blocked AS changed
FROM leads l LEFT JOIN (SELECT lead_id, min(rule_id) AS rule_id FROM leads JOIN exclusion_rules ON
  (rule_type = 'exact_name' AND normalized_business_name = normalized_pattern) OR (rule_type = 'business_name_contains' AND contains(normalized_business_name, normalized_pattern))
  OR (rule_type = 'domain' AND (domain = normalized_pattern OR ends_with(domain, '.' || normalized_pattern))) OR (rule_type = 'provider_category' AND category = normalized_pattern) GROUP BY lead_id) h ON l.lead_id = h.lead_id
LEFT JOIN exclusion_rules r ON h.rule_id = r.rule_id""", "leads", "exclusion_rules")
add("e8_region", lambda s, d: rules.matching_region(table(s, d, "leads"), table(s, d, "sales_regions")), f"""
SELECT lead_id, region_id, step FROM (SELECT l.lead_id, r.region_id, r.region_type, r.name, CASE
  WHEN postal_prefix IS NOT NULL AND starts_with(replace(l.postal_code, '-', ''), postal_prefix) AND l.city = r.city THEN 1
  WHEN neighborhood_keyword IS NOT NULL AND contains({_N1("concat_ws(' ', l.neighborhood, l.address)")}, neighborhood_keyword) AND l.city = r.city THEN 2
  WHEN NOT requires_neighborhood AND l.city = r.city THEN 3 END AS step FROM leads l JOIN sales_regions r ON l.state = r.state) WHERE step IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY lead_id ORDER BY step, region_type, name, region_id) = 1""", "leads", "sales_regions")
_RULE = """SELECT lead_id, rule_id, sales_rep_id FROM leads JOIN assignment_rules r ON (r.region_id IS NULL OR r.region_id = sales_region_id) AND (r.segment_id IS NULL OR r.segment_id = market_segment_id)
  AND (r.subsegment_id IS NULL OR r.subsegment_id = market_subsegment_id) QUALIFY row_number() OVER (PARTITION BY lead_id ORDER BY priority, rule_id) = 1"""
for _name, _over, _free in (("m9_assign_open", False, "assigned_sales_rep_id IS NULL"), ("m9_assign_overwrite", True, "true")):
    add(_name, lambda s, d, o=_over: rules.assign(table(s, d, "leads"), table(s, d, "assignment_rules"), o), f"SELECT l.lead_id, CASE WHEN {_free} THEN m.sales_rep_id ELSE assigned_sales_rep_id END AS sales_rep_id, CASE WHEN {_free} THEN m.rule_id END AS rule_id FROM leads l LEFT JOIN ({_RULE}) m ON l.lead_id = m.lead_id", "leads", "assignment_rules")

_KEYS = f"""k AS (SELECT lead_id, {_N1('business_name')} AS name, {_N1('city')} AS c, {_N1('address')} AS a, {_N1('neighborhood')} AS n, google_place_id AS g, google_maps_url AS m, domain AS d, phone AS p FROM leads WHERE NOT is_duplicate),
met AS (SELECT item_pos, 0 AS rung, lead_id, name, a FROM candidates x JOIN k ON x.google_place_id = g UNION ALL SELECT item_pos, 1, lead_id, name, a FROM candidates x JOIN k ON x.google_maps_url = m
 UNION ALL SELECT item_pos, 2, lead_id, name, a FROM candidates x JOIN k ON x.domain = d AND (c IS NULL OR c = city_key) UNION ALL SELECT item_pos, 3, lead_id, name, a FROM candidates x JOIN k ON x.phone = p AND (c IS NULL OR c = city_key)
 UNION ALL SELECT item_pos, 4, lead_id, name, a FROM candidates x JOIN k ON x.name_key = name AND address_key = a UNION ALL SELECT item_pos, 5, lead_id, name, a FROM candidates x JOIN k ON x.name_key = name AND neighborhood_key = n AND city_key = c
 UNION ALL SELECT item_pos, 6, lead_id, name, a FROM candidates x JOIN k ON x.name_key = name AND city_key = c),
r AS (SELECT item_pos, rung, min(lead_id) AS lead_id, count(*) AS n, count(DISTINCT coalesce(name, '?')) AS names, count(DISTINCT coalesce(a, '?')) AS adds FROM met GROUP BY item_pos, rung)"""
add("e1_existing_lead", lambda s, d: matching.existing_lead(table(s, d, "candidates"), table(s, d, "leads")))
ORACLE_SQL["e1_existing_lead"] = oracle("", "leads", "candidates").rstrip() + ",\n" + _KEYS + """
SELECT item_pos, lead_id AS existing_lead_id, CASE rung WHEN 0 THEN 'google_place_id' WHEN 1 THEN 'google_maps_url' WHEN 2 THEN 'domain' WHEN 3 THEN 'phone' WHEN 4 THEN 'name_address' WHEN 5 THEN 'name_neighborhood_city' ELSE 'name_city' END AS matched_by
FROM r WHERE rung < 2 OR n = 1 OR (rung < 4 AND names = 1) OR (rung IN (4, 5) AND adds = 1) QUALIFY row_number() OVER (PARTITION BY item_pos ORDER BY rung) = 1"""
add("e2_preview_groups", lambda s, d: matching.preview_groups(table(s, d, "candidates")))
ORACLE_SQL["e2_preview_groups"] = "WITH RECURSIVE " + oracle("", "candidates").removeprefix("WITH ").rstrip() + """,
e AS (SELECT item_pos, 'g' || google_place_id AS key FROM candidates WHERE google_place_id IS NOT NULL UNION ALL SELECT item_pos, 'm' || google_maps_url FROM candidates WHERE google_maps_url IS NOT NULL UNION ALL SELECT item_pos, 'd' || domain FROM candidates WHERE domain IS NOT NULL
 UNION ALL SELECT item_pos, 'p' || phone FROM candidates WHERE phone IS NOT NULL UNION ALL SELECT item_pos, 'a' || name_key || '|' || address_key FROM candidates WHERE address_key IS NOT NULL
 UNION ALL SELECT item_pos, 'n' || name_key || '|' || neighborhood_key || '|' || city_key FROM candidates WHERE neighborhood_key IS NOT NULL UNION ALL SELECT item_pos, 'c' || name_key || '|' || city_key FROM candidates),
reach AS (SELECT item_pos, item_pos AS other FROM candidates UNION SELECT r.item_pos, y.item_pos FROM reach r JOIN e x ON r.other = x.item_pos JOIN e y ON x.key = y.key)
SELECT item_pos, min(other) AS group_pos FROM reach GROUP BY item_pos"""
_SAME = lambda c: f"({_has('a.' + c)} AND a.{c} = b.{c})"
_MASK = " + ".join(f"CASE WHEN {_SAME(c)} THEN {1 << k} ELSE 0 END" for k, c in enumerate(matching.REASONS))
_PAIRS = f"""p AS (SELECT a.lead_id AS lead_a, b.lead_id AS lead_b, {_MASK} AS mask FROM leads a JOIN leads b ON (a.updated_at > b.updated_at OR (a.updated_at = b.updated_at AND a.lead_id > b.lead_id))
  AND ({_SAME('google_place_id')} OR {_SAME('phone')} OR {_SAME('whatsapp')} OR {_SAME('domain')} OR {_SAME('normalized_business_name')}) WHERE NOT a.is_duplicate AND NOT b.is_duplicate AND NOT a.is_blocked AND NOT b.is_blocked),
q AS (SELECT lead_a, lead_b, mask, CASE mask {' '.join(f'WHEN {m} THEN {matching.confidence_of(m)}' for m in range(1, 32))} END AS confidence FROM p WHERE mask % 2 = 1 OR bit_count(mask) >= 2)"""
add("e3_duplicate_pairs", lambda s, d: matching.duplicate_pairs(table(s, d, "leads")))
ORACLE_SQL["e3_duplicate_pairs"] = oracle("", "leads").rstrip() + ",\n" + _PAIRS + " SELECT lead_a, lead_b, mask, CAST(confidence AS DOUBLE) AS confidence FROM q"
add("e3_survivors", lambda s, d: matching.survivors(matching.duplicate_pairs(table(s, d, "leads")), matching.priorities(table(s, d, "leads"), table(s, d, "contacts"))))
_FULL = " + ".join(f"CAST({_has(c)} AS INT)" for c in matching.POPULATED)
ORACLE_SQL["e3_survivors"] = oracle("", "leads", "contacts").rstrip() + ",\n" + _PAIRS + f""",
s AS (SELECT lead_id, lead_score + 3 * ({_FULL}) + coalesce((SELECT sum(confidence) FROM contacts c WHERE c.lead_id = leads.lead_id), 0) AS priority FROM leads)
SELECT lead_a, lead_b, CAST(confidence AS DOUBLE) AS confidence, CASE WHEN x.priority >= y.priority THEN lead_a ELSE lead_b END AS survivor FROM q JOIN s x ON lead_a = x.lead_id JOIN s y ON lead_b = y.lead_id"""
add("m1_fill_missing", lambda s, d: matching.merge_missing(table(s, d, "leads"), table(s, d, "candidates").select("item_pos", "domain", "phone", "google_place_id"), matching.existing_lead(table(s, d, "candidates"), table(s, d, "leads")), ["domain", "phone", "google_place_id"]))

# compared fields of each record and its lead, then their points
_DIGITS = lambda c: f"nullif(regexp_replace({c}, '[^0-9]', '', 'g'), '')"
_HOST_OF = lambda c: f"nullif(regexp_replace(split_part(regexp_replace(lower({c}), '^[a-z]+://', ''), '/', 1), '^www\\.', ''), '')"
_MAIL_OF = lambda c: f"nullif(split_part(lower({c}), '@', 2), '')"
_NAMED = lambda c: f"CASE WHEN {c} = l_name THEN 'equal' WHEN length({c}) >= 10 AND length(l_name) >= 10 AND (contains({c}, l_name) OR contains(l_name, {c})) THEN 'strong' ELSE 'none' END"
_BOTH = lambda a, b: f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN 'missing' WHEN {a} = {b} THEN 'equal' ELSE 'different' END"
_ANY_OF = lambda c, ws: "(" + " OR ".join(f"contains({c}, '{w}')" for w in ws) + ")"
_KIND = "CASE " + " ".join(f"WHEN {_ANY_OF(_N1('category'), terms)} THEN '{kind}'" for kind, terms, _, _ in activities.ACTIVITIES) + " END"
_FITS = "coalesce(" + " OR ".join(f"(l_kind = '{kind}' AND {_ANY_OF(_N1('activity'), held)})" for kind, _, _, held in activities.ACTIVITIES) + ", false)"
_ALIAS = "CASE WHEN list_contains(l_aliases, trade) THEN 'equal' WHEN len(list_filter(l_aliases, lambda v: v = trade OR (least(length(v), length(trade)) >= 10 AND (contains(v, trade) OR contains(trade, v))))) > 0 THEN 'strong' ELSE 'none' END"
_SHORT = "list_filter(alias, lambda v: len(string_split(v, ' ')) <= 3)"
_BRAND = f"array_to_string(CASE WHEN len(alias) = 0 THEN [{_N1('leads.business_name')}] WHEN len({_SHORT}) > 0 THEN {_SHORT} ELSE alias[1:2] END, ' ')"
_EV = variant_steps("SELECT business_name, category FROM leads") + f""",
lp AS (SELECT lead_id, alias AS l_aliases, {_KIND.replace('category', 'leads.category')} AS l_kind, {_N1('leads.business_name')} AS l_name, list_distinct(list_filter(string_split({_BRAND}, ' '), lambda w: length(w) >= 4 AND w NOT IN ('loja', 'shop', 'casa', 'material', 'construcao'))) AS l_tokens,
  coalesce({_HOST_OF('website')}, nullif(domain, '')) AS l_site, {_MAIL_OF('email')} AS l_mail, phone AS l_phone, whatsapp AS l_whatsapp, substr(coalesce({_DIGITS('phone')}, {_DIGITS('whatsapp')}), -10, 2) AS l_area,
  {_N1("split_part(address, ', ', 1)")} AS l_street, nullif(split_part(address, ', ', 2), '') AS l_number, {_DIGITS('postal_code')} AS l_postal, {_N1('neighborhood')} AS l_neighborhood, {_N1('city')} AS l_city, state AS l_state FROM leads JOIN nv ON leads.business_name = nv.business_name AND leads.category = nv.category),
rp AS (SELECT *, {_N1('trade_name')} AS trade, {_N1('legal_name')} AS legal, {_HOST_OF('website')} AS site, {_MAIL_OF('email')} AS mail, '+55' || {_DIGITS('phone')} AS number_of, substr({_DIGITS('phone')}, -10, 2) AS area,
  {_N1("split_part(address, ', ', 1)")} AS street, nullif(split_part(address, ', ', 2), '') AS house, {_DIGITS('postal_code')} AS postal, {_N1('city')} AS c_city, CASE state WHEN 'São Paulo' THEN 'SP' ELSE state END AS c_state FROM registry),
cmp AS (SELECT record_id, r.lead_id, candidate_pos, cnpj, full_cnpj, coalesce(site IN (l_site, l_mail), false) OR coalesce(mail IN (l_site, l_mail), false) AS same_domain, coalesce(number_of = l_phone, false) OR coalesce(number_of = l_whatsapp, false) AS same_phone, coalesce(area = l_area, false) AS same_area,
  {_ALIAS} AS alias_match, {_NAMED('legal')} AS legal_match, CASE WHEN len(l_tokens) > 0 AND list_has_all(string_split(coalesce(legal, ''), ' '), l_tokens) THEN 'all' WHEN list_has_any(string_split(coalesce(legal, ''), ' '), l_tokens) THEN 'some' ELSE 'none' END AS brand_in_legal,
  list_has_any(string_split(coalesce(trade, ''), ' '), l_tokens) AS brand_in_alias, coalesce(street = l_street, false) AS same_street, {_BOTH('house', 'l_number')} AS number_match, coalesce(postal = l_postal, false) AS same_postal,
  coalesce({_N1('neighborhood')} = l_neighborhood, false) AS same_neighborhood, {_BOTH('c_city', 'l_city')} AS city_match, {_BOTH('c_state', 'l_state')} AS state_match, {_FITS} AS same_activity
  FROM rp r JOIN lp ON r.lead_id = lp.lead_id),
sc AS (SELECT record_id, lead_id, candidate_pos, cnpj, full_cnpj, greatest(0, CASE WHEN same_domain THEN 40 ELSE 0 END + CASE WHEN same_phone THEN 35 WHEN same_area THEN 5 ELSE 0 END + CASE alias_match WHEN 'equal' THEN 25 WHEN 'strong' THEN 20 ELSE 0 END
 + CASE brand_in_legal WHEN 'all' THEN 15 WHEN 'some' THEN 10 ELSE 0 END + CASE WHEN alias_match <> 'none' THEN 0 WHEN legal_match = 'equal' THEN 15 WHEN legal_match = 'strong' THEN 12 ELSE 0 END + CASE WHEN same_street THEN 15 ELSE 0 END
 + CASE number_match WHEN 'equal' THEN 10 WHEN 'different' THEN -10 ELSE 0 END + CASE WHEN same_postal THEN 25 ELSE 0 END + CASE WHEN same_neighborhood THEN 10 ELSE 0 END + CASE city_match WHEN 'equal' THEN 15 WHEN 'different' THEN -30 ELSE 0 END
 + CASE state_match WHEN 'equal' THEN 10 WHEN 'different' THEN -40 ELSE 0 END + CASE WHEN same_activity THEN 8 ELSE 0 END + CASE WHEN alias_match = 'none' AND legal_match = 'none' AND brand_in_legal = 'none' AND brand_in_alias THEN 15 ELSE 0 END) AS score,
 CAST(same_domain AS INT) + CAST(same_phone AS INT) + CAST(same_street AS INT) + CAST(number_match = 'equal' AS INT) + CAST(same_postal AS INT) + CAST(same_neighborhood AS INT) AS support,
 alias_match <> 'none' OR legal_match <> 'none' OR brand_in_legal <> 'none' OR brand_in_alias OR same_domain OR same_phone AS identity, city_match = 'different' OR state_match = 'different' AS conflict FROM cmp)"""
_registry = lambda s, d: linkage.compared(table(s, d, "leads"), table(s, d, "registry"))
_evidence = lambda s, d: linkage.evidence(_registry(s, d))
add("j11_compared_records", lambda s, d: _registry(s, d).drop("person_like"))
ORACLE_SQL["j11_compared_records"] = oracle("", "leads", "registry").rstrip() + ",\n" + _EV + " SELECT * FROM cmp"
add("e5_evidence", _evidence)
ORACLE_SQL["e5_evidence"] = oracle("", "leads", "registry").rstrip() + ",\n" + _EV + " SELECT * FROM sc"
add("e5_decision", lambda s, d: linkage.decide(_evidence(s, d)))
ORACLE_SQL["e5_decision"] = oracle("", "leads", "registry").rstrip() + ",\n" + _EV + """,
b AS (SELECT *, coalesce(score - lead(score) OVER w, 10) AS gap, row_number() OVER w AS rank FROM sc WINDOW w AS (PARTITION BY lead_id ORDER BY score DESC, candidate_pos, record_id)),
d AS (SELECT *, CASE WHEN conflict THEN 'location_conflict' WHEN gap < 10 THEN 'close_second' WHEN support < 1 THEN 'no_support' WHEN NOT full_cnpj THEN 'not_confirmable' END AS reason FROM b WHERE rank = 1),
t AS (SELECT *, score >= 80 AND reason IS NULL AND identity AS m, (score >= 80 AND reason IS NOT NULL) OR (score >= 50 AND NOT conflict AND full_cnpj) AS v FROM d)
SELECT lead_id, record_id, score, gap, CASE WHEN m THEN 'matched' WHEN v THEN 'needs_review' ELSE 'not_found' END AS status, reason,
  CAST(CASE WHEN NOT m AND v AND reason IS NULL THEN least(least(score, 100) / 100.0, 0.79) ELSE least(score, 100) / 100.0 END AS DOUBLE) AS confidence FROM t"""
add("w10_review_list", lambda s, d: linkage.review_list(_evidence(s, d)))
ORACLE_SQL["w10_review_list"] = oracle("", "leads", "registry").rstrip() + ",\n" + _EV + " SELECT lead_id, record_id, score, CAST(row_number() OVER (PARTITION BY lead_id ORDER BY score DESC, candidate_pos, record_id) AS INT) AS rank FROM sc WHERE score >= 50 AND NOT conflict QUALIFY rank <= 5"
# M1: of the candidates matched to a lead the first with a value fills what is empty
_M1 = ("domain", "phone", "google_place_id")
ORACLE_SQL["m1_fill_missing"] = ORACLE_SQL["e1_existing_lead"].rsplit("\nSELECT item_pos, lead_id AS existing_lead_id", 1)[0] + ",\nx AS (SELECT item_pos, lead_id AS existing_lead_id" + ORACLE_SQL["e1_existing_lead"].rsplit("\nSELECT item_pos, lead_id AS existing_lead_id", 1)[1] + f"""),
f AS (SELECT existing_lead_id, {', '.join(f"first({c} ORDER BY c.item_pos) FILTER ({_has('c.' + c)}) AS new_{c}" for c in _M1)} FROM x JOIN candidates c ON x.item_pos = c.item_pos GROUP BY existing_lead_id)
SELECT lead_id, {', '.join(f"CASE WHEN {_has(c)} THEN {c} ELSE coalesce(new_{c}, {c}) END AS {c}" for c in _M1)} FROM leads LEFT JOIN f ON lead_id = existing_lead_id"""


def texts(name: str, column: Callable[[], dict], sql: str | None) -> None:
    add(name, lambda s, d: table(s, d, "documents").select("doc_id", *[c.alias(k) for k, c in column().items()]), sql)


texts("n1_normalize_text", lambda: {"normalized": text.normalize_text(F.col("text"))}, f"SELECT doc_id, {_N1('text')} AS normalized FROM documents")
texts("n11_emails", lambda: {"emails": F.array_join(F.array_sort(text.emails(F.col("text"))), "|")}, "SELECT doc_id, coalesce((SELECT string_agg(DISTINCT trim(lower(e), '<>()[]{}\"''.,;:'), '|' ORDER BY trim(lower(e), '<>()[]{}\"''.,;:')) FROM unnest(regexp_extract_all(text, '(?i)[a-z0-9][a-z0-9._%+-]*@([a-z0-9-]+[.])+[a-z]{2,}')) t(e)), '') AS emails FROM documents")
_PH = "regexp_replace(p, '[^0-9]', '', 'g')"
_LOCAL = f"CASE WHEN starts_with({_PH}, '55') AND length({_PH}) BETWEEN 12 AND 13 THEN substr({_PH}, 3) ELSE regexp_replace({_PH}, '^0+', '') END"
texts("n14_phones", lambda: {"phones": F.array_join(F.array_sort(text.phones(F.col("text"))), "|")}, f"SELECT doc_id, coalesce((SELECT string_agg(DISTINCT '+55' || {_LOCAL}, '|' ORDER BY '+55' || {_LOCAL}) FROM unnest(regexp_extract_all(text, '(?:55[\\s(]*)?(?:[0-9]{{2}}[\\s)]*)?(?:9[0-9]{{4}}|[0-9]{{4}})[\\s-]?[0-9]{{4}}')) t(p) WHERE length({_LOCAL}) BETWEEN 8 AND 11), '') AS phones FROM documents")
add("n17_signals", lambda s, d: table(s, d, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("t")).select("doc_id", *[F.size(c).alias(k) for k, c in text.signals(F.col("t")).items()]), "SELECT doc_id, " + ", ".join("CAST(" + " + ".join(f"CAST(contains(coalesce({_N1('text')}, ''), strip_accents('{w}')) AS INT)" for w in ws) + f" AS INT) AS {k}" for k, ws in text.SIGNALS.items()) + " FROM documents")
add("n4_page_domains", lambda s, d: table(s, d, "pages").select("page_id", text.domain_of(F.col("url")).alias("domain"), text.own_website(F.col("url")).alias("own")), "SELECT page_id, regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\\.', '') AS domain, true AS own FROM pages")
leads_query("n24_postal_and_area", lambda df: df.select("lead_id", text.postal_code(F.col("postal_code")).alias("postal"), text.area_code(F.col("phone")).alias("area"), text.state_code(F.col("state")).alias("state_code")), "SELECT lead_id, nullif(replace(postal_code, '-', ''), '') AS postal, substr(phone, -10, 2) AS area, state AS state_code FROM leads")
_CHECK = lambda n: f"(SELECT CASE WHEN s % 11 < 2 THEN 0 ELSE 11 - s % 11 END FROM (SELECT sum(CAST(substr(x, CAST(i + 1 AS INT), 1) AS INT) * (({n} - i - 1) % 8 + 2)) AS s FROM range({n}) r(i)))"
add("n22_company_ids", lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.lpad((F.col("l_orderkey") * 1000003 + F.col("l_partkey") * 89).cast("string"), 14, "0").alias("x")).select("l_orderkey", "l_linenumber", text.valid_company_id(F.col("x")).alias("valid")),
    "SELECT l_orderkey, l_linenumber, c1 = CAST(substr(x, 13, 1) AS INT) AND c2 = CAST(substr(x, 14, 1) AS INT) AND x <> '00000000000000' AS valid FROM (SELECT *, " + ", ".join(
        f"CASE WHEN ({e}) % 11 < 2 THEN 0 ELSE 11 - ({e}) % 11 END AS c{j}" for j, e in ((j, " + ".join(f"CAST(substr(x, {i + 1}, 1) AS INT) * {(n - i - 1) % 8 + 2}" for i in range(n))) for j, n in ((1, 12), (2, 13)))
    ) + " FROM (SELECT l_orderkey, l_linenumber, lpad(CAST(l_orderkey * 1000003 + l_partkey * 89 AS VARCHAR), 14, '0') AS x FROM lineitem))")
leads_query("n35_signature", lambda df: df.select("lead_id", F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in ("business_name", "city", "state", "domain")]), 256).alias("signature")), "SELECT lead_id, sha256(coalesce(business_name, '') || '|' || coalesce(city, '') || '|' || coalesce(state, '') || '|' || coalesce(domain, '')) AS signature FROM leads")
