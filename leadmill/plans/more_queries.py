"""Further queries: page evidence, merges, imports, requests, activity."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadmill.functions import address, text
from leadmill.operators import extraction, importing, matching, merging
from leadmill.plans.lead_queries import _N1, _PAIRS, NOW, ORACLE_SQL, QUERIES, _has, add, leads_query
from leadmill.sources import connectors
from leadmill.sources.domain import oracle, table
from leadmill.streaming import activity

_HOST = "regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\\.', '')"
add("p12_page_types", lambda s, d: table(s, d, "pages").select("page_id", extraction.page_type(F.col("url"), F.regexp_extract("url", "^([^/]*://[^/?#]*)", 1)).alias("page_type")),
    "SELECT page_id, CASE WHEN rtrim(url, '/') = rtrim(regexp_extract(url, '^([^/]*://[^/?#]*)', 1), '/') THEN 'homepage' " + " ".join(f"WHEN regexp_matches(lower(regexp_extract(url, '://[^/?#]*([^?#]*)', 1)), '{'|'.join(w)}') THEN '{k}'" for k, w in extraction.PAGE_TYPES) + " ELSE 'website_page' END AS page_type FROM pages")
add("e12_page_evidence", lambda s, d: extraction.evidence(table(s, d, "pages")))
add("a11_page_confidence", lambda s, d: extraction.confidence_by_type(extraction.evidence(table(s, d, "pages"))))
_TEXT = "regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->', chr(10), 'g'), '<[^>]*>', chr(10), 'g')"
for _e, _p in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&#64;", "@"), ("&amp;", "&")):
    _TEXT = f"replace({_TEXT}, '{_e}', '{_p}')"
_COUNT = lambda ws: " + ".join(f"CAST(contains(t, strip_accents('{w}')) AS INT)" for w in ws)
add("a12_host_signals", lambda s, d: extraction.merged_signals(table(s, d, "pages"), text.domain_of(F.col("url"))),
    f"WITH p AS (SELECT {_HOST} AS host, coalesce({_N1(_TEXT)}, '') AS t FROM pages), c AS (" + " UNION ALL ".join(f"SELECT host, '{k}' AS signal, {_COUNT(w)} AS n FROM p" for k, w in text.SIGNALS.items()) + ") SELECT host, signal, max(n > 0) AS relevant, max(CASE WHEN n > 0 THEN CAST(round(least(1.0, 0.35 + 0.2 * n), 2) AS DOUBLE) ELSE 0.0 END) AS confidence, count(*) FILTER (n > 0) AS pages FROM c GROUP BY host, signal")

_REACH = """e AS (SELECT lead_a AS a, lead_b AS b FROM q UNION SELECT lead_b, lead_a FROM q), reach AS (SELECT a AS lead_id, a AS other FROM e UNION SELECT r.lead_id, e.b FROM reach r JOIN e ON r.other = e.a),
cl AS (SELECT lead_id, min(other) AS cluster FROM reach GROUP BY lead_id)"""
_RECURSIVE = "WITH RECURSIVE " + oracle("", "leads", "contacts").removeprefix("WITH ").rstrip() + ",\n" + _PAIRS + ",\n" + _REACH
add("e4_clusters", lambda s, d: merging.clusters(matching.duplicate_links(table(s, d, "leads"))))
ORACLE_SQL["e4_clusters"] = _RECURSIVE + " SELECT lead_id, cluster FROM cl"


def _merged(s, d):
    leads = table(s, d, "leads")
    return merging.merge_clusters(leads, merging.clusters(matching.duplicate_links(leads)), matching.priorities(leads, table(s, d, "contacts")))


_FULL = " + ".join(f"CAST({_has(c)} AS INT)" for c in matching.POPULATED)
add("m3_merged_clusters", _merged)
ORACLE_SQL["m3_merged_clusters"] = _RECURSIVE + f""",
r AS (SELECT l.*, cluster, lead_score + 3 * ({_FULL}) + coalesce((SELECT sum(confidence) FROM contacts c WHERE c.lead_id = l.lead_id), 0) AS priority FROM leads l JOIN cl ON l.lead_id = cl.lead_id)
SELECT cluster, first(lead_id ORDER BY priority DESC, lead_id) AS survivor, count(*) AS members, {', '.join(f"first({c} ORDER BY priority DESC, lead_id) FILTER ({_has(c)}) AS {c}" for c in merging.MERGED)},
 min(follow_up_date) AS follow_up_date, max(last_contacted_at) AS last_contacted_at, max(last_enriched_at) AS last_enriched_at, max(do_not_contact) AS do_not_contact FROM r GROUP BY cluster"""
add("m3_contacts_of_duplicates", lambda s, d: merging.merged_from_duplicates(matching.survivors(matching.duplicate_pairs(table(s, d, "leads")), matching.priorities(table(s, d, "leads"), table(s, d, "contacts"))), table(s, d, "leads")))
ORACLE_SQL["m3_contacts_of_duplicates"] = ORACLE_SQL["e3_survivors"].rsplit("\nSELECT lead_a", 1)[0] + ",\nv AS (SELECT lead_a" + ORACLE_SQL["e3_survivors"].rsplit("\nSELECT lead_a", 1)[1] + """),
f AS (SELECT v.survivor AS lead_id, l.lead_id AS merged_from, email, phone, whatsapp, instagram FROM v JOIN leads l ON l.lead_id = CASE WHEN v.survivor = v.lead_a THEN v.lead_b ELSE v.lead_a END)
""" + " UNION ALL ".join(f"SELECT lead_id, merged_from, '{c}' AS contact_type, {c} AS value, CAST(0.6 AS DOUBLE) AS confidence FROM f WHERE {_has(c)}" for c in ("email", "phone", "whatsapp", "instagram"))
_KEY = "lead_id, contact_type, coalesce(normalized_value, raw_value) AS value, source_record_type, source_record_id"
add("m2_new_contacts", lambda s, d: merging.new_contacts(table(s, d, "contacts").where("is_primary"), table(s, d, "contacts")),
    f"SELECT * FROM (SELECT {_KEY}, min(contact_id) AS contact_id FROM contacts GROUP BY ALL) n WHERE NOT EXISTS (SELECT 1 FROM (SELECT {_KEY} FROM contacts WHERE is_primary) o WHERE o.lead_id = n.lead_id AND o.contact_type = n.contact_type AND o.value = n.value AND o.source_record_type = n.source_record_type AND o.source_record_id = n.source_record_id)", "contacts")

_STEP = "CASE WHEN cnpj_match_status = 'matched' AND ok THEN 'skip_matched' WHEN cnpj_match_status = 'needs_review' THEN 'skip_review' WHEN ok THEN 'lookup' WHEN " + _has("cnpj") + " THEN 'malformed_id' WHEN last_enriched_at > TIMESTAMP '2024-02-14 00:00:00' THEN 'skip_recent' WHEN " + _has("website") + " THEN 'website_then_search' ELSE 'search' END"
leads_query("e6_registry_step", lambda df: importing.registry_step(df, NOW), f"SELECT lead_id, {_STEP} AS step FROM (SELECT *, coalesce(regexp_full_match(cnpj, '[0-9]{{14}}'), false) AS ok FROM leads)")
leads_query("r8_deferred_searches", lambda df: importing.deferred(importing.registry_step(df, NOW), F.col("lead_id") % 50), f"SELECT lead_id, CASE WHEN row_number() OVER (PARTITION BY lead_id % 50 ORDER BY lead_id) > 8 THEN 'pending_retry' ELSE step END AS step, lead_id % 50 AS batch FROM (SELECT lead_id, {_STEP} AS step FROM (SELECT *, coalesce(regexp_full_match(cnpj, '[0-9]{{14}}'), false) AS ok FROM leads)) WHERE step IN ('search', 'website_then_search')")
leads_query("e9_unassigned_reasons", importing.unassigned_reason, "SELECT lead_id, CASE WHEN sales_region_id IS NULL THEN 'no_sales_region_matched' WHEN market_subsegment_id IS NULL THEN 'no_market_subsegment_matched' WHEN market_segment_id IS NOT NULL THEN 'no_assignment_rule_matched' ELSE 'unassigned_unknown' END AS reason FROM leads WHERE assigned_sales_rep_id IS NULL")


def _annotated(s, d):
    return importing.annotate(table(s, d, "candidates"), table(s, d, "leads"), table(s, d, "exclusion_rules"))


_RULES = """b AS (SELECT item_pos, min(rule_id) AS rule_id FROM candidates JOIN exclusion_rules ON (rule_type = 'exact_name' AND name_key = normalized_pattern) OR (rule_type = 'business_name_contains' AND contains(name_key, normalized_pattern))
 OR (rule_type = 'domain' AND (domain = normalized_pattern OR ends_with(domain, '.' || normalized_pattern))) GROUP BY item_pos)"""
_E1 = ORACLE_SQL["e1_existing_lead"]
_ANNOTATED = oracle("", "exclusion_rules").rstrip() + ",\n" + _E1.removeprefix("WITH ").rsplit("\nSELECT item_pos, lead_id AS existing_lead_id", 1)[0] + ",\n" + _RULES + ",\nx AS (SELECT item_pos, lead_id AS existing_lead_id" + _E1.rsplit("\nSELECT item_pos, lead_id AS existing_lead_id", 1)[1] + ")"
add("e17_preview_annotated", lambda s, d: _annotated(s, d).select("item_pos", "business_name", "is_blocked", "rule_id", "is_existing", "existing_lead_id", "matched_by"))
ORACLE_SQL["e17_preview_annotated"] = _ANNOTATED + " SELECT c.item_pos, c.business_name, b.rule_id IS NOT NULL AS is_blocked, b.rule_id, x.existing_lead_id IS NOT NULL AS is_existing, x.existing_lead_id, x.matched_by FROM candidates c LEFT JOIN b ON c.item_pos = b.item_pos LEFT JOIN x ON c.item_pos = x.item_pos"
add("a15_preview_counters", lambda s, d: importing.preview_counters(_annotated(s, d)))
ORACLE_SQL["a15_preview_counters"] = _ANNOTATED + " SELECT count(*) AS items, count(b.rule_id) AS blocked, count(x.existing_lead_id) AS existing, count(*) FILTER (b.rule_id IS NULL AND x.existing_lead_id IS NULL) AS new FROM candidates c LEFT JOIN b ON c.item_pos = b.item_pos LEFT JOIN x ON c.item_pos = x.item_pos"
add("e15_imported", lambda s, d: importing.importable(_annotated(s, d), matching.preview_groups(table(s, d, "candidates")), 1_000_000).select("lead_id", "item_pos", "business_name"))
ORACLE_SQL["e15_imported"] = "WITH RECURSIVE " + _ANNOTATED.removeprefix("WITH ") + ",\n" + ORACLE_SQL["e2_preview_groups"].split(",\ne AS", 1)[1].join(["e AS", ""]).rsplit("\nSELECT item_pos, min(other)", 1)[0] + """,
g AS (SELECT item_pos, min(other) AS group_pos FROM reach GROUP BY item_pos)
SELECT 1000000 + c.item_pos AS lead_id, c.item_pos, c.business_name FROM candidates c JOIN g ON c.item_pos = g.item_pos AND g.group_pos = c.item_pos LEFT JOIN b ON c.item_pos = b.item_pos LEFT JOIN x ON c.item_pos = x.item_pos WHERE b.rule_id IS NULL AND x.existing_lead_id IS NULL"""
add("m12_upserted_rules", lambda s, d: importing.upserted_rules(table(s, d, "exclusion_rules").where("rule_type <> 'domain'"), table(s, d, "exclusion_rules").where("rule_type <> 'exact_name'").withColumn("rule_id", F.col("rule_id") + 1000)),
    """SELECT coalesce(o.rule_id, n.rule_id) AS rule_id, coalesce(o.rule_type, n.rule_type) AS rule_type, coalesce(o.normalized_pattern, n.normalized_pattern) AS normalized_pattern, coalesce(n.reason, o.reason) AS reason
FROM (SELECT rule_type, normalized_pattern, min(rule_id) AS rule_id, arg_min(reason, rule_id) AS reason FROM exclusion_rules WHERE rule_type <> 'domain' GROUP BY ALL) o FULL JOIN
 (SELECT rule_type, normalized_pattern, min(rule_id) + 1000 AS rule_id, arg_max_null(reason, rule_id) AS reason FROM exclusion_rules WHERE rule_type <> 'exact_name' GROUP BY ALL) n ON o.rule_type = n.rule_type AND o.normalized_pattern = n.normalized_pattern""", "exclusion_rules")
_ASK = "concat(category, ' em ', city, CASE lead_id % 3 WHEN 0 THEN ' - SP' WHEN 1 THEN ', xx' ELSE '' END)"
leads_query("src16_requests", lambda df: df.select("lead_id", F.expr(_ASK).alias("q")).select("lead_id", *[c.alias(k) for k, c in connectors.parse_request(F.col("q")).items()]), "SELECT lead_id, category, city || CASE WHEN lead_id % 3 = 1 THEN ', xx' ELSE '' END AS city, CASE WHEN lead_id % 3 = 0 THEN 'SP' END AS state FROM leads")
add("stream_activity_counts", lambda s, d: activity.activity_counts(table(s, d, "events")), "SELECT date_trunc('hour', ts) AS start, event_type AS action, count(*) AS n FROM events GROUP BY ALL")
leads_query("n7_street_and_number", lambda df: df.select("lead_id", address.split_address(F.concat_ws(" - ", F.concat_ws(", ", "address", "neighborhood"), "city", "state"), *[F.col(c) for c in ("neighborhood", "city", "state", "postal_code")]).alias("x")).select("lead_id", "x.street", "x.number"), "SELECT lead_id, nullif(split_part(address, ', ', 1), '') AS street, nullif(split_part(address, ', ', 2), '') AS number FROM leads")
__all__ = ["ORACLE_SQL", "QUERIES"]
