"""Queries of registry searches, previews, payloads, scopes and drafts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from leadmill.functions import text
from leadmill.operators import activities, importing, linkage, previews, registry_search
from leadmill.plans.lead_queries import _EV, _N1, BATCH, NOW, ORACLE_SQL, QUERIES, _evidence, add, leads_query
from leadmill.sources.domain import oracle, table

_SHARED = lambda c: "(" + f"coalesce({c}, '') = '' OR " + " OR ".join(f"{c} = '{d}' OR ends_with({c}, '.{d}')" for d in registry_search.SHARED_DOMAINS) + ")"
_mail_domain = "CASE c_custkey % 4 WHEN 0 THEN 'GMAIL.com' WHEN 1 THEN concat('loja', CAST(c_custkey AS VARCHAR(20)), '.com.br') WHEN 2 THEN 'mail.yahoo.com' ELSE NULL END"
_site = "CASE c_custkey % 3 WHEN 0 THEN 'https://www.instagram.com/x' WHEN 1 THEN concat('https://www.loja', CAST(c_custkey AS VARCHAR(20)), '.com.br/') ELSE NULL END"
add("n30_search_domain", lambda s, d: table(s, d, "customer").select("c_custkey", registry_search.search_domain(F.expr(_mail_domain), F.expr(_site)).alias("x")).select("c_custkey", "x.domain", "x.source"),
    f"""SELECT c_custkey, CASE WHEN NOT {_SHARED('m')} THEN m WHEN NOT {_SHARED('w')} THEN w END AS domain, CASE WHEN NOT {_SHARED('m')} THEN 'email_domain' WHEN NOT {_SHARED('w')} THEN 'website_domain_as_email_domain' END AS source
FROM (SELECT c_custkey, lower({_mail_domain}) AS m, regexp_replace(regexp_extract({_site}, '://([^/]*)', 1), '^www\\.', '') AS w FROM customer)""")
leads_query("n31_phone_area", lambda df: df.select("lead_id", registry_search.phone_area(text.area_code(F.col("phone")), F.expr("CASE lead_id % 3 WHEN 0 THEN '19' WHEN 1 THEN '21' END"), False).alias("x")).select("lead_id", "x.*"),
    "SELECT lead_id, CASE WHEN a = e THEN a END AS area, coalesce(a <> e, false) AS conflict FROM (SELECT lead_id, substr(phone, -10, 2) AS a, CASE lead_id % 3 WHEN 0 THEN '19' WHEN 1 THEN '21' END AS e FROM leads)")
_CATEGORY = "CASE lead_id % 7 WHEN 0 THEN 'Pet Shop' WHEN 1 THEN 'Loja de MÓVEIS' WHEN 2 THEN 'Material de Construção' WHEN 3 THEN 'Conserto de celular' WHEN 4 THEN 'Oficina' WHEN 5 THEN 'Padaria' END"
_ACTIVITY = "CASE lead_id % 5 WHEN 0 THEN 'Comércio de rações' WHEN 1 THEN 'Comércio de móveis e colchões' WHEN 2 THEN 'Manutenção automotiva' WHEN 3 THEN 'Ferragens e cimento' END"
_ACTIVITY_ID = "CASE lead_id % 4 WHEN 0 THEN '47.89-0/04' WHEN 1 THEN '4520001' END"
_ANY = lambda c, ws: "(" + " OR ".join(f"contains({c}, '{w}')" for w in ws) + ")"
_HINT = "CASE " + " ".join(f"WHEN {_ANY('c', t)} THEN '{k}'" for k, t, _, _ in activities.ACTIVITIES) + " END"
leads_query("n32_activity", lambda df: df.select("lead_id", activities.activity_hint(F.expr(_CATEGORY)).alias("hint"), activities.activity_matches(F.expr(_CATEGORY), F.expr(_ACTIVITY), F.expr(_ACTIVITY_ID)).alias("matches")),
    "SELECT lead_id, hint, coalesce(" + " OR ".join(f"(hint = '{k}' AND (coalesce({_ANY('a', ws)}, false) OR coalesce(i IN ({', '.join(repr(x) for x in ids)}), false)))" for k, _, ids, ws in activities.ACTIVITIES) + f", false) AS matches FROM (SELECT *, {_HINT} AS hint FROM (SELECT lead_id, {_N1(_CATEGORY)} AS c, {_N1(_ACTIVITY)} AS a, regexp_replace({_ACTIVITY_ID}, '[^0-9]', '', 'g') AS i FROM leads))")
add("r17_rejections", lambda s, d: linkage.decide(_evidence(s, d)).select("lead_id", registry_search.rejection_reason(F.col("score"), F.col("reason")).alias("rejection")))
ORACLE_SQL["r17_rejections"] = ORACLE_SQL["e5_decision"].rsplit("\nSELECT lead_id, record_id, score, gap", 1)[0] + " SELECT lead_id, coalesce(reason, CASE WHEN score < 50 THEN 'below_review_threshold' WHEN score < 80 THEN 'below_autofill_threshold' END) AS rejection FROM t"
_MESSAGE = "concat('Error: ', CASE WHEN o_orderkey % 5 = 0 THEN 'Usage LIMIT reached' WHEN o_orderkey % 5 = 1 THEN 'at most 3 calls' ELSE o_orderpriority END)"
add("r18_provider_reasons", lambda s, d: table(s, d, "orders").select("o_orderkey", registry_search.provider_reason(F.expr(_MESSAGE)).alias("reason"), registry_search.provider_reason(F.expr(_MESSAGE), True).alias("search_reason")),
    "SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 2 THEN 'cnpj_provider_rate_limited' ELSE 'provider_error' END AS reason, CASE WHEN o_orderkey % 5 < 2 THEN 'company_search_rate_limited' ELSE 'company_search_provider_error' END AS search_reason FROM orders")
_ATTEMPT = {"lead_id": "o_custkey", "signature": "concat('s', CAST(o_orderkey % 3 AS VARCHAR(20)))", "provider": "CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END", "reason": "CASE o_orderkey % 4 WHEN 0 THEN 'company_search_matched' WHEN 1 THEN 'company_search_no_candidates' ELSE 'company_search_low_confidence' END", "at": "CAST(DATE '2024-02-13' + CAST(o_orderkey % 3 AS INT) AS TIMESTAMP)"}
_ATTEMPTS = "SELECT " + ", ".join(f"{v} AS {k}" for k, v in _ATTEMPT.items()) + " FROM {orders}"
_SEARCH = "SELECT lead_id, concat('s', CAST(lead_id % 3 AS VARCHAR(20))) AS signature, CASE WHEN lead_id % 2 = 0 THEN 'a' ELSE 'b' END AS provider FROM {leads}"
add("r5_cooldown", lambda s, d: registry_search.on_cooldown(s.sql(_SEARCH, leads=table(s, d, "leads")), s.sql(_ATTEMPTS, orders=table(s, d, "orders")), NOW),
    f"SELECT s.*, EXISTS (SELECT 1 FROM ({_ATTEMPTS.format(orders='orders')}) a WHERE a.lead_id = s.lead_id AND a.signature = s.signature AND a.provider = s.provider AND reason IN ({', '.join(repr(r) for r in registry_search.REPEATABLE)}) AND a.at > TIMESTAMP '2024-02-14 00:00:00') AS waits FROM ({_SEARCH.format(leads='leads')}) s", "leads")
add("r9_known_ids", lambda s, d: registry_search.known_id_outcome(table(s, d, "leads").withColumn("cnpj", F.expr("lpad(CAST(lead_id AS VARCHAR(20)), 14, '0')")), table(s, d, "registry")))
_D = [f"CAST(substr(cnpj, {i + 1}, 1) AS INT)" for i in range(14)]
_CHECKS = [f"(CASE WHEN ({e}) % 11 < 2 THEN 0 ELSE 11 - ({e}) % 11 END) = {_D[n]}" for n, e in ((n, " + ".join(f"{_D[i]} * {(n - i - 1) % 8 + 2}" for i in range(n))) for n in (12, 13))]
ORACLE_SQL["r9_known_ids"] = oracle("", "leads", "registry").rstrip() + f""",
a AS (SELECT lead_id, cnpj FROM (SELECT lead_id, lpad(CAST(lead_id AS VARCHAR), 14, '0') AS cnpj FROM leads) WHERE cnpj <> '00000000000000' AND {' AND '.join(_CHECKS)}), f AS (SELECT cnpj, record_id FROM registry QUALIFY row_number() OVER (PARTITION BY cnpj ORDER BY candidate_pos, record_id) = 1)
SELECT lead_id, record_id, CASE WHEN record_id IS NULL THEN 'not_found' ELSE 'matched' END AS status, CAST(CASE WHEN record_id IS NULL THEN 0 ELSE 1 END AS DOUBLE) AS confidence FROM a LEFT JOIN f ON a.cnpj = f.cnpj"""
add("m11_bulk_approvals", lambda s, d: registry_search.approvals(linkage.review_list(_evidence(s, d), most=1 << 30)))
ORACLE_SQL["m11_bulk_approvals"] = oracle("", "leads", "registry").rstrip() + ",\n" + _EV + " SELECT lead_id, min(record_id) AS record_id, CAST(least(max(score), 100) / 100.0 AS DOUBLE) AS confidence FROM sc WHERE score >= 50 AND NOT conflict GROUP BY lead_id HAVING count(*) = 1"
_FOUND = "SELECT cnpj, coalesce(website, 'none') AS url, CASE lead_id % 3 WHEN 0 THEN 'homepage' WHEN 1 THEN 'contact' ELSE 'website_page' END AS page_type, record_id AS pos FROM {registry}"
add("a13_urls_of_ids", lambda s, d: registry_search.urls_of_ids(s.sql(_FOUND, registry=table(s, d, "registry"))).select("cnpj", F.array_join("urls", "|").alias("urls"), F.array_join("page_types", "|").alias("page_types")),
    f"WITH f AS ({_FOUND.format(registry='registry')}), u AS (SELECT cnpj, string_agg(url, '|' ORDER BY p) AS urls FROM (SELECT cnpj, url, min(pos) AS p FROM f GROUP BY ALL) GROUP BY cnpj), t AS (SELECT cnpj, string_agg(page_type, '|' ORDER BY p) AS page_types FROM (SELECT cnpj, page_type, min(pos) AS p FROM f GROUP BY ALL) GROUP BY cnpj) SELECT u.cnpj, urls, page_types FROM u JOIN t ON u.cnpj = t.cnpj", "registry")
ORACLE_SQL["a13_urls_of_ids"] = ORACLE_SQL["a13_urls_of_ids"].replace("\nWITH f AS", ",\nf AS", 1)
add("r22_first_per_id", lambda s, d: registry_search.first_per_id(table(s, d, "registry"), "balanced"), "SELECT cnpj, record_id, 'balanced' AS query_mode FROM registry QUALIFY row_number() OVER (PARTITION BY cnpj ORDER BY candidate_pos, record_id) = 1", "registry")

add("p11_preview_ids", lambda s, d: table(s, d, "candidates").select("item_pos", previews.preview_id(F.lit("oficina"), F.col("domain"), F.col("google_place_id"), F.col("name_key"), F.col("city"), F.col("google_maps_url"), index=F.col("item_pos")).alias("id")),
    "SELECT item_pos, sha1(concat_ws('|', 'oficina', coalesce(domain, ''), coalesce(google_place_id, ''), coalesce(name_key, ''), coalesce(city, ''), coalesce(google_maps_url, ''), CAST(item_pos AS VARCHAR))) AS id FROM candidates", "candidates")
_LABELS = "concat_ws(', ', " + ", ".join("CASE WHEN " + " OR ".join(f"contains(t, strip_accents('{w}'))" for w in text.SIGNALS[k]) + f" THEN '{v}' END" for k, v in previews.SIGNAL_LABELS.items()) + ")"
_BEFORE, _AFTER = previews.SOME_SIGNALS.split("{}")
add("p9_message_context", lambda s, d: table(s, d, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("t")).select("doc_id", *[c.alias(k) for k, c in previews.message_context(F.col("t")).items()]),
    f"SELECT doc_id, CASE WHEN l = '' THEN '{previews.NO_SIGNAL}' ELSE l END AS profile_short_text, CASE WHEN l = '' THEN '{previews.BASIC}' ELSE '{_BEFORE}' || l || '{_AFTER}' END AS profile_text FROM (SELECT doc_id, {_LABELS} AS l FROM (SELECT doc_id, coalesce({_N1('text')}, '') AS t FROM documents))")
add("w3_best_extracted", lambda s, d: previews.best_extracted(table(s, d, "contacts")), "SELECT lead_id, contact_type, contact_id FROM contacts QUALIFY row_number() OVER (PARTITION BY lead_id, contact_type ORDER BY confidence DESC, length(coalesce(normalized_value, raw_value)) DESC, source_record_id DESC, contact_id DESC) = 1", "contacts")
add("n37_payload_values", lambda s, d: table(s, d, "events").select("event_id", previews.payload_value(F.col("props"), "k").cast("long").alias("k"), previews.payload_value(F.col("props"), "k", "deeper").alias("deeper")), "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS deeper FROM events")
add("n38_merged_payloads", lambda s, d: table(s, d, "events").select("event_id", previews.merged_payload(F.to_json(F.struct(F.col("event_type").alias("a"), F.lit("1").alias("k"))), F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise("{}")).alias("merged")), "SELECT event_id, '{\"a\":\"' || event_type || '\",\"k\":\"' || CASE WHEN event_id % 2 = 0 THEN json_extract_string(props, '$.k') ELSE '1' END || '\"}' AS merged FROM events")
add("r35_copied_contacts", lambda s, d: previews.copied_contacts(table(s, d, "contacts"), table(s, d, "leads").where("is_duplicate").select("lead_id", (F.col("lead_id") - F.col("lead_id") % 19 + 1).alias("survivor")), "copied from a duplicate").drop("is_primary"), "SELECT l.lead_id - l.lead_id % 19 + 1 AS lead_id, contact_id AS copied_from, contact_type, raw_value, normalized_value, confidence, 'copied from a duplicate' AS note FROM contacts c JOIN leads l ON c.lead_id = l.lead_id AND l.is_duplicate", "contacts", "leads")
_ASKED = [*range(1, 40), 7, 99999999]
leads_query("e14_scope_of_ids", lambda df: reduce(lambda a, b: a.unionByName(b), [x.select("lead_id", F.lit(k).alias("found")) for k, x in zip((True, False), previews.scope_of_ids(df, _ASKED))]), "SELECT lead_id, true AS found FROM leads WHERE NOT is_blocked AND lead_id BETWEEN 1 AND 39 UNION ALL SELECT i, false FROM (SELECT range AS i FROM range(1, 40) UNION SELECT 99999999) WHERE i NOT IN (SELECT lead_id FROM leads WHERE NOT is_blocked)")
add("e14_scope_of_batch", lambda s, d: previews.scope_of_latest_batch(table(s, d, "leads"), table(s, d, "raw_records"), table(s, d, "batches")).select("lead_id"), "SELECT lead_id FROM leads WHERE NOT is_blocked AND lead_id IN (SELECT lead_id FROM raw_records WHERE batch_id = (SELECT batch_id FROM batches WHERE status = 'completed' ORDER BY completed_at DESC, batch_id DESC LIMIT 1))", "leads", "raw_records", "batches")
add("r34_completed_batch", lambda s, d: previews.completed_batch(table(s, d, "batches"), BATCH).select("batch_id", "record_count"), f"SELECT batch_id, record_count FROM batches WHERE batch_id = {BATCH} AND status = 'completed'", "batches")
_DRAFTS = "SELECT contact_id AS draft_id, lead_id, CASE contact_id % 3 WHEN 0 THEN 'draft' WHEN 1 THEN 'approved' ELSE 'rejected' END AS status, CASE WHEN contact_id % 3 = 1 THEN TIMESTAMP '2024-01-01 00:00:00' END AS approved_at, CASE WHEN contact_id % 3 = 2 THEN 'tone' END AS rejected_reason FROM {contacts}"
_CHANGES = "SELECT contact_id AS draft_id, CASE contact_id % 5 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'draft' END AS new_status, 'late' AS reason FROM {contacts} WHERE contact_id % 2 = 0"
add("m14_draft_states", lambda s, d: previews.drafts_after(s.sql(_DRAFTS, contacts=table(s, d, "contacts")), s.sql(_CHANGES, contacts=table(s, d, "contacts")), NOW),
    f"SELECT d.draft_id, lead_id, coalesce(new_status, status) AS status, CASE WHEN new_status IS NULL THEN approved_at WHEN new_status = 'approved' THEN TIMESTAMP '2024-02-15 00:00:00' END AS approved_at, CASE WHEN new_status IS NULL THEN rejected_reason WHEN new_status = 'rejected' THEN reason END AS rejected_reason FROM ({_DRAFTS.format(contacts='contacts')}) d LEFT JOIN ({_CHANGES.format(contacts='contacts')}) c ON d.draft_id = c.draft_id", "contacts")
add("e15_imported_contacts", lambda s, d: importing.imported_contacts(table(s, d, "candidates").select(F.col("item_pos").alias("lead_id"), "phone")), "SELECT item_pos AS lead_id, phone AS value, k AS contact_type, CAST(CASE k WHEN 'phone' THEN 0.9 ELSE 0.5 END AS DOUBLE) AS confidence FROM candidates, (VALUES ('phone'), ('whatsapp')) v(k) WHERE coalesce(phone, '') <> ''", "candidates")
__all__ = ["ORACLE_SQL", "QUERIES"]
