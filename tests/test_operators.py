"""Operators on literal cases."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from leadmill.operators import extraction, filters, linkage, matching, merging, rules, scoring
from leadmill.sources import connectors
from leadmill.streaming import activity

PAGE = """<html><head><script>var a = "no@script.com";</script></head><body><a href="mailto:Ana@Loja.com?subject=x">Mail</a>
<a href="tel:(11) 98765-4321">Fone WhatsApp</a><a href="https://wa.me/5511912345678">chat</a><a href="/contato#x">Contato</a>
<a href="https://instagram.com/loja/">foto</a><span data-cfemail="{hidden}"></span><p>vendas@loja.com ou vendas2 @ loja . com . br</p>
<p>suporte [arroba] loja (ponto) com</p><p>WhatsApp: 11 93333-4444</p><form action="/enviar"></form><p>Delivery e agendamento</p></body></html>"""


def test_page_evidence(spark):
    hidden = "42" + "".join(f"{ord(c) ^ 0x42:02x}" for c in "oculto@loja.com")
    pages = spark.createDataFrame([(1, "https://loja.com/a/b", PAGE.replace("{hidden}", hidden)), (2, None, None), (3, "x", "")], "page_id long, url string, html string")
    rows = extraction.evidence(pages).collect()
    found = {(r["type"], r["value"]): r["confidence"] for r in rows}
    assert {r["page_id"] for r in rows} == {1}
    assert found["email", "ana@loja.com"] == 0.98 and found["email", "oculto@loja.com"] == 0.9 and found["email", "vendas@loja.com"] == 0.92
    assert found["email", "vendas2@loja.com.br"] == 0.9 and found["email", "suporte@loja.com"] == 0.82
    assert found["phone", "+5511987654321"] == 0.96 and found["whatsapp", "+5511987654321"] == 0.88 and found["whatsapp", "+5511912345678"] == 0.99
    assert found["whatsapp", "+5511933334444"] == 0.86 and found["phone", "+5511933334444"] == 0.78
    assert found["instagram", "https://instagram.com/loja"] == 0.93
    assert found["contact_form", "https://loja.com/contato"] == 0.55 and found["contact_form", "https://loja.com/enviar"] == 0.84


@pytest.mark.parametrize(
    ("mask", "wanted"),
    [(1, 1.0), (2 | 16, 0.82), (4 | 16, 0.82), (2 | 4, 0.9), (2 | 8, 0.88)],
)
def test_confidence_rounds_as_binary_floats(mask, wanted):
    assert matching.confidence_of(mask) == wanted


def leads(spark, rows):
    names = ["lead_id", "business_name", "normalized_business_name", "city", "address", "neighborhood", "google_place_id", "google_maps_url", "domain", "website", "phone", "whatsapp", "is_duplicate", "is_blocked", "updated_at"]
    base = dict.fromkeys(names) | {"is_duplicate": False, "is_blocked": False, "updated_at": datetime(2024, 1, 1)}
    types = {"lead_id": "long", "is_duplicate": "boolean", "is_blocked": "boolean", "updated_at": "timestamp"}
    return spark.createDataFrame([tuple((base | r)[n] for n in names) for r in rows], ", ".join(f"{n} {types.get(n, 'string')}" for n in names))


def test_cascade_continues_past_an_unresolved_rung(spark):
    known = leads(spark, [
        {"lead_id": 1, "business_name": "Padaria A", "city": "X", "domain": "d.com", "phone": "+551"}, {"lead_id": 2, "business_name": "Padaria B", "city": "X", "domain": "d.com", "phone": "+552"},
        {"lead_id": 3, "business_name": None, "city": "X", "phone": "+552"}, {"lead_id": 4, "business_name": "Gone", "city": "X", "phone": "+553", "is_duplicate": True},
    ])
    cols = "item_pos long, name_key string, city_key string, address_key string, neighborhood_key string, google_place_id string, google_maps_url string, domain string, phone string"
    asked = spark.createDataFrame([(1, "padaria z", "x", None, None, None, None, "d.com", "+551"), (2, "n", "x", None, None, None, None, "d.com", "+552"), (3, "padaria b", "x", None, None, None, None, None, None), (4, "n", "y", None, None, None, None, None, "+551"), (5, "n", "x", None, None, None, None, None, "+553")], cols)
    out = {r["item_pos"]: (r["existing_lead_id"], r["matched_by"]) for r in matching.existing_lead(asked, known).collect()}
    assert out == {1: (1, "phone"), 3: (2, "name_city")}


def test_pairs_need_two_reasons_or_one_place(spark):
    rows = [{"lead_id": 1, "phone": "p", "domain": "d"}, {"lead_id": 2, "phone": "p", "domain": "d"}, {"lead_id": 3, "phone": "p"}, {"lead_id": 4, "google_place_id": "g"}, {"lead_id": 5, "google_place_id": "g", "domain": "", "phone": ""}, {"lead_id": 6, "domain": "", "phone": ""}]
    pairs = {(r["lead_a"], r["lead_b"]): r["confidence"] for r in matching.duplicate_pairs(leads(spark, rows)).collect()}
    assert pairs == {(2, 1): 0.88, (5, 4): 1.0}
    chain = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (9, 8)], "lead_a long, lead_b long")
    assert {r["lead_id"]: r["cluster"] for r in merging.clusters(chain).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8}


def test_exclusion_by_sub_domain_and_least_rule(spark):
    df = spark.createDataFrame([(1, "Loja Um", "loja um", None, "a.b.com"), (2, "Outra", "outra", "Mercado!", "xb.com")], "lead_id long, business_name string, normalized_business_name string, category string, domain string")
    ruled = spark.createDataFrame([(5, "domain", "b.com"), (3, "business_name_contains", "ja u"), (7, "provider_category", "mercado")], "rule_id long, rule_type string, normalized_pattern string")
    assert {r["lead_id"]: r["rule_id"] for r in rules.exclusion_matches(df, ruled).collect()} == {1: 3, 2: 7}


def test_lane_and_next_action(spark):
    df = spark.createDataFrame([(1, "new", "a@b.c", None, None, False, 80, None, None, None), (2, "contacted", None, "+55", None, False, 80, datetime(2024, 1, 1), date(2024, 1, 1), None)], "lead_id long, status string, email string, phone string, whatsapp string, do_not_contact boolean, lead_score int, last_enriched_at timestamp, follow_up_date date, last_contacted_at timestamp")
    today = date(2024, 1, 2)
    assert [r["lead_id"] for r in df.where(filters.lane("Ready for outreach", today)).collect()] == [1]
    assert [r["lead_id"] for r in df.where(filters.lane("Follow-up due", today)).collect()] == [2]
    assert [r[0] for r in df.orderBy("lead_id").select(scoring.next_action(today)).collect()] == ["review", "follow_up"]


def test_decision_of_registry_linkage(spark):
    cols = "record_id long, lead_id long, candidate_pos int, cnpj string, full_cnpj boolean, score int, support int, identity boolean, conflict boolean"
    rows = [(1, 1, 1, "a", True, 95, 2, True, False), (2, 1, 2, "b", True, 80, 1, True, False), (3, 2, 1, "a", True, 85, 2, True, False), (4, 2, 2, "b", True, 85, 2, True, False), (5, 3, 1, "a", True, 60, 0, True, False), (6, 4, 1, "a", True, 90, 1, True, True), (7, 5, 1, "a", False, 55, 1, True, False)]
    out = {r["lead_id"]: (r["record_id"], r["status"], r["confidence"]) for r in linkage.decide(spark.createDataFrame(rows, cols)).collect()}
    assert out == {1: (1, "matched", 0.95), 2: (3, "needs_review", 0.85), 3: (5, "needs_review", 0.6), 4: (6, "needs_review", 0.9), 5: (7, "not_found", 0.55)}


def test_trade_and_template(spark):
    df = spark.createDataFrame([("mega loja online e atacado", None), ("atacadista central", "varejo"), ("lojao", None)], "t string, s string")
    assert [r[0] for r in df.select(scoring.trade_type(F.col("t"), F.col("s"))).collect()] == ["ecommerce", "varejo", "unknown"]
    assert df.limit(1).select(merging.rendered("Oi {name}, {none}!", {"name": F.lit("Ana")})).first()[0] == "Oi Ana, !"
    kept = df.limit(1).select(merging.redacted(F.create_map(F.lit("API_KEY"), F.lit("x"), F.lit("city"), F.lit("y")))).first()[0]
    assert kept == {"API_KEY": "[redacted]", "city": "y"}


def test_rule_file_and_export(spark, tmp_path):
    (tmp_path / "rules.csv").write_text("﻿rule_type,pattern,reason,is_active\ndomain,https://www.Loja.com/x,r,true\nexact_name,  ,r,true\nexact_name,São João,,no\n", encoding="utf-8")
    out = {(r["rule_type"], r["normalized_pattern"], r["is_active"]) for r in connectors.read_exclusion_rules(spark, str(tmp_path / "rules.csv")).collect()}
    assert out == {("domain", "loja.com", True), ("exact_name", "sao joao", False)}
    df = spark.createDataFrame([('say "x"', ["a", "b"])], "t string, l array<string>")
    connectors.write_csv(df.coalesce(1), str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("part-*")).read_text()
    assert text.splitlines() == ['"t","l"', '"say ""x""","a|b"']


def test_payload(spark):
    payload = '{"id":"p1","displayName":{"text":"Loja"},"internationalPhoneNumber":"+55 11 98765-4321","websiteUri":"https://www.loja.com","addressComponents":[{"longText":"Campinas","shortText":"C","types":["locality"]},{"longText":"Sao Paulo","shortText":"SP","types":["administrative_area_level_1"]}]}'
    r = connectors.place_candidates(spark.createDataFrame([(payload,), (None,)], "payload string")).collect()
    assert (r[0]["google_place_id"], r[0]["city"], r[0]["state"], r[0]["domain"], r[0]["phone"]) == ("p1", "Campinas", "SP", "loja.com", "+5511987654321")
    assert r[1]["google_place_id"] is None


def test_activity_stream(spark, tmp_path):
    spark.createDataFrame([(datetime(2024, 1, 1, 10, 5), "edit"), (datetime(2024, 1, 1, 10, 50), "edit")], "ts timestamp, event_type string").write.parquet(f"{tmp_path}/in")
    log = spark.readStream.schema("ts timestamp, event_type string").parquet(f"{tmp_path}/in")
    activity.append_batches(log, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(120)
    copied = spark.read.parquet(f"{tmp_path}/out")
    assert activity.activity_counts(copied).collect()[0]["n"] == 2


def test_contained_finds_every_pattern(spark):
    """Against all pairs: patterns of any length, repeated, empty and null, and texts without them."""
    from leadmill.operators.containment import contained

    texts = ["oficina mecanica", "oficina", "padaria bela vista", "a", "", None, "oficina", "ab", "mecanica a"]
    patterns = ["oficina", "mec", "a", "el", "", None, "zzz", "nica a", "oficina", "padaria bela vista e mais"]
    found = contained(spark.createDataFrame([(t,) for t in texts], "t string"), "t", spark.createDataFrame([(p,) for p in patterns], "p string"), "p").collect()
    assert {tuple(r) for r in found} == {(t, p) for t in texts for p in patterns if t and p and p in t} and len(found) == len({tuple(r) for r in found})


def test_records_compared_by_their_fields(spark):
    """A record with the lead's mail domain, phone, name, street and place; one that shares nothing; one without fields."""
    names = "lead_id long, business_name string, category string, website string, domain string, email string, phone string, whatsapp string, address string, neighborhood string, city string, state string, postal_code string"
    lead = (1, "Padaria Bela Vista", "Pet shop", None, None, "Ana@BelaVista.com.br", "(11) 98765-4321", None, "Rua A, 10 - Centro", "Centro", "Porto Alegre", "RS", None)
    fields = "record_id long, lead_id long, candidate_pos int, cnpj string, full_cnpj boolean, trade_name string, legal_name string, website string, email string, phone string, address string, neighborhood string, city string, state string, postal_code string, activity string"
    records = [
        (1, 1, 1, "1", True, "PADARIA BELA VISTA", "Bela Vista Paes Ltda", "https://www.belavista.com.br/x", None, "+55 11 98765 4321", "Rua A, 10", "CENTRO", "porto alegre", "Rio Grande do Sul", "90650-001", "Comércio de rações"),
        (2, 1, 2, "2", True, "Outra", "Maria da Silva", None, "x@y.com", "(21) 3333-0000", "Av. B, 12", None, "Rio", "RJ", None, None),
        (3, 1, 3, "3", False, *[None] * 11),
    ]
    out = {r["record_id"]: r.asDict() for r in linkage.compared(spark.createDataFrame([lead], names), spark.createDataFrame(records, fields)).collect()}
    assert [out[1][k] for k in ("same_domain", "same_phone", "same_street", "same_neighborhood", "same_activity")] == [True] * 5
    assert (out[1]["alias_match"], out[1]["number_match"], out[1]["city_match"], out[1]["state_match"], out[1]["brand_in_legal"]) == ("equal", "equal", "equal", "equal", "some")
    assert (out[2]["same_domain"], out[2]["alias_match"], out[2]["city_match"], out[2]["state_match"], out[2]["person_like"]) == (False, "none", "different", "different", True)
    assert (out[3]["alias_match"], out[3]["number_match"], out[3]["city_match"], out[3]["person_like"]) == ("none", "missing", "missing", False)
    scored = {r["record_id"]: r for r in linkage.evidence(linkage.compared(spark.createDataFrame([lead], names), spark.createDataFrame(records, fields))).collect()}
    assert scored[1]["score"] == 40 + 35 + 25 + 10 + 15 + 10 + 10 + 15 + 10 + 8 and scored[2]["score"] == 0 and scored[3]["score"] == 0


def test_subsegment_takes_the_first_with_a_keyword(spark):
    from leadmill.operators import assignment

    taxonomy = spark.createDataFrame([(1, 9, "b", 2, ["padaria"]), (2, 9, "a", 1, ["Pão", "VISTA", "bela"]), (3, 8, "c", 0, [None, "", "zz"])], "subsegment_id long, segment_id long, name string, sort_order int, keywords array<string>")
    rows = spark.createDataFrame([(1, "Padaria Bela Vista", None, None, None, None), (2, "Padaria", None, None, None, None), (3, None, None, None, None, None)], "lead_id long, business_name string, normalized_business_name string, category string, website string, domain string")
    out = {r["lead_id"]: (r["subsegment_id"], r["keywords"]) for r in assignment.matching_subsegment(rows, taxonomy).collect()}
    assert out == {1: (2, ["VISTA", "bela"]), 2: (1, ["padaria"])}
