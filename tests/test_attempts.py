"""Planned and executed searches on literal cases."""

import json
from datetime import datetime, timedelta

import pytest

from leadmill.operators import attempts
from leadmill.operators.attempts import PlanSettings
from leadmill.operators.registry_search import REPEATABLE

NOW = datetime(2024, 2, 15)
LEAD = "lead_id long, business_name string, category string, city string, state string, postal_code string, address string, neighborhood string, email string, website string, phone string, whatsapp string"
CITY = "city string, state string, municipality string, area string"
ODILA = (1, "Santa Odila Material de Construção", None, "Londrina", "PR", None, "Av. Higienópolis, 2657 - Guanabara - 86050-000", "Guanabara", "loja1@santaodila.com.br", "https://santaodila.com.br", "(43) 3322-0000", None)


def lead(**changed):
    names = [c.split()[0] for c in LEAD.split(", ")]
    return tuple({**dict(zip(names, ODILA, strict=True)), **changed}[c] for c in names)


@pytest.fixture(scope="module")
def plans(spark):
    def of(mode, *leads, settings=PlanSettings(), cities=(("LONDRINA", "Paraná", "4113700", "43"), ("Campinas", "SP", "3509502", "19"))):
        profiles = attempts.search_profiles(spark.createDataFrame(list(leads), LEAD), spark.createDataFrame(list(cities), CITY), settings)
        return [(r, json.loads(r["params"])) for r in attempts.planned(profiles, mode, settings).orderBy("lead_id", "place").collect()]

    return of


def test_modes(plans):
    modes = lambda *a, **k: [r["mode"] for r, _ in plans(*a, **k)]
    assert modes("cheap", ODILA) == ["alias"] and modes("balanced", ODILA) == ["email_domain", "alias"]
    found = plans("delivery", ODILA, settings=PlanSettings(strict_address=True))
    assert [r["mode"] for r, _ in found] == ["email_domain", "alias", "names", "zip_fallback"] and [r["place"] for r, _ in found] == [1, 2, 3, 4]
    assert [r["conditional"] for r, _ in found] == [False, False, True, True]
    mail, alias, names, postal = (p for _, p in found)
    assert mail == {"limit": "10", "status.id.in": "2", "address.state.in": "PR", "address.municipality.in": "4113700", "emails.domain.in": "santaodila.com.br"}
    assert found[0][0]["domain_source"] == "email_domain" and alias["alias.in"] == ",".join(found[1][0]["searched"])
    assert names["phones.area.in"] == "43" and postal["limit"] == "20" and postal["address.zip.in"] == "86050000" and found[3][0]["query_param"] is None
    assert modes("delivery", ODILA, settings=PlanSettings(most_attempts=3)) == ["email_domain", "alias", "names"] and modes("delivery", ODILA, settings=PlanSettings(most_paid_calls=0)) == ["email_domain"]


def test_later_searches_take_the_places_of_those_that_are_off(plans):
    bare = lead(email=None, website=None)
    found = plans("delivery", bare, settings=PlanSettings(strict_address=True, zip_fallback=False, legal_name=True))
    assert [r["mode"] for r, _ in found] == ["alias", "names", "address", "company_name"]
    assert found[2][1]["address.district.in"] == "Guanabara" and found[2][1]["alias.in"].count(",") <= 1 and "emails.domain.in" not in found[2][1]
    filtering = plans("delivery", lead(), settings=PlanSettings(strict_address=True, zip_fallback=False, email_domain_filter=True))
    assert filtering[3][1]["emails.domain.in"] == "santaodila.com.br"
    off = plans("delivery", ODILA, settings=PlanSettings(email_domain_search=False))
    assert "email_domain" not in {r["mode"] for r, _ in off}


@pytest.mark.parametrize(("website", "email", "domain"), [("https://sofal.com.br", "loja@gmail.com", "sofal.com.br"), ("https://facebook.com/empresa", "contato@gmail.com", None), ("https://wa.me/5511999999999", "contato@yahoo.com", None), (None, "no address", None)])
def test_shared_domains_are_not_searched(plans, website, email, domain):
    found = [(r["domain_source"], p["emails.domain.in"]) for r, p in plans("balanced", lead(website=website, email=email)) if r["mode"] == "email_domain"]
    assert found == ([("website_domain_as_email_domain", domain)] if domain else [])


@pytest.mark.parametrize(("city", "phone", "unmapped", "area"), [("Campinas", "(19) 3333-4444", True, "19"), ("Campinas", "(99) 3333-4444", True, None), ("Cidade Inventada", "(17) 3333-4444", True, "17"), ("Cidade Inventada", "(17) 3333-4444", False, None)])
def test_area_is_checked_against_the_city(plans, city, phone, unmapped, area):
    found = plans("delivery", lead(city=city, state="SP", phone=phone, website=None, email=None), settings=PlanSettings(unmapped_area=unmapped))
    names = next(p for r, p in found if r["mode"] == "names")
    assert names.get("phones.area.in") == area and names.get("address.municipality.in") == ("3509502" if city == "Campinas" else None)


def test_nothing_known_and_repeated_cities(plans, spark):
    assert plans("delivery", (7, *[None] * 11)) == [] and plans("delivery", lead(business_name="", email="", website="", postal_code="", address="", neighborhood="")) == []
    assert attempts.planned(attempts.search_profiles(spark.createDataFrame([], LEAD), spark.createDataFrame([], CITY)), "delivery").count() == 0
    found = plans("cheap", ODILA, cities=[("Londrina", "PR", "2", "43"), ("londrina", "pr", "1", None), (None, "PR", "0", None)])
    assert [p["address.municipality.in"] for _, p in found] == ["1"]


PLAN = "lead_id long, place int, mode string, query_param string, searched array<string>, params string, conditional boolean, domain_source string, signature string"
HISTORY = "lead_id long, signature string, provider string, reason string, at timestamp"


def status(spark, plans, outcomes=(), history=()):
    rows = [(k, i, mode, None, [], "{}", attempts.MODES[mode], None, f"{mode}-{sign}") for i, (k, mode, sign) in enumerate(plans)]
    past = [(k, s, attempts.PROVIDER, reason, NOW - timedelta(hours=h)) for k, s, reason, h in history]
    made = attempts.executed(spark.createDataFrame(rows, PLAN), spark.createDataFrame(list(outcomes), "lead_id long, mode string, score int"), spark.createDataFrame(past, HISTORY), NOW)
    return {(r["lead_id"], r["mode"]): r["status"] for r in made.collect()}


def test_a_reviewable_candidate_ends_the_searches(spark):
    plans = [(k, m, k) for k in (1, 2, 3, 4) for m in ("alias", "names", "zip_fallback")]
    found = status(spark, plans, [(1, "alias", 50), (1, "alias", None), (2, "alias", 49), (2, "names", 90), (3, "zip_fallback", 99)])
    assert [found[1, m] for m in ("alias", "names", "zip_fallback")] == ["executed", "not_needed", "not_needed"]
    assert [found[2, m] for m in ("alias", "names", "zip_fallback")] == ["executed", "executed", "not_needed"]
    assert all(found[k, m] == "executed" for k in (3, 4) for m in ("alias", "names", "zip_fallback"))


def test_equal_searches_of_a_batch_and_recent_ones(spark):
    plans = [(1, "alias", "a"), (1, "names", 1), (2, "alias", "a"), (2, "names", "n"), (3, "alias", "a"), (3, "names", "n"), (4, "alias", "b"), (5, "alias", "b"), (6, "alias", "c"), (7, "alias", "d")]
    history = [(1, "alias-a", REPEATABLE[0], 1), (4, "alias-b", REPEATABLE[0], 25), (6, "alias-c", "no such reason", 1), (7, "alias-x", REPEATABLE[0], 1)]
    found = status(spark, plans, [(1, "alias", 90), (2, "alias", 90), (3, "alias", 90)], history)
    # lead 1 waits, so its candidate is not found and lead 2 makes the search; lead 3's is a repeat that finds nothing
    assert (found[1, "alias"], found[2, "alias"], found[3, "alias"]) == ("skipped_recent", "executed", "skipped_duplicate")
    assert (found[1, "names"], found[2, "names"], found[3, "names"]) == ("executed", "not_needed", "executed")
    assert (found[4, "alias"], found[5, "alias"], found[6, "alias"], found[7, "alias"]) == ("executed", "skipped_duplicate", "executed", "executed")


def test_no_searches(spark):
    assert status(spark, []) == {}
