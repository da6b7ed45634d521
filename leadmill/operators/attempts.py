"""Searches of a paid provider: which ones a lead's evidence allows (R2, R3), their signatures (R7), and which of them would be made."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.functions.text import area_code, blank_to_null, clean_email, domain_of, normalize_text, postal_code, state_code
from leadmill.operators.linkage import REVIEW
from leadmill.operators.name_variants import LEGAL_TERMS, with_variants
from leadmill.operators.registry_search import on_cooldown, phone_area, search_domain
from leadmill.operators.shared import materialise, measured

#: Kinds of searches in the order in which they are tried, and whether each is made only while no candidate can be reviewed.
MODES = {"email_domain": False, "alias": False, "names": True, "zip_fallback": True, "address": True, "company_name": True}
#: The most paid calls of a lead by search mode, the provider and its endpoint, the code of active companies.
MOST_CALLS = {"cheap": 1, "balanced": 2, "delivery": 4}
PROVIDER, ENDPOINT, ACTIVE = "cnpja_commercial", "/office", "2"


PLAN = "struct<mode:string,query_param:string,searched:array<string>,params:string,conditional:boolean,domain_source:string>"


@dataclass(frozen=True)
class PlanSettings:
    """What a planner may do; the defaults are those of the settings file."""

    limit: int = 10
    zip_limit: int = 20
    most_attempts: int = 4
    most_paid_calls: int = 4
    email_domain_search: bool = True
    zip_fallback: bool = True
    strict_address: bool = False
    legal_name: bool = False
    email_domain_filter: bool = False
    unmapped_area: bool = True


def search_profiles(leads: DataFrame, municipalities: DataFrame, settings: PlanSettings = PlanSettings()) -> DataFrame:
    """The evidence that searches are built from: lead_id, business_name, state, municipality, postal, neighborhood,
    area, domain, domain_source, and arrays of variants alias, names and legal.

    municipalities: city, state, municipality (code) and area (null where none is known); it is
    broadcast where its measured size allows. Of repeated rows of a city the least code counts."""
    placed = lambda city, state: (normalize_text(city), F.lower(state_code(state)))
    city, state = placed(F.col("city"), F.col("state"))
    known = municipalities.select(city.alias("m_city"), state.alias("m_state"), "municipality", "area").where("m_city is not null and m_state is not null")
    known = known.groupBy("m_city", "m_state").agg(F.min_by(F.struct("municipality", "area"), "municipality").alias("of"))
    own = leads.select("lead_id", "business_name", "category", "city", "state", "postal_code", "address", "neighborhood", "email", "website", "phone", "whatsapp")
    # each field is cleaned once, in a projection below those that use it several times
    clean = with_variants(own).select(
        "lead_id", "business_name", "alias", "names", "legal", city.alias("city_key"), state_code(F.col("state")).alias("state"), clean_email(F.col("email")).alias("mail"), domain_of(F.col("website")).alias("site"),
        F.coalesce(area_code(F.col("phone")), area_code(F.col("whatsapp"))).alias("own_area"), F.coalesce(postal_code(F.col("postal_code")), postal_code(F.col("address"))).alias("postal"), blank_to_null(F.col("neighborhood")).alias("neighborhood"),
    )
    met = clean.join(measured(known.select("m_city", "m_state", "of.*")), (F.col("city_key") == F.col("m_city")) & (F.lower("state") == F.col("m_state")), "left")
    mail_domain = F.when(F.contains("mail", F.lit("@")), F.substring_index("mail", "@", -1))
    domain = search_domain(mail_domain, F.col("site")) if settings.email_domain_search else F.lit(None).cast("struct<domain:string,source:string>")
    told = met.withColumns({"told": domain, "agreed": phone_area(F.col("own_area"), F.col("area"), settings.unmapped_area)})
    return told.select("lead_id", "business_name", "state", "municipality", "postal", "neighborhood", F.col("agreed.area").alias("area"), F.col("told.domain").alias("domain"), F.col("told.source").alias("domain_source"), "alias", "names", "legal")


def _parameters(limit: int, **own: Column) -> Column:
    """R3 with a plan's own parameters: JSON with keys in order; those without a value are left out."""
    given = {"limit": F.lit(str(limit)), "status.id.in": F.lit(ACTIVE), "address.state.in": F.col("state"), "address.municipality.in": F.col("municipality"), **{f"{k}.in".replace("_", "."): v for k, v in own.items()}}
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in sorted(given.items())])
    return F.to_json(F.map_from_entries(F.filter(pairs, lambda p: F.coalesce(p["value"], F.lit("")) != "")))


def _plans(mode: str, s: PlanSettings) -> Column:
    """R2: a profile's plans in order, as an array of structs; equal parameters count once, the first of them."""
    joined = lambda c: F.array_join(c, ",")
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    limit = min(max(1, s.limit), 10)
    alias, names, legal, domain = (F.col(c) for c in ("alias", "names", "legal", "domain"))
    wide, deep = F.lit(mode in ("balanced", "delivery")), F.lit(mode == "delivery")
    by_alias, strict = some(alias), F.slice(F.when(some(alias), alias).otherwise(names), 1, 2)
    filtering = {"emails_domain": domain} if s.email_domain_filter else {}
    company = F.arrays_overlap(F.split(F.coalesce(normalize_text(F.col("business_name")), F.lit("")), " "), F.array(*map(F.lit, LEGAL_TERMS)))
    address = _parameters(limit, alias=F.when(by_alias, joined(strict)), names=F.when(~by_alias, joined(strict)), address_zip=F.col("postal"), address_district=F.col("neighborhood"), **filtering)
    # of each kind: whether it can be made, its parameter, the values looked for and its parameters
    made = {
        "email_domain": (wide & F.lit(s.email_domain_search) & domain.isNotNull(), F.lit("emails.domain.in"), F.array(domain), _parameters(limit, emails_domain=domain)),
        "alias": (by_alias, F.lit("alias.in"), alias, _parameters(limit, alias=joined(alias))),
        "names": (wide & some(names), F.lit("names.in"), names, _parameters(limit, names=joined(names), phones_area=F.col("area"))),
        "zip_fallback": (deep & F.lit(s.zip_fallback) & F.col("postal").isNotNull() & F.col("state").isNotNull(), F.lit(None).cast("string"), F.array("postal"), _parameters(s.zip_limit, address_zip=F.col("postal"))),
        "address": (deep & F.lit(s.strict_address) & F.col("postal").isNotNull() & F.col("neighborhood").isNotNull() & (by_alias | some(names)), F.when(by_alias, "alias.in").otherwise("names.in"), strict, address),
        "company_name": (deep & F.lit(s.legal_name) & some(legal) & company, F.lit("company.name.in"), legal, _parameters(limit, company_name=joined(legal))),
    }
    return F.array_compact(F.array(*[
        F.when(made[k][0], F.struct(
            F.lit(k).alias("mode"), made[k][1].alias("query_param"), made[k][2].alias("searched"), made[k][3].alias("params"), F.lit(later).alias("conditional"),
            (F.col("domain_source") if k == "email_domain" else F.lit(None).cast("string")).alias("domain_source"),
        )) for k, later in MODES.items()
    ]))


def planned(profiles: DataFrame, mode: str, settings: PlanSettings = PlanSettings()) -> DataFrame:
    """One row for each search that a lead's profile allows in a mode (cheap, balanced, delivery), numbered
    by place from 1: lead_id, place, mode, query_param, searched, params (JSON), conditional, domain_source, signature.

    A mode bounds the paid calls. A lead without evidence has no row; nothing is shuffled."""
    most = max(1, min(MOST_CALLS[mode], settings.most_paid_calls, settings.most_attempts))
    plans = _plans(mode, settings)
    distinct = F.aggregate(plans, F.array().cast(f"array<{PLAN}>"), lambda done, x: F.when(F.exists(done, lambda y: y["params"] == x["params"]), done).otherwise(F.concat(done, F.array(x))))
    rows = profiles.select("lead_id", F.posexplode(F.slice(distinct, 1, most)).alias("at", "plan"))
    signature = F.sha2(F.concat_ws("|", F.lit(PROVIDER), F.lit(ENDPOINT), "plan.mode", F.coalesce("plan.query_param", F.lit("")), "plan.params"), 256)
    return rows.select("lead_id", (F.col("at") + 1).alias("place"), "plan.*", signature.alias("signature"))


def executed(plans: DataFrame, outcomes: DataFrame, history: DataFrame, now: datetime) -> DataFrame:
    """Planned searches with their status, as a batch makes them in order of lead_id.

    outcomes: lead_id, mode and the score of each candidate that the search would find;
    history: earlier searches, as on_cooldown() reads them. Status: not_needed (conditional,
    and a search of the lead that was made found a candidate of at least REVIEW),
    skipped_duplicate (an earlier lead of the batch made the same search), skipped_recent
    (the lead's own history has it), executed. Only searches that are made find candidates.

    A search depends on its lead's earlier kinds and on equal searches, which are of its own
    kind; so the batch goes by kind, each a join by signature and one by lead."""
    found = outcomes.groupBy("lead_id", "mode").agg(F.max("score").alias("found"))
    ready = plans.join(found, ["lead_id", "mode"], "left").withColumn("provider", F.lit(PROVIDER))
    ready = materialise(on_cooldown(ready, history, now), "attempts")
    made: list[DataFrame] = []
    for kind, later in MODES.items():
        rows = ready.where(F.col("mode") == kind)
        if later and made:
            best = reduce(lambda a, b: a.unionByName(b), made).where("status = 'executed'").groupBy("lead_id").agg(F.max("found").alias("best"))
            rows = rows.join(best, "lead_id", "left").withColumn("needed", ~F.col("conditional") | (F.coalesce("best", F.lit(0)) < REVIEW)).drop("best")
        else:
            rows = rows.withColumn("needed", F.lit(True))
        firsts = rows.where("needed and not waits").groupBy("signature").agg(F.min("lead_id").alias("first_lead"))
        late = F.coalesce(F.col("lead_id") > F.col("first_lead"), F.lit(False))
        status = F.when(~F.col("needed"), "not_needed").when(late, "skipped_duplicate").when(F.col("waits"), "skipped_recent").otherwise("executed")
        made.append(materialise(rows.join(firsts, "signature", "left").withColumn("status", status).drop("needed", "first_lead"), f"attempts-{kind}"))
    return reduce(lambda a, b: a.unionByName(b), made).drop("waits", "provider")
