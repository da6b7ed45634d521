"""Lead filters, searches, lanes and sorts."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.functions.text import present
from leadmill.operators.shared import measured

#: Statuses by their place in the workflow, and the score from which a lead is a priority.
ACTIVE = ("new", "reviewed", "approved", "contacted", "replied", "interested")
FOLLOW_UP = ("contacted", "replied", "interested")
UNCONTACTED = ("new", "reviewed", "approved")
PRIORITY = 70
SEARCHED = ("business_name", "normalized_business_name", "category", "city", "state", "email", "phone", "whatsapp", "instagram", "website", "domain", "cnpj", "legal_name", "blocked_reason", "company_size_fit", "trade_type")
#: Related tables whose names a search reads too: the key of a lead and the key there.
RELATED = {"sales_regions": ("sales_region_id", "region_id"), "market_segments": ("market_segment_id", "segment_id"), "market_subsegments": ("market_subsegment_id", "subsegment_id"), "sales_reps": ("assigned_sales_rep_id", "sales_rep_id")}
SORTED = ("lead_id", "business_name", "city", "state", "status", "lead_score", "created_at", "updated_at", "last_enriched_at", "assigned_at", "company_size_fit", "trade_type")
HAYSTACK = ("business_name", "category", "neighborhood", "city", "state", "website", "email", "phone", "whatsapp", "status", "lead_source_type")


@dataclass(frozen=True)
class LeadFilters:
    """One list request; None leaves a filter out. % and _ in city, state and texts are wildcards."""

    organization_id: int | None = None
    with_shared: bool = False
    blocked: str = "exclude"
    city: str | None = None
    state: str | None = None
    category: str | None = None
    search: str | None = None
    status: str | None = None
    cnpj_match_status: str | None = None
    lead_source_type: str | None = None
    do_not_contact: bool | None = None
    sales_region_id: int | None = None
    market_segment_id: int | None = None
    market_subsegment_id: int | None = None
    assigned_sales_rep_id: int | None = None
    company_size_fit: str | None = None
    trade_type: str | None = None
    assigned: bool | None = None
    score_min: int | None = None
    score_max: int | None = None
    has_email: bool | None = None
    has_whatsapp: bool | None = None
    has_instagram: bool | None = None


EQUAL = ("status", "cnpj_match_status", "lead_source_type", "do_not_contact", "sales_region_id", "market_segment_id", "market_subsegment_id", "assigned_sales_rep_id", "company_size_fit", "trade_type")


def like(c: Column, pattern: str) -> Column:
    return F.coalesce(F.ilike(c, F.lit(pattern.replace("\\", "\\\\"))), F.lit(False))


def condition(f: LeadFilters, searched: tuple[str, ...] = SEARCHED) -> Column:
    """F1 to F8 as one predicate."""
    out = F.lit(True)
    if f.organization_id is not None:
        out &= (F.col("organization_id") == f.organization_id) | (F.col("organization_id").isNull() if f.with_shared else F.lit(False))
    if f.blocked != "include":
        out &= F.col("is_blocked") == (f.blocked == "only")
    for name in ("city", "state"):
        if value := getattr(f, name):
            out &= like(F.col(name), value)
    if f.category:
        out &= like(F.col("category"), f"%{f.category}%")
    if f.search and f.search.strip():
        found = F.lit(False)
        for name in searched:
            found |= like(F.col(name), f"%{f.search.strip()}%")
        out &= found
    for name in EQUAL:
        if (value := getattr(f, name)) is not None:
            out &= F.col(name) == value
    if f.assigned is not None:
        out &= F.col("assigned_sales_rep_id").isNotNull() == f.assigned
    if f.score_min is not None:
        out &= F.col("lead_score") >= f.score_min
    if f.score_max is not None:
        out &= F.col("lead_score") <= f.score_max
    for name in ("email", "whatsapp", "instagram"):
        if (wanted := getattr(f, f"has_{name}")) is not None:
            out &= present(F.col(name)) == wanted
    return out


def filtered(leads: DataFrame, f: LeadFilters, related: dict[str, DataFrame] | None = None) -> DataFrame:
    """F1 to F8; with `related` (tables by the names of RELATED, each with `name`) a search also finds the
    leads whose region, segment, subsegment or representative has the text in its name.

    Only ids of matching rows meet the leads, so the leads are read once; a key that is null,
    or repeats or has no row in its table, finds nothing more and doubles no lead."""
    search = (f.search or "").strip()
    if not search or not related:
        return leads.where(condition(f))
    met, found = leads.where(condition(replace(f, search=None))), condition(LeadFilters(blocked="include", search=search))
    for name, (own, key) in RELATED.items():
        if name in related:
            hits = related[name].where(like(F.col("name"), f"%{search}%") & F.col(key).isNotNull()).select(F.col(key).alias(f"hit_{own}")).distinct()
            met = met.join(measured(hits), F.col(own) == F.col(f"hit_{own}"), "left")
            found |= F.col(f"hit_{own}").isNotNull()
    return met.where(found).select(*leads.columns)


def in_batch(leads: DataFrame, raw: DataFrame, batch_id: int) -> DataFrame:
    """leads that a batch brought."""
    return leads.join(raw.where(F.col("batch_id") == batch_id).select("lead_id"), "lead_id", "left_semi")


def any_contact() -> Column:
    return present(F.col("email")) | present(F.col("whatsapp")) | present(F.col("phone"))


def direct_channel() -> Column:
    return present(F.col("email")) | present(F.col("whatsapp"))


def follow_up_due(today: date) -> Column:
    """F15."""
    return F.coalesce(F.col("follow_up_date") <= F.lit(today), F.lit(False))


def uncontacted() -> Column:
    return F.col("status").isin(*UNCONTACTED) & F.col("last_contacted_at").isNull()


def lane(name: str, today: date) -> Column:
    """the condition of a workflow lane."""
    free = ~F.col("do_not_contact")
    return {
        "Action queue": F.col("status").isin(*UNCONTACTED) & free & any_contact() & (F.col("lead_score") >= PRIORITY),
        "Ready for outreach": F.col("status").isin(*ACTIVE) & free & direct_channel() & (F.col("lead_score") >= PRIORITY),
        "Needs enrichment": F.col("status").isin(*ACTIVE) & free & F.col("last_enriched_at").isNull(),
        "Follow-up due": F.col("status").isin(*FOLLOW_UP) & free & follow_up_due(today),
    }.get(name, F.lit(True))


def quick(hide_duplicates: bool = False, require_contact: bool = False, high_score: bool = False, only_uncontacted: bool = False) -> Column:
    """F11."""
    out = F.lit(True)
    for wanted, c in ((hide_duplicates, ~F.col("is_duplicate")), (require_contact, any_contact()), (high_score, F.col("lead_score") >= PRIORITY), (only_uncontacted, uncontacted())):
        if wanted:
            out &= c
    return out


def matches(term: str) -> Column:
    """the term stands in the joined text of eleven fields; it may span fields."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in HAYSTACK]))
    return F.contains(text, F.lit(term.lower().strip()))


def list_order(key: str, descending: bool = True) -> list[Column]:
    """O1: a known column or updated_at, ties by id the same way."""
    name = key if key in SORTED else "updated_at"
    return [F.col(c).desc() if descending else F.col(c).asc() for c in (name, "lead_id")]


def queue_order(key: str) -> list[Column]:
    """O3."""
    return {
        "highest_priority": [F.desc("lead_score"), F.desc("updated_at"), F.desc("lead_id")],
        "follow_up_date": [F.asc_nulls_last("follow_up_date"), F.desc("lead_score"), F.lower("business_name"), F.col("lead_id")],
        "business_name": [F.lower("business_name"), F.col("lead_id")],
    }.get(key, [F.desc("updated_at"), F.desc("lead_id")])


def queue(leads: DataFrame, view: str, term: str, key: str, today: date, **flags: bool) -> DataFrame:
    """lane, quick filters, search, sort."""
    kept = leads.where(lane(view, today) & quick(**flags))
    return (kept.where(matches(term)) if term.strip() else kept).orderBy(*queue_order(key))


def page(df: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """O2: 1 to 500 rows."""
    return df.offset(offset).limit(max(1, min(500, limit)))


def by_ids(leads: DataFrame, ids: list[int], blocked: str = "include", keep_order: bool = False) -> DataFrame:
    """SRC2 and SRC3: leads by id; in id order, or in the order asked for, first place of a repeated id."""
    wanted = leads.sparkSession.createDataFrame([(x, k) for k, x in enumerate(dict.fromkeys(ids))], "lead_id long, pos int")
    found = leads.where(condition(LeadFilters(blocked=blocked))).join(measured(wanted), "lead_id")
    return found.orderBy("pos" if keep_order else "lead_id").drop("pos")


def filter_names() -> list[str]:
    return [f.name for f in fields(LeadFilters)]
