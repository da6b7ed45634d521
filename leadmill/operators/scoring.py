"""Lead score, size fit and trade type, contact state, next action."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.functions.text import first_signal, normalize_text, present
from leadmill.operators.filters import FOLLOW_UP, any_contact, direct_channel, follow_up_due

#: Names of large chains and words that tell a trade, in order of precedence.
LARGE_CHAINS = ("walmart", "carrefour", "atacadao", "assai", "magazine luiza", "mercado livre", "amazon", "shopee", "americanas", "casas bahia", "madeira madeira", "pao de acucar", "extra hipermercado", "hipermercado extra")
LARGE_CATEGORIES = ("hipermercado", "megastore", "shopping center", "shopping mall")
TRADES = (
    ("ecommerce", ("e commerce", "ecommerce", "loja online", "online store", "marketplace")),
    ("distribuidora", ("distribuidora", "distribuicao", "distributor")),
    ("atacado", ("atacado", "atacadista", "wholesale")),
    ("industria", ("industria", "industrial", "fabrica", "manufacturer", "manufatura")),
    ("varejo", ("loja", "store", "boutique", "showroom", "retail")),
)
SEGMENT_TRADES = {"varejo": "varejo", "e_commerce": "ecommerce", "industria": "industria", "construcao_civil": "construcao_civil"}


def _points(c: Column, n: int) -> Column:
    return F.when(c, n).otherwise(0)


def score_parts(now: datetime, rating: Column | None = None, reviews: Column | None = None) -> dict[str, Column]:
    """The twelve parts of the score."""
    has = lambda c: present(F.col(c))
    site, listing = has("website") | has("domain"), has("google_maps_url") | has("google_place_id")
    core = [*map(has, ("business_name", "category", "city", "state", "address", "phone")), site, has("email"), has("whatsapp"), listing]
    age = F.greatest(F.lit(0), F.floor((F.unix_timestamp(F.lit(now)) - F.unix_timestamp("last_enriched_at")) / 86400))
    source = F.col("lead_source_type")
    positive = lambda c: F.lit(False) if c is None else F.coalesce(c > 0, F.lit(False))
    return {
        "has_email": _points(has("email"), 14),
        "has_phone": _points(has("phone"), 14),
        "has_whatsapp": _points(has("whatsapp"), 9),
        "has_website": _points(site, 12),
        "has_address": _points(has("address"), 10),
        "has_map_listing": _points(listing, 8),
        "location_completeness": _points(has("city") & has("state"), 4) + _points(has("postal_code"), 1) + _points(has("neighborhood"), 1),
        "core_field_completeness": F.least(F.lit(8), sum((c.cast("int") for c in core), F.lit(0))),
        "source_reliability": F.when(source == "google_places", F.when(listing, 5).otherwise(3)).when(source == "website", F.when(site, 5).otherwise(3)).when(source.isin("manual_import", "merged"), 4).when(source == "demo_seed", 1).otherwise(0),
        "freshness": F.when(F.col("last_enriched_at").isNull(), 0).when(age <= 30, 4).when(age <= 180, 2).otherwise(0),
        "reputation_signals": _points(positive(rating), 2) + _points(positive(reviews), 2),
        "not_duplicate": _points(~F.col("is_duplicate"), 6),
    }


def score(leads: DataFrame, now: datetime) -> DataFrame:
    """lead_id, total score within 0 to 100 and its parts."""
    parts = score_parts(now)
    total = sum(parts.values(), F.lit(0))
    return leads.select("lead_id", F.least(F.lit(100), F.greatest(F.lit(0), total)).alias("score"), *[c.alias(k) for k, c in parts.items()])


def trade_type(text: Column, segment: Column | None = None, subsegment_text: Column | None = None) -> Column:
    """The trade told by the segment, else by the first list with a word in the text."""
    found = F.coalesce(*[F.when(first_signal(text, words).isNotNull(), name) for name, words in TRADES], F.lit("unknown"))
    if segment is None:
        return found
    both = F.concat_ws(" ", subsegment_text if subsegment_text is not None else F.lit(""), text)
    wholesale = F.when(first_signal(both, TRADES[1][1]).isNotNull(), "distribuidora").when(first_signal(both, TRADES[2][1]).isNotNull(), "atacado").otherwise("unknown")
    out = F.when(segment == "atacado_distribuidora", wholesale)
    for key, trade in SEGMENT_TRADES.items():
        out = out.when(segment == key, trade)
    return out.otherwise(found)


def size_fit(text: Column, trade: Column) -> Column:
    """Large chains first, then contacts, place and classification."""
    count = lambda *cs: sum((c.cast("int") for c in cs), F.lit(0))
    has = lambda c: present(F.col(c))
    contacts = count(has("email"), has("phone"), has("whatsapp"), has("website") | has("domain"))
    places = count(has("city"), has("state"), has("address"))
    known = F.col("market_segment_id").isNotNull() | F.col("market_subsegment_id").isNotNull()
    return (
        F.when(first_signal(text, LARGE_CHAINS).isNotNull() | first_signal(text, LARGE_CATEGORIES).isNotNull(), "large_enterprise")
        .when((contacts >= 2) & (places >= 1), "ideal_sme")
        .when(known & (contacts >= 1) & (places >= 1), "ideal_sme")
        .when((contacts >= 1) | (places >= 1) | known | (trade != "unknown"), "possible_sme")
        .otherwise("unknown")
    )


def classify(leads: DataFrame) -> DataFrame:
    text = normalize_text(F.concat_ws(" ", "business_name", "category", "domain"))
    trade = trade_type(text)
    return leads.select("lead_id", size_fit(text, trade).alias("size_fit"), trade.alias("trade"))


def contact_state(leads: DataFrame) -> DataFrame:
    """P5."""
    has = {c: present(F.col(c)) for c in ("email", "phone", "whatsapp")}
    n = lambda *cs: sum((has[c].cast("int") for c in cs), F.lit(0))
    return leads.select("lead_id", *[c.alias(f"has_{k}") for k, c in has.items()], direct_channel().alias("has_direct_channel"), any_contact().alias("has_any_contact"), n("email", "phone", "whatsapp").alias("contact_count"), n("email", "whatsapp").alias("direct_channel_count"))


def next_action(today: date) -> Column:
    """A short key of the next step, by the first rule that holds."""
    return (
        F.when(F.col("do_not_contact"), "blocked").when(F.col("status") == "new", "review").when(F.col("last_enriched_at").isNull(), "enrich")
        .when(follow_up_due(today), "follow_up").when(direct_channel(), "draft").when(any_contact(), "phone_only").otherwise("note")
    )


def default_template(keys: tuple[str, ...]) -> Column:
    """The template for the status and the channel at hand, else the first."""
    follow, out = F.col("status").isin(*FOLLOW_UP), F
    for wanted, kind in ((follow, "follow_up"), (~follow, "cold")):
        for channel in ("email", "whatsapp"):
            if f"{kind}_{channel}" in keys:
                out = out.when(wanted & present(F.col(channel)), f"{kind}_{channel}")
    return F.lit(keys[0]) if out is F else out.otherwise(keys[0])
