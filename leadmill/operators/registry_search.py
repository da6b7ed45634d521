"""What a registry search for a lead asks for, whether it may be asked again, and what its outcome means."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.functions.text import blank_to_null, domain_of, normalize_text, valid_company_id
from leadmill.operators.linkage import MATCH, REVIEW
from leadmill.operators.shared import materialise, measured

#: Mail and link hosts by which no company is looked for.
SHARED_DOMAINS = (
    "aol.com", "bit.ly", "blogspot.com", "bol.com.br", "facebook.com", "gmail.com", "instagram.com", "icloud.com", "linktree.com", "linktr.ee", "live.com", "mercadolivre.com.br", "google.com", "googleusercontent.com",
    "hotmail.com", "outlook.com", "proton.me", "protonmail.com", "terra.com.br", "uol.com.br", "whatsapp.com", "wa.me", "wixsite.com", "wordpress.com", "yahoo.com",
)
#: Outcomes of a search after which an equal one is not sent again for some hours, and the confidence for approval in bulk.
REPEATABLE = ("company_search_no_candidates", "cnpja_zero_candidates", "company_search_low_confidence", "company_search_needs_review", "company_search_preview_only")
REPEAT_HOURS, BULK_CONFIDENCE = 24, 0.5


def shared_domain(c: Column) -> Column:
    """no domain, or one of the shared hosts or below it."""
    host = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    hosts = "|".join(map(re.escape, SHARED_DOMAINS))
    return (host == "") | host.rlike(rf"(^|\.)({hosts})$")


def search_domain(mail_domain: Column, site_domain: Column) -> Column:
    """A struct of the domain to look for and where it is from: the mail's unless shared, else the site's."""
    plain = lambda c: F.coalesce(domain_of(c), blank_to_null(F.lower(F.trim(c))))
    mail, site = plain(mail_domain), plain(site_domain)
    told = lambda domain, source: F.struct(domain.alias("domain"), F.lit(source).alias("source"))
    return F.when(~shared_domain(mail), told(mail, "email_domain")).when(~shared_domain(site), told(site, "website_domain_as_email_domain"))


def phone_area(area: Column, expected: Column, allow_unmapped: bool = False) -> Column:
    """A struct of the area to search by and whether it conflicts with the one expected of the city."""
    agreed = F.when(expected.isNull(), area if allow_unmapped else F.lit(None).cast("string")).when(area == expected, area)
    return F.struct(agreed.alias("area"), F.coalesce(area != expected, F.lit(False)).alias("conflict"))


def rejection_reason(score: Column, blocked: Column) -> Column:
    """Why the best candidate was not taken: its block, else the threshold it misses."""
    return F.coalesce(blocked, F.when(score < REVIEW, "below_review_threshold").when(score < MATCH, "below_autofill_threshold"))


def provider_reason(message: Column, company_search: bool = False) -> Column:
    """A code for a provider's error message."""
    limited = F.contains(F.lower(message), F.lit("usage limit")) | F.contains(F.lower(message), F.lit("at most 3"))
    codes = ("company_search_rate_limited", "company_search_provider_error") if company_search else ("cnpj_provider_rate_limited", "provider_error")
    return F.when(limited, codes[0]).otherwise(codes[1])


def on_cooldown(searches: DataFrame, attempts: DataFrame, now: datetime) -> DataFrame:
    """Searches (lead_id, signature, provider) with whether an equal one ran within REPEAT_HOURS and ended so that it need not be repeated.

    attempts: lead_id, signature, provider, reason, at."""
    recent = attempts.where(F.col("reason").isin(*REPEATABLE) & (F.col("at") > F.lit(now) - F.make_dt_interval(F.lit(0), F.lit(REPEAT_HOURS)))).select("lead_id", "signature", "provider").distinct()
    return searches.join(recent.withColumn("waits", F.lit(True)), ["lead_id", "signature", "provider"], "left").withColumn("waits", F.coalesce("waits", F.lit(False)))


def known_id_outcome(leads: DataFrame, records: DataFrame) -> DataFrame:
    """Leads with a valid id: matched with confidence 1 where the registry has it, else not_found.

    Of several records of one id the first in the provider's order counts."""
    # written, so that the check of an id isn't inferred for each record; records of other ids go before they are grouped
    asked = materialise(leads.where(valid_company_id(F.col("cnpj"))).select("lead_id", "cnpj"), "asked_ids")
    wanted = records.join(measured(asked.select("cnpj")), "cnpj", "left_semi")
    first = wanted.groupBy("cnpj").agg(F.min_by("record_id", F.struct("candidate_pos", "record_id")).alias("record_id"))
    met = asked.join(first, "cnpj", "left")
    found = F.col("record_id").isNotNull()
    return met.select("lead_id", "record_id", F.when(found, "matched").otherwise("not_found").alias("status"), F.when(found, 1.0).otherwise(0.0).alias("confidence"))


def approvals(reviewable: DataFrame, least: float = BULK_CONFIDENCE) -> DataFrame:
    """What a bulk approval takes: leads with exactly one reviewable record, of a confidence of at least a half. reviewable: lead_id, record_id, score."""
    one = reviewable.groupBy("lead_id").agg(F.count("*").alias("n"), F.min("record_id").alias("record_id"), F.max("score").alias("score")).where("n = 1")
    confidence = F.least(F.col("score"), F.lit(100)) / 100
    return one.select("lead_id", "record_id", confidence.alias("confidence")).where(F.col("confidence") >= least)


def urls_of_ids(found: DataFrame) -> DataFrame:
    """Cnpj with its distinct urls and page types, each in order of first sight. found: cnpj, url, page_type, pos."""
    firsts = found.groupBy("cnpj", "url").agg(F.min("pos").alias("pos"))
    kinds = found.groupBy("cnpj", "page_type").agg(F.min("pos").alias("pos"))
    listed = lambda df, c: df.groupBy("cnpj").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", c))), lambda x: x[c]).alias(f"{c}s"))
    return listed(firsts, "url").join(listed(kinds, "page_type"), "cnpj")


def first_per_id(records: DataFrame, mode: str) -> DataFrame:
    """The first record of each id, tagged with the search's mode."""
    first = F.struct("candidate_pos", "record_id")
    return records.groupBy("cnpj").agg(F.min_by("record_id", first).alias("record_id")).withColumn("query_mode", F.lit(mode))
