"""Aggregates, ordered picks and export rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadmill.functions.address import joined, split_address
from leadmill.functions.text import client_email, own_website, present
from leadmill.operators.filters import LeadFilters, any_contact, condition, follow_up_due


def overview(leads: DataFrame) -> DataFrame:
    """A2."""
    has = lambda c: F.count_if(present(F.col(c)))
    return leads.agg(F.count("*").alias("leads"), has("email").alias("with_email"), has("whatsapp").alias("with_whatsapp"), F.count_if("do_not_contact").alias("do_not_contact"))


def count_with(leads: DataFrame, f: LeadFilters) -> DataFrame:
    """A1: the number of leads that the filters leave, before any page is cut."""
    return leads.where(condition(f)).agg(F.count("*").alias("leads"))


def filter_options(leads: DataFrame, columns: tuple[str, ...] = ("city", "state", "category", "status")) -> DataFrame:
    """Field, value and leads of each value that a filter can offer, in one pass of grouping sets."""
    shown = leads.where(~F.col("is_blocked")).groupingSets([[F.col(c)] for c in columns], *[F.col(c) for c in columns]).agg(F.count("*").alias("leads"), *[F.grouping(c).alias(f"no_{c}") for c in columns])
    field = F.coalesce(*[F.when(F.col(f"no_{c}") == 0, c) for c in columns])
    return shown.select(field.alias("field"), F.coalesce(*columns).alias("value"), "leads").where(present(F.col("value")))


def most_common(counts: DataFrame, key: str, n: str, most: int = 5) -> DataFrame:
    """A10: the most frequent keys, ties by key."""
    return counts.orderBy(F.desc(n), key).limit(most)


def raw_history(raw: DataFrame, leads: DataFrame) -> DataFrame:
    """The raw records of each lead in order of time."""
    place = F.row_number().over(Window.partitionBy("lead_id").orderBy("created_at", "raw_id"))
    return raw.join(leads.select("lead_id"), "lead_id", "left_semi").select("lead_id", "raw_id", "batch_id", place.alias("place"))


def batches_with_leads(batches: DataFrame, raw: DataFrame, leads: DataFrame) -> DataFrame:
    """Completed batches that brought a lead which is there, latest first."""
    met = raw.join(leads.select("lead_id"), "lead_id", "left_semi")
    return batches.where("status = 'completed'").join(met, "batch_id", "left_semi").orderBy(F.desc("completed_at"), F.desc("batch_id"))


def by_organization(leads: DataFrame) -> DataFrame:
    """A3."""
    return leads.groupBy("organization_id").agg(F.count("*").alias("leads"))


def distinct_values(leads: DataFrame, column: str) -> DataFrame:
    """A4: values of unblocked leads, without empty ones."""
    return leads.where(~F.col("is_blocked") & present(F.col(column))).select(F.col(column).alias("value")).distinct()


def queue_stats(leads: DataFrame, today) -> DataFrame:
    """A5."""
    return leads.agg(
        F.count("*").alias("queue_size"), F.count_if(any_contact()).alias("any_contact"),
        F.count_if(F.col("last_enriched_at").isNull() & ~F.col("do_not_contact")).alias("needs_enrichment"), F.count_if(follow_up_due(today)).alias("follow_up_due"),
    )


def export_metadata(leads: DataFrame) -> DataFrame:
    """Counts by state with least, mean and greatest score."""
    return leads.groupBy("state").agg(F.count("*").alias("leads"), F.min("lead_score").alias("least"), F.round(F.avg("lead_score"), 2).alias("mean"), F.max("lead_score").alias("greatest"))


def assignment_counts(leads: DataFrame) -> DataFrame:
    """Leads by representative, region, segment and subsegment in one pass of grouping sets."""
    keys = ["assigned_sales_rep_id", "sales_region_id", "market_segment_id", "market_subsegment_id"]
    sets = leads.groupingSets([[F.col(k)] for k in keys], *[F.col(k) for k in keys]).agg(F.count("*").alias("leads"), F.grouping_id().alias("gid"))
    kind = F.when(F.col("gid") == 7, "rep").when(F.col("gid") == 11, "region").when(F.col("gid") == 13, "segment").otherwise("subsegment")
    none = F.when(kind.isin("rep", "region"), "Unmatched").otherwise("Unclassified")
    return sets.select(kind.alias("kind"), F.coalesce(F.coalesce(*keys).cast("string"), none).alias("label"), "leads")


def best_contact(contacts: DataFrame, for_export: bool = False) -> DataFrame:
    """W1 (confidence first) or W2 (primary first): the contact of each lead and type."""
    order = ["is_primary", "confidence"] if for_export else ["confidence", "is_primary"]
    return contacts.groupBy("lead_id", "contact_type").agg(F.max_by("contact_id", F.struct(*order, "updated_at", "contact_id")).alias("contact_id"))


def export_email(leads: DataFrame, contacts: DataFrame) -> DataFrame:
    """The best contact address that a client may read, else the lead's own if it may, else null."""
    value = F.coalesce("normalized_value", "raw_value")
    kept = contacts.where((F.col("contact_type") == "email") & client_email(value))
    best = kept.groupBy(F.col("lead_id").alias("of")).agg(F.max_by(value, F.struct("is_primary", "confidence", "updated_at", "contact_id")).alias("best"))
    return leads.join(best, leads.lead_id == best["of"], "left").select("lead_id", F.coalesce("best", F.when(client_email(F.col("email")), F.col("email"))).alias("export_email"))


def crm_rows(leads: DataFrame) -> DataFrame:
    """The columns of the export sheet that come from the lead alone; street and number are split by N7 and joined by N6."""
    leads = leads.withColumn("__a", split_address(*[F.col(c) for c in ("address", "neighborhood", "city", "state", "postal_code")]))
    matched = F.col("cnpj_match_status") == "matched"
    return leads.select(
        "lead_id", "business_name", "category", F.when(matched, F.col("cnpj")).alias("cnpj"), F.when(matched, F.col("legal_name")).alias("legal_name"),
        F.col("__a.street").alias("street"), F.col("__a.number").alias("number"), joined(F.col("__a.street"), F.col("__a.number")).alias("street_address"),
        "neighborhood", "city", "state", "postal_code", F.lit("Brasil").alias("country"), "phone", "whatsapp",
        F.when(own_website(F.col("website")), F.col("website")).alias("site"), F.replace(F.col("lead_source_type"), F.lit("_"), F.lit(" ")).alias("source"),
        F.coalesce("owner", F.when(F.col("assigned_sales_rep_id").isNotNull(), F.concat(F.lit("id:"), F.col("assigned_sales_rep_id").cast("string")))).alias("owner"),
        "status", "lead_score",
    )


def first_in_batch(raw: DataFrame, batch_id: int) -> DataFrame:
    """Leads of a batch by the time of their first raw record."""
    return raw.where((F.col("batch_id") == batch_id) & F.col("lead_id").isNotNull()).groupBy("lead_id").agg(F.min(F.struct("created_at", "raw_id")).alias("first")).select("lead_id", F.col("first.raw_id").alias("first_raw_id"))


def latest_batch(batches: DataFrame) -> DataFrame:
    """The completed batch of the latest time, then id."""
    return batches.where("status = 'completed'").agg(F.max(F.struct("completed_at", "batch_id")).alias("b")).select("b.batch_id", "b.completed_at")


def batch_summary(raw: DataFrame, leads: DataFrame) -> DataFrame:
    """Per batch the records, those with a lead, and how those leads stand with the registry."""
    met = raw.join(leads.select("lead_id", "cnpj_match_status"), "lead_id", "left")
    counts = [F.count_if(F.col("cnpj_match_status") == s).alias(s) for s in ("matched", "needs_review", "not_found", "error", "unknown")]
    return met.groupBy("batch_id").agg(F.count("*").alias("records"), F.count("lead_id").alias("with_lead"), *counts)


def nested_contacts(leads: DataFrame, contacts: DataFrame) -> DataFrame:
    """Contacts of each lead as one ordered text: primary first, type, confidence, id."""
    key: list[Column] = [F.when(F.col("is_primary"), 0).otherwise(1).alias("p"), F.col("contact_type"), (-F.col("confidence")).alias("c"), F.col("contact_id")]
    lists = contacts.groupBy(F.col("lead_id").alias("of")).agg(F.array_sort(F.collect_list(F.struct(*key))).alias("x"))
    text = F.array_join(F.transform("x", lambda e: e["contact_id"].cast("string")), "|")
    return leads.join(lists, leads.lead_id == lists["of"], "left").select("lead_id", F.coalesce(F.size("x"), F.lit(0)).alias("n_contacts"), F.coalesce(text, F.lit("")).alias("contact_ids"))
