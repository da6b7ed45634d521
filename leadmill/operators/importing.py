"""Preview annotation, import of candidates, registry next steps, rule and job keys."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadmill.functions.text import present
from leadmill.operators.matching import existing_lead
from leadmill.operators.rules import exclusion_matches

#: Confidence of contacts that come from an import, batch limits, hours between equal searches.
PHONE_TRUST, WHATSAPP_TRUST = 0.9, 0.5
MOST_SEARCHES, REPEAT_HOURS = 8, 24


def annotate(candidates: DataFrame, leads: DataFrame, rules: DataFrame) -> DataFrame:
    """Candidates with is_blocked, rule_id, is_existing, existing_lead_id and matched_by."""
    shaped = candidates.select(F.col("item_pos").alias("lead_id"), "business_name", F.col("name_key").alias("normalized_business_name"), F.lit(None).cast("string").alias("category"), "domain")
    blocked = exclusion_matches(shaped, rules).withColumnRenamed("lead_id", "item_pos")
    out = candidates.join(blocked, "item_pos", "left").join(existing_lead(candidates, leads), "item_pos", "left")
    return out.withColumns({"is_blocked": F.col("rule_id").isNotNull(), "is_existing": F.col("existing_lead_id").isNotNull()})


def importable(annotated: DataFrame, groups: DataFrame, first_id: int) -> DataFrame:
    """The candidates that become leads, neither blocked nor known, the first of each group.

    A new lead's id is the first free id plus its item's position: no counting over all rows."""
    firsts = annotated.join(groups, "item_pos").where("item_pos = group_pos and not is_blocked and not is_existing").drop("group_pos")
    return firsts.withColumn("lead_id", F.lit(first_id) + F.col("item_pos"))


def imported_contacts(imported: DataFrame) -> DataFrame:
    """Phone and WhatsApp contacts of imported leads."""
    each = F.array(F.struct(F.lit("phone").alias("contact_type"), F.lit(PHONE_TRUST).alias("confidence")), F.struct(F.lit("whatsapp").alias("contact_type"), F.lit(WHATSAPP_TRUST).alias("confidence")))
    return imported.where(present(F.col("phone"))).select("lead_id", F.col("phone").alias("value"), F.explode(each).alias("e")).select("lead_id", "value", "e.*")


def registry_step(leads: DataFrame, now: datetime) -> DataFrame:
    """What is to be done for each lead; one ordered decision. Columns used: cnpj, cnpj_match_status, website, last_enriched_at."""
    valid = F.coalesce(F.col("cnpj").rlike("^[0-9]{14}$"), F.lit(False))
    recent = F.coalesce(F.col("last_enriched_at") > F.lit(now) - F.make_dt_interval(F.lit(0), F.lit(REPEAT_HOURS)), F.lit(False))
    step = (
        F.when((F.col("cnpj_match_status") == "matched") & valid, "skip_matched").when(F.col("cnpj_match_status") == "needs_review", "skip_review").when(valid, "lookup")
        .when(present(F.col("cnpj")), "malformed_id").when(recent, "skip_recent").when(present(F.col("website")), "website_then_search").otherwise("search")
    )
    return leads.select("lead_id", step.alias("step"))


def deferred(steps: DataFrame, batch: Column, most: int = MOST_SEARCHES) -> DataFrame:
    """Searches beyond the first of each batch wait for a later run."""
    searches = steps.where(F.col("step").isin("search", "website_then_search")).withColumn("batch", batch)
    place = F.row_number().over(Window.partitionBy("batch").orderBy("lead_id"))
    return searches.withColumn("step", F.when(place > most, "pending_retry").otherwise(F.col("step")))


def job_key(kind: str, *parts: Column) -> Column:
    """Type and 32 hex digits of the SHA-256 of the parts as JSON."""
    return F.concat(F.lit(kind + ":"), F.substring(F.sha2(F.to_json(F.struct(*parts)), 256), 1, 32))


def upserted_rules(rules: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rules by type and pattern; an incoming one takes the id of an equal rule and replaces its reason."""
    key = ["rule_type", "normalized_pattern"]
    new = incoming.groupBy(*key).agg(F.max_by("reason", "rule_id").alias("new_reason"), F.min("rule_id").alias("new_id"))
    old = rules.groupBy(*key).agg(F.min("rule_id").alias("rule_id"), F.min_by("reason", "rule_id").alias("reason"))
    return old.join(new, key, "full").select(F.coalesce("rule_id", "new_id").alias("rule_id"), *key, F.coalesce("new_reason", "reason").alias("reason"))


def unassigned_reason(leads: DataFrame) -> DataFrame:
    """Why a lead has no representative, by the first reason that holds."""
    reason = F.when(F.col("sales_region_id").isNull(), "no_sales_region_matched").when(F.col("market_subsegment_id").isNull(), "no_market_subsegment_matched").when(F.col("market_segment_id").isNotNull(), "no_assignment_rule_matched").otherwise("unassigned_unknown")
    return leads.where("assigned_sales_rep_id is null").select("lead_id", reason.alias("reason"))


def preview_counters(annotated: DataFrame) -> DataFrame:
    """A15."""
    return annotated.agg(F.count("*").alias("items"), F.count_if(F.col("is_blocked")).alias("blocked"), F.count_if(F.col("is_existing")).alias("existing"), F.count_if(~F.col("is_blocked") & ~F.col("is_existing")).alias("new"))


def applied_quality(leads: DataFrame, suggested: DataFrame, overwrite: bool = False) -> DataFrame:
    """Size fit and trade type after applying suggestions: only empty or unknown values change, unless overwritten."""
    met = leads.join(suggested, "lead_id", "left")
    pick = lambda old, new: F.when(F.lit(overwrite) | ~present(F.col(old)) | (F.col(old) == "unknown"), F.coalesce(F.col(new), F.col(old))).otherwise(F.col(old))
    return met.select("lead_id", pick("company_size_fit", "size_fit").alias("company_size_fit"), pick("trade_type", "trade").alias("trade_type"))
