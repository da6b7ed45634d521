"""Taxonomy by keywords, suggested assignments and the report that validates them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.functions.text import normalize_text
from leadmill.operators.containment import with_contained
from leadmill.operators.rules import matching_region, matching_rule

#: Keywords that fit too many businesses to tell one, and subsegments that one of them is not enough for.
BROAD_KEYWORDS = ("marketplace", "loja virtual", "e commerce", "ecommerce", "marmore", "granito", "refrigeracao", "climatizacao", "ar condicionado")
BROAD_SUBSEGMENTS = ("marketplace / loja virtual", "refrigeração")


def lead_text() -> Column:
    """The text in which keywords are looked for."""
    return normalize_text(F.concat_ws(" ", "business_name", "normalized_business_name", "category", "website", "domain"))


def matching_subsegment(leads: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """lead_id, and of the first subsegment by (sort_order, name, id) with a keyword in the lead's text
    its id, its segment's, and its keywords that stand there, in the order listed.

    taxonomy: subsegment_id, segment_id, name, sort_order, keywords (array). Each
    keyword is looked for once, however many subsegments share it."""
    listed = taxonomy.select("subsegment_id", "segment_id", "name", "sort_order", F.posexplode("keywords").alias("place", "keyword"))
    listed = listed.withColumn("pattern", normalize_text(F.col("keyword"))).where("pattern is not null")
    texts = leads.select("lead_id", lead_text().alias("text")).where("text is not null")
    met = with_contained(texts, "text", listed, "pattern").join(listed, "pattern")
    each = met.groupBy("lead_id", "subsegment_id", "segment_id", "name", "sort_order").agg(F.array_sort(F.collect_list(F.struct("place", "keyword"))).alias("found"))
    first = F.struct("sort_order", "name", "subsegment_id")
    best = each.groupBy("lead_id").agg(F.min_by(F.struct("subsegment_id", "segment_id", "name", "found"), first).alias("best"))
    return best.select("lead_id", "best.subsegment_id", "best.segment_id", F.col("best.name").alias("subsegment"), F.transform("best.found", lambda x: x["keyword"]).alias("keywords"))


def suggestions(leads: DataFrame, regions: DataFrame, taxonomy: DataFrame, rules: DataFrame) -> DataFrame:
    """Each lead's region, segment and subsegment, the first rule that fits them, and its representative."""
    region = matching_region(leads, regions).select("lead_id", F.col("region_id").alias("sales_region_id"))
    segment = matching_subsegment(leads, taxonomy).select("lead_id", F.col("segment_id").alias("market_segment_id"), F.col("subsegment_id").alias("market_subsegment_id"), "subsegment", "keywords")
    placed = leads.select("lead_id").join(region, "lead_id", "left").join(segment, "lead_id", "left")
    return placed.join(matching_rule(placed, rules), "lead_id", "left")


def report_rows(leads: DataFrame, suggested: DataFrame) -> DataFrame:
    """Each lead as it is assigned now, why it is not, and what looks suspicious about its keywords."""
    told = suggested.select("lead_id", F.col("sales_rep_id").alias("could_have"), F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"), "subsegment")
    met = leads.join(told, "lead_id", "left")
    reason = (
        F.when(F.col("could_have").isNotNull(), "assignment_available_not_committed").when(F.col("sales_region_id").isNull(), F.when(normalize_text(F.col("city")) == "sao paulo", "sao_paulo_missing_zone_signal").otherwise("no_sales_region_matched"))
        .when(F.col("market_subsegment_id").isNull(), "no_market_subsegment_matched").when(F.col("market_segment_id").isNotNull(), "no_assignment_rule_matched").otherwise("unassigned_unknown")
    )
    broad = F.array_sort(F.array_distinct(F.filter(F.transform("keywords", normalize_text), lambda k: k.isin(*BROAD_KEYWORDS))))
    lone = (F.size("keywords") == 1) & F.col("subsegment").isin(*BROAD_SUBSEGMENTS)
    return met.select(
        "lead_id", "assigned_sales_rep_id", "sales_region_id", "market_segment_id", "market_subsegment_id",
        F.when(F.col("assigned_sales_rep_id").isNull(), reason).alias("unassigned_reason"),
        F.concat_ws(";", F.when(F.size(broad) > 0, F.concat(F.lit("broad_keyword:"), F.array_join(broad, "|"))), F.when(lone, "single_keyword_broad_subsegment")).alias("suspicious"),
    )


def report(rows: DataFrame) -> DataFrame:
    """The report's totals in one row."""
    assigned = F.col("assigned_sales_rep_id").isNotNull()
    return rows.agg(
        F.count("*").alias("processed"), F.count_if(assigned).alias("assigned"), F.count_if(~assigned).alias("unassigned"),
        F.when(F.count("*") > 0, F.round(F.count_if(assigned) * 100 / F.count("*"), 2)).otherwise(0.0).alias("assignment_rate"), F.count_if(F.col("suspicious") != "").alias("suspicious"),
    )


def reason_counts(rows: DataFrame) -> DataFrame:
    """Unassigned leads by reason."""
    return rows.where("unassigned_reason is not null").groupBy("unassigned_reason").agg(F.count("*").alias("leads"))


def transitions(applied: DataFrame) -> DataFrame:
    """Of the leads whose rules were applied how many were blocked, freed and left as they were."""
    now = F.col("blocked_now")
    return applied.agg(F.count("*").alias("evaluated"), F.count_if(F.col("changed") & now).alias("blocked"), F.count_if(F.col("changed") & ~now).alias("unblocked"), F.count_if(~F.col("changed")).alias("unchanged"))


def updated(leads: DataFrame, changes: DataFrame) -> DataFrame:
    """M7: leads after a table of changes (lead_id and status, notes, follow_up_date, do_not_contact; null: as it was).

    The status do_not_contact and the flag imply each other; lifting the flag leads such a
    status back to reviewed. changed lists the fields that differ, for the log."""
    new = changes.select(F.col("lead_id").alias("__id"), *[F.col(c).alias(f"__{c}") for c in ("status", "follow_up_date", "do_not_contact")])
    met = leads.join(new, leads.lead_id == F.col("__id"), "left")
    flag = F.when(F.col("__status") == "do_not_contact", True).otherwise(F.coalesce("__do_not_contact", "do_not_contact"))
    status = F.when(F.col("__do_not_contact"), "do_not_contact").when(~flag & (F.coalesce("__status", "status") == "do_not_contact"), "reviewed").otherwise(F.coalesce("__status", "status"))
    out = met.select("lead_id", status.alias("status"), F.coalesce("__follow_up_date", "follow_up_date").alias("follow_up_date"), flag.alias("do_not_contact"), *[F.col(c).alias(f"old_{c}") for c in ("status", "follow_up_date", "do_not_contact")])
    differs = [F.when(~F.col(c).eqNullSafe(F.col(f"old_{c}")), c) for c in ("status", "follow_up_date", "do_not_contact")]
    return out.select("lead_id", "status", "follow_up_date", "do_not_contact", F.concat_ws("|", *differs).alias("changed"))
