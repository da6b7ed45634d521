"""Contacts added once, clusters of duplicates merged into their survivor, drafts and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.functions.text import present
from leadmill.operators.folds import folded, ordered_union
from leadmill.operators.shared import discard, materialise

#: Lead columns filled from duplicates, and words in a key whose value isn't logged.
MERGED = ("category", "address", "neighborhood", "city", "state", "postal_code", "website", "domain", "instagram", "google_maps_url", "google_place_id", "owner")
SECRET_WORDS = ("email", "phone", "whatsapp", "cnpj", "token", "api_key", "password", "secret")


def clusters(pairs: DataFrame) -> DataFrame:
    """lead_id and cluster (least lead id) over all duplicate pairs; labels halve their distance each round."""
    spark = pairs.sparkSession
    both = pairs.select(F.col("lead_a").alias("a"), F.col("lead_b").alias("b"))
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both, written = materialise(both, "edges"), None
    labels, total = both.select(F.col("a").alias("lead_id"), F.col("a").alias("cluster")).distinct(), None
    while True:
        near = both.join(labels, both.b == labels.lead_id).groupBy("a").agg(F.min("cluster").alias("near"))
        step = labels.join(near, labels.lead_id == near.a).select("lead_id", F.least("cluster", "near").alias("cluster"))
        jump = step.select(F.col("lead_id").alias("cluster"), F.col("cluster").alias("further"))
        step = step.join(jump, "cluster").select("lead_id", F.col("further").alias("cluster"))
        labels = materialise(step, "labels")
        if written:
            discard(spark, written)
        written = labels
        now = labels.agg(F.sum("cluster")).first()[0]
        if now == total:
            discard(spark, both)
            return labels
        total = now


def merge_clusters(leads: DataFrame, members: DataFrame, priority: DataFrame) -> DataFrame:
    """M3 over whole clusters: one row per cluster with its survivor, of highest priority and then least id.

    Empty fields take the value of the best other member; dates follow their rule:
    the earliest follow-up, the latest contact and enrichment; do_not_contact spreads."""
    rows = leads.join(members, "lead_id").join(priority, "lead_id")
    rank = F.struct((-F.col("priority")).alias("p"), "lead_id")
    return rows.groupBy("cluster").agg(
        F.min_by("lead_id", rank).alias("survivor"), F.count("*").alias("members"),
        *[F.min_by(c, F.when(present(F.col(c)), rank)).alias(c) for c in MERGED if c in leads.columns],
        F.min("follow_up_date").alias("follow_up_date"), F.max("last_contacted_at").alias("last_contacted_at"), F.max("last_enriched_at").alias("last_enriched_at"), F.max("do_not_contact").alias("do_not_contact"),
    )


def merged_tags(leads: DataFrame, members: DataFrame, priority: DataFrame) -> DataFrame:
    """M3: cluster and tags, the survivor's first, then what others add in their order."""
    rows = leads.join(members, "lead_id").join(priority, "lead_id")
    return ordered_union(rows, "cluster", F.struct((-F.col("priority")).alias("p"), "lead_id"), F.col("tags"), "tags")


def merged_notes(leads: DataFrame, members: DataFrame, priority: DataFrame) -> DataFrame:
    """M3: cluster and notes: the survivor's, and below them those of others that they don't hold yet, under the other's id."""
    mark = "\x1f"
    rows = leads.join(members, "lead_id").join(priority, "lead_id").withColumn("notes", F.when(present(F.col("notes")), F.concat(F.col("lead_id").cast("string"), F.lit(mark), F.col("notes"))))

    def below(state: tuple, incoming: tuple) -> tuple:
        held, (lead, note) = state[0], incoming[0].split(mark, 1)
        return state if note in held.split(mark, 1)[1] else (f"{held}\n\n[Merged from lead {lead}]\n{note}", None)

    told = folded(rows, "cluster", F.struct((-F.col("priority")).alias("p"), "lead_id"), ["notes"], below)
    return told.select("cluster", F.get(F.split("notes", mark, 2), F.lit(1)).alias("notes"))


def merged_profiles(profiles: DataFrame, members: DataFrame, priority: DataFrame) -> DataFrame:
    """Cluster, signal, whether it is relevant to any member, the greatest confidence, and its words as an
    ordered union. profiles: lead_id, signal, relevant, confidence, words."""
    rows = profiles.join(members, "lead_id").join(priority, "lead_id").withColumn("of", F.struct("cluster", "signal"))
    totals = rows.groupBy("of").agg(F.max("relevant").alias("relevant"), F.max("confidence").alias("confidence"))
    words = ordered_union(rows, "of", F.struct((-F.col("priority")).alias("p"), "lead_id"), F.col("words"), "words")
    return totals.join(words, "of", "left").select("of.cluster", "of.signal", "relevant", "confidence", F.coalesce("words", F.array().cast("array<string>")).alias("words"))


def new_contacts(contacts: DataFrame, incoming: DataFrame) -> DataFrame:
    """M2: incoming contacts that aren't there yet, by lead, type, value and source record; of repeats the least id."""
    key = lambda: [F.col("lead_id"), F.col("contact_type"), F.coalesce("normalized_value", "raw_value").alias("value"), F.col("source_record_type"), F.col("source_record_id")]
    names = ["lead_id", "contact_type", "value", "source_record_type", "source_record_id"]
    first = incoming.select(*key(), "contact_id").groupBy(*names).agg(F.min("contact_id").alias("contact_id"))
    return first.join(contacts.select(*key()).distinct(), names, "left_anti")


def merged_from_duplicates(pairs_with_survivor: DataFrame, leads: DataFrame) -> DataFrame:
    """Contact fields of each pair's losing lead as contacts of its survivor, with confidence 0.6."""
    loser = F.when(F.col("survivor") == F.col("lead_a"), F.col("lead_b")).otherwise(F.col("lead_a"))
    met = pairs_with_survivor.select("survivor", loser.alias("lead_id")).join(leads, "lead_id")
    each = F.array(*[F.struct(F.lit(c).alias("contact_type"), F.col(c).alias("value")) for c in ("email", "phone", "whatsapp", "instagram")])
    rows = met.select(F.col("survivor").alias("lead_id"), F.col("lead_id").alias("merged_from"), F.explode(each).alias("e"))
    return rows.where(present(F.col("e.value"))).select("lead_id", "merged_from", "e.contact_type", "e.value", F.lit(0.6).alias("confidence"))


def redacted(m: Column) -> Column:
    """P10: a map whose values are masked where the key holds a secret word."""
    return F.transform_values(m, lambda k, v: F.when(F.lower(k).rlike("|".join(SECRET_WORDS)), F.lit("[redacted]")).otherwise(v))


def rendered(template: str, values: dict[str, Column]) -> Column:
    """Placeholders in braces filled in; unknown names become empty."""
    out = F.lit(template)
    for name, c in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(c.cast("string"), F.lit("")))
    return F.regexp_replace(out, r"\{[A-Za-z_]+\}", "")


def error_class(status: Column, message: Column) -> Column:
    """Class of a provider's failure by status, then by words of its message."""
    m = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when((status == 429) | m.rlike("rate limit|limited"), "rate_limited").when(status.isin(401, 403) | m.rlike("api_key|token|credential"), "configuration")
        .when((status == 404) | F.contains(m, F.lit("not found")), "not_found").when(status >= 500, "provider_unavailable").when(m.rlike("timeout|timed out"), "timeout").otherwise("provider_error")
    )


def transient(error: Column) -> Column:
    """Worth another try."""
    return ~error.isin("configuration", "not_found")
