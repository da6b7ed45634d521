"""Rules where the first match wins: exclusion, sales regions, assignment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadmill.functions.text import domain_of, normalize_text, present
from leadmill.operators.containment import with_contained


def exclusion_matches(leads: DataFrame, rules: DataFrame) -> DataFrame:
    """lead_id and the least rule id that fits: exact name, name contains, domain or sub-domain, category.

    Equalities are hash joins (the domain and the website's are entered with all their
    parents); "contains" is a pass over the leads, or beyond a few rules a join over runs
    of three characters."""
    name = F.coalesce("normalized_business_name", normalize_text(F.col("business_name")))
    site = domain_of(F.col("website")) if "website" in leads.columns else F.lit(None).cast("string")
    base = leads.select("lead_id", name.alias("name"), normalize_text(F.col("category")).alias("cat"), F.array_distinct(F.array_compact(F.array("domain", site))).alias("hosts"))
    of = lambda kind: rules.where(F.col("rule_type") == kind).select("rule_id", F.col("normalized_pattern").alias("pattern"))
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    domains = base.select("lead_id", F.explode("hosts").alias("host")).where("host <> ''").select("lead_id", F.explode(parents).alias("pattern"))
    found = [
        base.select("lead_id", F.col("name").alias("pattern")).join(of("exact_name"), "pattern"),
        base.select("lead_id", F.col("cat").alias("pattern")).join(of("provider_category"), "pattern"),
        domains.join(of("domain"), "pattern"),
    ]
    contains = of("business_name_contains")
    found.append(with_contained(base.select("lead_id", "name"), "name", contains, "pattern").join(contains, "pattern").select("pattern", "lead_id", "rule_id"))
    both = reduce(lambda a, b: a.unionByName(b), found)
    return both.groupBy("lead_id").agg(F.min("rule_id").alias("rule_id"))


def apply_exclusion(leads: DataFrame, rules: DataFrame) -> DataFrame:
    """M8: lead_id, whether it is now blocked, by which rule and why, and whether that changed."""
    hit = exclusion_matches(leads, rules).join(rules, "rule_id").select(F.col("lead_id").alias("hit_id"), "rule_id", F.coalesce("reason", F.concat(F.lit("rule "), F.col("rule_id").cast("string"))).alias("reason"))
    met = leads.join(hit, leads.lead_id == hit.hit_id, "left")
    now = F.col("rule_id").isNotNull()
    return met.select("lead_id", now.alias("blocked_now"), "rule_id", "reason", (now != F.col("is_blocked")).alias("changed"))


def matching_region(leads: DataFrame, regions: DataFrame) -> DataFrame:
    """E8, first part: lead_id and region_id by postal prefix, neighbourhood keyword or city, in this order.

    States have to agree where both are given, and for the first two so do cities. Each
    way is a join of its own, on the prefix, on the keyword that stands in the lead's
    place and on the city; the first region by (pass, type, name, id) wins."""
    r = regions.select(*[F.col(c).alias(f"r_{c}") for c in regions.columns]).withColumns({"r_city": normalize_text(F.col("r_city")), "r_state": normalize_text(F.col("r_state"))})
    digits = F.regexp_replace(F.coalesce("postal_code", F.lit("")), "[^0-9]", "")
    place = normalize_text(F.concat_ws(" ", "neighborhood", "address"))
    base = leads.select("lead_id", normalize_text(F.col("state")).alias("state"), normalize_text(F.col("city")).alias("city"), digits.alias("digits"), place.alias("place"))
    agree = lambda c: F.col(c).isNull() | F.col(f"r_{c}").isNull() | (F.col(c) == F.col(f"r_{c}"))
    prefixed = r.where(present(F.col("r_postal_prefix")))
    sizes = [x[0] for x in prefixed.select(F.length("r_postal_prefix")).distinct().collect()]  # eight at most
    prefixes = base.select("*", F.explode(F.array(*[F.when(F.length("digits") >= n, F.substring("digits", 1, n)) for n in sizes] or [F.lit(None).cast("string")])).alias("r_postal_prefix")).where("r_postal_prefix is not null")
    near = r.where(present(F.col("r_neighborhood_keyword")))
    keywords = with_contained(base, "place", near, "r_neighborhood_keyword").withColumnRenamed("pattern", "r_neighborhood_keyword")
    of_city = r.where(~F.col("r_requires_neighborhood") & F.col("r_city").isNotNull()).withColumn("city", F.col("r_city"))
    ways = [
        prefixes.join(prefixed, "r_postal_prefix").where(agree("state") & agree("city")).withColumn("step", F.lit(1)),
        keywords.join(near, "r_neighborhood_keyword").where(agree("state") & agree("city")).withColumn("step", F.lit(2)),
        base.join(of_city, "city").where(agree("state")).withColumn("step", F.lit(3)),
    ]
    met = reduce(lambda a, b: a.unionByName(b), [w.select("lead_id", "step", "r_region_type", "r_name", F.col("r_region_id").alias("region_id")) for w in ways])
    return met.groupBy("lead_id").agg(F.min_by("region_id", F.struct("step", "r_region_type", "r_name", "region_id")).alias("region_id"), F.min("step").alias("step"))


def matching_rule(leads: DataFrame, rules: DataFrame) -> DataFrame:
    """lead_id and the first rule by (priority, id) whose region, segment and subsegment are open or equal.

    A rule's open fields make it one of eight shapes; each shape is an equi-join."""
    keys = ("region_id", "segment_id", "subsegment_id")
    own = {"region_id": "sales_region_id", "segment_id": "market_segment_id", "subsegment_id": "market_subsegment_id"}
    open_key = F.lit(-1).cast("long")
    shapes = F.array(*[F.struct(*[(F.col(own[k]) if m >> i & 1 else open_key).cast("long").alias(k) for i, k in enumerate(keys)]) for m in range(8)])
    entered = leads.select("lead_id", F.explode(shapes).alias("s")).select("lead_id", "s.*")
    closed = rules.select("rule_id", "priority", "sales_rep_id", *[F.coalesce(F.col(k).cast("long"), open_key).alias(k) for k in keys])
    met = entered.join(closed, list(keys))
    first = F.struct("priority", "rule_id")
    return met.groupBy("lead_id").agg(F.min_by("rule_id", first).alias("rule_id"), F.min_by("sales_rep_id", first).alias("sales_rep_id"))


def assign(leads: DataFrame, rules: DataFrame, overwrite: bool = False) -> DataFrame:
    """M9: lead_id, the representative and rule after assignment. Without overwrite an assigned lead
    keeps its own and gets no rule; with it a lead that matches nothing loses its assignment."""
    found = matching_rule(leads, rules).select(F.col("lead_id").alias("hit_id"), "rule_id", F.col("sales_rep_id").alias("rep"))
    met = leads.join(found, leads.lead_id == found.hit_id, "left")
    free = F.lit(True) if overwrite else F.col("assigned_sales_rep_id").isNull()
    return met.select("lead_id", F.when(free, F.col("rep")).otherwise(F.col("assigned_sales_rep_id")).alias("sales_rep_id"), F.when(free, F.col("rule_id")).alias("rule_id"))
