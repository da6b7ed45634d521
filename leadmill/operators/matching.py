"""Matching of candidates and leads: existing-lead cascade, preview groups, duplicate pairs, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.functions.text import blank_to_null, domain_of, normalize_text, present
from leadmill.operators.shared import discard, materialise

#: Reasons for a pair to be one business and their weights.
REASONS = {"google_place_id": 1.0, "phone": 0.9, "whatsapp": 0.9, "domain": 0.85, "normalized_business_name": 0.75}
POPULATED = ("business_name", "category", "address", "website", "email", "phone", "whatsapp", "instagram", "google_place_id")
RUNGS = ("google_place_id", "google_maps_url", "domain", "phone", "name_address", "name_neighborhood_city", "name_city")


def confidence_of(mask: int) -> float:
    """Mean weight of a set of reasons, rounded as binary floating point rounds."""
    held = [w for k, w in enumerate(REASONS.values()) if mask >> k & 1]
    return round(sum(held) / len(held), 2) if held else 0.0


def lead_keys(leads: DataFrame) -> DataFrame:
    """Cascade keys of leads: rung, key, lead_id, name, city, address."""
    name, city, address = normalize_text(F.col("business_name")), normalize_text(F.col("city")), normalize_text(F.col("address"))
    part = lambda *cs: F.when(sum((present(c).cast("int") for c in cs), F.lit(0)) == len(cs), F.concat_ws("|", *cs))
    keys = [blank_to_null(F.trim("google_place_id")), blank_to_null(F.col("google_maps_url")), F.coalesce(blank_to_null(F.col("domain")), domain_of(F.col("website"))), blank_to_null(F.col("phone")), part(name, address), part(name, normalize_text(F.col("neighborhood")), city), part(name, city)]
    whole = leads.select("lead_id", name.alias("name"), city.alias("city"), address.alias("address"), F.array(*keys).alias("keys"))
    return whole.select("lead_id", "name", "city", "address", F.posexplode("keys").alias("rung", "key")).where("key is not null")


def candidate_keys(candidates: DataFrame) -> DataFrame:
    part = lambda *cs: F.when(sum((present(F.col(c)).cast("int") for c in cs), F.lit(0)) == len(cs), F.concat_ws("|", *cs))
    keys = [F.col("google_place_id"), F.col("google_maps_url"), F.col("domain"), F.col("phone"), part("name_key", "address_key"), part("name_key", "neighborhood_key", "city_key"), part("name_key", "city_key")]
    whole = candidates.select("item_pos", F.col("city_key").alias("own_city"), F.array(*keys).alias("keys"))
    return whole.select("item_pos", "own_city", F.posexplode("keys").alias("rung", "key")).where("key is not null")


def existing_lead(candidates: DataFrame, leads: DataFrame) -> DataFrame:
    """item_pos, existing_lead_id and matched_by; the first rung that resolves wins.

    Place and map keys resolve to the least lead id. Domain and phone keep leads of a
    compatible city and resolve if one is left or all have one name. The name rungs
    resolve by one address or, for name and city, by a single lead. Counts and least
    ids are aggregated, so a franchise's key doesn't gather its leads.
    """
    found = candidate_keys(candidates).join(lead_keys(leads.where(~F.col("is_duplicate"))), ["rung", "key"])
    compatible = F.col("own_city").isNull() | F.col("city").isNull() | (F.col("own_city") == F.col("city"))
    found = found.where(~F.col("rung").isin(2, 3) | compatible)
    name, address = F.coalesce("name", F.lit("\0")), F.coalesce("address", F.lit("\0"))
    rungs = found.groupBy("item_pos", "rung").agg(
        F.min("lead_id").alias("lead_id"), F.max("lead_id").alias("last_id"),
        (F.min(name) == F.max(name)).alias("one_name"), (F.min(address) == F.max(address)).alias("one_address"),
    )
    single = F.col("lead_id") == F.col("last_id")
    solved = F.when(F.col("rung") < 2, True).when(F.col("rung") < 4, single | F.col("one_name")).when(F.col("rung") < 6, single | F.col("one_address")).otherwise(single)
    best = rungs.where(solved).groupBy("item_pos").agg(F.min_by("lead_id", "rung").alias("existing_lead_id"), F.min("rung").alias("rung"))
    return best.select("item_pos", "existing_lead_id", F.element_at(F.array(*[F.lit(r) for r in RUNGS]), F.col("rung") + 1).alias("matched_by"))


def preview_groups(candidates: DataFrame) -> DataFrame:
    """item_pos and group_pos, the least item reachable through shared keys.

    Labels spread along keys, each round halving the distance by following the label's
    own label; keys and rounds are written to the shared folder, and rounds end when nothing changes.
    """
    spark = candidates.sparkSession
    edges = materialise(candidate_keys(candidates).select("item_pos", F.concat_ws("=", "rung", "key").alias("key")), "preview_keys")
    labels, written = candidates.select("item_pos").distinct().select("item_pos", F.col("item_pos").alias("label")), None
    total = None
    while True:
        by_key = edges.join(labels, "item_pos").groupBy("key").agg(F.min("label").alias("label"))
        near = edges.join(by_key, "key").groupBy("item_pos").agg(F.min("label").alias("near"))
        step = labels.join(near, "item_pos", "left").select("item_pos", F.least("label", F.coalesce("near", "label")).alias("label"))
        over = step.select(F.col("item_pos").alias("label"), F.col("label").alias("further"))
        step = step.join(over, "label", "left").select("item_pos", F.coalesce("further", "label").alias("label"))
        labels = materialise(step, "labels")
        if written:
            discard(spark, written)
        written = labels
        now = labels.agg(F.sum("label")).first()[0]
        if now == total:
            discard(spark, edges)
            return labels.select("item_pos", F.col("label").alias("group_pos"))
        total = now


def _mask(a: str, b: str) -> Column:
    same = lambda c: present(F.col(f"{a}.{c}")) & (F.col(f"{a}.{c}") == F.col(f"{b}.{c}"))
    return sum((F.when(same(c), 1 << k).otherwise(0) for k, c in enumerate(REASONS)), F.lit(0))


def _blocks() -> list[tuple[str, ...]]:
    """The sets of keys that make leads that share all of them duplicates: the place id, or any two of the others."""
    others = [c for c in REASONS if c != "google_place_id"]
    return [("google_place_id",)] + [(x, y) for k, x in enumerate(others) for y in others[k + 1 :]]


def duplicate_links(leads: DataFrame) -> DataFrame:
    """E3 without its pairs: lead_a and lead_b (the least lead of the block) for each lead of each block.

    All leads of a block are duplicates of each other, so these links have the components
    of the pairs, and there are at most seven for each lead, however many share a key."""
    rows = leads.where(~F.col("is_duplicate") & ~F.col("is_blocked")).select("lead_id", *REASONS)
    out = None
    for block in _blocks():
        kept = rows.where(sum((present(F.col(c)).cast("int") for c in block), F.lit(0)) == len(block)).select("lead_id", *block)
        least = kept.groupBy(*block).agg(F.min("lead_id").alias("lead_b"), F.count("*").alias("n")).where("n > 1").drop("n")
        found = kept.join(least, list(block)).where("lead_id <> lead_b").select(F.col("lead_id").alias("lead_a"), "lead_b")
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def duplicate_pairs(leads: DataFrame) -> DataFrame:
    """lead_a, lead_b (a later in list order loses), mask and confidence; every pair, so use duplicate_links() for clusters.

    A pair needs one place id or two reasons, so it is looked for by place id and by
    each two of the other four keys together: a key that a whole franchise shares
    makes no pairs by itself. Equal pairs of several blocks are met once, by the
    first block that holds for them.
    """
    rows = leads.where(~F.col("is_duplicate") & ~F.col("is_blocked")).select("lead_id", "updated_at", *REASONS)
    blocks, out = _blocks(), None
    for block in blocks:
        kept = rows
        for c in block:
            kept = kept.where(present(F.col(c)))
        a, b = kept.alias("a"), kept.alias("b")
        on = (F.col("a.updated_at") > F.col("b.updated_at")) | ((F.col("a.updated_at") == F.col("b.updated_at")) & (F.col("a.lead_id") > F.col("b.lead_id")))
        for c in block:
            on &= F.col(f"a.{c}") == F.col(f"b.{c}")
        found = a.join(b, on).select(F.col("a.lead_id").alias("lead_a"), F.col("b.lead_id").alias("lead_b"), _mask("a", "b").alias("mask"))
        first = F.lit(False)
        for earlier in blocks[: blocks.index(block)]:
            bits = sum(1 << list(REASONS).index(c) for c in earlier)
            first |= F.col("mask").bitwiseAND(F.lit(bits)) == bits
        found = found.where(~first)
        out = found if out is None else out.unionByName(found)
    table = F.create_map(*[x for m in range(1, 32) for x in (F.lit(m), F.lit(confidence_of(m)))])
    return out.withColumn("confidence", table[F.col("mask")])


def pair_order() -> list[Column]:
    """The surest pairs first, then those with more reasons, then by their leads."""
    return [F.desc("confidence"), F.desc(F.bit_count("mask")), F.col("lead_a"), F.col("lead_b")]


def priorities(leads: DataFrame, contacts: DataFrame) -> DataFrame:
    """lead_id and its priority as a survivor: score, three for each populated field, confidence of its contacts."""
    sums = contacts.groupBy("lead_id").agg(F.sum("confidence").alias("trust"))
    full = sum((present(F.col(c)).cast("int") for c in POPULATED), F.lit(0))
    return leads.join(sums, "lead_id", "left").select("lead_id", (F.col("lead_score") + 3 * full + F.coalesce("trust", F.lit(0.0))).alias("priority"))


def survivors(pairs: DataFrame, priority: DataFrame) -> DataFrame:
    """Of each pair the lead that stays: higher priority, the earlier one on a tie."""
    a, b = priority.alias("pa"), priority.alias("pb")
    met = pairs.join(a, F.col("lead_a") == F.col("pa.lead_id")).join(b, F.col("lead_b") == F.col("pb.lead_id"))
    wins = F.col("pa.priority") >= F.col("pb.priority")
    return met.select("lead_a", "lead_b", "confidence", F.when(wins, F.col("lead_a")).otherwise(F.col("lead_b")).alias("survivor"))


def merge_missing(leads: DataFrame, incoming: DataFrame, match: DataFrame, columns: list[str]) -> DataFrame:
    """M1: leads with empty columns filled from the candidates matched to them, earliest item first."""
    filled = incoming.join(match, "item_pos").groupBy("existing_lead_id").agg(*[F.min_by(c, F.when(present(F.col(c)), F.col("item_pos"))).alias(f"new_{c}") for c in columns])
    met = leads.join(filled, leads.lead_id == filled.existing_lead_id, "left")
    return met.select("lead_id", *[F.when(present(F.col(c)), F.col(c)).otherwise(F.coalesce(f"new_{c}", c)).alias(c) for c in columns])
