"""Merged previews (M6, second half of E2): items of one business as one row, by an ordered fold.

Items are grouped by shared keys, each group is folded in item order (the richer text of
each field, search terms as an ordered union, payload entries of the last item that has
them), and a merged row is keyed again: it may have a key that none of its items had, such as
one item's name with another's address. Groups that meet so are joined until none do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadmill.operators.folds import folded, latest_entries, ordered_union, richer_of
from leadmill.operators.matching import candidate_keys, preview_groups
from leadmill.operators.merging import clusters
from leadmill.operators.shared import discard, materialise

#: The texts of an item of which the richer one stays.
TEXTS = ("business_name", "name_key", "category", "address_key", "neighborhood_key", "city", "city_key", "website", "domain", "email", "phone", "google_maps_url", "google_place_id")


def fold_groups(items: DataFrame, groups: DataFrame) -> DataFrame:
    """group_pos, members, TEXTS that the items have, search_terms and payload of each group."""
    rows = items.join(groups, "item_pos")
    place = F.col("item_pos")
    out = rows.groupBy("group_pos").agg(F.count("*").alias("members"))
    parts = [folded(rows, "group_pos", place, [c for c in TEXTS if c in items.columns], richer_of), ordered_union(rows, "group_pos", place, F.col("search_terms"), "search_terms"), latest_entries(rows, "group_pos", place, F.col("payload"), "payload")]
    for part in parts:
        out = out.join(part, "group_pos", "left")
    return out


def merged_previews(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged rows by group_pos, item_pos with its group_pos). Items have item_pos, the columns of candidate_keys(),
    search_terms (array of texts) and payload (map of texts); of TEXTS those that are there are merged."""
    spark = items.sparkSession
    groups = materialise(preview_groups(items), "preview_groups")
    while True:
        merged = materialise(fold_groups(items, groups), "merged_previews")
        keys = candidate_keys(merged.withColumnRenamed("group_pos", "item_pos")).select("item_pos", "rung", "key")
        least = keys.groupBy("rung", "key").agg(F.min("item_pos").alias("lead_b"), F.max("item_pos").alias("most")).where("lead_b < most")
        links = materialise(keys.join(least, ["rung", "key"]).where("item_pos <> lead_b").select(F.col("item_pos").alias("lead_a"), "lead_b").distinct(), "preview_links")
        if links.isEmpty():
            discard(spark, links)
            return merged, groups
        joined = clusters(links).select(F.col("lead_id").alias("group_pos"), F.col("cluster").alias("joined"))
        further = materialise(groups.join(joined, "group_pos", "left").select("item_pos", F.coalesce("joined", "group_pos").alias("group_pos")), "preview_groups")
        discard(spark, merged, links, groups)
        groups = further
