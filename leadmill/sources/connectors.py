"""Readers of rule files and provider payloads, and writers of exports and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadmill.functions.text import STATES, domain_of, normalize_text, phone_br, present

RULE_TYPES = ("exact_name", "business_name_contains", "domain", "provider_category")
#: Words between a category and a place.
CONNECTORS = ("em", "no", "na", "nos", "nas", "in")


def read_exclusion_rules(spark: SparkSession, path: str) -> DataFrame:
    """SRC14: rules of a CSV file with the columns rule_type, pattern, reason, is_active; blank patterns are skipped."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    if missing := {"rule_type", "pattern"} - set(raw.columns):
        raise ValueError(f"columns are missing: {sorted(missing)}")
    for c in {"reason", "is_active"} - set(raw.columns):
        raw = raw.withColumn(c, F.lit(None).cast("string"))
    pattern = F.when(F.col("rule_type") == "domain", domain_of(F.col("pattern"))).otherwise(normalize_text(F.col("pattern")))
    active = ~F.lower(F.trim(F.coalesce("is_active", F.lit("true")))).isin("0", "false", "no", "n", "nao", "não")
    return raw.where(present(F.trim("pattern"))).select(F.trim("rule_type").alias("rule_type"), pattern.alias("normalized_pattern"), "reason", active.alias("is_active"))


def place_candidates(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """SRC6: flat candidate columns of a provider's JSON payloads; address parts are found by their type."""
    schema = "id string, displayName struct<text: string>, formattedAddress string, internationalPhoneNumber string, nationalPhoneNumber string, websiteUri string, googleMapsUri string, primaryTypeDisplayName struct<text: string>, location struct<latitude: double, longitude: double>, addressComponents array<struct<longText: string, shortText: string, types: array<string>>>"
    p = raw.select("*", F.from_json(payload, schema).alias("p"))

    def part(field: str, *kinds: str) -> Column:
        return F.get(F.transform(F.filter("p.addressComponents", lambda c: F.arrays_overlap(c["types"], F.array(*[F.lit(k) for k in kinds]))), lambda c: c[field]), F.lit(0))

    phone = phone_br(F.coalesce("p.internationalPhoneNumber", "p.nationalPhoneNumber"))
    return p.select(
        *raw.columns, F.col("p.id").alias("google_place_id"), F.col("p.displayName.text").alias("business_name"), F.col("p.primaryTypeDisplayName.text").alias("category"), F.col("p.formattedAddress").alias("address"),
        part("longText", "sublocality", "sublocality_level_1", "neighborhood").alias("neighborhood"), part("longText", "administrative_area_level_2", "locality").alias("city"),
        part("shortText", "administrative_area_level_1").alias("state"), part("longText", "postal_code").alias("postal_code"), F.col("p.location.latitude").alias("latitude"), F.col("p.location.longitude").alias("longitude"),
        F.col("p.websiteUri").alias("website"), domain_of(F.col("p.websiteUri")).alias("domain"), F.col("p.googleMapsUri").alias("google_maps_url"), phone.alias("phone"), phone.alias("whatsapp"),
    )


def parse_request(c: Column) -> dict[str, Column]:
    """SRC16: category, city and state of "category em city - UF"; the last connector counts, unknown states belong to the city."""
    found = rf"(?i)^(.+)\s(?:{'|'.join(CONNECTORS)})\s+(.+?)$"
    text = F.trim(F.regexp_replace(c, r"\s+", " "))
    place = F.regexp_extract(text, found, 2)
    code = F.upper(F.regexp_extract(place, r"[\s,/-]+([A-Za-z]{2})$", 1))
    known = code.isin(*STATES.values())
    return {
        "category": F.when(place == "", text).otherwise(F.trim(F.regexp_extract(text, found, 1))),
        "city": F.when(place == "", F.lit(None)).when(known, F.regexp_replace(place, r"[\s,/-]+[A-Za-z]{2}$", "")).otherwise(place),
        "state": F.when(known & (place != ""), code),
    }


def write_csv(df: DataFrame, path: str) -> None:
    """SNK4 and SNK7: all cells quoted, quotes doubled, lists joined by a bar."""
    flat = [F.array_join(c, "|").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def append_log(df: DataFrame, path: str) -> None:
    """SNK6: audit rows are only added."""
    df.write.mode("append").parquet(path)
