"""Linkage of leads to company registry records: compared fields, additive evidence, gap to the second, decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadmill.functions.address import split_address
from leadmill.functions.text import STATES, area_code, blank_to_null, clean_email, domain_of, normalize_text, phone_br, postal_code, state_code, strong_variant
from leadmill.operators.activities import activity_hint, kind_matches
from leadmill.operators.name_variants import with_variants
from leadmill.operators.shared import materialise, measured

#: Thresholds of the decision.
MATCH, REVIEW, GAP = 80, 50, 10
#: Words that are no brand, words that show a company, and the least letters of a brand's word.
NO_BRAND, COMPANY_WORDS, BRAND_LETTERS = ("loja", "shop", "casa", "material", "construcao"), ("ltda", "me", "mei", "eireli", "sa", "s a", "comercio", "servicos", "industria"), 4


def brand_tokens(name: Column) -> Column:
    """The words of a normalised name that tell its brand."""
    return F.array_distinct(F.filter(F.split(F.coalesce(name, F.lit("")), " "), lambda w: (F.length(w) >= BRAND_LETTERS) & ~w.isin(*NO_BRAND)))


def person_like(name: Column) -> Column:
    """Two to five words of letters alone, none of which a company has; of a normalised name."""
    return F.coalesce(name.rlike("^[a-z]+(?: [a-z]+){1,4}$") & ~name.rlike(rf"(?:^| )(?:{'|'.join(w for w in COMPANY_WORDS if ' ' not in w)})(?: |$)"), F.lit(False))


def _mail_domain(mail: Column) -> Column:
    """The domain of a clean address."""
    return blank_to_null(F.substring_index(F.when(F.contains(mail, F.lit("@")), mail), "@", -1))


def located(rows: DataFrame, *address: str) -> DataFrame:
    """rows with `street` and `number` of their columns address, neighborhood (or none), city, state and postal: each
    distinct address is taken apart once, with those of the places that one of its segments can be.

    A place, or its postal code, matters only where it stands in the address; most don't, and without them far fewer
    addresses differ. The distinct ones are written, and broadcast where they are measured to be few."""
    line, *places = address
    flat, state = F.col("__flat"), address[3]
    # case folding of other letters may depend on what stands around them, so there every place stays
    stands = lambda c: F.contains(flat, F.lower(F.trim(c))) | (F.octet_length(c) != F.length(c)) | (F.octet_length(flat) != F.length(flat))
    coded = flat.rlike(rf"(?:^|[ ,;:-])(?:{'|'.join(sorted(x.lower() for x in STATES.values()))})(?:$|[ ,;:-])")
    of = {c: F.when(stands(F.col(c)) | (coded if c == state else F.lit(False)), F.col(c)) for c in places if c}
    keyed = rows.withColumn("__flat", F.lower(F.regexp_replace(line, r"\s+", " "))).withColumns({f"__{c}": x for c, x in of.items()}).drop("__flat")
    names = [line, *(f"__{c}" for c in of)]
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    # short rows that take long: tasks by number of bytes would be few
    once = keyed.select(*names).where(F.col(line).isNotNull()).distinct().repartition(tasks)
    split = split_address(*[F.col(f"__{c}" if c in of else c) if c else F.lit(None).cast("string") for c in address])
    once = once.select(*[F.col(c).alias(f"of_{c}") for c in names], split.alias("split"))
    once = once.select(*[f"of_{c}" for c in names], normalize_text(F.col("split.street")).alias("street"), F.col("split.number").alias("number"))
    once = measured(materialise(once, "addresses"))
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"of_{c}"))
    return keyed.join(once, same, "left").drop(*names[1:], *[f"of_{c}" for c in names])


def profiles(leads: DataFrame) -> DataFrame:
    """The evidence of each lead, normalised: lead_id, and name, aliases (N28), tokens, domains, numbers, area, street,
    number, postal, neighborhood, city, state, category and kind with l_ in front."""
    raw = leads.select(
        "lead_id", "business_name", "category", "address", "neighborhood", "city", "state", "website", "domain", "email", "phone", "whatsapp",
        F.coalesce(postal_code(F.col("postal_code")), postal_code(F.col("address"))).alias("own_postal"),
    )
    named = with_variants(located(raw, "address", "neighborhood", "city", "state", "own_postal"))
    clean = named.select(
        "lead_id", normalize_text(F.col("business_name")).alias("l_name"), F.transform("alias", F.lower).alias("l_aliases"),
        F.coalesce(domain_of(F.col("website")), domain_of(F.col("domain"))).alias("site"), clean_email(F.col("email")).alias("mail"),
        phone_br(F.col("phone")).alias("phone"), phone_br(F.col("whatsapp")).alias("whatsapp"), F.coalesce(area_code(F.col("phone")), area_code(F.col("whatsapp"))).alias("l_area"),
        F.col("street").alias("l_street"), F.col("number").alias("l_number"), F.col("own_postal").alias("l_postal"), normalize_text(F.col("neighborhood")).alias("l_neighborhood"),
        normalize_text(F.col("city")).alias("l_city"), state_code(F.col("state")).alias("l_state"), normalize_text(F.col("category")).alias("l_category"),
    )
    short = F.filter("l_aliases", lambda v: F.size(F.split(v, " ")) <= 3)
    # the brand's words are those of its short aliases; without any, of the first two, and then of the name itself
    brand = F.when(F.size(short) > 0, short).otherwise(F.slice("l_aliases", 1, 2))
    brand = F.array_join(F.when(F.size("l_aliases") > 0, brand).otherwise(F.array("l_name")), " ")
    return clean.select(
        "lead_id", "l_name", "l_aliases", brand_tokens(brand).alias("l_tokens"), F.array_compact(F.array("site", _mail_domain(F.col("mail")))).alias("l_domains"), F.array_compact(F.array("phone", "whatsapp")).alias("l_numbers"), "l_area",
        "l_street", "l_number", "l_postal", "l_neighborhood", "l_city", "l_state", "l_category", activity_hint(F.col("l_category")).alias("l_kind"),
    )


def kept_records(records: DataFrame) -> DataFrame:
    """Registry records with the columns that are read, written, as they are read more than once."""
    raw = records.select("record_id", "lead_id", "candidate_pos", "cnpj", "full_cnpj", "trade_name", "legal_name", "website", "email", "phone", "address", "neighborhood", "city", "state", "postal_code", "activity")
    return materialise(raw, "registry_records")


def cleaned_records(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Records of kept_records() with the facts that are compared, normalised; columns named in keep stay in a struct `facts`.

    Records move once, as they are, to where all that is done by lead stays: with both spellings they would be twice as wide."""
    facts = [F.struct(*keep).alias("facts")] if keep else []
    clean = located(raw, "address", "", "city", "state", "postal_code").repartition("lead_id").select(
        *facts, "record_id", "lead_id", "candidate_pos", "cnpj", "full_cnpj", normalize_text(F.col("trade_name")).alias("trade"), normalize_text(F.col("legal_name")).alias("legal"),
        domain_of(F.col("website")).alias("site"), clean_email(F.col("email")).alias("mail"), phone_br(F.col("phone")).alias("phone"), area_code(F.col("phone")).alias("area"),
        "street", "number", postal_code(F.col("postal_code")).alias("postal"), normalize_text(F.col("neighborhood")).alias("neighborhood"), normalize_text(F.col("city")).alias("city"), state_code(F.col("state")).alias("state"), normalize_text(F.col("activity")).alias("activity"),
    )
    return clean.withColumns({"domains": F.array_compact(F.array("site", _mail_domain(F.col("mail")))), "person_like": person_like(F.col("legal"))}).drop("site", "mail")


def compared(leads: DataFrame, records: DataFrame) -> DataFrame:
    """Each registry record beside its lead, with the compared facts that evidence() reads."""
    return compared_kept(leads, kept_records(records))


def compared_kept(leads: DataFrame, raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """compared() for records that kept_records() has written; columns of theirs named in keep stay in a struct `facts`.

    Both sides are normalised before they are joined by lead, once for each row; addresses
    and names once for each distinct value."""
    met = cleaned_records(raw, keep).join(profiles(leads), "lead_id")
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    both = lambda a, b: F.when(F.col(a).isNull() | F.col(b).isNull(), "missing").when(F.col(a) == F.col(b), "equal").otherwise("different")
    words = lambda c: F.split(F.coalesce(F.col(c), F.lit("")), " ")
    shared = F.size(F.array_intersect("l_tokens", words("legal")))
    alias = F.when(F.coalesce(F.array_contains("l_aliases", F.col("trade")), F.lit(False)), "equal").when(F.exists("l_aliases", lambda v: strong_variant(v, F.col("trade"))), "strong").otherwise("none")
    legal = F.when(same("legal", "l_name"), "equal").when(strong_variant(F.col("l_name"), F.col("legal")), "strong").otherwise("none")
    return met.select(
        "record_id", "lead_id", "candidate_pos", "cnpj", "full_cnpj", "person_like",
        F.arrays_overlap("domains", "l_domains").alias("same_domain"), F.coalesce(F.array_contains("l_numbers", F.col("phone")), F.lit(False)).alias("same_phone"), same("area", "l_area").alias("same_area"),
        alias.alias("alias_match"), legal.alias("legal_match"),
        F.when((F.size("l_tokens") > 0) & (shared == F.size("l_tokens")), "all").when(shared > 0, "some").otherwise("none").alias("brand_in_legal"),
        F.arrays_overlap("l_tokens", words("trade")).alias("brand_in_alias"),
        same("street", "l_street").alias("same_street"), both("number", "l_number").alias("number_match"), same("postal", "l_postal").alias("same_postal"), same("neighborhood", "l_neighborhood").alias("same_neighborhood"),
        both("city", "l_city").alias("city_match"), both("state", "l_state").alias("state_match"),
        kind_matches(F.col("l_kind"), F.col("activity")).alias("same_activity"), *(["facts"] if keep else []),
    )


def evidence(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """E5: records with score, supportive evidence, identity and conflict. Input columns hold the compared facts:
    same_* booleans, alias_match and legal_match (equal, strong, none), brand_in_legal (all, some, none),
    number_match, city_match, state_match (equal, different, missing). Columns named in keep stay."""
    c, when = F.col, F.when
    alias, legal = c("alias_match") != "none", (c("alias_match") == "none") & (c("legal_match") != "none")
    # a brand's words in the legal name are a match of names too
    by_legal = legal | (c("brand_in_legal") != "none")
    parts = {
        "p_domain": when(c("same_domain"), 40).otherwise(0),
        "p_phone": when(c("same_phone"), 35).when(c("same_area"), 5).otherwise(0),
        "p_alias": when(c("alias_match") == "equal", 25).when(alias, 20).otherwise(0),
        "p_brand_legal": when(c("brand_in_legal") == "all", 15).when(c("brand_in_legal") == "some", 10).otherwise(0),
        "p_legal": when(legal & (c("legal_match") == "equal"), 15).when(legal, 12).otherwise(0),
        "p_street": when(c("same_street"), 15).otherwise(0),
        "p_number": when(c("number_match") == "equal", 10).when(c("number_match") == "different", -10).otherwise(0),
        "p_postal": when(c("same_postal"), 25).otherwise(0),
        "p_neighborhood": when(c("same_neighborhood"), 10).otherwise(0),
        "p_city": when(c("city_match") == "equal", 15).when(c("city_match") == "different", -30).otherwise(0),
        "p_state": when(c("state_match") == "equal", 10).when(c("state_match") == "different", -40).otherwise(0),
        "p_activity": when(c("same_activity"), 8).otherwise(0),
        "p_brand_alias": when(~alias & ~by_legal & c("brand_in_alias"), 15).otherwise(0),
    }
    support = sum((x.cast("int") for x in (c("same_domain"), c("same_phone"), c("same_street"), c("number_match") == "equal", c("same_postal"), c("same_neighborhood"))), F.lit(0))
    return records.select(
        "record_id", "lead_id", "candidate_pos", "cnpj", "full_cnpj",
        F.greatest(F.lit(0), sum(parts.values(), F.lit(0))).alias("score"), support.alias("support"),
        (alias | by_legal | c("brand_in_alias") | c("same_domain") | c("same_phone")).alias("identity"),
        ((c("city_match") == "different") | (c("state_match") == "different")).alias("conflict"), *keep,
    )


def decide(scored: DataFrame) -> DataFrame:
    """W4 and the decision: the best record of each lead, its gap to the second, status, reason and confidence.

    Equal scores keep the order of the provider. A lone record has the gap of a clear winner."""
    best = Window.partitionBy("lead_id").orderBy(F.desc("score"), "candidate_pos", "record_id")
    ranked = scored.withColumn("second", F.lead("score").over(best)).withColumn("rank", F.row_number().over(best)).where("rank = 1")
    gap = F.coalesce(F.col("score") - F.col("second"), F.lit(GAP))
    reason = F.when(F.col("conflict"), "location_conflict").when(gap < GAP, "close_second").when(F.col("support") < 1, "no_support").when(~F.col("full_cnpj"), "not_confirmable")
    matched = (F.col("score") >= MATCH) & reason.isNull() & F.col("identity")
    review = ((F.col("score") >= MATCH) & reason.isNotNull()) | ((F.col("score") >= REVIEW) & ~F.col("conflict") & F.col("full_cnpj"))
    status = F.when(matched, "matched").when(review, "needs_review").otherwise("not_found")
    share = F.least(F.col("score"), F.lit(100)) / 100
    return ranked.select("lead_id", "record_id", "score", gap.alias("gap"), status.alias("status"), reason.alias("reason"), F.when(~matched & review & reason.isNull(), F.least(share, F.lit(0.79))).otherwise(share).alias("confidence"))


def review_list(scored: DataFrame, most: int = 5) -> DataFrame:
    """Up to five reviewable records of each lead, best first."""
    kept = scored.where((F.col("score") >= REVIEW) & ~F.col("conflict"))
    best = Window.partitionBy("lead_id").orderBy(F.desc("score"), "candidate_pos", "record_id")
    return kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most).select("lead_id", "record_id", "score", "rank")
