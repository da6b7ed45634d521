"""Registry records that a person reviews: the summaries kept with a lead, and what approval and rejection change.

A lead's review state is an array `candidates` of summaries and one summary `candidate`; both may be null.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadmill.functions.text import blank_to_null, company_id, present
from leadmill.operators.linkage import GAP, MATCH, REVIEW, evidence
from leadmill.operators.registry_search import BULK_CONFIDENCE

#: Most summaries of a lead; only the best by score are shown to a reviewer.
MOST = 5
FACTS = ("legal_name", "trade_name", "address", "neighborhood", "city", "state", "postal_code", "website", "email", "phone", "activity")
#: Names of evidence and the facts that give them, of which the first six tell who a company is; of penalties; why a record waits.
IDENTITY = {"domain_or_email": "same_domain", "phone": "same_phone", "postal_code": "same_postal", "address": "same_street", "address_number": "number_match = 'equal'", "neighborhood": "same_neighborhood"}
PLACES = {"city": "city_match = 'equal'", "state": "state_match = 'equal'"}
PENALTIES = {"different_city": "city_match = 'different'", "different_state": "state_match = 'different'"}
BELOW, AMBIGUOUS = "below_autofill_threshold", "ambiguous_top_candidates"
REASONS = {
    "missing_full_cnpj": "O provedor não retornou um CNPJ completo para confirmação automática.",
    "city_state_conflict": "Cidade ou UF do candidato conflita com o lead.",
    AMBIGUOUS: "Mais de um candidato forte foi encontrado.",
    "provider_preview_masked": "O provedor retornou dados em modo prévia ou mascarados.",
    "insufficient_identity_support": "Os sinais de identidade ainda não são suficientes para preencher automaticamente.",
    BELOW: "O candidato ficou abaixo do limite de confirmação automática.",
}
PERSON_NOTE = "Razão social pode ser nome do titular/MEI; confira nome fantasia, endereço e telefone."


def reason_text(reason: Column) -> Column:
    """What a reviewer reads of a reason; null for others."""
    return F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])[reason]


def _bounded(c: Column) -> Column:
    """A confidence between 0 and 1; null stays, which greatest and least alone would skip."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(c, F.lit(1.0))))


def confidence(score: Column) -> Column:
    return F.round(F.least(score, F.lit(100)) / 100, 2)


def summaries(compared: DataFrame, records: DataFrame | None = None, most: int = MOST) -> DataFrame:
    """lead_id and `candidates`, the summaries of a lead's best reviewable records, best first.

    compared: as linkage.compared gives it. records: record_id and the FACTS; without them compared has the FACTS
    in a struct `facts`, and nothing moves, as all of it is done by lead. A record is reviewable with 14 digits
    and no conflict of place, from a score of REVIEW; where the two best are close and the best is above MATCH,
    only those within GAP of it and above MATCH are. Equal scores keep the provider's order. Leads without one give no row.
    The window's partitions are those of the comparison, so the ranking needs no further shuffle."""
    best = Window.partitionBy("lead_id").orderBy(F.desc("score"), "candidate_pos", "record_id")
    whole = best.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    named = lambda names: F.array_compact(F.array(*[F.when(F.expr(fact), n) for n, fact in names.items()]))
    facts = ("person_like", "alias_match", "legal_match", "brand_in_legal", *sorted({x.split(" ")[0] for x in (*IDENTITY.values(), *PLACES.values())}))
    held = records is None
    scored = evidence(compared, keep=(*facts, "facts") if held else facts)
    if held:  # most records can't be kept, and the window sorts them without their facts
        scored = scored.withColumn("facts", F.when((F.col("score") >= REVIEW) & ~F.col("conflict"), F.col("facts")))
    ranked = scored.select(
        "*", F.first("score").over(whole).alias("top"), F.first("conflict").over(whole).alias("top_conflict"), F.nth_value("score", 2).over(whole).alias("second"), F.count("*").over(whole).alias("candidate_count"),
    )
    close = (F.col("top") >= MATCH) & ~F.col("top_conflict") & (F.coalesce(F.col("top") - F.col("second"), F.lit(GAP)) < GAP)
    strong = (F.col("score") >= MATCH) & (F.col("top") - F.col("score") < GAP)
    kept = ranked.where(company_id(F.col("cnpj")).isNotNull() & ~F.col("conflict") & F.when(close, strong).otherwise(F.col("score") >= REVIEW))
    few = kept.withColumn("place", F.row_number().over(best)).where(F.col("place") <= most).withColumn("blocked_reason", F.when(close, AMBIGUOUS).otherwise(BELOW))
    c = F.col
    names = (c("alias_match") != "none") | (c("legal_match") != "none") | (c("brand_in_legal") != "none")
    placed = F.expr(" AND ".join(PLACES.values()))
    whole_rows = few.select("*", *[F.col(f"facts.{x}").alias(x) for x in FACTS]) if held else few.join(records.select("record_id", *FACTS), "record_id")
    told = whole_rows.select(
        "lead_id", "place",
        F.struct(
            "record_id", "cnpj", *FACTS, "score", confidence(c("score")).alias("match_confidence"), "candidate_count", named({**IDENTITY, **PLACES}).alias("evidence"), named(PENALTIES).alias("penalties"),
            "blocked_reason", reason_text(c("blocked_reason")).alias("review_reason"), "person_like", F.when(c("person_like") & (c("alias_match") != "none"), PERSON_NOTE).alias("legal_name_note"),
            (c("full_cnpj") & ((placed & names) | F.expr(" OR ".join(IDENTITY.values())))).alias("approvable"),
        ).alias("summary"),
    )
    return told.groupBy("lead_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "summary"))), lambda x: x["summary"]).alias("candidates"))


def listed(candidates: Column, candidate: Column) -> Column:
    """A lead's summaries, its single one put first where none has its id; never null, without null items."""
    many = F.array_compact(candidates)
    own = company_id(candidate["cnpj"])
    known = F.exists(many, lambda x: F.coalesce(company_id(x["cnpj"]) == own, F.lit(False)))
    alone = F.when(candidate.isNotNull(), F.array(candidate)).otherwise(F.array())
    return F.when(F.coalesce(F.size(many), F.lit(0)) <= 0, alone).when(own.isNotNull() & ~known, F.concat(F.array(candidate), many)).otherwise(many)


def reviewable(status: Column, summaries: Column) -> Column:
    """The first summary with 14 digits of a lead that waits for review."""
    return F.when(status == "needs_review", F.get(F.filter(summaries, lambda x: company_id(x["cnpj"]).isNotNull()), F.lit(0)))


def chosen(summaries: Column, target: Column) -> Column:
    """The summary of an id; without one the first; null where the id is none or unknown."""
    by_id = F.get(F.filter(summaries, lambda x: company_id(x["cnpj"]) == company_id(target)), F.lit(0))
    return F.when(target.isNull(), F.get(summaries, F.lit(0))).otherwise(by_id)


def reviewed(leads: DataFrame, decisions: DataFrame, now: datetime) -> DataFrame:
    """One row for each lead of the decisions, with its outcome and, where it is changed, its new values.

    leads: lead_id, cnpj, legal_name, cnpj_match_status, cnpj_match_confidence, candidates, candidate.
    decisions: lead_id, action (approve or reject), target (an id or null), at; of several for a lead the last counts,
    of one time the greatest action and target. outcome: approved, rejected, no_candidate, not_approvable or no_lead."""
    last = decisions.groupBy("lead_id").agg(F.max(F.struct("at", "action", F.coalesce("target", F.lit("")).alias("key"), "target")).alias("d")).select("lead_id", "d.action", "d.target")
    met = last.join(leads.withColumn("known", F.lit(True)), "lead_id", "left")
    met = met.withColumn("candidates", listed(F.col("candidates"), F.col("candidate"))).withColumn("picked", chosen(F.col("candidates"), F.col("target")))
    own = company_id(F.col("picked.cnpj"))
    refused = own.isNull() | ~F.coalesce("picked.approvable", F.lit(True))
    outcome = F.when(F.col("known").isNull(), "no_lead").when(F.col("picked").isNull(), "no_candidate").when(F.col("action") == "reject", "rejected").when(refused, "not_approvable").otherwise("approved")
    yes, changed = F.col("outcome") == "approved", F.col("outcome").isin("approved", "rejected")
    sure = _bounded(F.col("picked.match_confidence"))
    return met.withColumn("outcome", outcome).select(
        "lead_id", "outcome", F.col("cnpj_match_status").alias("previous_status"),
        F.when(yes, own).otherwise(F.col("cnpj")).alias("cnpj"), F.when(yes, F.coalesce(blank_to_null(F.trim("picked.legal_name")), "legal_name")).otherwise(F.col("legal_name")).alias("legal_name"),
        F.when(yes, "matched").when(changed, "not_found").otherwise(F.col("cnpj_match_status")).alias("cnpj_match_status"),
        F.when(yes, F.coalesce(sure, "cnpj_match_confidence")).when(~changed, F.col("cnpj_match_confidence")).alias("cnpj_match_confidence"),
        "candidates", F.when(changed, F.col("picked")).otherwise(F.col("candidate")).alias("candidate"), F.when(changed, F.lit(now)).alias("decided_at"),
    )


def review_log(reviews: DataFrame, actor: str) -> DataFrame:
    """SNK6: an activity row for each review that changed its lead."""
    kept = reviews.where(F.col("outcome").isin("approved", "rejected"))
    message = F.concat(F.lit("CNPJ candidate "), F.col("outcome"), F.lit(" manually."))
    return kept.select(
        "lead_id", F.lit("enriched").alias("action"), F.lit(actor).alias("actor"), message.alias("message"), F.col("decided_at").alias("at"),
        F.to_json(F.struct(F.col("outcome").alias("approval_action"), F.col("candidate.cnpj").alias("cnpj"), "previous_status")).alias("metadata"),
    )


def batch_outcomes(leads: DataFrame, requested: DataFrame, least: float = BULK_CONFIDENCE) -> DataFrame:
    """For each requested lead_id once what a bulk approval does with it, and the id it takes.

    outcome: no_lead, already_matched, no_candidate, ambiguous (several approvable), low_confidence or approved."""
    met = requested.select("lead_id").distinct().join(leads.withColumn("known", F.lit(True)), "lead_id", "left")
    open_ = F.filter(listed(F.col("candidates"), F.col("candidate")), lambda x: company_id(x["cnpj"]).isNotNull() & F.coalesce(x["approvable"], F.lit(True)))
    sure = F.coalesce(_bounded(F.get("open", F.lit(0))["match_confidence"]) >= least, F.lit(False))
    outcome = (
        F.when(F.col("known").isNull(), "no_lead").when((F.col("cnpj_match_status") == "matched") & present(F.col("cnpj")), "already_matched")
        .when(F.size("open") == 0, "no_candidate").when(F.size("open") > 1, "ambiguous").when(~sure, "low_confidence").otherwise("approved")
    )
    told = met.select("lead_id", "known", "cnpj", "cnpj_match_status", open_.alias("open")).withColumn("outcome", outcome)
    return told.select("lead_id", "outcome", F.when(F.col("outcome") == "approved", company_id(F.get("open", F.lit(0))["cnpj"])).alias("cnpj"))
