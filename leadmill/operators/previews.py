"""Preview items, their payloads and contacts, scopes of leads, drafts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.functions.text import signals
from leadmill.operators.filters import by_ids
from leadmill.operators.reports import latest_batch

#: What a signal is called in a message, and what stands there without any.
SIGNAL_LABELS = {"appointments": "agendamento publico", "catalog": "catalogo de produtos ou servicos", "delivery": "entrega ou retirada", "support": "atendimento publico"}
NO_SIGNAL, SOME_SIGNALS, BASIC = "presenca publica basica do negocio", "Tambem identificamos sinais publicos como {}.", "A busca encontrou apenas sinais publicos basicos do negocio."


def preview_id(*parts: Column, index: Column) -> Column:
    """SHA-1 of the parts of an item and its place, joined by bars; null parts are empty."""
    return F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts], index.cast("string")))


def message_context(normalized: Column) -> dict[str, Column]:
    """The signals of a normalised text in words, short and as a sentence."""
    found = signals(normalized)
    labels = F.array_compact(F.array(*[F.when(F.size(found[k]) > 0, label) for k, label in SIGNAL_LABELS.items()]))
    short = F.when(F.size(labels) > 0, F.array_join(labels, ", ")).otherwise(NO_SIGNAL)
    before, after = SOME_SIGNALS.split("{}")
    return {"profile_short_text": short, "profile_text": F.when(F.size(labels) > 0, F.concat(F.lit(before), short, F.lit(after))).otherwise(BASIC)}


def best_extracted(contacts: DataFrame) -> DataFrame:
    """Of each lead and type the contact of the highest confidence, then of the longest value, then of the last source."""
    value = F.coalesce("normalized_value", "raw_value")
    return contacts.groupBy("lead_id", "contact_type").agg(F.max_by("contact_id", F.struct("confidence", F.length(value), "source_record_id", "contact_id")).alias("contact_id"))


def payload_value(payload: Column, *path: str) -> Column:
    """The value at a path of a JSON object; null where any step is missing."""
    return F.get_json_object(payload, "$" + "".join(f"['{p}']" for p in path))


def merged_payload(current: Column, incoming: Column) -> Column:
    """Two flat JSON objects in one; where both have a key the incoming value stays."""
    kind = "map<string, string>"
    pairs = F.map_concat(F.map_filter(F.from_json(current, kind), lambda k, _: ~F.map_contains_key(F.from_json(incoming, kind), k)), F.from_json(incoming, kind))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(pairs))))


def copied_contacts(contacts: DataFrame, targets: DataFrame, suffix: str) -> DataFrame:
    """The contacts of merged leads as contacts of their survivors, never primary, with a note. targets: lead_id, survivor."""
    note = F.trim(F.concat_ws(" ", F.lit(""), F.lit(suffix)))
    return contacts.join(targets, "lead_id").select(
        F.col("survivor").alias("lead_id"), F.col("contact_id").alias("copied_from"), "contact_type", "raw_value", "normalized_value", "confidence", F.lit(False).alias("is_primary"), note.alias("note"),
    )


def scope_of_ids(leads: DataFrame, ids: list[int]) -> tuple[DataFrame, DataFrame]:
    """The unblocked leads of the ids asked for, in their order, and the ids that have none."""
    asked = leads.sparkSession.createDataFrame([(x,) for x in dict.fromkeys(ids)], "lead_id long")
    found = by_ids(leads, ids, blocked="exclude", keep_order=True)
    return found, asked.join(found.select("lead_id"), "lead_id", "left_anti")


def scope_of_latest_batch(leads: DataFrame, raw: DataFrame, batches: DataFrame) -> DataFrame:
    """The unblocked leads that the latest completed batch brought."""
    of = raw.join(F.broadcast(latest_batch(batches).select("batch_id")), "batch_id", "left_semi")  # one row
    return leads.where(~F.col("is_blocked")).join(of, "lead_id", "left_semi")


def completed_batch(batches: DataFrame, batch_id: int) -> DataFrame:
    """A batch by its id, if it is completed."""
    return batches.where((F.col("batch_id") == batch_id) & (F.col("status") == "completed"))


def drafts_after(drafts: DataFrame, changes: DataFrame, now: datetime) -> DataFrame:
    """Drafts after a table of new states (draft_id, new_status, reason): approving sets the time, rejecting keeps the reason, all else clears both."""
    met = drafts.join(changes, "draft_id", "left")
    status = F.coalesce("new_status", "status")
    touched = F.col("new_status").isNotNull()
    approved = F.when(~touched, F.col("approved_at")).when(status == "approved", F.lit(now))
    reason = F.when(~touched, F.col("rejected_reason")).when(status == "rejected", F.col("reason"))
    return met.select("draft_id", "lead_id", status.alias("status"), approved.alias("approved_at"), reason.alias("rejected_reason"))
