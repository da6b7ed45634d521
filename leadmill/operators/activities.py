"""Kinds of business: told by a lead's category and fitted to a registry's activity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadmill.functions.text import let, normalize_text

#: Kinds of business by the words of their category, with the activity ids and words that a registry has for them.
ACTIVITIES = (
    ("pet_shop", ("pet shop", "petshop", "banho e tosa", "pet", "clinica veterinaria"), ("4789004", "9609208"), ("pet shop", "racoes", "banho e tosa", "produtos para animais")),
    ("furniture_retail", ("moveis", "movel", "moveleira", "marcenaria"), ("4754701",), ("moveis", "colchoes", "decoracao", "planejados")),
    ("construction_materials", ("material de construcao", "materiais de construcao", "construcao", "ferragens"), ("4744099",), ("materiais de construcao", "cimento", "acabamentos", "hidraulica", "ferragens")),
    ("electronics_repair", ("assistencia tecnica", "celular", "eletronica", "reparo", "conserto"), ("9512600",), ("assistencia tecnica", "reparo", "manutencao", "celular", "eletronicos")),
    ("automotive_repair", ("oficina", "mecanica", "reparo automotivo", "auto center", "centro automotivo"), ("4520001",), ("oficina mecanica", "manutencao automotiva", "auto center", "centro automotivo")),
)


def activity_hint(category: Column) -> Column:
    """The first kind of business with a word in the category."""

    def first(text: Column) -> Column:
        out = F.lit(None).cast("string")
        for kind, terms, _, _ in reversed(ACTIVITIES):
            out = F.when(_holds(text, terms), kind).otherwise(out)
        return out

    return let(normalize_text(category), first)


def activity_matches(category: Column, activity: Column, activity_id: Column | None = None) -> Column:
    """A registry's activity fits the category's kind by a word or by its id."""
    return let(activity_hint(category), lambda kind: let(normalize_text(activity), lambda text: kind_matches(kind, text, activity_id)))


def kind_matches(kind: Column, activity: Column, activity_id: Column | None = None) -> Column:
    """N32 for a kind of activity_hint() and a normalised activity."""
    out = F.lit(False)
    digits = F.regexp_replace(activity_id, "[^0-9]", "") if activity_id is not None else F.lit(None).cast("string")
    for name, _, ids, words in ACTIVITIES:
        out = out | ((kind == name) & (_holds(activity, words) | F.coalesce(digits.isin(*ids), F.lit(False))))
    return F.coalesce(out, F.lit(False))


def _holds(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.coalesce(F.contains(text, F.lit(w)), F.lit(False))
    return out
