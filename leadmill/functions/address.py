"""Street and number of a postal address, as native columns.

An address is cut into segments at commas and lone dashes, and each segment is told
by its words: a place (country, state, city, neighbourhood), a run of digits that is
a postal code or a phone number, a house number, or a part of the street.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadmill.functions.text import blank_to_null, fold, let, state_code

#: Words that name a part of a building or plot, kinds of street, labels in front of an address.
COMPONENTS = ("quadra", "lote", "bloco", "apartamento", "apto", "fundos", "andar")
STREETS = ("r", "rua", "av", "avenida", "al", "alameda", "trav", "travessa", "rod", "rodovia", "estr", "estrada", "pc", "praca")
LABELS = ("endereco", "logradouro")
COUNTRIES = ("brasil", "brazil")
#: What an address without a number has in its place.
NUMBERLESS = ("s/n", "sn")
DIGITS, MARKS = "0123456789", " .,;:()-+"


def _words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def _bare(word: Column) -> Column:
    """A word in lower case without accents and the marks around it."""
    return F.lower(F.btrim(fold(word), F.lit(MARKS)))


def _trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(MARKS.replace(".", "").replace("(", "").replace(")", "").replace("+", "")))


def _only_digits(c: Column) -> Column:
    return (c != "") & (F.btrim(c, F.lit(DIGITS)) == "")


def segments(address: Column) -> Column:
    """The segments of an address without empty ones, single spaces between their words."""
    parts = F.transform(F.split(address, r",|\s-(?=\s|$)"), lambda x: _trimmed(F.array_join(_words(x), " ")))
    return F.filter(parts, lambda x: x != "")


def is_number(c: Column) -> Column:
    """A house number: up to six digits, then nothing, two letters at most, or a dash or slash and up to four letters or digits."""
    digits = F.length(c) - F.length(F.translate(c, DIGITS, ""))

    def fits(rest: Column) -> Column:
        joined = F.substring(rest, 1, 1).isin("-", "/") & F.length(rest).between(2, 5) & F.substring(rest, 2, 9).rlike("^[A-Za-z0-9]+$")
        return (F.length(rest) < F.length(c)) & ((rest == "") | (F.length(rest) <= 2) & rest.rlike("^[A-Za-z]+$") | joined)

    return (digits <= 6) & let(F.ltrim(c, F.lit(DIGITS)), fits)


def _code(c: Column) -> Column:
    """A postal code or phone number: eight digits or more and no letters."""
    digits = F.translate(c, MARKS, "")
    return _only_digits(digits) & (F.length(digits) >= 8)


def street_of(c: Column) -> Column:
    """A street without what stands before its kind and from the first word for a part of a building on."""
    unglued = lambda w: let(F.ltrim(w, F.lit(DIGITS)), lambda rest: F.when(_bare(rest).isin(*STREETS), rest).otherwise(w))

    def from_kind(words: Column) -> Column:
        ahead = F.array_min(F.transform(words, lambda w, i: F.when(~_only_digits(w), i)))
        return let(ahead, lambda k: F.when(_bare(F.get(words, k)).isin(*STREETS), F.slice(words, k + 1, F.size(words))).otherwise(words))

    def to_part(words: Column) -> Column:
        part = F.array_min(F.transform(words, lambda w, i: F.when((i > 0) & _bare(w).isin(*COMPONENTS), i)))
        return F.slice(words, F.lit(1), F.coalesce(part, F.size(words)))

    kept = let(let(F.transform(_words(c), unglued), from_kind), to_part)
    return blank_to_null(_trimmed(F.array_join(kept, " ")))


def split_address(address: Column, neighborhood: Column, city: Column, state: Column, postal: Column) -> Column:
    """A struct of street and number; null where nothing is left.

    A label in front goes, and so do postal codes and phone numbers, and at the end the
    segments that name a place. The last segment is the number if it looks like one and
    no word before it names a part of a building; "s/n" means none."""
    labelled = let(_words(address), lambda words: F.when(_bare(F.get(words, F.lit(0))).isin(*LABELS), F.array_join(F.slice(words, 2, F.size(words)), " ")).otherwise(address))
    own = blank_to_null(F.trim(postal))
    parts = F.filter(segments(labelled), lambda x: ~_code(x) & F.coalesce(x != own, F.lit(True)))
    places = F.array_compact(F.transform(F.array(*[F.lit(c) for c in COUNTRIES], state, state_code(state), city, neighborhood), lambda x: F.lower(F.trim(x))))

    def without_places(found: Column) -> Column:
        last = F.array_max(F.transform(found, lambda x, i: F.when(~F.array_contains(places, F.lower(x)), i + 1)))
        return F.slice(found, F.lit(1), F.coalesce(last, F.lit(0)))

    def told(kept: Column) -> Column:
        last, before = F.element_at(kept, -1), F.slice(kept, F.lit(1), F.size(kept) - 1)
        of_building = F.exists(before, lambda x: F.exists(_words(x), lambda w: _bare(w).isin(*COMPONENTS)))
        number = F.when(F.size(kept) < 2, F.lit(0)).when(F.lower(last).isin(*NUMBERLESS), 1).when(is_number(last) & ~of_building, 2).otherwise(0)
        # 0: all of it is street, 1: the last segment says that there is no number, 2: it is the number
        return let(number, lambda n: F.struct(street_of(F.array_join(F.when(n > 0, before).otherwise(kept), ", ")).alias("street"), F.when(n == 2, last).alias("number")))

    return let(let(parts, without_places), lambda kept: F.when(F.size(kept) > 0, told(kept)))


def joined(street: Column, number: Column) -> Column:
    """Street and number in one text; null without a street."""
    street, number = blank_to_null(_trimmed(street)), blank_to_null(_trimmed(number))
    return F.when(street.isNotNull(), F.concat_ws(", ", street, number))
