"""Names under which a registry may know a business (N28, N29): an ordered list of rewrites of its name.

A name is cut at separators into sources: the whole name first, then each part. Each
source is rewritten by rules on its normalised words (address, city, trailing place,
noise, generic prefix, connectors, known brands); candidates keep the rules' order, repeats
go, and the first few stay. Names are normalised natively and the rules run in Arrow batches,
once for each distinct name and category: as higher-order functions over arrays they took
10 ms of a core for each name, fifty times as long.

Noise phrases go in one pass from left to right, longer ones first, so the outcome doesn't
depend on the order in which phrases are tried.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadmill.functions.text import normalize_text

#: Separators of a name's parts, words and phrases of the rules.
SEPARATORS = r"[|/\-,()]+"
CONNECTORS = ("de", "da", "do", "das", "dos", "e")
PLACE_CONNECTORS = ("de", "da", "do", "das", "dos")
LIGHT_NOISE = ("banho e tosa", "banho", "tosa", "delivery", "unidade", "ltda", "me", "eireli")
HEAVY_NOISE = ("pet shop", "petshop", "loja", "comercio", "comercio varejista", "materiais de construcao", "oficina", "mecanica", "auto", "autos", "centro automotivo", "clinica", "restaurante")
ADDRESS_WORDS = ("av", "avenida", "rua", "rod", "rodovia", "estrada", "travessa", "alameda")
GENERIC_PREFIXES = ("agro", "casa", "loja")
BRANDS = ("cobasi", "petz", "leroy merlin", "madeiramadeira", "telhanorte", "c c", "tok stok", "petlove")
CITIES = (
    "londrina", "curitiba", "maringa", "ponta grossa", "cascavel", "foz do iguacu", "joinville", "florianopolis", "porto alegre", "caxias do sul", "sao paulo", "campinas", "sorocaba",
    "jundiai", "santos", "sao jose dos campos", "mogi das cruzes", "guarulhos", "osasco", "barueri", "embu das artes", "ribeirao preto", "belo horizonte", "rio de janeiro", "santana de parnaiba",
)
LEGAL_TERMS = ("ltda", "me", "mei", "eireli", "comercio", "servicos", "industria", "materiais", "construcao")
GENERIC_TERMS = ("pet", "petshop", "pet shop", "loja", "servicos", "assistencia", "manutencao", "moveis", "materiais", "construcao", "celular", "eletronica")
BRAND_STOPS = ("sociedade", "comercial", "comercio", "servicos", "service", "materiais", "material", "construcao", "construcoes", "ltda", "me", "mei", "eireli")
BRANCH_WORDS = ("homecenter", "center", "centro", "catuai")

#: One-word cities, words of noise, first words of brands: what follows from the lists above.
TOWNS = tuple(c for c in CITIES if " " not in c)
NOISE_WORDS = tuple(dict.fromkeys(w for p in LIGHT_NOISE + HEAVY_NOISE for w in p.split()))
BRAND_STARTS = tuple(dict.fromkeys(b.split()[0] for b in BRANDS))

#: The rules as patterns over words with single spaces.
_one = "|".join
ADDRESS_CUT = rf"^(\S+(?: \S+)*?) (?:{_one(ADDRESS_WORDS)})(?: .*)?$"
PLACE_CUT = rf"^(\S.*) (?:{_one(PLACE_CONNECTORS)}) (\S{{4,}})$"
PREFIX_CUT = rf"^(?:{_one(GENERIC_PREFIXES)}) (.+)$"
PREFIX_KEPT = rf"^(?:{_one(GENERIC_PREFIXES)}) (?:{_one(CONNECTORS)})(?: \S+)?$"
LAST_BRAND = rf"^(?:{_one(GENERIC_PREFIXES)})(?: \S+)* (\S+)$"
LEADING = rf"^(?:(?:{_one(CONNECTORS)}) )*(\S+)((?: (?:{_one(CONNECTORS)}))*)(?: (\S+))?"


def noise_pattern(phrases: tuple[str, ...]) -> str:
    """Phrases where every word has a space of its own on both sides, longer ones first."""
    return " (?:" + _one(p.replace(" ", "  ") for p in sorted(phrases, key=lambda p: (-len(p.split()), p))) + ") "


def spaced(x: str) -> str:
    return f" {x.replace(' ', '  ')} "


def cut_from(x: str, pattern: re.Pattern, *phrases: str) -> str | None:
    """x without all that matches (and the given phrases); null if nothing is left."""
    out = spaced(x)
    for phrase in phrases:
        out = out.replace(spaced(phrase), "")
    return " ".join(pattern.sub("", out).split()) or None


_CONNECTORS, _LIGHT, _HEAVY, _BOTH = (re.compile(noise_pattern(p)) for p in (CONNECTORS, LIGHT_NOISE, HEAVY_NOISE, LIGHT_NOISE + HEAVY_NOISE))
_ADDRESS, _PLACE, _PREFIX, _PREFIX_KEPT, _LAST, _LEADING = map(re.compile, (ADDRESS_CUT, PLACE_CUT, PREFIX_CUT, PREFIX_KEPT, LAST_BRAND, LEADING))


def address_cut(x: str) -> str:
    """Up to the first word of an address that isn't the first word."""
    return _ADDRESS.sub(r"\1", x)


def city_cut(x: str) -> str:
    """Without a city at the end; with a word behind the city, as many last words go as the city has."""
    for city in CITIES:
        if x.endswith(f" {city}"):
            return x[: -len(city) - 1]
        if f" {city} " in f" {x}" and f" {x}".endswith(f" {city} {x.rsplit(' ', 1)[-1]}"):
            return x.rsplit(" ", len(city.split()))[0]
    return x


def place_cut(x: str) -> str:
    return _PLACE.sub(r"\1", x)


def place_word(x: str) -> str | None:
    found = _PLACE.match(x)
    return found and found[2]


def prefix_cut(x: str | None) -> str | None:
    found = None if x is None or _PREFIX_KEPT.match(x) else _PREFIX.match(x)
    return found and found[1]


def noise_cut(x: str, category: str | None, pattern: re.Pattern, keep_connectors: bool = False) -> str | None:
    """Without noise phrases and the category; where one went, connectors go too unless kept."""
    rest = cut_from(x, pattern, *([category] if category else []))
    return rest if keep_connectors or rest is None or rest == x else cut_from(rest, _CONNECTORS)


def connectors_cut(x: str | None) -> str | None:
    """Without connectors, unless less than two words would be left."""
    rest = x and cut_from(x, _CONNECTORS)
    return rest if rest and " " in rest else x


def last_brand(x: str) -> str | None:
    """The last word behind a generic first one."""
    found = _LAST.match(cut_from(x, _CONNECTORS) or "")
    return found[1] if found and found[1] not in ADDRESS_WORDS else None


def known_brands(x: str) -> list[str]:
    """Chains named in x: alone, with the next word, with the word behind a city, with the first telling word."""
    out = []
    for brand in BRANDS:
        before, held, after = f" {x} ".partition(f" {brand} ")
        if held:
            rest = after.split()
            plain = [w not in CONNECTORS and w not in ADDRESS_WORDS for w in rest]
            telling = next((w for w, p in zip(rest, plain, strict=True) if p and w not in TOWNS), None)
            two = len(rest) > 1 and rest[0] in TOWNS and plain[1]
            out += [brand, *(f"{brand} {w}" for w, use in ((rest and rest[0], rest and plain[0]), (two and rest[1], two), (telling, telling)) if use)]
    return out


def first_brand(stripped: str) -> str | None:
    """The first word, where it alone may be the brand."""
    one, *more = (cut_from(stripped, _CONNECTORS) or "").split() or [""]
    if len(one) < 2 or one in GENERIC_PREFIXES + ADDRESS_WORDS + TOWNS + GENERIC_TERMS:
        return None
    alone = not more or one in BRAND_STARTS or any(c.isdigit() for c in one) or len(one) <= 3 or more[0] in BRAND_STOPS + TOWNS + BRANCH_WORDS
    return one if alone else None


def leading_brand(stripped: str) -> str | None:
    """The first telling word, connectors behind it, and the second telling word unless it stops a brand."""
    one, between, two = _LEADING.match(stripped).groups("")
    if one in CONNECTORS + TOWNS + ADDRESS_WORDS:
        return None
    stops = two in BRAND_STOPS and not (two == "construcao" and len(one) <= 3 and one.isalpha())
    return one + between + ("" if not two or stops or two in TOWNS + ADDRESS_WORDS else f" {two}")


def legal_like(x: str) -> bool:
    return any(w in LEGAL_TERMS for w in x.split())


def searchable(x: str) -> bool:
    """Long enough, not an address, and with a word that is neither a connector nor noise."""
    held = x.split()
    long = len(x) >= 3 or (any(c.isdigit() for c in x) and len("".join(held)) >= 2)
    return long and held[0] not in ADDRESS_WORDS and any(w not in CONNECTORS and w not in NOISE_WORDS for w in held)


def generic(x: str) -> bool:
    """No brand: only generic words, or a legal form alone."""
    return x.replace(" ", "") in ("cc", "me", "mei") or all(w in CONNECTORS or w in GENERIC_TERMS for w in x.split())


def written(x: str) -> str:
    """As a search spells it: connectors small, words of two letters large, others capitalised."""
    return " ".join(w if w in CONNECTORS else w.upper() if len(w) <= 2 else w.capitalize() for w in x.split())


class Source:
    """A name or a part of it with its rewrites."""

    def __init__(self, s: str, category: str | None):
        self.s, self.category = s, category
        self.address, self.city, self.brands = address_cut(s), city_cut(s), known_brands(s)
        self.stripped = city_cut(self.address)

    def whole(self) -> list[str | None]:
        """Names to search for where this is the whole name."""
        return [self.address, self.s, self.city, place_cut(self.s), place_word(self.s), prefix_cut(self.address), *self.brands]

    def part(self) -> list[str | None]:
        """Names to search for where this is a part."""
        noise = lambda x, *how: noise_cut(x, self.category, *how)
        heavy = noise(self.address, _HEAVY, True)
        core = connectors_cut(noise(self.city, _HEAVY))
        return [
            self.s, self.address, noise(self.s, _LIGHT), heavy, noise(self.s, _BOTH), self.city, place_cut(self.s), place_word(self.s),
            prefix_cut(self.address), prefix_cut(heavy), core, last_brand(self.s), *self.brands,
        ]

    def aliases(self, with_itself: bool) -> list[str | None]:
        leading = leading_brand(self.stripped)
        return [
            first_brand(self.stripped), leading, connectors_cut(leading), *self.brands, self.stripped if with_itself else None,
            noise_cut(self.stripped, self.category, _HEAVY, True), place_cut(self.stripped), prefix_cut(self.stripped), last_brand(self.s),
        ]


def variants(whole: str | None, parts: list[str], category: str | None, most: int) -> tuple[list[str], list[str], list[str]]:
    """Names, aliases and legal names of a normalised name, its normalised parts and category."""
    kept = lambda found, good: list(dict.fromkeys(x for x in found if x and good(x)))
    if whole is None:
        return [], [], []
    full, pieces = Source(whole, category), [Source(p, category) for p in parts]
    names = kept([*full.whole(), *(x for p in pieces for x in p.part())], searchable)
    split = len(parts) > 1
    # the whole name is a source of aliases only where it has no parts, and no alias itself where a chain's name is in it
    sources = [*([] if split else full.aliases(not full.brands)), *(x for p in pieces for x in p.aliases(True))]
    more = [v for v in names[: most + 2] if v.count(" ") < 4 and not (split and " " not in v) and not (v == whole and (split or full.brands))]
    alias = kept([*full.brands, *sources, *more], lambda x: searchable(x) and not generic(x))
    legal = kept([whole, full.address, full.stripped, *names[:most]], legal_like) if legal_like(whole) else []
    return tuple([written(x) for x in found[:most]] for found in (names, alias, legal))


def of_names(leads: DataFrame, most: int = 4) -> DataFrame:
    """business_name, category and arrays of variants, best first and `most` of each at most: `names`, `alias`
    and `legal`; once for each distinct pair. A null or empty name has none."""

    @F.pandas_udf("names array<string>, alias array<string>, legal array<string>")
    def rewritten(wholes: pd.Series, parts: pd.Series, kinds: pd.Series) -> pd.DataFrame:
        text = lambda x: x if isinstance(x, str) else None
        rows = [variants(text(w), [] if p is None else list(p), text(k), most) for w, p, k in zip(wholes, parts, kinds, strict=True)]
        return pd.DataFrame(rows, columns=["names", "alias", "legal"])

    bare = F.regexp_replace("business_name", "['’]", "")
    # short rows that take long: tasks by number of bytes would be few
    tasks = max(int(leads.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = leads.select("business_name", "category").repartition(tasks, "business_name", "category").distinct()
    whole = normalize_text(F.regexp_replace(bare, SEPARATORS, " "))
    parts = F.array_compact(F.transform(F.split(bare, SEPARATORS), normalize_text))
    return rows.select("business_name", "category", rewritten(whole, parts, normalize_text(F.col("category"))).alias("v")).select("business_name", "category", "v.names", "v.alias", "v.legal")


def with_variants(leads: DataFrame, most: int = 4) -> DataFrame:
    """leads with the variants of their names."""
    a, b = leads.alias("a"), of_names(leads, most).alias("b")
    same = F.col("a.business_name").eqNullSafe(F.col("b.business_name")) & F.col("a.category").eqNullSafe(F.col("b.category"))
    return a.join(b, same).select("a.*", "b.names", "b.alias", "b.legal")
