"""Registry payloads of three providers, read by paths into one table of records.

A payload is JSON in one of three shapes: "office" (an office and its company), "establishment"
(a company and its place) and "flat" (fields beside each other, ids perhaps masked). A field is the
first text that isn't blank among its paths; numbers, lists and objects aren't texts. Payloads that
are null, no JSON or no object give rows with an empty record, and rows pass with all their columns.
All of it is native expressions over VARIANT columns in one stage, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import VariantType

from leadmill.functions import address
from leadmill.functions.text import blank_to_null, company_id, domain_of, state_code

BLANKS = " \t\n\r\x0b\x0c"
#: Columns of a record, in order; those before "phones" are texts.
TEXTS = ("legal_name", "trade_name", "registration_status", "street", "number", "neighborhood", "city", "state", "postal_code", "website", "primary_activity", "activity_id", "municipality")


@dataclass(frozen=True)
class Shape:
    """Where a payload keeps its fields. A path is a key of the payload, or "part.key"; "*" is the payload itself.

    parts: objects inside the payload, each the first of its paths that is an object with a key; parts in strict
    are the first value of their paths that isn't empty, and none if that is no object.
    lists: keys under which a response lists its candidates. single: keys that make a response its only candidate."""

    parts: dict[str, str]
    id: str
    own_id: str
    texts: dict[str, str]
    lists: str
    single: str = ""
    strict: frozenset[str] = field(default_factory=frozenset)


#: The providers' formats, paths in order of preference.
OFFICE = Shape(
    parts={
        "office": "office *", "company": "office.company company", "address": "office.address address", "status": "office.status status",
        "activity": "office.mainActivity mainActivity company.mainActivity", "municipality": "address.municipality",
    },
    id="office.taxId office.cnpj taxId cnpj",
    own_id="office.id office.taxId id",
    texts={
        "legal_name": "company.name legalName companyName office.companyName",
        "trade_name": "office.alias alias company.alias tradeName",
        "registration_status": "status.text status.label status.description office.registrationStatus registrationStatus",
        "street": "address.street address.details office.address",
        "number": "address.number office.number number",
        "neighborhood": "address.district address.neighborhood office.district district",
        "city": "address.city office.city city",
        "state": "address.state office.state state",
        "postal_code": "address.zip address.postalCode office.postalCode postalCode",
        "website": "office.website office.url website url company.website",
        "primary_activity": "activity.text activity.description activity.name office.mainActivity mainActivity",
        "activity_id": "activity.id activity.code",
        "municipality": "municipality.id municipality.code municipality.ibge address.municipality",
    },
    lists="* records results items offices companies data",
    single="office company taxId cnpj companyName legalName",
)
#: A lookup reads the place alone, a found candidate the payload too.
LOOKED_UP = Shape(
    parts={"place": "estabelecimento", "city": "place.cidade", "state": "place.estado", "activity": "place.atividade_principal"},
    id="place.cnpj cnpj",
    own_id="",
    texts={
        "legal_name": "razao_social place.razao_social",
        "trade_name": "place.nome_fantasia",
        "registration_status": "place.situacao_cadastral place.status",
        "street": "place.logradouro",
        "number": "place.numero",
        "neighborhood": "place.bairro",
        "city": "city.nome place.cidade",
        "state": "state.sigla place.estado",
        "postal_code": "place.cep",
        "website": "place.website place.site",
        "primary_activity": "activity.descricao",
    },
    lists="",
)
ESTABLISHMENT = Shape(
    parts={"place": "estabelecimento", "city": "place.cidade cidade", "state": "place.estado estado", "activity": "place.atividade_principal atividade_principal"},
    id="place.cnpj cnpj cnpj_completo",
    own_id="",
    texts={
        "legal_name": "razao_social place.razao_social",
        "trade_name": "place.nome_fantasia nome_fantasia",
        "registration_status": "place.situacao_cadastral situacao_cadastral",
        "street": "place.logradouro logradouro",
        "number": "place.numero numero",
        "neighborhood": "place.bairro bairro",
        "city": "city.nome place.cidade cidade",
        "state": "state.sigla place.estado estado",
        "postal_code": "place.cep cep",
        "website": "place.website place.site website site",
        "primary_activity": "activity.descricao",
    },
    lists="resultados results items data",
)
FLAT = Shape(
    parts={
        "place": "endereco address estabelecimento", "city": "place.cidade cidade", "state": "place.estado estado", "activity": "atividade_principal place.atividade_principal",
        "standing": "situacao_cadastral", "status": "status",
    },
    id="cnpj cnpj_formatado cnpj_mascarado place.cnpj",
    own_id="id",
    texts={
        "legal_name": "razao_social legal_name",
        "trade_name": "nome_fantasia trade_name",
        "registration_status": "situacao_cadastral standing.descricao standing.description standing.status standing.texto standing.nome status status.descricao status.description status.status status.texto status.nome",
        "street": "place.logradouro logradouro place.street",
        "number": "place.numero numero",
        "neighborhood": "place.bairro bairro",
        "city": "city.nome cidade_nome cidade place.cidade",
        "state": "state.sigla uf estado place.uf",
        "postal_code": "place.cep cep",
        "website": "website site place.website",
        "primary_activity": "activity.descricao cnae_principal_descricao",
    },
    lists="data items results empresas",
    strict=frozenset({"place"}),
)
#: Keys of an establishment that lists more than its id, and those that may hold the id alone.
DETAILS = "razao_social nome_fantasia cep logradouro cidade estado email telefone site website"
ID_ALONE = "place.cnpj cnpj cnpj_completo id taxId *"
#: Keys of contact values, and of the objects in lists of them.
CONTACT_KEYS = "full address value number"
FLAT_PHONES, FLAT_PHONE_LISTS, FLAT_PHONE_KEYS = "telefone telefone1 telefone2 celular whatsapp", "telefones phones", "numero telefone value"
FLAT_EMAIL_KEYS = "email value"


def member(v: Column, key: str) -> Column:
    """A key of an object; null for anything else."""
    return F.try_variant_get(v, f"$.{key}", "variant")


def text_of(v: Column) -> Column:
    """A text that isn't blank, without white space around it."""
    return F.when(F.schema_of_variant(v) == "STRING", F.nullif(F.btrim(F.try_variant_get(v, "$", "string"), F.lit(BLANKS)), F.lit("")))


def list_of(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT<"), F.lit(False))


def _at(path: str, root: Column, parts: dict[str, Column]) -> Column:
    if path == "*":
        return root
    part, _, key = path.rpartition(".")
    return member(parts[part] if part else root, key)


def _part(paths: str, strict: bool, root: Column, parts: dict[str, Column]) -> Column:
    values = [_at(p, root, parts) for p in paths.split()]
    if strict:
        filled = F.coalesce(*[F.when(~F.to_json(v).isin("null", '""', "{}", "[]", "false", "0"), v) for v in values])
        return F.when(is_object(filled), filled)
    return F.coalesce(*[F.when(F.schema_of_variant(v).rlike("^OBJECT<[^>]"), v) for v in values])


def _first(paths: str, root: Column, parts: dict[str, Column]) -> Column:
    found = [text_of(_at(p, root, parts)) for p in paths.split()]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def _listed(v: Column, keys: str, pair: tuple[str, str] | None = None) -> Column:
    """Texts of a list's items: a text itself, else area and number together, else the first text among the keys."""

    def one(x: Column) -> Column:
        texts = [text_of(member(x, k)) for k in keys.split()]
        joined = [F.concat(text_of(member(x, pair[0])), text_of(member(x, pair[1])))] if pair else []
        return F.coalesce(text_of(x), *joined, *texts)

    return F.coalesce(F.array_compact(F.transform(list_of(v), one)), F.array().cast("array<string>"))


def contact_values(v: Column) -> Column:
    """Values of a text, or of a list of texts and objects; repeated ones stay."""
    alone = text_of(v)
    return F.when(alone.isNotNull(), F.array(alone)).otherwise(_listed(v, CONTACT_KEYS, ("area", "number")))


def _or(first: Column, second: Column) -> Column:
    return F.when(F.size(first) > 0, first).otherwise(second)


def _distinct(values: list[Column]) -> Column:
    return F.array_distinct(F.array_compact(F.array(*values)))


def _place_phones(v: Column) -> Column:
    numbers = [F.concat(F.coalesce(text_of(member(v, f"ddd{k}")), F.lit("")), text_of(member(v, f"telefone{k}"))) for k in (1, 2)]
    return _distinct([*numbers, text_of(member(v, "telefone"))])


def _place_emails(v: Column) -> Column:
    return _distinct([text_of(member(v, "email"))])


def _flat_values(keys: str, lists: str, item_keys: str, *sources: Column) -> Column:
    """Values of all keys and lists of the sources, distinct in order."""
    each = [a for v in sources for a in (_distinct([text_of(member(v, k)) for k in keys.split()]), *[_listed(member(v, k), item_keys) for k in lists.split()])]
    return F.array_distinct(F.concat(*each))


def _contacts(name: str, root: Column, parts: dict[str, Column]) -> tuple[Column, Column]:
    if name == "office":
        return tuple(_or(contact_values(member(parts["office"], k)), contact_values(member(root, k))) for k in ("phones", "emails"))
    if name == "looked_up":
        return _place_phones(parts["place"]), _place_emails(parts["place"])
    if name == "establishment":
        return _or(_place_phones(parts["place"]), _place_phones(root)), _or(_place_emails(parts["place"]), _place_emails(root))
    sources = (root, parts["place"])
    return _flat_values(FLAT_PHONES, FLAT_PHONE_LISTS, FLAT_PHONE_KEYS, *sources), _flat_values("email", "emails", FLAT_EMAIL_KEYS, *sources)


SHAPES = {"office": OFFICE, "looked_up": LOOKED_UP, "establishment": ESTABLISHMENT, "flat": FLAT}


def email_domains(values: Column) -> Column:
    """Distinct domains of addresses, in order."""
    domains = F.transform(F.filter(values, lambda x: F.contains(x, F.lit("@"))), lambda x: F.lower(F.btrim(F.regexp_extract(x, "(?s)^[^@]*@(.*)$", 1), F.lit(BLANKS))))
    return F.array_distinct(F.filter(domains, lambda x: x != ""))


def found_candidates(responses: DataFrame, shape: str, payload: str = "payload") -> DataFrame:
    """One row for each candidate of a response, as VARIANT in the payload's place, with candidate_pos from 0.

    The first list among the shape's keys counts; of an office's keys one makes the response itself a candidate.
    Items that aren't objects are left out, texts stay for the shape "establishment", which lists bare ids.
    A response without candidates gives no row; columns named payload or candidate_pos are replaced."""
    s, root = SHAPES[shape], _parsed(responses, payload)
    lists = [list_of(_at(p, root, {})) for p in s.lists.split()]
    kept = lambda x: is_object(x) | (F.schema_of_variant(x) == "STRING") if shape == "establishment" else is_object(x)
    alone = [F.when(_has_any(root, s.single), F.array(root))] if s.single else []
    items = F.filter(F.coalesce(*lists, *alone), kept)
    others = [c for c in responses.columns if c not in (payload, "candidate_pos")]
    return responses.select(*[responses[f"`{c}`"].alias(c) for c in others], F.posexplode(items).alias("candidate_pos", payload))


def _has_any(root: Column, keys: str) -> Column:
    out = F.lit(False)
    for k in keys.split():
        out = out | member(root, k).isNotNull()
    return out


def _parsed(df: DataFrame, payload: str) -> Column:
    return df[payload] if isinstance(df.schema[payload].dataType, VariantType) else F.try_parse_json(df[payload])


def records(payloads: DataFrame, shape: str, payload: str = "payload", requested: str | None = None) -> DataFrame:
    """SRC8, R25 and R26: the columns of payloads but the payload itself, and a struct `record` of its fields.

    requested: the column of the id that was looked up, for payloads without one. company_id is the 14 digits
    of the first id, null where it has others; the shape "flat" keeps a masked id as masked_id, and record_id is
    the provider's own id or the company's. full_id tells whether there are 14 digits. lookup_id is the id of
    an establishment that lists nothing else, which has to be looked up. A column named record is replaced."""
    s = SHAPES[shape]
    others = [c for c in payloads.columns if c != payload]
    staged = payloads.select(F.struct(*[payloads[f"`{c}`"].alias(c) for c in others]).alias("row") if others else F.lit(None).alias("row"), _parsed(payloads, payload).alias("root"))
    for name, paths in s.parts.items():
        parts = {p: F.col(f"part_{p}") for p in s.parts if f"part_{p}" in staged.columns}
        staged = staged.withColumn(f"part_{name}", _part(paths, name in s.strict, F.col("root"), parts))
    parts, root = {p: F.col(f"part_{p}") for p in s.parts}, F.col("root")
    phones, emails = _contacts(shape, root, parts)
    raw = F.coalesce(_first(s.id, root, parts), F.col(f"row.{requested}").cast("string") if requested else F.lit(None).cast("string"))
    texts = {c: _first(s.texts.get(c, ""), root, parts) for c in TEXTS}
    detailed = (F.col("part_place").isNotNull() | _first(DETAILS, root, parts).isNotNull()) if shape == "establishment" else F.lit(True)
    alone = company_id(_first(ID_ALONE, root, parts)) if shape == "establishment" else F.lit(None).cast("string")
    read = staged.select(
        "row", raw.alias("raw_id"), _first(s.own_id, root, parts).alias("own_id"), *[v.alias(c) for c, v in texts.items()], phones.alias("phones"), emails.alias("emails"), F.when(~detailed, alone).alias("lookup_id"),
    )
    c = F.col
    full = company_id(c("raw_id"))
    masked = F.when(full.isNull(), c("raw_id")) if shape == "flat" else F.lit(None).cast("string")
    record = F.struct(
        F.lit(shape).alias("shape"), full.alias("company_id"), masked.alias("masked_id"), full.isNotNull().alias("full_id"), F.when(F.coalesce(full, masked).isNotNull(), F.coalesce(c("own_id"), full, masked)).alias("record_id"), "lookup_id",
        "legal_name", "trade_name", "registration_status", address.joined(c("street"), c("number")).alias("address"), c("street").alias("street_name"), c("number").alias("street_number"), "neighborhood", "city",
        state_code(c("state")).alias("state"), "postal_code", "municipality", "website", domain_of(c("website")).alias("domain"), "phones", "emails", email_domains(c("emails")).alias("email_domains"),
        "primary_activity", blank_to_null(F.regexp_replace(c("activity_id"), r"\D", "")).alias("activity_id"),
    )
    return read.select(*([c(f"row.`{o}`").alias(o) for o in others if o != "record"]), record.alias("record"))
