"""Queries of registry payloads, and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadmill.functions.text import STATES
from leadmill.plans.lead_queries import _N1
from leadmill.sources import payloads
from leadmill.sources.domain import oracle, table
from leadmill.sources.payloads import SHAPES, TEXTS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
LISTS = ("phones", "emails", "email_domains")


def _flat(df: DataFrame) -> DataFrame:
    """A record's fields as columns, lists joined by a bar."""
    fields = df.schema["record"].dataType.names
    return df.select(*[c for c in df.columns if c != "record"], *[(F.array_join(f"record.{f}", "|") if f in LISTS else F.col(f"record.{f}")).alias(f) for f in fields])


def _lookups(shape: str, requested: str | None) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: _flat(payloads.records(table(s, d, "registry_payloads").where(F.col("shape") == shape).select("payload_id", "requested_id", "payload"), shape, requested=requested)).drop("requested_id")


def _found(s: SparkSession, d: str) -> DataFrame:
    """Candidates of all responses, each shape by its own keys."""
    responses, each = table(s, d, "registry_responses"), []
    for shape in ("office", "establishment", "flat"):
        mine = responses.where(F.col("shape") == shape).select("payload_id", "payload")
        each.append(_flat(payloads.records(payloads.found_candidates(mine, shape), shape)))
    return each[0].unionByName(each[1]).unionByName(each[2])


# the same in SQL over JSON
def _member(x: str, key: str) -> str:
    return f"json_extract({x}, '$.{key}')"


def _text(x: str) -> str:
    return f"CASE WHEN json_type({x}) = 'VARCHAR' THEN nullif(trim(json_extract_string({x}, '$')), '') END"


def _at(path: str) -> str:
    part, _, key = path.rpartition(".")
    return "root" if path == "*" else _member(f"part_{part}" if part else "root", key)


def _first(paths: str) -> str:
    return "coalesce(NULL, " + ", ".join(_text(_at(p)) for p in paths.split()) + ")" if paths else "CAST(NULL AS VARCHAR)"


def _part(paths: str, strict: bool) -> str:
    at = [_at(p) for p in paths.split()]
    if strict:
        filled = "coalesce(" + ", ".join(f"CASE WHEN CAST({x} AS VARCHAR) NOT IN ('null', '\"\"', '{{}}', '[]', 'false', '0') THEN {x} END" for x in at) + ")"
        return f"CASE WHEN json_type({filled}) = 'OBJECT' THEN {filled} END"
    return "coalesce(NULL, " + ", ".join(f"CASE WHEN json_type({x}) = 'OBJECT' AND CAST({x} AS VARCHAR) <> '{{}}' THEN {x} END" for x in at) + ")"


def _items(x: str) -> str:
    return f"CASE WHEN json_type({x}) = 'ARRAY' THEN CAST({x} AS JSON[]) ELSE CAST([] AS JSON[]) END"


def _kept(xs: str) -> str:
    return f"list_filter({xs}, lambda t: t IS NOT NULL)"


def _listed(x: str, keys: str, pair: bool = False) -> str:
    joined = f"{_text(_member('i', 'area'))} || {_text(_member('i', 'number'))}, " if pair else ""
    return _kept(f"list_transform({_items(x)}, lambda i: coalesce({_text('i')}, {joined}{', '.join(_text(_member('i', k)) for k in keys.split())}))")


def _ordered(xs: str) -> str:
    """Distinct values by their first place."""
    return f"list_filter({xs}, lambda t, k: list_position({xs}, t) = k)"


def _values(x: str) -> str:
    return f"CASE WHEN {_text(x)} IS NOT NULL THEN [{_text(x)}] ELSE {_listed(x, payloads.CONTACT_KEYS, True)} END"


def _or(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 THEN {a} ELSE {b} END"


def _contacts(shape: str) -> tuple[str, str]:
    if shape == "office":
        phones, emails = (_or(_values(_member("part_office", k)), _values(_member("root", k))) for k in ("phones", "emails"))
        return phones, emails
    if shape == "flat":
        phones, emails = [], []
        for x in ("root", "part_place"):
            phones += ["[" + ", ".join(_text(_member(x, k)) for k in payloads.FLAT_PHONES.split()) + "]", *[_listed(_member(x, k), payloads.FLAT_PHONE_KEYS) for k in payloads.FLAT_PHONE_LISTS.split()]]
            emails += ["[" + _text(_member(x, "email")) + "]", _listed(_member(x, "emails"), payloads.FLAT_EMAIL_KEYS)]
        return _kept(" || ".join(phones)), _kept(" || ".join(emails))

    def numbers(x: str) -> str:
        each = [f"coalesce({_text(_member(x, f'ddd{k}'))}, '') || {_text(_member(x, f'telefone{k}'))}" for k in (1, 2)]
        return _kept(f"[{each[0]}, {each[1]}, {_text(_member(x, 'telefone'))}]")

    mail = lambda x: _kept(f"[{_text(_member(x, 'email'))}]")
    if shape == "looked_up":
        return numbers("part_place"), mail("part_place")
    return _or(numbers("part_place"), numbers("root")), _or(mail("part_place"), mail("root"))


_FIELDS = ("legal_name", "trade_name", "registration_status", "neighborhood", "city", "postal_code", "municipality", "website", "primary_activity")
_STATE = "CASE WHEN upper(state) IN (" + ", ".join(f"'{c}'" for c in STATES.values()) + ") THEN upper(state) " + " ".join(f"WHEN {_N1('state')} = '{n}' THEN '{c}'" for n, c in STATES.items()) + " ELSE state END"


def _sql(shape: str, source: str, keys: str, requested: str = "CAST(NULL AS VARCHAR)") -> str:
    """Records of one shape: source has the columns keys and a JSON column root."""
    s = SHAPES[shape]
    for name, paths in s.parts.items():
        source = f"SELECT *, {_part(paths, name in s.strict)} AS part_{name} FROM ({source})"
    phones, emails = _contacts(shape)
    detailed = f"part_place IS NOT NULL OR {_first(payloads.DETAILS)} IS NOT NULL" if shape == "establishment" else "true"
    digits = lambda x: f"regexp_replace({x}, '\\D', '', 'g')"
    id_alone = _first(payloads.ID_ALONE) if shape == "establishment" else "CAST(NULL AS VARCHAR)"
    read = f"""SELECT {keys}, coalesce({_first(s.id)}, {requested}) AS raw_id, {_first(s.own_id)} AS own_id, {", ".join(f"{_first(s.texts.get(c, ''))} AS {c}" for c in TEXTS)},
 {phones} AS all_phones, {emails} AS all_emails, CASE WHEN NOT ({detailed}) THEN {id_alone} END AS id_alone FROM ({source})"""
    told = f"""SELECT *, CASE WHEN len({digits("raw_id")}) = 14 THEN {digits("raw_id")} END AS company_id, {_ordered("all_phones") if shape != "office" else "all_phones"} AS ph, {_ordered("all_emails") if shape != "office" else "all_emails"} AS em FROM ({read})"""
    masked = "CASE WHEN company_id IS NULL THEN raw_id END" if shape == "flat" else "CAST(NULL AS VARCHAR)"
    domains = "list_filter(list_transform(list_filter(em, lambda x: contains(x, '@')), lambda x: lower(trim(substring(x, strpos(x, '@') + 1)))), lambda x: x <> '')"
    url = "CASE WHEN contains(website, '://') THEN website ELSE 'https://' || website END"
    return f"""SELECT {keys}, '{shape}' AS shape, company_id, {masked} AS masked_id, company_id IS NOT NULL AS full_id, CASE WHEN coalesce(company_id, {masked}) IS NOT NULL THEN coalesce(own_id, company_id, {masked}) END AS record_id,
 CASE WHEN len({digits("id_alone")}) = 14 THEN {digits("id_alone")} END AS lookup_id, {", ".join(_FIELDS)}, CASE WHEN street IS NOT NULL THEN concat_ws(', ', street, number) END AS address, street AS street_name, number AS street_number,
 {_STATE} AS state, nullif(regexp_replace(lower(regexp_extract({url}, '://([^/?#]*)', 1)), '^www\\.', ''), '') AS domain, array_to_string(ph, '|') AS phones, array_to_string(em, '|') AS emails, array_to_string({_ordered(domains)}, '|') AS email_domains,
 nullif({digits("activity_id")}, '') AS activity_id FROM ({told})"""


def _payloads(shape: str) -> str:
    return f"SELECT payload_id, requested_id, TRY_CAST(payload AS JSON) AS root FROM registry_payloads WHERE shape = '{shape}'"


def _responses(shape: str) -> str:
    s = SHAPES[shape]
    lists = ", ".join(f"CASE WHEN json_type({_at(p)}) = 'ARRAY' THEN CAST({_at(p)} AS JSON[]) END" for p in s.lists.split())
    single = ", CASE WHEN " + " OR ".join(f"{_member('root', k)} IS NOT NULL" for k in s.single.split()) + " THEN [root] END" if s.single else ""
    kinds = "('OBJECT', 'VARCHAR')" if shape == "establishment" else "('OBJECT')"
    items = f"SELECT payload_id, list_filter(coalesce({lists}{single}), lambda i: json_type(i) IN {kinds}) AS items FROM (SELECT payload_id, TRY_CAST(payload AS JSON) AS root FROM registry_responses WHERE shape = '{shape}')"
    return f"SELECT payload_id, unnest(range(len(items))) AS candidate_pos, unnest(items) AS root FROM ({items})"


for _name, _shape, _asked in (("src8_office_lookups", "office", True), ("r25_place_lookups", "looked_up", True), ("r25_place_candidates", "establishment", False), ("r26_flat_candidates", "flat", False)):
    QUERIES[_name] = _lookups(_shape, "requested_id" if _asked else None)
    ORACLE_SQL[_name] = oracle(_sql(_shape, _payloads(_shape), "payload_id", *(["requested_id"] if _asked else [])), "registry_payloads")
QUERIES["r20_found_candidates"] = _found
ORACLE_SQL["r20_found_candidates"] = oracle(" UNION ALL BY NAME ".join(_sql(_shape, _responses(_shape), "payload_id, candidate_pos") for _shape in ("office", "establishment", "flat")), "registry_responses")
