"""Queries of name variants and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadmill.operators import name_variants as nv
from leadmill.sources.domain import oracle, table


def _n1(c: str) -> str:
    return f"nullif(trim(regexp_replace(lower(regexp_replace(strip_accents({c}), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g')), '')"


def _in(x: str, *words: str) -> str:
    return f"{x} IN ({', '.join(repr(w) for w in words)})"


def _unspaced(y: str) -> str:
    return f"nullif(trim(regexp_replace({y}, ' +', ' ', 'g')), '')"


def _spaced(x: str) -> str:
    return f"(' ' || replace({x}, ' ', '  ') || ' ')"


def _bare(x: str) -> str:
    return _unspaced(f"regexp_replace({_spaced(x)}, '{nv.noise_pattern(nv.CONNECTORS)}', '', 'g')")


def _city(x: str) -> str:
    each = (f"WHEN ends_with({x}, ' {c}') THEN left({x}, length({x}) - {len(c) + 1}) WHEN regexp_matches(' ' || {x}, ' {c} \\S+$') THEN regexp_replace({x}, '(?: \\S+){{{len(c.split())}}}$', '')" for c in nv.CITIES)
    return f"CASE {' '.join(each)} ELSE {x} END"


def _noise(x: str, phrases: tuple[str, ...], keep: bool) -> str:
    cut = f"regexp_replace(CASE WHEN kind IS NULL THEN {_spaced(x)} ELSE replace({_spaced(x)}, {_spaced('kind')}, '') END, '{nv.noise_pattern(phrases)}', '', 'g')"
    return _unspaced(cut) if keep else f"CASE WHEN {cut} = {_spaced(x)} THEN {x} ELSE {_unspaced(f"regexp_replace({cut}, '{nv.noise_pattern(nv.CONNECTORS)}', '', 'g')")} END"


def _core(x: str) -> str:
    return f"CASE WHEN contains({_bare(x)}, ' ') THEN {_bare(x)} ELSE {x} END"


def _group(x: str, pattern: str, k: int) -> str:
    return f"nullif(regexp_extract({x}, '{pattern}', {k}), '')"


def _prefix(x: str) -> str:
    return f"CASE WHEN NOT regexp_matches({x}, '{nv.PREFIX_KEPT}') THEN {_group(x, nv.PREFIX_CUT, 1)} END"


def _searchable(x: str) -> str:
    held = f"string_split({x}, ' ')"
    return f"({x} IS NOT NULL AND (length({x}) >= 3 OR (regexp_matches({x}, '[0-9]') AND length(replace({x}, ' ', '')) >= 2)) AND NOT {_in(held + '[1]', *nv.ADDRESS_WORDS)} AND len(list_filter({held}, lambda w: NOT {_in('w', *nv.CONNECTORS, *nv.NOISE_WORDS)})) > 0)"


def _generic(x: str) -> str:
    return f"({_in(f"replace({x}, ' ', '')", 'cc', 'me', 'mei')} OR len(list_filter(string_split({x}, ' '), lambda w: NOT {_in('w', *nv.CONNECTORS, *nv.GENERIC_TERMS)})) = 0)"


def _legal(x: str) -> str:
    return f"list_has_any(string_split({x}, ' '), {list(nv.LEGAL_TERMS)})"


def _written(found: str) -> str:
    word = f"CASE WHEN {_in('w', *nv.CONNECTORS)} THEN w WHEN length(w) <= 2 THEN upper(w) ELSE upper(left(w, 1)) || substr(w, 2) END"
    return f"list_transform({found}, lambda x: array_to_string(list_transform(string_split(x, ' '), lambda w: {word}), ' '))"


def variant_steps(source: str, most: int = 4) -> str:
    """Common table expressions that end in nv (business_name, category, names, alias, legal as lists of variants in small letters)."""
    plain = f"NOT {_in('w', *nv.CONNECTORS, *nv.ADDRESS_WORDS)}"
    pairs = lambda names, low: ", ".join(f"({low + k}, {v})" for k, v in enumerate(names))
    rows = lambda names, low: f"SELECT k, n, t.p, t.v FROM nr4, LATERAL (VALUES {pairs(names, low)}) t(p, v)"
    whole = ("address", "s", "city", "place", "word", "prefix")
    part = ("s", "address", "light", "heavy", "bothn", "city", "place", "word", "prefix", "heavy_prefix", "core", "lastb")
    first, own = ("opening", "front", "front_core"), ("bare", "stripped_place", "stripped_prefix", "lastb")
    leads_first = f"({_in('o1', *nv.BRAND_STARTS)} OR regexp_matches(o1, '[0-9]') OR length(o1) <= 3 OR {_in('o2', *nv.BRAND_STOPS, *nv.TOWNS, *nv.BRANCH_WORDS)} OR o2 IS NULL)"
    joins = f"l2 IS NOT NULL AND NOT {_in('l2', *nv.TOWNS, *nv.ADDRESS_WORDS)} AND (NOT {_in('l2', *nv.BRAND_STOPS)} OR (regexp_matches(l1, '^[a-z]{{1,3}}$') AND l2 = 'construcao'))"
    ranked = lambda found, good: f"SELECT k, list(v ORDER BY rank) AS vs FROM (SELECT k, v, min(rank) AS rank FROM ({found}) WHERE {good} GROUP BY k, v) GROUP BY k"
    at = "(n * 1000 + p)"
    bare_name = "replace(replace(business_name, '''', ''), '’', '')"
    return f"""nm AS (SELECT row_number() OVER () AS k, *, {_n1('category')} AS kind, {_n1(f"regexp_replace({bare_name}, '{nv.SEPARATORS}', ' ', 'g')")} AS whole,
  list_filter(list_transform(regexp_split_to_array({bare_name}, '{nv.SEPARATORS}'), lambda y: {_n1('y')}), lambda y: y IS NOT NULL) AS parts FROM (SELECT DISTINCT business_name, category FROM ({source}))),
ns AS (SELECT k, kind, 0 AS n, whole AS s FROM nm WHERE whole IS NOT NULL UNION ALL SELECT k, kind, i AS n, parts[i] AS s FROM nm, LATERAL (SELECT unnest(generate_series(1, len(parts))) AS i) WHERE whole IS NOT NULL),
nr1 AS (SELECT *, regexp_replace(s, '{nv.ADDRESS_CUT}', '\\1') AS address, {_city('s')} AS city, regexp_replace(s, '{nv.PLACE_CUT}', '\\1') AS place, {_group('s', nv.PLACE_CUT, 2)} AS word FROM ns),
nr2 AS (SELECT *, {_city('address')} AS stripped, {_prefix('address')} AS prefix, {_noise('address', nv.HEAVY_NOISE, True)} AS heavy, {_noise('s', nv.LIGHT_NOISE, False)} AS light, {_noise('s', nv.LIGHT_NOISE + nv.HEAVY_NOISE, False)} AS bothn, {_noise('city', nv.HEAVY_NOISE, False)} AS city_heavy,
  {_group(_bare('s'), nv.LAST_BRAND, 1)} AS lb FROM nr1),
nr3 AS (SELECT *, {_prefix('heavy')} AS heavy_prefix, {_core('city_heavy')} AS core, CASE WHEN NOT {_in('lb', *nv.ADDRESS_WORDS)} THEN lb END AS lastb, {_noise('stripped', nv.HEAVY_NOISE, True)} AS bare, regexp_replace(stripped, '{nv.PLACE_CUT}', '\\1') AS stripped_place, {_prefix('stripped')} AS stripped_prefix,
  string_split({_bare('stripped')}, ' ')[1] AS o1, string_split({_bare('stripped')}, ' ')[2] AS o2, {_group('stripped', nv.LEADING, 1)} AS l1, regexp_extract(stripped, '{nv.LEADING}', 2) AS lm, {_group('stripped', nv.LEADING, 3)} AS l2 FROM nr2),
nr3b AS (SELECT *, CASE WHEN NOT {_in('o1', *nv.GENERIC_PREFIXES, *nv.ADDRESS_WORDS, *nv.TOWNS, *nv.GENERIC_TERMS)} AND length(o1) >= 2 AND {leads_first} THEN o1 END AS opening,
  CASE WHEN NOT {_in('l1', *nv.CONNECTORS, *nv.TOWNS, *nv.ADDRESS_WORDS)} THEN l1 || lm || CASE WHEN {joins} THEN ' ' || l2 ELSE '' END END AS front FROM nr3),
nr4 AS (SELECT *, {_core('front')} AS front_core FROM nr3b),
nb0 AS (SELECT k, n, b, ({list(nv.BRANDS)})[b] AS brand, strpos(' ' || s || ' ', ' ' || ({list(nv.BRANDS)})[b] || ' ') AS place_of, s FROM ns, range(1, {len(nv.BRANDS) + 1}) AS t(b)),
nb1 AS (SELECT k, n, b, brand, list_filter(string_split(trim(substr(' ' || s || ' ', place_of + length(brand) + 1)), ' '), lambda w: w <> '') AS rest FROM nb0 WHERE place_of > 0),
nb AS (SELECT k, n, t.p, t.v FROM nb1, LATERAL (VALUES (300 + b * 10, brand), (301 + b * 10, CASE WHEN len(list_filter(rest[1:1], lambda w: {plain})) > 0 THEN brand || ' ' || rest[1] END),
  (302 + b * 10, CASE WHEN {_in('rest[1]', *nv.TOWNS)} AND len(list_filter(rest[2:2], lambda w: {plain})) > 0 THEN brand || ' ' || rest[2] END), (303 + b * 10, brand || ' ' || list_filter(rest, lambda w: {plain} AND NOT {_in('w', *nv.TOWNS)})[1])) t(p, v)),
nn AS ({ranked(f"SELECT k, {at} AS rank, v FROM ({rows(whole, 100)} WHERE n = 0 UNION ALL {rows(part, 200)} WHERE n > 0 UNION ALL SELECT * FROM nb)", _searchable('v'))}),
nf AS (SELECT nm.*, coalesce(vs, []) AS found, len(parts) > 1 AS split, nm.k IN (SELECT k FROM nb WHERE n = 0) AS chains FROM nm LEFT JOIN nn ON nm.k = nn.k),
na AS ({ranked(f'''SELECT k, p - 100000 AS rank, v FROM nb WHERE n = 0 UNION ALL
  SELECT k, {at} AS rank, v FROM ({rows(first, 200)} UNION ALL SELECT k, n, p, v FROM nb UNION ALL SELECT k, n, 500, stripped FROM nr4 WHERE n > 0 OR k NOT IN (SELECT k FROM nf WHERE chains) UNION ALL {rows(own, 600)}) c WHERE n > 0 OR k NOT IN (SELECT k FROM nf WHERE split)
  UNION ALL SELECT k, 1000000 + i AS rank, found[i] AS v FROM nf, LATERAL (SELECT unnest(generate_series(1, least({most + 2}, len(found)))) AS i)
    WHERE len(string_split(found[i], ' ')) <= 4 AND NOT (split AND NOT contains(found[i], ' ')) AND NOT ((split OR chains) AND found[i] = whole)''', _searchable('v') + ' AND NOT ' + _generic('v'))}),
nl AS ({ranked(f'''SELECT k, p AS rank, v FROM ({rows(('s', 'address', 'stripped'), 0)} WHERE n = 0) UNION ALL SELECT k, 10 + i AS rank, found[i] AS v FROM nf, LATERAL (SELECT unnest(generate_series(1, least({most}, len(found)))) AS i)''', _legal('v') + f" AND k IN (SELECT k FROM nm WHERE {_legal('whole')})")}),
nv AS (SELECT business_name, category, found[1:{most}] AS names, coalesce(na.vs, [])[1:{most}] AS alias, coalesce(nl.vs, [])[1:{most}] AS legal FROM nf LEFT JOIN na ON nf.k = na.k LEFT JOIN nl ON nf.k = nl.k)"""


_NAME = """concat(CASE c_custkey % 7 WHEN 0 THEN 'Pet Shop ' WHEN 1 THEN 'Casa ' WHEN 2 THEN 'Agro ' WHEN 3 THEN 'Cobasi ' WHEN 4 THEN 'ABC da ' WHEN 5 THEN 'Leroy Merlin ' ELSE '' END,
 CASE c_custkey % 6 WHEN 0 THEN 'Londrina ' WHEN 1 THEN 'Construção ' WHEN 2 THEN 'do Bixiga ' WHEN 3 THEN 'Banho e Tosa ' WHEN 4 THEN 'Mecânica ' ELSE 'de Ferro ' END,
 CASE c_custkey % 11 WHEN 0 THEN '| Padaria ' WHEN 1 THEN '- Av. Higienópolis ' WHEN 2 THEN 'São Paulo Centro ' WHEN 3 THEN 'Comércio LTDA ' WHEN 4 THEN 'Rua Nova ' WHEN 5 THEN '(Loja) ' ELSE '' END,
 CASE WHEN c_custkey % 13 < 8 THEN concat('No', CAST(c_custkey % 1000 AS VARCHAR(20))) WHEN c_custkey % 13 < 10 THEN 'do Campo' ELSE 'Campinas' END)"""
_KIND = "CASE c_custkey % 4 WHEN 0 THEN 'Padaria' WHEN 1 THEN 'Pet Shop' END"
_NAMES = f"SELECT {_NAME} AS business_name, {_KIND} AS category FROM customer"
_listed = lambda c: F.array_join(c, "|")

QUERIES = {
    "n28_name_variants": lambda s, d: nv.of_names(table(s, d, "customer").selectExpr(f"{_NAME} AS business_name", f"{_KIND} AS category")).select("business_name", "category", *[_listed(c).alias(c) for c in ("names", "alias", "legal")]),
    "n28_variants_of_leads": lambda s, d: nv.with_variants(table(s, d, "leads").select("lead_id", "business_name", "category")).select("lead_id", *[_listed(c).alias(c) for c in ("names", "alias", "legal")]),
}
_spelled = ", ".join(f"array_to_string({_written(c)}, '|') AS {c}" for c in ("names", "alias", "legal"))
ORACLE_SQL = {
    "n28_name_variants": f"WITH {variant_steps(_NAMES)} SELECT business_name, category, {_spelled} FROM nv",
    "n28_variants_of_leads": oracle("", "leads").rstrip() + ",\n" + variant_steps("SELECT business_name, category FROM leads") + f" SELECT lead_id, {_spelled} FROM leads JOIN nv ON leads.business_name = nv.business_name AND leads.category = nv.category",
}
