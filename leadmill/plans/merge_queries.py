"""Queries of ordered merges and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadmill.functions import text
from leadmill.operators import extraction, matching, merging, preview_merge
from leadmill.plans.more_queries import _FULL, _HOST, _RECURSIVE, _TEXT
from leadmill.plans.variant_queries import _n1
from leadmill.sources.domain import dealt, table

QUERIES, ORACLE_SQL = {}, {}

# Items of which a third meet only under a key that their merged row has.
_B = "CAST(c_custkey - c_custkey % 6 AS VARCHAR(20))"
_ITEMS = f"""SELECT c_custkey AS item_pos,
  CASE c_custkey % 6 WHEN 0 THEN concat('Casa ', {_B}) WHEN 1 THEN concat('  Casa ', {_B}, ' Longa') WHEN 2 THEN concat('CASA ', {_B}, ' Longa') ELSE concat('Loja ', {_B}) END AS business_name,
  CASE c_custkey % 6 WHEN 0 THEN concat('casa ', {_B}) WHEN 1 THEN concat('casa ', {_B}, ' longa') WHEN 2 THEN concat('casa ', {_B}, ' longa') ELSE concat('loja ', {_B}) END AS name_key,
  CASE c_custkey % 6 WHEN 0 THEN 'Pet' WHEN 1 THEN 'pet shop' WHEN 3 THEN 'móveis' WHEN 4 THEN 'Moveis' WHEN 5 THEN '' ELSE 'Outra' END AS category,
  CASE c_custkey % 6 WHEN 0 THEN concat('rua ', {_B}, ' 1') WHEN 2 THEN concat('rua ', {_B}, ' 1') ELSE NULL END AS address_key,
  CASE c_custkey % 6 WHEN 4 THEN 'centro' ELSE NULL END AS neighborhood_key,
  CASE c_custkey % 6 WHEN 3 THEN n_name WHEN 5 THEN concat(n_name, ' ') ELSE NULL END AS city, CASE c_custkey % 6 WHEN 3 THEN lower(n_name) WHEN 5 THEN lower(n_name) ELSE NULL END AS city_key,
  CASE c_custkey % 6 WHEN 3 THEN concat('loja', {_B}, '.com.br') WHEN 4 THEN concat('loja', {_B}, '.com.br') ELSE NULL END AS domain,
  CASE c_custkey % 4 WHEN 0 THEN 'a@b.com' WHEN 1 THEN concat('extra.a@b.com') ELSE NULL END AS email,
  CASE WHEN c_custkey % 6 < 2 THEN concat('+5511', {_B}) ELSE NULL END AS phone,
  CASE WHEN c_custkey % 36 = 6 THEN concat('place-', CAST(c_custkey - c_custkey % 36 AS VARCHAR(20))) WHEN c_custkey % 36 = 0 THEN concat('place-', CAST(c_custkey AS VARCHAR(20))) ELSE NULL END AS google_place_id,
  CAST(NULL AS VARCHAR(20)) AS google_maps_url,
  CASE c_custkey % 3 WHEN 0 THEN 'b' WHEN 1 THEN 'a' ELSE '' END AS term_1, CASE c_custkey % 5 WHEN 0 THEN 'c' WHEN 1 THEN 'a' ELSE NULL END AS term_2,
  CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR(20)) ELSE NULL END AS pay_x, CAST(c_custkey % 7 AS VARCHAR(20)) AS pay_y
FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey"""
_FIELDS = [c for c in preview_merge.TEXTS if f" AS {c}" in _ITEMS]


def _items(s: SparkSession, d: str) -> DataFrame:
    rows = s.sql(_ITEMS, customer=dealt(table(s, d, "customer")), nation=table(s, d, "nation"))
    return rows.withColumns({"search_terms": F.array("term_1", "term_2"), "payload": F.create_map(F.lit("x"), F.col("pay_x"), F.lit("y"), F.col("pay_y"))})


def _m6(s: SparkSession, d: str) -> DataFrame:
    merged, _ = preview_merge.merged_previews(_items(s, d))
    return merged.select("group_pos", "members", *_FIELDS, F.array_join("search_terms", "|").alias("terms"), F.col("payload")["x"].alias("pay_x"), F.col("payload")["y"].alias("pay_y"))


def _keys(source: str, node: str) -> str:
    held = lambda *cs: " AND ".join(f"coalesce({c}, '') <> ''" for c in cs)
    each = [("g", "google_place_id"), ("m", "google_maps_url"), ("d", "domain"), ("p", "phone"), ("a", "name_key", "address_key"), ("n", "name_key", "neighborhood_key", "city_key"), ("c", "name_key", "city_key")]
    return " UNION ALL ".join(f"SELECT {node} AS node, concat_ws('|', '{k}', {', '.join(cs)}) AS key FROM {source} WHERE {held(*cs)}" for k, *cs in each)


def _fold(k: int) -> str:
    richer = f"CASE WHEN contains({_n1('b')}, {_n1('a')}) AND length(b) > length(a) THEN b ELSE a END"
    fields = ", ".join(f"list_reduce(list(trim({c}) ORDER BY item_pos) FILTER (trim({c}) <> ''), lambda a, b: {richer}) AS {c}" for c in _FIELDS)
    return f"m{k} AS (SELECT group_pos, count(*) AS members, {fields}, arg_max(pay_x, item_pos) AS pay_x, arg_max(pay_y, item_pos) AS pay_y FROM items JOIN g{k} USING (item_pos) GROUP BY group_pos)"


def _rounds(most: int) -> str:
    steps = [f"e0 AS ({_keys('items', 'item_pos')})", "r0 AS (SELECT item_pos AS node, item_pos AS other FROM items UNION SELECT r.node, y.node FROM r0 r JOIN e0 x ON r.other = x.node JOIN e0 y ON x.key = y.key)", "g0 AS (SELECT node AS item_pos, min(other) AS group_pos FROM r0 GROUP BY node)", _fold(0)]
    for k in range(1, most + 1):
        steps += [
            f"e{k} AS ({_keys(f'm{k - 1}', 'group_pos')})", f"r{k} AS (SELECT group_pos AS node, group_pos AS other FROM m{k - 1} UNION SELECT r.node, y.node FROM r{k} r JOIN e{k} x ON r.other = x.node JOIN e{k} y ON x.key = y.key)",
            f"h{k} AS (SELECT node, min(other) AS least FROM r{k} GROUP BY node)", f"g{k} AS (SELECT item_pos, least AS group_pos FROM g{k - 1} JOIN h{k} ON group_pos = node)", _fold(k),
        ]
    return ", ".join(steps)


QUERIES["m6_merged_previews"] = _m6
ORACLE_SQL["m6_merged_previews"] = f"""WITH RECURSIVE items AS ({_ITEMS.format(customer='customer', nation='nation')}), {_rounds(2)},
t AS (SELECT group_pos, string_agg(term, '|' ORDER BY first) AS terms FROM (SELECT group_pos, term, min(item_pos * 2 + k) AS first FROM (SELECT item_pos, 0 AS k, term_1 AS term FROM items UNION ALL SELECT item_pos, 1, term_2 FROM items) JOIN g2 USING (item_pos) WHERE term <> '' GROUP BY group_pos, term) GROUP BY group_pos)
SELECT m2.*, terms FROM m2 LEFT JOIN t USING (group_pos)"""

_TAGS = "CASE lead_id % 4 WHEN 0 THEN 'vip|norte' WHEN 1 THEN 'norte|novo' WHEN 2 THEN 'sul' ELSE '' END"
_NOTES = "CASE lead_id % 3 WHEN 0 THEN concat('Ligar ', CAST(lead_id - lead_id % 4 AS VARCHAR(20))) WHEN 1 THEN 'Ligar' ELSE NULL END"
_SIGNAL = "CASE lead_id % 2 WHEN 0 THEN 'delivery' ELSE 'catalog' END"


def _with_details(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    leads = table(s, d, "leads")
    members = merging.clusters(matching.duplicate_links(leads))
    return leads.withColumns({"tags": F.split(F.expr(_TAGS), r"\|"), "notes": F.expr(_NOTES)}), members, matching.priorities(leads, table(s, d, "contacts"))


QUERIES["m3_merged_tags"] = lambda s, d: merging.merged_tags(*_with_details(s, d)).select("cluster", F.array_join("tags", "|").alias("tags"))
QUERIES["m3_merged_notes"] = lambda s, d: merging.merged_notes(*_with_details(s, d))


def _profiles(s: SparkSession, d: str) -> DataFrame:
    leads, members, priority = _with_details(s, d)
    told = leads.select("lead_id", F.expr(_SIGNAL).alias("signal"), (F.col("lead_id") % 5 == 0).alias("relevant"), (F.col("lead_id") % 10 / F.lit(10.0)).alias("confidence"), F.col("tags").alias("words"))
    return merging.merged_profiles(told, members, priority).withColumn("words", F.array_join("words", "|"))


QUERIES["m3_merged_profiles"] = _profiles
_MEMBERS = _RECURSIVE + f""",
r AS (SELECT l.*, cluster, lead_score + 3 * ({_FULL}) + coalesce((SELECT sum(confidence) FROM contacts c WHERE c.lead_id = l.lead_id), 0) AS priority FROM leads l JOIN cl ON l.lead_id = cl.lead_id),
d AS (SELECT cluster, lead_id, string_split({_TAGS}, '|') AS tags, {_NOTES} AS notes, {_SIGNAL} AS signal, lead_id % 5 = 0 AS relevant, (lead_id % 10) / 10.0 AS confidence, row_number() OVER (PARTITION BY cluster ORDER BY priority DESC, lead_id) AS n FROM r)"""
_UNION = lambda by: f"SELECT {by}, string_agg(tag, '|' ORDER BY first) AS tags FROM (SELECT {by}, tag, min(n * 100 + i) AS first FROM (SELECT {by}, n, unnest(tags) AS tag, unnest(generate_series(1, len(tags))) AS i FROM d) WHERE tag <> '' GROUP BY {by}, tag) GROUP BY {by}"
ORACLE_SQL["m3_merged_tags"] = f"{_MEMBERS} {_UNION('cluster')}"
ORACLE_SQL["m3_merged_notes"] = _MEMBERS + r""",
w AS (SELECT cluster, list({'i': lead_id, 't': notes} ORDER BY n) AS each FROM d WHERE notes <> '' GROUP BY cluster)
SELECT cluster, list_reduce(each, lambda a, b: CASE WHEN contains(a.t, b.t) THEN a ELSE {'i': a.i, 't': a.t || chr(10) || chr(10) || '[Merged from lead ' || CAST(b.i AS VARCHAR) || ']' || chr(10) || b.t} END).t AS notes FROM w"""
ORACLE_SQL["m3_merged_profiles"] = f"{_MEMBERS}, u AS ({_UNION('cluster, signal')}) SELECT cluster, signal, max(relevant) AS relevant, CAST(max(confidence) AS DOUBLE) AS confidence, coalesce(max(u.tags), '') AS words FROM d LEFT JOIN u USING (cluster, signal) GROUP BY cluster, signal"

QUERIES["a12_host_words"] = lambda s, d: extraction.merged_signal_words(table(s, d, "pages"), text.domain_of(F.col("url")), F.col("page_id")).withColumn("words", F.array_join("words", "|"))
_words = lambda held: "[" + ", ".join(f"CASE WHEN contains(t, strip_accents('{w}')) THEN '{w}' END" for w in held) + "]"
ORACLE_SQL["a12_host_words"] = f"WITH p AS (SELECT page_id, {_HOST} AS host, coalesce({_n1(_TEXT)}, '') AS t FROM pages), c AS (" + " UNION ALL ".join(f"SELECT page_id, host, '{k}' AS signal, {_words(w)} AS words FROM p" for k, w in text.SIGNALS.items()) + "), u AS (SELECT host, signal, page_id, unnest(words) AS w, unnest(generate_series(1, len(words))) AS i FROM c) SELECT host, signal, string_agg(w, '|' ORDER BY first) AS words FROM (SELECT host, signal, w, min((page_id, i)) AS first FROM u WHERE w IS NOT NULL GROUP BY host, signal, w) GROUP BY host, signal"
