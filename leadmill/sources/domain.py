"""The lead domain, derived from the star-schema tables.

Each table is one SQL text that Spark and the oracle engine both accept, with the
base tables in braces: Spark binds DataFrames to them, the oracle plain names.
Keys are rounded down (k - k % m), which gives small clusters of duplicates at
every scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")

#: Base tables whose rows each give a row of text work.
DEALT = ("customer", "supplier", "orders")
#: Rows that are dealt by a key at once: a window by order and line and a join by order then move them no more.
DEALT_BY = {"lineitem": "l_orderkey"}

TABLES: dict[str, str] = {}

TABLES["leads"] = """
SELECT c_custkey AS lead_id,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey % 3 + 1 END AS organization_id,
  concat('Oficina Mecânica São José ', CAST(c_custkey - c_custkey % 4 AS VARCHAR(20)), CASE WHEN c_custkey % 2 = 0 THEN '!' ELSE '' END) AS business_name,
  concat('oficina mecanica sao jose ', CAST(c_custkey - c_custkey % 4 AS VARCHAR(20))) AS normalized_business_name,
  CASE WHEN c_custkey % 6 = 1 THEN 'Oficina mecânica' ELSE lower(c_mktsegment) END AS category,
  CASE c_custkey % 5 WHEN 0 THEN 'google_places' WHEN 1 THEN 'website' WHEN 2 THEN 'manual_import' WHEN 3 THEN 'demo_seed' ELSE 'merged' END AS lead_source_type,
  CASE WHEN c_custkey % 10 = 9 THEN NULL ELSE concat('Rua ', n_name, ', ', CAST(c_custkey % 50 AS VARCHAR(20))) END AS address,
  CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE concat('Bairro ', CAST(c_custkey % 5 AS VARCHAR(20))) END AS neighborhood,
  n_name AS city, r_name AS state,
  CASE WHEN c_custkey % 8 = 3 THEN '' ELSE concat(lpad(CAST(c_custkey % 97 AS VARCHAR(20)), 5, '0'), '-', lpad(CAST(c_custkey % 13 AS VARCHAR(20)), 3, '0')) END AS postal_code,
  CASE WHEN c_custkey % 5 = 2 THEN NULL ELSE concat('https://www.loja', CAST(c_custkey - c_custkey % 3 AS VARCHAR(20)), '.com.br/contato') END AS website,
  CASE WHEN c_custkey % 5 = 2 THEN NULL ELSE concat('loja', CAST(c_custkey - c_custkey % 3 AS VARCHAR(20)), '.com.br') END AS domain,
  CASE WHEN c_custkey % 3 = 0 THEN concat('contato@loja', CAST(c_custkey AS VARCHAR(20)), '.com.br') WHEN c_custkey % 11 = 1 THEN '' ELSE NULL END AS email,
  CASE WHEN c_custkey % 4 = 1 THEN NULL ELSE concat('+55119', lpad(CAST(c_custkey - c_custkey % 2 AS VARCHAR(20)), 8, '0')) END AS phone,
  CASE WHEN c_custkey % 6 < 2 THEN concat('+55119', lpad(CAST(c_custkey - c_custkey % 6 AS VARCHAR(20)), 8, '0')) ELSE NULL END AS whatsapp,
  CASE WHEN c_custkey % 9 = 0 THEN concat('https://instagram.com/loja', CAST(c_custkey AS VARCHAR(20))) ELSE NULL END AS instagram,
  CASE WHEN c_custkey % 4 < 2 THEN concat('https://maps.google.com/?cid=', CAST(c_custkey AS VARCHAR(20))) ELSE NULL END AS google_maps_url,
  CASE WHEN c_custkey % 20 < 3 THEN concat('place-', CAST(c_custkey - c_custkey % 20 AS VARCHAR(20))) ELSE NULL END AS google_place_id,
  CASE WHEN c_custkey % 13 = 0 THEN concat('Razao Social ', CAST(c_custkey AS VARCHAR(20))) ELSE NULL END AS legal_name,
  CASE WHEN c_custkey % 13 = 0 THEN lpad(CAST(c_custkey AS VARCHAR(20)), 14, '0') ELSE NULL END AS cnpj,
  CASE c_custkey % 13 WHEN 0 THEN 'matched' WHEN 1 THEN 'needs_review' WHEN 2 THEN 'not_found' WHEN 3 THEN 'error' ELSE 'unknown' END AS cnpj_match_status,
  CAST((c_custkey * 37) % 101 AS INT) AS lead_score,
  CASE c_custkey % 9 WHEN 0 THEN 'new' WHEN 1 THEN 'reviewed' WHEN 2 THEN 'approved' WHEN 3 THEN 'contacted' WHEN 4 THEN 'replied' WHEN 5 THEN 'interested' WHEN 6 THEN 'closed' WHEN 7 THEN 'not_interested' ELSE 'do_not_contact' END AS status,
  CASE WHEN c_custkey % 8 = 5 THEN concat('Owner ', CAST(c_custkey % 3 AS VARCHAR(20))) ELSE NULL END AS owner,
  CASE WHEN c_custkey % 4 = 2 THEN DATE '2024-01-01' + CAST(c_custkey % 60 AS INT) ELSE NULL END AS follow_up_date,
  CASE WHEN c_custkey % 9 IN (3, 4, 5) THEN CAST(DATE '2024-01-01' + CAST(c_custkey % 31 AS INT) AS TIMESTAMP) ELSE NULL END AS last_contacted_at,
  CASE WHEN c_custkey % 3 = 1 THEN NULL ELSE CAST(DATE '2023-06-01' + CAST(c_custkey % 270 AS INT) AS TIMESTAMP) END AS last_enriched_at,
  CAST(DATE '2024-02-01' + CAST(c_custkey % 29 AS INT) AS TIMESTAMP) AS updated_at,
  c_custkey % 17 = 0 AS do_not_contact, c_custkey % 19 = 0 AS is_duplicate, c_custkey % 11 = 0 AS is_blocked,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 5 END AS sales_region_id,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey % 4 END AS market_segment_id,
  CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_custkey % 6 END AS market_subsegment_id,
  CASE WHEN c_custkey % 7 IN (0, 5) THEN NULL ELSE c_custkey % 7 END AS assigned_sales_rep_id,
  CASE c_custkey % 4 WHEN 0 THEN 'ideal_sme' WHEN 1 THEN 'possible_sme' WHEN 2 THEN 'large_enterprise' ELSE 'unknown' END AS company_size_fit,
  CASE c_custkey % 3 WHEN 0 THEN 'varejo' WHEN 1 THEN 'atacado' ELSE 'unknown' END AS trade_type,
  CASE WHEN c_custkey % 11 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'Cliente atual' ELSE 'Pedido de saída' END END AS blocked_reason,
  CAST(DATE '2023-01-01' + CAST(c_custkey % 300 AS INT) AS TIMESTAMP) AS created_at,
  CASE WHEN c_custkey % 7 IN (0, 5) THEN NULL ELSE CAST(DATE '2023-11-01' + CAST(c_custkey % 90 AS INT) AS TIMESTAMP) END AS assigned_at
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""

TABLES["contacts"] = """
SELECT o_orderkey AS contact_id, o_custkey AS lead_id,
  CASE o_orderkey % 4 WHEN 0 THEN 'email' WHEN 1 THEN 'phone' WHEN 2 THEN 'whatsapp' ELSE 'instagram' END AS contact_type,
  concat('v', CAST(o_orderkey % 3 AS VARCHAR(20)), '@loja', CAST(o_custkey AS VARCHAR(20)), CASE WHEN o_orderkey % 7 = 0 THEN '.example.com' ELSE '.com.br' END) AS raw_value,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE concat('v', CAST(o_orderkey % 3 AS VARCHAR(20)), '@loja', CAST(o_custkey AS VARCHAR(20)), CASE WHEN o_orderkey % 7 = 0 THEN '.example.com' ELSE '.com.br' END) END AS normalized_value,
  CAST(o_orderkey % 5 AS DOUBLE) / 4 AS confidence, o_orderkey % 6 = 0 AS is_primary, o_orderdate AS updated_at,
  'lead_enrichment_record' AS source_record_type, o_orderkey % 2 AS source_record_id
FROM {orders}
"""

TABLES["candidates"] = """
SELECT s_suppkey AS item_pos,
  concat('OFICINA MECANICA SAO JOSE ', CAST(s_suppkey - s_suppkey % 4 AS VARCHAR(20))) AS business_name,
  concat('oficina mecanica sao jose ', CAST(s_suppkey - s_suppkey % 4 AS VARCHAR(20))) AS name_key,
  n_name AS city, lower(n_name) AS city_key,
  CASE WHEN s_suppkey % 3 = 0 THEN lower(concat('rua ', n_name, ' ', CAST(s_suppkey % 50 AS VARCHAR(20)))) ELSE NULL END AS address_key,
  CASE WHEN s_suppkey % 2 = 0 THEN concat('bairro ', CAST(s_suppkey % 5 AS VARCHAR(20))) ELSE NULL END AS neighborhood_key,
  CASE WHEN s_suppkey % 20 = 0 THEN concat('place-', CAST(s_suppkey AS VARCHAR(20))) ELSE NULL END AS google_place_id,
  CASE WHEN s_suppkey % 7 = 0 THEN concat('https://maps.google.com/?cid=', CAST(s_suppkey AS VARCHAR(20))) ELSE NULL END AS google_maps_url,
  CASE WHEN s_suppkey % 5 = 1 THEN concat('loja', CAST(s_suppkey - s_suppkey % 3 AS VARCHAR(20)), '.com.br') ELSE NULL END AS domain,
  CASE WHEN s_suppkey % 6 = 2 THEN concat('+55119', lpad(CAST(s_suppkey - s_suppkey % 2 AS VARCHAR(20)), 8, '0')) ELSE NULL END AS phone
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
"""

TABLES["batches"] = """
SELECT CAST(year(o_orderdate) * 100 + month(o_orderdate) AS BIGINT) AS batch_id,
  CASE min(o_orderstatus) WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'pending' END AS status,
  CAST(count(*) AS BIGINT) AS record_count, max(o_orderdate) AS completed_at
FROM {orders} GROUP BY CAST(year(o_orderdate) * 100 + month(o_orderdate) AS BIGINT)
"""

TABLES["raw_records"] = """
SELECT o_orderkey AS raw_id, CAST(year(o_orderdate) * 100 + month(o_orderdate) AS BIGINT) AS batch_id,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_custkey END AS lead_id, o_orderdate AS created_at,
  lower(o_orderpriority) AS search_term
FROM {orders}
"""

TABLES["registry"] = """
SELECT (l_orderkey * 8 + l_linenumber) * 100 + nth AS record_id, o_custkey AS lead_id, l_linenumber AS candidate_pos,
  lpad(CAST(l_partkey AS VARCHAR(20)), 14, '0') AS cnpj, l_linestatus = 'F' AS full_cnpj,
  CASE l_partkey % 5 WHEN 0 THEN concat('Oficina Mecânica São José ', CAST(o_custkey - o_custkey % 4 AS VARCHAR(20))) WHEN 1 THEN concat('OFICINA MECANICA SAO JOSE ', CAST(o_custkey - o_custkey % 4 AS VARCHAR(20)), ' - Centro')
    WHEN 2 THEN concat('Mecânica José ', CAST(o_custkey % 4 AS VARCHAR(20))) WHEN 3 THEN NULL ELSE 'Padaria Bela Vista' END AS trade_name,
  CASE l_partkey % 6 WHEN 0 THEN concat('Oficina Mecanica Sao Jose ', CAST(o_custkey - o_custkey % 4 AS VARCHAR(20))) WHEN 1 THEN concat('Oficina Mecânica São José ', CAST(o_custkey - o_custkey % 4 AS VARCHAR(20)), ' Ltda')
    WHEN 2 THEN 'Jose Oficina Mecanica ME' WHEN 3 THEN 'Maria da Silva' WHEN 4 THEN 'Comercio de Pecas Jose Ltda' ELSE NULL END AS legal_name,
  CASE WHEN l_quantity > 25 THEN concat('http://WWW.loja', CAST(o_custkey - o_custkey % 3 AS VARCHAR(20)), '.com.br/') WHEN l_quantity > 15 THEN 'contabil.com.br' ELSE NULL END AS website,
  CASE WHEN l_quantity < 10 THEN concat('Fiscal@Loja', CAST(o_custkey AS VARCHAR(20)), '.com.br') ELSE NULL END AS email,
  CASE l_suppkey % 4 WHEN 0 THEN concat('(11) 9', lpad(CAST(o_custkey - o_custkey % 2 AS VARCHAR(20)), 8, '0')) WHEN 1 THEN '(11) 98888-0000' WHEN 2 THEN '(21) 3333-0000' ELSE NULL END AS phone,
  CASE l_suppkey % 5 WHEN 0 THEN concat('RUA ', n_name, ', ', CAST(o_custkey % 50 AS VARCHAR(20))) WHEN 1 THEN concat('Rua ', n_name, ', ', CAST(o_custkey % 50 + 1 AS VARCHAR(20))) WHEN 2 THEN 'Av. Central, 10' WHEN 3 THEN concat('Rua ', n_name) ELSE NULL END AS address,
  CASE WHEN l_partkey % 3 = 0 THEN concat('BAIRRO ', CAST(o_custkey % 5 AS VARCHAR(20))) ELSE NULL END AS neighborhood,
  CASE l_suppkey % 9 WHEN 0 THEN 'Outra Cidade' WHEN 1 THEN NULL ELSE lower(n_name) END AS city, CASE l_suppkey % 11 WHEN 0 THEN 'São Paulo' WHEN 1 THEN NULL ELSE r_name END AS state,
  CASE WHEN l_tax > 0.03 THEN concat(lpad(CAST(o_custkey % 97 AS VARCHAR(20)), 5, '0'), lpad(CAST(o_custkey % 13 AS VARCHAR(20)), 3, '0')) ELSE '01310-100' END AS postal_code,
  CASE l_orderkey % 4 WHEN 0 THEN 'Comércio de AUTOMOBILE e peças' WHEN 1 THEN 'Machinery' WHEN 2 THEN 'Serviços de MANUTENÇÃO automotiva' ELSE NULL END AS activity
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus, l_shipdate) AS nth FROM {lineitem}) lines
  JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""

TABLES["taxonomy"] = """
SELECT DISTINCT dense_rank() OVER (ORDER BY p_type) AS subsegment_id, dense_rank() OVER (ORDER BY p_type) % 7 AS segment_id, lower(p_type) AS name, CAST(dense_rank() OVER (ORDER BY p_type) % 10 AS INT) AS sort_order,
  CASE dense_rank() OVER (ORDER BY p_type) % 6 WHEN 0 THEN 'Building|loja' WHEN 1 THEN 'MACHINERY' WHEN 2 THEN concat('José ', CAST(dense_rank() OVER (ORDER BY p_type) AS VARCHAR(20))) WHEN 3 THEN 'loja9|hold' WHEN 4 THEN 'automobile|mecânica' ELSE '' END AS keywords
FROM {part}
"""

TABLES["exclusion_rules"] = """
SELECT CAST(n_nationkey + 1 AS BIGINT) AS rule_id,
  CASE n_nationkey % 4 WHEN 0 THEN 'exact_name' WHEN 1 THEN 'business_name_contains' WHEN 2 THEN 'domain' ELSE 'provider_category' END AS rule_type,
  CASE n_nationkey % 4 WHEN 0 THEN concat('oficina mecanica sao jose ', CAST(n_nationkey * 4 AS VARCHAR(20))) WHEN 1 THEN concat('jose ', CAST(n_nationkey * 3 AS VARCHAR(20)))
    WHEN 2 THEN concat('loja', CAST(n_nationkey * 6 AS VARCHAR(20)), '.com.br') ELSE CASE WHEN n_nationkey = 23 THEN 'machinery' ELSE concat('category ', CAST(n_nationkey AS VARCHAR(20))) END END AS normalized_pattern,
  CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE concat('reason ', CAST(n_nationkey AS VARCHAR(20))) END AS reason
FROM {nation}
"""

TABLES["sales_regions"] = """
SELECT CAST(n_nationkey AS BIGINT) AS region_id, r_name AS state, n_name AS city,
  CASE n_nationkey % 3 WHEN 0 THEN 'city' WHEN 1 THEN 'neighborhood' ELSE 'postal' END AS region_type, concat('Region ', n_name) AS name,
  CASE WHEN n_nationkey % 3 = 2 THEN lpad(CAST(n_nationkey AS VARCHAR(20)), 5, '0') ELSE NULL END AS postal_prefix,
  CASE WHEN n_nationkey % 3 = 1 THEN concat('bairro ', CAST(n_nationkey % 5 AS VARCHAR(20))) ELSE NULL END AS neighborhood_keyword,
  n_nationkey % 3 = 1 AS requires_neighborhood
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
"""

TABLES["market_segments"] = """
SELECT CAST(r_regionkey AS BIGINT) AS segment_id, concat('Segmento ', r_name) AS name FROM {region}
"""

TABLES["market_subsegments"] = """
SELECT CAST(n_nationkey AS BIGINT) AS subsegment_id, concat('Ramo ', n_name, ' e ', r_name) AS name FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
"""

TABLES["sales_reps"] = """
SELECT CAST(n_nationkey AS BIGINT) AS sales_rep_id, CASE WHEN n_nationkey % 6 = 4 THEN NULL ELSE concat('Equipe ', n_name) END AS name FROM {nation}
"""

TABLES["municipalities"] = """
SELECT n_name AS city, r_name AS state, lpad(CAST(3500000 + n_nationkey * 13 AS VARCHAR(20)), 7, '0') AS municipality,
  CASE n_nationkey % 3 WHEN 0 THEN '11' WHEN 1 THEN '19' ELSE NULL END AS area
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey WHERE n_nationkey % 4 <> 3
"""

TABLES["assignment_rules"] = """
SELECT CAST(n_nationkey + 1 AS BIGINT) AS rule_id, CAST(n_nationkey % 10 AS INT) AS priority,
  CASE WHEN n_nationkey % 2 = 0 THEN NULL ELSE CAST(n_nationkey % 5 AS BIGINT) END AS region_id,
  CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE CAST(n_nationkey % 4 AS BIGINT) END AS segment_id,
  CASE WHEN n_nationkey % 5 = 0 THEN CAST(n_nationkey % 6 AS BIGINT) ELSE NULL END AS subsegment_id, CAST(n_nationkey % 8 AS BIGINT) AS sales_rep_id
FROM {nation}
"""


_ID = "lpad(CAST(o_orderkey * 37 AS VARCHAR(20)), 14, '0')"
_PLACE = "concat('\"nome_fantasia\":\"Mecânica ', n_name, '\",\"situacao_cadastral\":', CASE WHEN o_orderkey % 7 = 0 THEN '{{\"descricao\":\"Baixada\"}}' ELSE '\"Ativa\"' END, ',\"cep\":\"13000-', lpad(CAST(o_custkey % 1000 AS VARCHAR(20)), 3, '0'), '\",\"logradouro\":\" Rua ', n_name, ' \",\"numero\":\"', CAST(o_custkey % 50 AS VARCHAR(20)), '\",\"bairro\":\"\",\"email\":\"Fiscal@Loja', CAST(o_custkey AS VARCHAR(20)), '.com.br\",\"ddd1\":\"11\",\"telefone1\":\"3', lpad(CAST(o_custkey AS VARCHAR(20)), 7, '0'), '\",\"telefone2\":\"3', lpad(CAST(o_custkey AS VARCHAR(20)), 7, '0'), '\",\"telefone\":\"3', lpad(CAST(o_custkey AS VARCHAR(20)), 7, '0'), '\"')"
_CITY = "concat('\"cidade\":', CASE WHEN o_custkey % 3 = 0 THEN concat('{{\"nome\":\"', n_name, '\"}}') ELSE concat('\"', n_name, '\"') END, ',\"estado\":', CASE o_custkey % 4 WHEN 0 THEN '{{\"sigla\":\"sp\"}}' WHEN 1 THEN '\"São Paulo\"' WHEN 2 THEN '35' ELSE concat('\"', r_name, '\"') END)"

TABLES["registry_payloads"] = f"""
SELECT payload_id, shape, requested_id, CASE WHEN payload_id % 29 = 0 THEN NULL WHEN payload_id % 31 = 0 THEN '{{{{broken' ELSE payload END AS payload FROM (
SELECT o_orderkey AS payload_id, {_ID} AS requested_id, CASE o_custkey % 4 WHEN 0 THEN 'office' WHEN 1 THEN 'looked_up' WHEN 2 THEN 'establishment' ELSE 'flat' END AS shape,
  CASE o_custkey % 4 WHEN 0 THEN
    CASE o_orderkey % 4 WHEN 0 THEN concat('{{{{"office":{{{{"id":"o', CAST(o_orderkey AS VARCHAR(20)), '","taxId":"', {_ID}, '","alias":"Mecânica ', n_name, '","status":{{{{"id":2,"text":"Ativa"}}}},"address":{{{{"street":"Rua ', n_name, '","number":"', CAST(o_custkey % 50 AS VARCHAR(20)), '","district":"Centro","city":"', n_name, '","state":"', r_name, '","zip":"13000000","municipality":{{{{"id":3509502,"code":"3509502"}}}}}}}},"phones":[{{{{"area":"19","number":"3234', CAST(o_custkey AS VARCHAR(20)), '"}}}}," 1130 ",7,{{{{"number":"99"}}}}],"emails":[{{{{"address":"Contato@Loja', CAST(o_custkey AS VARCHAR(20)), '.com.br"}}}},"a@loja.com.br"],"website":"https://www.Loja', CAST(o_custkey AS VARCHAR(20)), '.com.br/contato","mainActivity":{{{{"code":"47.59-8/99","text":"Comércio"}}}}}}}},"company":{{{{"name":"', n_name, ' Ltda"}}}}}}}}')
      WHEN 1 THEN concat('{{{{"cnpj":"', substring({_ID}, 1, 2), '.', substring({_ID}, 3, 3), '.', substring({_ID}, 6, 3), '/', substring({_ID}, 9, 4), '-', substring({_ID}, 13, 2), '","legalName":"  ","companyName":"', n_name, ' SA","tradeName":"Mecânica","registrationStatus":"Inapta","city":"', n_name, '","state":"sp","postalCode":"13000-000","phones":" 1933 ","emails":[{{{{"value":"sem arroba"}}}}],"url":"loja.com.br","mainActivity":"Oficina","address":{{{{}}}}}}}}')
      WHEN 2 THEN concat('{{{{"office":{{{{}}}},"company":{{{{"name":"', n_name, '","alias":"Apelido"}}}},"address":{{{{"details":"Av. Central","municipality":"3509502","postalCode":"13000"}}}},"phones":[],"number":12,"number2":"x"}}}}')
      ELSE concat('{{{{"office":{{{{"taxId":"123","company":{{{{"name":"', n_name, '"}}}},"phones":[]}}}},"phones":["11', CAST(o_custkey AS VARCHAR(20)), '"],"emails":"x@loja.com.br"}}}}') END
    WHEN 3 THEN
      concat('{{{{"id":"f', CAST(o_orderkey AS VARCHAR(20)), '","cnpj', CASE WHEN o_orderkey % 3 = 0 THEN concat('_mascarado":"**.', substring({_ID}, 3, 3), '.***/****-', substring({_ID}, 13, 2)) ELSE concat('":"', {_ID}) END, '","razao_social":"', n_name, ' Ltda",', {_PLACE}, ',', {_CITY}, ',"telefones":["1133",{{{{"telefone":"1144"}}}},{{{{"numero":" "}}}}],"emails":[{{{{"email":"b@loja.com.br"}}}}],"cnae_principal_descricao":"Oficina"', CASE WHEN o_orderkey % 5 = 0 THEN ',"endereco":"Rua Solta","address":{{{{"cep":"99999"}}}}' WHEN o_orderkey % 5 = 1 THEN concat(',"endereco":{{{{"street":"Rua Outra","uf":"RJ",', {_CITY}, ',"phones":["1155","1133"]}}}}') ELSE '' END, '}}}}')
    ELSE CASE WHEN o_orderkey % 6 = 0 THEN concat('{{{{"cnpj_completo":"', {_ID}, '","razao_social":"', n_name, '",', {_PLACE}, ',', {_CITY}, ',"site":"http://loja.com.br"}}}}') WHEN o_orderkey % 6 = 1 THEN concat('{{{{"cnpj":"', {_ID}, '"}}}}')
      ELSE concat('{{{{"razao_social":"', n_name, ' Ltda","estabelecimento":{{{{"cnpj":"', {_ID}, '",', {_PLACE}, ',', {_CITY}, ',"atividade_principal":{{{{"descricao":"Oficina"}}}}}}}}}}}}') END
  END AS payload
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey) shaped
"""

TABLES["registry_responses"] = """
SELECT payload_id, shape, CASE WHEN payload IS NULL OR payload_id % 31 = 0 OR payload_id % 8 = 0 THEN payload WHEN payload_id % 8 = 1 AND shape = 'office' THEN concat('[', payload, ',4,', payload, ']')
  ELSE concat('{{', CASE WHEN payload_id % 3 = 0 THEN '"items":{{}},' ELSE '' END, '"', CASE shape WHEN 'office' THEN 'records' WHEN 'flat' THEN 'data' ELSE 'resultados' END, '":[', payload, ',"', requested_id, '",null,{{}}],"', CASE shape WHEN 'flat' THEN 'empresas' ELSE 'data' END, '":[{{}}]}}') END AS payload
FROM (""" + TABLES["registry_payloads"] + """) payloads
"""


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """rows over as many tasks as shuffles have: a million rows of a narrow file are one row group and so one task,
    which would work out all that is derived from them. Only the columns that are used move."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table, or a base table by its own name."""
    if name in BASE:
        return base(spark, sf_dir, name)
    text = TABLES[name]
    bound = lambda b, rows: dealt(rows) if b in DEALT else rows.repartition(DEALT_BY[b]) if b in DEALT_BY else rows
    return spark.sql(text, **{b: bound(b, base(spark, sf_dir, b)) for b in BASE if "{" + b + "}" in text})


def oracle(query: str, *names: str) -> str:
    """SQL for the oracle engine: the derived tables as common table expressions before the query."""
    plain = {b: b for b in BASE}
    return "WITH " + ",\n".join(f"{n} AS ({TABLES[n].format(**plain)})" for n in names) + "\n" + query
