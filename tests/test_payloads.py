"""Provider payloads on literal cases."""

import json

import pytest
from pyspark.sql import functions as F

from leadmill.sources.payloads import contact_values, found_candidates, records

PLACE = {
    "cnpj": "37.335.118/0001-80", "nome_fantasia": "Oficina CNPJ", "situacao_cadastral": "Ativa", "cep": "13000-000", "logradouro": "Rua Alfa", "numero": "10", "bairro": "Centro", "email": "contato@oficina.com.br",
    "ddd1": "11", "telefone1": "33334444", "telefone2": " ", "telefone": "1133334444", "atividade_principal": {"descricao": "Oficina mecanica"}, "cidade": {"nome": "Campinas"}, "estado": {"sigla": "SP"},
}
OFFICE = {
    "taxId": "37335118000180", "alias": "Oficina CNPJ", "status": {"text": "Ativa"}, "address": {"street": "Rua Alfa", "number": "10", "city": "Campinas", "state": "SP", "zip": "13000-000", "municipality": 3509502},
    "phones": [{"full": "1133334444"}], "emails": ["contato@oficina.com.br", "Outro@OFICINA.com.br"], "website": "https://oficina-cnpj.com.br", "mainActivity": {"id": 4520001, "code": "45.20-0/01", "text": "Oficina mecanica"},
}
FLAT = {
    "cnpj": "17247065000139", "razao_social": "Casa Falci Ltda", "nome_fantasia": "Casa Falci", "situacao_cadastral": "Ativa", "cep": "13000-000", "logradouro": "Rua Beta", "numero": "45", "bairro": "Centro",
    "cidade": "Campinas", "uf": "SP", "telefone": "1133334444", "email": "contato@casafalci.com.br", "atividade_principal": {"descricao": "Comercio varejista"},
}
COMMON = {
    "company_id": "37335118000180", "legal_name": "Oficina CNPJ LTDA", "trade_name": "Oficina CNPJ", "registration_status": "Ativa", "address": "Rua Alfa, 10", "city": "Campinas", "state": "SP", "postal_code": "13000-000",
    "phones": ["1133334444"], "primary_activity": "Oficina mecanica", "full_id": True,
}


@pytest.fixture(scope="module")
def read(spark):
    def of(shape, *payloads, requested=None):
        rows = [(k, requested, p if p is None or isinstance(p, str) else json.dumps(p)) for k, p in enumerate(payloads)]
        df = records(spark.createDataFrame(rows, "k int, asked string, payload string"), shape, requested="asked")
        return [r["record"].asDict() for r in df.orderBy("k").collect()]

    return of


def has(record, **wanted):
    assert {k: record[k] for k in wanted} == wanted


def test_office_lookup(read):
    (r,) = read("office", {"office": OFFICE, "company": {"name": "Oficina CNPJ LTDA"}})
    has(r, **COMMON, emails=["contato@oficina.com.br", "Outro@OFICINA.com.br"], email_domains=["oficina.com.br"], domain="oficina-cnpj.com.br", activity_id="4520001", municipality=None, record_id="37335118000180", masked_id=None, lookup_id=None)


def test_place_lookup(read):
    (r,) = read("looked_up", {"razao_social": "Oficina CNPJ LTDA", "estabelecimento": PLACE, "cidade": "Outra", "telefone": "99"})
    has(r, **COMMON, emails=["contato@oficina.com.br"], neighborhood="Centro")


def test_requested_id_stands_in_for_a_missing_one_only(read):
    asked = read("office", {"office": {}}, {"taxId": "12"}, {"cnpj": " "}, requested="37.335.118/0001-80")
    assert [r["company_id"] for r in asked] == ["37335118000180", None, "37335118000180"]


def test_flat_candidate_and_masked_id(read):
    whole, masked, nothing = read("flat", FLAT, {**FLAT, "cnpj": None, "cnpj_mascarado": "**.247.065/****-39", "id": "f-1"}, {"razao_social": "Sem id"})
    has(whole, company_id="17247065000139", legal_name="Casa Falci Ltda", trade_name="Casa Falci", address="Rua Beta, 45", city="Campinas", state="SP", phones=["1133334444"], emails=["contato@casafalci.com.br"], full_id=True, record_id="17247065000139")
    has(masked, company_id=None, masked_id="**.247.065/****-39", full_id=False, record_id="f-1")
    has(nothing, company_id=None, masked_id=None, record_id=None, legal_name="Sem id")


def test_flat_status_and_contacts_of_several_keys(read):
    by_object, later, by_text = read(
        "flat",
        {"cnpj": "1", "situacao_cadastral": {"descricao": " ", "texto": "Suspensa"}, "telefone": "1", "celular": "2", "phones": ["1", {"value": "3"}, {"numero": "", "telefone": "4"}, 5], "endereco": {"whatsapp": "6", "telefone": "2", "emails": [{"value": "a@b.c"}, "a@b.c", " "]}},
        {"cnpj": "1", "situacao_cadastral": {}, "status": {"nome": "Ativa"}},
        {"cnpj": "1", "endereco": "Rua Solta", "address": {"cep": "1"}, "cep": "2"},
    )
    has(by_object, registration_status="Suspensa", phones=["1", "2", "3", "4", "6"], emails=["a@b.c"])
    has(later, registration_status="Ativa", phones=[], emails=[])
    has(by_text, postal_code="2")


def test_alternative_paths(read):
    (r,) = read("office", {"office": {"company": {}, "phones": [" "], "alias": 7}, "company": {"name": "Nome", "alias": "Apelido"}, "phones": "1133", "legalName": "Outro", "address": {"municipality": {"id": 3, "code": " 3509502 "}}, "mainActivity": "Oficina"})
    has(r, legal_name="Nome", trade_name="Apelido", phones=["1133"], municipality="3509502", primary_activity="Oficina", company_id=None, record_id=None)


def test_contact_values(spark):
    cases = [('" 1130 "', ["1130"]), ('""', []), ("null", []), ("7", []), ('[{"area":"19","number":"32348887"},{"number":"9"},{"area":"19","full":"8"},"a","a",[]," "]', ["1932348887", "9", "8", "a", "a"]), ('{"full":"1"}', [])]
    df = spark.createDataFrame([(k, p) for k, (p, _) in enumerate(cases)], "k int, p string")
    assert [r[0] for r in df.orderBy("k").select(contact_values(F.parse_json("p"))).collect()] == [v for _, v in cases]


@pytest.mark.parametrize(
    ("shape", "payload", "wanted"),
    [
        ("office", [{"taxId": "1"}, 2, None, "3"], ['{"taxId":"1"}']),
        ("office", {"records": {}, "items": [], "data": [{"a": 1}]}, []),
        ("office", {"records": None, "data": [{"a": 1}, {"a": 1}]}, ['{"a":1}', '{"a":1}']),
        ("office", {"companyName": None}, ['{"companyName":null}']),
        ("office", {"name": "x"}, []),
        ("establishment", {"resultados": ["17247065000139", {"cnpj": "1"}, 3]}, ['"17247065000139"', '{"cnpj":"1"}']),
        ("establishment", [{"cnpj": "1"}], []),
        ("flat", {"empresas": [{"cnpj": "1"}, "2"]}, ['{"cnpj":"1"}']),
        ("flat", "no json", []),
        ("flat", None, []),
    ],
)
def test_found_candidates(spark, shape, payload, wanted):
    text = payload if payload is None or payload == "no json" else json.dumps(payload)
    found = found_candidates(spark.createDataFrame([(text, "x", 9)], "payload string, record string, candidate_pos int"), shape)
    assert [r[0] for r in found.orderBy("candidate_pos").select(F.to_json("payload")).collect()] == wanted
    assert records(found, shape).columns == ["candidate_pos", "record"]


def test_bare_ids_are_to_be_looked_up(spark):
    found = found_candidates(spark.createDataFrame([(json.dumps({"results": ["17.247.065/0001-39", {"taxId": "17247065000139"}, {"cnpj": "17247065000139", "cep": "1"}, {"id": "9"}]}),)], "payload string"), "establishment")
    rows = records(found, "establishment").orderBy("candidate_pos").select("record.lookup_id", "record.company_id").collect()
    assert [tuple(r) for r in rows] == [("17247065000139", None), ("17247065000139", None), (None, "17247065000139"), (None, None)]


def test_rows_without_payload_and_odd_columns_pass(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "[1]", "b"), (2, "[1]", "b")], "root int, payload string, `part_office.x` string")
    rows = records(df, "office").orderBy("root").collect()
    assert [(r["root"], r["part_office.x"], r["record"]["company_id"], r["record"]["phones"]) for r in rows] == [(1, "a", None, []), (2, "b", None, []), (2, "b", None, [])]
    assert records(df.limit(0), "flat").count() == 0
