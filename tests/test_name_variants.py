"""Variants of business names on literal cases."""

import pytest

from leadmill.operators import name_variants

NAMES = {
    ("Pet Shop Bela Vista | Banho Carinhoso", 4): ["Pet Shop Bela Vista Banho Carinhoso", "Pet Shop Bela Vista", "Bela Vista", "Banho Carinhoso"],
    ("Cobasi Londrina Centro", 4): ["Cobasi Londrina Centro", "Cobasi Londrina", "Cobasi", "Cobasi Centro"],
    ("Petz Catuaí Londrina", 4): ["Petz Catuai Londrina", "Petz Catuai", "Petz"],
    ("", 4): [], (None, 4): [], ("Av. Higienópolis", 4): [], ("Pet Shop", 4): [], ("Padaria", 0): [],
}


@pytest.fixture(scope="module")
def of(spark):
    def found(name, most, category=None):
        df = spark.createDataFrame([(name, category)], "business_name string, category string")
        return name_variants.of_names(df, most).first()

    return found


@pytest.mark.parametrize("case", NAMES, ids=str)
def test_names(of, case):
    assert of(*case)["names"] == NAMES[case]


def test_names_hold_and_lack(of):
    found = of("Baby's Pet Shop e Banho e Tosa", 5)["names"]
    assert found[0] == "Babys Pet Shop e Banho e Tosa" and {"Babys Pet Shop", "Babys"} <= set(found) and "Pet Shop" not in found
    found = of("Pet Space do Bixiga", 4)["names"]
    assert found[:3] == ["Pet Space do Bixiga", "Pet Space", "Bixiga"] and len(found) <= 4
    found = of("Empório dos Animais Pet Shop - Av. Higienópolis", 5)["names"]
    assert {"Emporio dos Animais Pet Shop", "Emporio dos Animais", "Emporio Animais"} <= set(found) and "AV Higienopolis" not in found
    found = of("AGRO BAGGIO PETSHOP", 5)["names"]
    assert {"Agro Baggio Petshop", "Baggio Petshop", "Baggio"} <= set(found) and "Petshop" not in found


def test_alias_and_legal(of):
    found = of("Cobasi Londrina Centro", 4)
    assert found["alias"][:2] == ["Cobasi", "Cobasi Londrina"] and found["legal"] == []
    assert of("Petz Catuaí Londrina", 4)["alias"][:2] == ["Petz", "Petz Catuai"]
    found = of("Tecnocell Comercio e Servicos LTDA", 4)
    assert found["alias"] and "Tecnocell Comercio e Servicos Ltda" in found["legal"]
    for name, held in {
        "Sofal Sociedade Comercial de Materiais para Construções": ["Sofal"], "ABC da Construção Cambuí Campinas": ["Abc da Construcao", "Abc"],
        "M2 MATERIAIS PARA CONSTRUÇÃO": ["M2"], "Sodimac Homecenter Campinas": ["Sodimac", "Sodimac Homecenter"],
    }.items():
        assert set(held) <= set(of(name, 6)["alias"])


def test_rules():
    v = name_variants
    assert [v.address_cut(x) for x in ("casa rua nova", "rua nova", "a b av c rua d")] == ["casa", "rua nova", "a b"]
    assert [v.city_cut(x) for x in ("x sao paulo centro", "x campinas", "campinas", "campinas londrina", "londrina campinas")] == ["x sao", "x", "campinas", "campinas", "londrina"]
    assert [v.place_cut(x) for x in ("pet space do bixiga", "casa do boi", "do bixiga", "a de b do lago")] == ["pet space", "casa do boi", "do bixiga", "a de b"]
    assert [v.prefix_cut(x) for x in ("agro baggio", "casa de ferro", "casa de ferro e aco", "loja", "nova casa", None)] == ["baggio", None, "de ferro e aco", None, None, None]
    assert [v.noise_cut(x, "padaria", v._HEAVY) for x in ("auto auto center", "padaria do ze", "sem nada de", "comercio varejista de po", "oficina")] == ["center", "ze", "sem nada de", "po", None]
    assert [v.last_brand(x) for x in ("casa do ze", "agro rua", "nova casa", "loja")] == ["ze", None, None, None]


def test_repeated_and_null_rows(spark):
    rows = [(1, "Cobasi Centro", None), (2, "Cobasi Centro", None), (3, None, "x"), (4, "Cobasi Centro", "Cobasi")]
    found = name_variants.with_variants(spark.createDataFrame(rows, "lead_id int, business_name string, category string"))
    assert sorted(r["lead_id"] for r in found.collect()) == [1, 2, 3, 4]
    assert found.where("lead_id < 3").select("names").distinct().count() == 1
