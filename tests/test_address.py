import pytest
from pyspark.sql import functions as F

from leadmill.functions.address import joined, split_address

CASES = [
    ("8665R. Bento Goncalves, 112 - Centro, Porto Alegre - RS, 90650-001, Brasil", ("R. Bento Goncalves", "112")),
    ("Endereço: Rua A, 10, Centro", ("Rua A", "10")),
    ("Rua A, s/n - Porto Alegre - RS", ("Rua A", None)),
    ("Rua A", ("Rua A", None)),
    ("Av. B, 12-A, Bloco 3", ("Av. B, 12-A", None)),
    ("Quadra 5, 7", ("Quadra 5, 7", None)),
    ("Logradouro - Rua A, 10/B", ("Rua A", "10/B")),
    ("12 34 Avenida Brasil Sul, 1500, +55 (51) 98765-4321", ("Avenida Brasil Sul", "1500")),
    ("Rua das Flores apto 12, Centro", ("Rua das Flores", None)),
    ("Praça XV, 1234567", ("Praça XV, 1234567", None)),
    ("Rua 7, 90650001, 22", ("Rua 7", "22")),
    (" , - ", None),
    (None, None),
]


@pytest.mark.parametrize(("address", "wanted"), CASES)
def test_split(spark, address, wanted):
    df = spark.createDataFrame([(address, "Centro", "Porto Alegre", "Rio Grande do Sul", "90650-001")], "a string, n string, c string, s string, p string")
    found = df.select(split_address(F.col("a"), F.col("n"), F.col("c"), F.col("s"), F.col("p")).alias("x")).first()["x"]
    assert (None if found is None else tuple(found)) == wanted


def test_joined(spark):
    df = spark.createDataFrame([("Rua A", "10"), ("Rua A", None), (" ", "10"), (None, "")], "s string, n string")
    assert [r[0] for r in df.select(joined(F.col("s"), F.col("n"))).collect()] == ["Rua A, 10", "Rua A", None, None]
