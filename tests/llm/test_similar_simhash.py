"""SimHash in the pipeline's near-dup stage: its links alone join close copies, each checked exactly."""

import random

from pyspark.sql import functions as F

from leadmill.llm import similar


def test_simhash_links_without_shared_cells(spark, monkeypatch):
    r = random.Random(5)
    words = [f"w{r.randrange(9000)}" for _ in range(3000)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), "  ".join(words).upper(), " ".join(words[:1500]), "a b c", "a b c d", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    mark = similar.mark
    monkeypatch.setattr(similar, "mark", lambda *a: mark(*a).withColumn("cells", F.array().cast("array<long>")))
    found = {x["doc_id"]: x["component_id"] for x in similar.near_duplicates(docs).collect()}
    assert found == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6}


def test_simhash_pairs_by_brute_force(spark):
    """Every set is paired with the least of its value, and values up to two bits apart are connected by pairs."""
    r = random.Random(7)
    base = [r.getrandbits(63) for _ in range(6)]
    values = [*base, base[0] ^ 3, base[0] ^ 1, base[1] ^ (1 << 40), base[1] ^ (7 << 40), base[2], base[2]]
    rows = [(100 + k, 10, v) for k, v in enumerate(values)]
    pairs = {(x["a"], x["b"]) for x in similar.fitting(similar.simhash_pairs(spark.createDataFrame(rows, "fp long, n long, bits long")), 0.8).collect()}

    def groups(edges):
        label = {fp: fp for fp, _, _ in rows}
        for _ in rows:
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
        return label

    near = {(a, b) for a, _, x in rows for b, _, y in rows if a < b and (x ^ y).bit_count() <= 2}
    assert groups(pairs) == groups(near) and len(set(groups(pairs).values())) == 6
    assert all((values[a - 100] ^ values[b - 100]).bit_count() <= 2 for a, b in pairs)
