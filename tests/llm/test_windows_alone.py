"""op7: a window that met doesn't carry its document on, items of equal texts are matched once, and hashes beyond a broadcast go by a bitmap."""

from leadmill.llm import decontaminate
from pyspark.sql import functions as F

ITEM = "A train leaves with 120 passengers at 45 km per hour and stops after 3 hours, how many passengers remain if 12 left?"


def table(spark, rows, key):
    return spark.createDataFrame(list(enumerate(rows)), f"{key} long, text string")


def test_a_long_document_that_is_met_everywhere(spark):
    """69,000 words, as many windows that meet: with the words of the document in each row they would be 100 GB."""
    text = " ".join([ITEM.replace("120", str(k)) for k in range(3_000)])
    for most in (1 << 26, 1):
        found = decontaminate.leaks(table(spark, [text, "nothing of it"], "doc_id"), table(spark, [ITEM], "item_id"), most_bytes=most).collect()
        assert [(r["doc_id"], r["item_id"], r["first_word"], r["last_word"]) for r in found] == [(0, 0, 1, 69_000)]


def test_items_of_equal_texts(spark, monkeypatch):
    written = {}
    materialise = decontaminate.materialise

    def kept(df, name):
        written[name] = materialise(df, name)
        return written[name]

    monkeypatch.setattr(decontaminate, "materialise", kept)
    items = spark.createDataFrame([(k, t) for k in (3, 1, 2, None) for t in (ITEM, ITEM, "too short")] + [(1, ITEM.replace("train", "bus"))], "item_id long, text string")
    docs = table(spark, [f"Before it: {ITEM}", ITEM.replace("train", "bus").replace("45", "90"), "nothing"], "doc_id")
    found = decontaminate.leaks(docs, items).collect()
    assert sorted((r["doc_id"], r["item_id"], r["verbatim"]) for r in found if r["share"] == 1) == [(0, 1, True), (0, 2, True), (0, 3, True), (1, 1, False)]
    assert {r["item"] for r in written["matches"].select("item").distinct().collect()} == {1}
    assert written["benchmark_texts"].count() == 3


def test_only_marked_windows_move(spark):
    hashes = spark.range(-50_000, 50_000, 7).select(F.xxhash64("id").alias("hash"))
    windows = spark.range(-100_000, 100_000).select("id", F.xxhash64("id").alias("hash")).unionByName(spark.range(1).select("id", F.lit(None).cast("long").alias("hash")))
    left = {r["id"] for r in decontaminate._marked(windows, decontaminate._marks(hashes)).collect()}
    wanted = set(range(-50_000, 50_000, 7))
    assert wanted <= left and len(left) < len(wanted) + 200
