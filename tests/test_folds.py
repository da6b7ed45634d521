"""Ordered merges on literal cases: repeats, nulls, empty tables, groups that meet only when merged."""

from pyspark.sql import functions as F

from leadmill.functions.text import richer
from leadmill.operators import folds, merging, preview_merge

ITEM = "item_pos long, name_key string, address_key string, neighborhood_key string, city_key string, google_place_id string, google_maps_url string, domain string, phone string, search_terms array<string>, payload map<string,string>"


def item(pos, name=None, address=None, phone=None, domain=None, terms=(), **payload):
    return pos, name, address, None, None, None, None, domain, phone, list(terms), payload


def test_richer(spark):
    cases = [("Pet", "pet shop", "pet shop"), ("Pét", "PET!", "PET!"), ("abc", "xyz abcd", "xyz abcd"), ("long name", "name", "long name"), (" a ", None, "a"), ("", " b", "b"), (None, " ", None), ("!!", "???", "!!"), ("a", "b", "a")]
    df = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(cases)], "k int, a string, b string")
    assert [r[0] for r in df.orderBy("k").select(richer(F.col("a"), F.col("b"))).collect()] == [c for *_, c in cases]
    rows = spark.createDataFrame([(k, p, v) for k, case in enumerate(cases) for p, v in enumerate(case[:2])], "g int, p int, v string")
    found = {r["g"]: r["v"] for r in folds.folded(rows, "g", F.col("p"), ["v"], folds.richer_of).collect()}
    # symbols alone have no normalised form and nothing replaces them
    assert [found.get(k) for k in range(len(cases))] == [c for *_, c in cases]


def test_fold_follows_the_order_and_ignores_repeats(spark):
    values = ["ab", "abc", "ab", "zzz", "abc", "xabcx", "abc", None, "", "ab"]
    for times in (1, 200):
        rows = spark.createDataFrame([(1, k, v) for _ in range(times) for k, v in enumerate(values)] + [(None, 0, "n")], "g int, p int, v string")
        assert {r["g"]: r["v"] for r in folds.folded(rows, "g", F.col("p"), ["v"], folds.richer_of).collect()} == {1: "xabcx", None: "n"}


def test_ordered_union_and_latest_entries(spark):
    rows = spark.createDataFrame([(1, 2, ["b", "a"], {"k": "late"}), (1, 1, ["c", "a", None, "", "c"], {"k": "soon", "z": "1"}), (1, 2, ["b"], None), (2, 1, [], {})], "g int, p int, v array<string>, m map<string,string>")
    assert {r["g"]: r["u"] for r in folds.ordered_union(rows, "g", F.col("p"), F.col("v"), "u").collect()} == {1: ["c", "a", "b"]}
    assert {r["g"]: r["m"] for r in folds.latest_entries(rows, "g", F.col("p"), F.col("m"), "m").collect()} == {1: {"k": "late", "z": "1"}}


def test_a_merged_row_makes_a_new_key(spark):
    rows = [
        item(1, "casa 1", "rua a 1", phone="5", terms=["x"], k="1"), item(2, "casa 1 longa", phone="5", terms=["y", "x"], k="2", j="3"),
        item(3, "casa 1 longa", "rua a 1", terms=["w"]), item(4, "outra"), item(5, "casa 9", domain="d.com"), item(5, "casa 9", domain="d.com"),
    ]
    merged, groups = preview_merge.merged_previews(spark.createDataFrame(rows, ITEM))
    found = {r["group_pos"]: r for r in merged.collect()}
    assert sorted(found) == [1, 4, 5] and {r["item_pos"]: r["group_pos"] for r in groups.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    assert (found[1]["name_key"], found[1]["address_key"], found[1]["phone"]) == ("casa 1 longa", "rua a 1", "5")
    assert found[1]["search_terms"] == ["x", "y", "w"] and found[1]["payload"] == {"j": "3", "k": "2"}


def test_no_items(spark):
    merged, groups = preview_merge.merged_previews(spark.createDataFrame([], ITEM))
    assert merged.count() == groups.count() == 0


def test_notes_below_each_other(spark):
    leads = spark.createDataFrame([(1, "call"), (2, "call back"), (3, "call"), (4, None), (5, "other")], "lead_id long, notes string")
    members = spark.createDataFrame([(k, 1) for k in range(1, 6)], "lead_id long, cluster long")
    priority = spark.createDataFrame([(1, 1.0), (2, 9.0), (3, 0.5), (4, 8.0), (5, 0.1)], "lead_id long, priority double")
    assert merging.merged_notes(leads, members, priority).first()["notes"] == "call back\n\n[Merged from lead 5]\nother"
