"""Benchmark decontamination by template canonicalisation, native expressions only.

Words lose their punctuation. Those that begin with a digit become <num>, units
<unit>, and capitalised words <name>. Windows of eight canonical words of the
benchmark are hash-joined to those of the documents, so a question with other
numbers, names or units still meets its template.

A capitalised word may be a name or not, and case may have been changed. So each
window is hashed in two forms, in lower case and with <name>; each form is judged
by itself, with the windows that have no capitalised word in both.

A match is an instance: one document, one item and one alignment (distance of
positions, within a band of 8 words). It is a leak if its windows are at least
min_share of the item's windows, or a run of RUN consecutive windows of the item
(13 words) whatever its length, and the slots of these are consistent: one value of the
item always stands for one value of the document. A verbatim copy is consistent
by itself.

Documents are read once for windows of all sizes. Hashes of windows are built by
doubling (pairs, fours, eights), and slots only for windows that met, in the step
that finds them: no row of a window carries its document's words on, of which one
long document would need memory by its length squared. Items of equal texts are
matched once. The windows of the benchmark are broadcast where their measured
bytes are at most most_bytes. Beyond that they are joined by shuffle, of the
documents' windows only those that a broadcast bitmap of the benchmark's hashes
doesn't rule out. Nothing is gathered per document or item but counts and distinct
slot pairs.

Defined results: a document is a key and a text, so different texts under one key,
null keys included, are judged apart, and rows that repeat both are one; null or
empty texts match nothing; items below eight words have one window of all their
words if they have at least four, and are otherwise too short to tell; items that
repeat count as one item each; other columns of either table are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadmill.llm.common import BROADCAST_BYTES, materialise, row_bytes, small

WINDOW = 8
#: Consecutive windows that are a leak by themselves: 13 words.
RUN = 6
#: Units that become a slot.
UNITS = ("mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "mg", "g", "kg", "gram", "grams", "pound", "pounds", "ounce", "ounces", "ton", "tons", "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "cent", "cents", "dollar", "dollars", "euro", "euros", "percent", "degrees", "meter", "meters", "metre", "metres", "kilometer", "kilometers", "kilogram", "kilograms")
_MARK = "\x01"
#: A placeholder among words with single spaces between them, as placeholder() tells them.
_SLOT = rf"(?:^| )(?:{_MARK}|[0-9]|(?:{'|'.join(UNITS)})(?: |\z))"
#: Bits of a bitmap of the benchmark's hashes (16 MB at most, whatever their number) and of each of its rows.
MARKS, ROW_MARKS = 1 << 27, 1 << 12


def words(text: Column) -> Column:
    """Words as they stand, without punctuation."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{M}\p{N}\s\xA0]++", "")
    return F.split(F.btrim(plain, F.lit(" \t\n\x0b\x0c\r\xa0")), r"[\s\xA0]+")


def placeholder(word: Column) -> Column:
    """The typed placeholder of a word in lower case or marked as a name, null for other words."""
    # what sorts before ":" begins with a digit or the mark, as punctuation is gone
    return F.when(word.startswith(_MARK), "<name>").when((word >= "0") & (word < ":"), "<num>").when(word.isin(*UNITS), "<unit>")


def _joined(a: str, b: str, by: int) -> Column:
    """Hashes of adjoining windows put together; null where the second lies beyond the text."""
    return F.zip_with(a, F.slice(b, F.lit(by + 1), F.size("__w")), lambda x, y: F.xxhash64(x).bitwiseXOR(y))


def _window(of: str, size: int) -> Column:
    return {4: lambda: F.col(f"{of}4"), 5: lambda: _joined(f"{of}4", of, 4), 6: lambda: _joined(f"{of}4", f"{of}2", 4), 7: lambda: _joined(f"{of}6", of, 6), 8: lambda: _joined(f"{of}4", f"{of}4", 4)}[size]()


def windows(texts: DataFrame, keys: list[str], text: str, sizes: list[int]) -> DataFrame:
    """keys, hash, __l and __x (the text's words in lower case, and with names marked), __at, __n and __all: what place() needs to tell a window that met."""
    df = texts.select(*keys, words(F.col(text)).alias("__w"))
    df = df.select(*keys, "__w", F.transform("__w", F.lower).alias("__l"))
    keys = [*keys, "__l", "__x"]
    fixed = {p: F.xxhash64(F.lit(p)) for p in ("<num>", "<unit>", "<name>")}
    hashed = F.transform("__l", lambda x: F.when((x >= "0") & (x < ":"), fixed["<num>"]).when(x.isin(*UNITS), fixed["<unit>"]).otherwise(F.xxhash64(x)))
    marked = F.zip_with("__w", "__l", lambda x, y: F.when(x != y, F.concat(F.lit(_MARK), y)).otherwise(y)).alias("__x")
    df = df.select(*keys[:-1], marked, "__w", hashed.alias("__h"), F.zip_with("__w", "__l", lambda x, y: F.when(x != y, fixed["<name>"])).alias("__c"))
    df = df.select(*keys, "__w", "__h", F.zip_with("__c", "__h", lambda c, h: F.coalesce(c, h)).alias("__g"))
    df = df.select("*", *[_joined(x, x, 1).alias(f"{x}2") for x in ("__h", "__g")])
    df = df.select("*", *[_joined(f"{x}2", f"{x}2", 2).alias(f"{x}4") for x in ("__h", "__g")])
    if 7 in sizes:
        df = df.select("*", *[_joined(f"{x}4", f"{x}2", 4).alias(f"{x}6") for x in ("__h", "__g")])
    plain = df.select(*keys, F.size("__w").alias("__n"), *[_window(x, s).alias(f"{x}of{s}") for s in sizes for x in ("__h", "__g")])
    both = [c for s in sizes for c in (F.col(f"__hof{s}"), F.zip_with(f"__hof{s}", f"__gof{s}", lambda h, g: F.nullif(g, h)))]
    blocks = plain.select(*keys, "__n", F.concat(*both).alias("__all"))
    # outer, as Spark would else filter by the size of __all below all these steps and take them twice
    return blocks.select(*keys, "__n", "__all", F.posexplode_outer("__all").alias("__at", "hash"))


def place(df: DataFrame, sizes: list[int]) -> DataFrame:
    """pos (from 1), size and kind (0: of both forms, 1: lower case, 2: with names) of windows, and their slots: the words of one with a placeholder, else null."""
    block = F.expr("int(__at div __n)")
    df = df.withColumns({"pos": F.col("__at") % F.col("__n") + 1, "size": F.element_at(F.array(*[F.lit(s) for s in sizes]), F.expr("int(__at div __n div 2) + 1")), "kind": F.when(block % 2 == 1, 2).when(F.get("__all", F.col("__at") + F.col("__n")).isNotNull(), 1).otherwise(0)})
    # without lambdas, so that it is one step with the explode and the join before it and rows without the words leave that
    df = df.withColumn("slots", F.array_join(F.slice(F.when(F.col("kind") == 2, F.col("__x")).otherwise(F.col("__l")), F.col("pos"), F.col("size")), " "))
    return df.withColumn("slots", F.when(F.col("slots").rlike(_SLOT), F.col("slots"))).drop("__l", "__x", "__at", "__all")


def _marks(hashes: DataFrame) -> DataFrame:
    """A bitmap of hashes: rows of ROW_MARKS bits, 64 in each of their numbers."""
    at = F.pmod("hash", F.lit(MARKS))
    placed = hashes.select(F.floor(at / ROW_MARKS).cast("int").alias("__row"), F.floor(at % ROW_MARKS / 64).cast("int").alias("slot"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int")).alias("bit"))
    each = placed.groupBy("__row", "slot").agg(F.bit_or("bit").alias("bits"))
    filled = each.groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct("slot", "bits"))).alias("of"))  # ROW_MARKS / 64 at most
    return filled.select("__row", F.transform(F.sequence(F.lit(0), F.lit(ROW_MARKS // 64 - 1)), lambda k: F.coalesce(F.col("of")[k], F.lit(0).cast("long"))).alias("bits"))


def _marked(windows: DataFrame, marks: DataFrame) -> DataFrame:
    """Windows whose hash the bitmap doesn't rule out; a hash that isn't in it may share a mark."""
    at = F.pmod("hash", F.lit(MARKS))
    met = windows.join(F.broadcast(marks), F.floor(at / ROW_MARKS).cast("int") == F.col("__row"))
    return met.where(F.getbit(F.get("bits", F.floor(at % ROW_MARKS / 64).cast("int")), (at % 64).cast("int")) == 1).drop("__row", "bits")


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", min_share: float = 0.5, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per leaked (document, item): key, text_hash (xxhash64 of the text), item_id, first and last word, share, verbatim."""
    each = materialise(benchmark.where(F.col(item).isNotNull()).select(F.col(item).alias("id"), F.col(item_text).alias("__t")).distinct(), "benchmark_items")
    # equal texts are matched once, under the least of their ids
    items = materialise(each.groupBy("__t").agg(F.min("id").alias("item")).select("item", F.xxhash64("__t").alias("of"), "__t"), "benchmark_texts")
    ids = small(each.join(items, "__t").select("id", F.col("item").alias("item_of"), F.col("of").alias("text_of")), "benchmark_ids")
    lengths = items.select(F.size(words(F.col("__t"))).alias("n")).where("n between 4 and 7").distinct().collect()  # four rows at most
    sizes = [WINDOW, *sorted(r["n"] for r in lengths)]
    ours = place(windows(items, ["item", "of"], "__t", sizes).where("hash is not null"), sizes).where(f"size = least(__n, {WINDOW})").drop("__n", "size")
    ours = materialise(ours.withColumnsRenamed({"pos": "at", "slots": "want", "kind": "form"}).distinct(), "benchmark_windows")
    total = ours.groupBy("item", "of").agg(F.countDistinct("at").alias("total"))
    ours = materialise(ours.join(total, ["item", "of"]), "benchmark_templates")
    spread = (ours.agg(F.sum(row_bytes(ours))).first()[0] or 0) <= most_bytes
    whole = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("row"), F.col(text).alias("__t"))
    theirs = windows(whole, ["k", "row"], "__t", sizes)
    # slots are put together after the join, or before it where rows move for it
    met = place(theirs.join(F.broadcast(ours), "hash"), sizes) if spread else place(_marked(theirs, materialise(_marks(ours), "marks")), sizes).join(ours, "hash")
    met = met.where("kind + form <> 3").withColumn("form", F.explode(F.when(F.col("kind") + F.col("form") == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.greatest("kind", "form")))))
    instance = ["k", "row", "item", "of", "form", "band"]
    # two bands, half a band apart, so that an alignment that shifts by a word stays in one of them
    shift = F.col("pos") - F.col("at")
    met = met.withColumn("band", F.explode(F.array(F.floor(shift / 8) * 2, F.floor((shift + 4) / 8) * 2 + 1)))
    # rows that repeat a key and a text meet here before their windows are numbered
    met = materialise(met.select(*instance, "pos", "at", "total", "size", "want", "slots").distinct(), "matches")
    # each instance is judged as a whole (run -1) and by its runs of consecutive windows
    run = F.col("at") - F.dense_rank().over(Window.partitionBy(*instance).orderBy("at"))
    met = met.withColumn("run", run).withColumn("run", F.explode(F.array(F.lit(-1), "run")))
    instance.append("run")
    share = met.groupBy(*instance).agg(F.countDistinct("at").alias("n"), F.first("total").alias("total"), F.min("pos").alias("first_word"), F.max(F.col("pos") + F.col("size") - 1).alias("last_word"))
    share = share.where((F.col("n") >= F.lit(min_share) * F.col("total")) | (F.col("run") >= 0) & (F.col("n") >= RUN))
    pairs = met.where("slots is not null").select(*instance, F.explode(F.arrays_zip(F.split("want", " ").alias("a"), F.split("slots", " ").alias("b"), F.transform(F.split("slots", " "), placeholder).alias("c"))).alias("p"))
    pairs = pairs.where(F.col("p.c").isNotNull()).select(*instance, F.col("p.a").alias("a"), F.col("p.b").alias("b")).distinct()
    slots = pairs.groupBy(*instance).agg(F.count("*").alias("pairs"), F.countDistinct("a").alias("values"), F.count_if(F.col("a") != F.col("b")).alias("changed"))
    judged, slots = share.alias("s"), slots.alias("t")
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}")) for c in instance]
    sound = judged.join(slots, same, "left").where(F.coalesce(F.col("pairs") == F.col("values"), F.lit(True)))
    # every id of an item's text
    sound = sound.join(ids, (F.col("s.item") == F.col("item_of")) & (F.col("s.of") == F.col("text_of")))
    return sound.groupBy(F.col("s.k").alias(key), F.col("s.row").alias("text_hash"), F.col("id").alias("item_id")).agg(
        F.min("first_word").cast("long").alias("first_word"), F.max("last_word").cast("long").alias("last_word"),
        F.max(F.col("n") / F.col("total")).alias("share"), F.max(F.coalesce("changed", F.lit(0)) == 0).alias("verbatim"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those that hold a leaked item; a document is a key and a text, null keys included."""
    leaked = materialise(leaks(docs, benchmark, key, text).select(F.col(key).alias("__k"), F.col("text_hash").alias("__h")).distinct(), "leaked")
    return docs.join(leaked, docs[key].eqNullSafe(leaked["__k"]) & (F.xxhash64(docs[text]) == leaked["__h"]), "left_anti")
