"""Near-duplicates: SimHash by the segment-popcount embedding, then Jaccard similarity of word shingles.

The first candidates are those of simhash.py: each set of shingles has a 64-bit
SimHash, sets of one value are compared to its least set, and the least sets of
values are compared along the links that the embedding's cells give. As an exact
check follows, every link stands for a similarity that was asked for.

A pair that just reaches a similarity of 0.8 differs in ten of 64 bits, which no
index over 64 bits reaches. What SimHash leaves apart therefore meets by min-wise
hashes: a set has one minimum under each of bands x ROWS permutations, and sets
that agree in all rows of a band share a cell. The number of bands follows from
the similarity, so that a pair that just reaches it shares no cell with a
probability of MISS (1e-8) only.

Pairs of a cell are never listed. Its members are first compared to a member of
its least and of its greatest component, which links a group of copies. Texts of
cells that are in several components after that are compared where they share one
of their rarest shingles: two sets of this similarity have to meet in the rarest
fifth of either, whatever passages else they share with many others.

Defined results: null or empty text, or one without words, has the empty set,
and all such are alike; texts shorter than a shingle have one of all their words;
words are split at white space and compared without case of A to Z; repeated
rows each get a row; a null key never becomes a component's id unless all its
rows lack one; representatives() tells documents apart by key and text, so
different texts under one key, or without a key, are kept or dropped each for itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadmill.llm.common import discard, materialise, small
from leadmill.llm.components import components
from leadmill.llm.simhash import links, majority

ROWS = 6
#: Probability that a pair of just the similarity asked for shares no cell.
MISS = 1e-8


def shingles_of(text: str | None, size: int) -> np.ndarray:
    """The set of the text's shingles as sorted 64-bit hashes."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    each = np.array([digest(w, 7) for w in words], np.uint64)
    size = min(size, len(words))
    found = np.full(len(words) - size + 1, len(words) if len(words) == size else 0, np.uint64)
    for k in range(size):
        found = found * np.uint64(0x9E3779B97F4A7C15) + each[k : k + len(found)]
        found ^= found >> np.uint64(29)
    return np.unique(found * np.uint64(0xBF58476D1CE4E5B9))


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both)


def mark(docs: DataFrame, key: str, text: str, size: int, bands: int) -> DataFrame:
    """key, h (hash of the text), fp (of its set of shingles), n (their number), bits (their SimHash) and cells."""

    @F.pandas_udf("fp long, n long, bits long, cells array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        r = np.random.default_rng(11)
        times = r.integers(0, 1 << 32, bands * ROWS, np.uint32) | np.uint32(1)
        plus = r.integers(0, 1 << 32, bands * ROWS, np.uint32)
        mix = r.integers(0, 1 << 63, ROWS, np.uint64) | np.uint64(1)
        band = r.integers(0, 1 << 63, bands, np.uint64)
        rows = []
        for t in texts:
            found = shingles_of(t, size)
            least = np.full(bands * ROWS, 0xFFFFFFFF, np.uint32)
            high = (found >> np.uint64(32)).astype(np.uint32)
            for k in range(0, len(high), 256):
                least = np.minimum(least, (high[k : k + 256, None] * times + plus).min(0))
            cells = (least.reshape(bands, ROWS).astype(np.uint64) * mix).sum(1, dtype=np.uint64) + band
            cells = (cells ^ cells >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
            fp = xxhash.xxh64_intdigest(found.tobytes())
            rows.append((fp - (1 << 64) if fp >> 63 else fp, len(found), majority(found), cells.view(np.int64)))
        return pd.DataFrame(rows, columns=["fp", "n", "bits", "cells"])

    marked = docs.select(F.col(key).alias("k"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"), of(F.col(text)).alias("m"))
    return marked.select("k", "h", "m.fp", "m.n", "m.bits", "m.cells")


def simhash_pairs(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets whose SimHash values are equal or linked by two bits at most: each set with the least of its
    value, and these along the links of values. sets: fp, n, bits, one row for each set."""
    least = materialise(sets.groupBy("bits").agg(F.min(F.struct("fp", "n")).alias("of")), "simhash_values")
    own = sets.join(least, "bits").select(F.col("of").alias("x"), F.struct("fp", "n").alias("y"))
    of = lambda end, name: least.select(F.col("bits").alias(end), F.col("of").alias(name))
    near = links(least.select(F.col("bits").alias("fp"))).join(of("a", "x"), "a").join(of("b", "y"), "b").select("x", "y")
    return own.unionByName(near)


def fitting(pairs: DataFrame, similarity: float) -> DataFrame:
    """The distinct pairs (a, b) of different sets x and y (fp, n) whose sizes allow the similarity, a < b."""
    fits = F.least("x.n", "y.n") >= F.lit(similarity) * F.greatest("x.n", "y.n")
    return pairs.where((F.col("x.fp") != F.col("y.fp")) & fits).select(F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b")).distinct()


def check(pairs: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """Those of the distinct pairs (a, b) whose texts are alike; texts: fp, text."""

    @F.pandas_udf("boolean")
    def of(b: pd.Series, left: pd.Series, right: pd.Series) -> pd.Series:
        out, last, held = [], None, None
        for fp, x, y in zip(b, left, right):
            if held is None or fp != last:
                last, held = fp, shingles_of(y, size)
            out.append(alike(shingles_of(x, size), held, similarity))
        return pd.Series(out, dtype=bool)

    met = pairs.join(texts.select(F.col("fp").alias("a"), F.col("text").alias("left")), "a")
    met = met.join(texts.select(F.col("fp").alias("b"), F.col("text").alias("right")), "b")
    return met.where(of("b", "left", "right")).select("a", "b")


def rare_pairs(texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of different label that can be alike by the shingles that are rarest in either; texts: fp, label, text.

    Of n shingles in an order common to all texts, a text that is alike shares one of the
    first n - similarity * n + 1. Sizes, the places of the first shingle shared and the
    number shared among these each bound what two texts can share, and a pair comes out
    only if every bound allows the similarity, at its first shared shingle."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [shingles_of(t, size).view(np.int64) for t in b["text"]]
            yield pd.DataFrame({"fp": b["fp"], "label": b["label"], "n": [len(x) for x in found], "s": found})

    sets = materialise(texts.select("fp", "label", "text").mapInPandas(of, "fp long, label long, n long, s array<long>"), "open_sets")
    each = sets.select("fp", "label", "n", F.explode_outer("s").alias("s")).where("s is not null")
    counts = each.groupBy("s").agg(F.count("*").alias("of"))
    place = F.row_number().over(Window.partitionBy("fp").orderBy("of", "s"))
    head = F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - 1e-9) + 1
    rare = each.join(counts, "s").withColumn("place", place).withColumn("head", head).where("place <= head")
    rare = materialise(rare.select("s", "fp", "label", "n", "place", "head"), "rarest_shingles")
    mixed = small(rare.groupBy("s").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("s"), "shared_rarest")
    rare = materialise(rare.join(mixed, "s", "left_semi"), "shared_rarest_places")
    # a text's own rarest shingles that others share, in order
    heads = rare.groupBy("fp").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "s"))), lambda x: x["s"]).alias("all"))
    rare = rare.join(heads, "fp")
    x = rare.select("s", F.col("fp").alias("a"), F.col("n").alias("n"), F.col("label").alias("la"), F.col("place").alias("pa"), F.col("head").alias("ha"), F.col("all").alias("sa"))
    y = rare.select(F.col("s").alias("t"), F.col("fp").alias("b"), F.col("n").alias("m"), F.col("label").alias("lb"), F.col("place").alias("pb"), F.col("head").alias("hb"), F.col("all").alias("sb"))
    need = F.lit(similarity / (1 + similarity)) * (F.col("n") + F.col("m")) - 1e-6
    fits = F.least("n", "m") >= F.lit(similarity) * F.greatest("n", "m") - 1e-6
    at = F.least(F.col("n") - F.col("pa"), F.col("m") - F.col("pb")) + 1 >= need
    both = F.array_intersect("sa", "sb")
    many = F.size(both) + F.greatest(F.col("n") - F.col("ha"), F.col("m") - F.col("hb")) >= need
    pair = (F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & fits & at & many & (F.get(both, F.lit(0)) == F.col("s"))
    return x.join(y, (F.col("s") == F.col("t")) & pair).select("a", "b").distinct()


def labelled(docs: DataFrame, key: str, text: str, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """k and h (hash of the text) of each row of docs with fp, and label of each fp: equal where a chain of pairs of at least this similarity links them."""
    bands = math.ceil(math.log(MISS) / math.log1p(-(similarity**ROWS))) if similarity < 1 else 1
    marked = materialise(mark(docs, key, text, shingle, bands), "shingle_sets")
    sets = materialise(marked.select("fp", "n", "bits").distinct(), "distinct_sets")
    first = materialise(fitting(simhash_pairs(sets), similarity), "simhash_pairs")
    entered = marked.select("fp", F.explode("cells").alias("cell"))
    shared = entered.groupBy("cell").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z").select("cell")
    members = materialise(entered.join(shared, "cell").distinct(), "members")

    wanted = first.select(F.explode(F.array("a", "b")).alias("fp")).unionByName(members.select("fp")).distinct()
    one = marked.join(wanted, "fp", "left_semi").groupBy("fp").agg(F.min(F.struct("k", "h")).alias("of"))
    one = small(one.select("fp", F.col("of.k").alias("k"), F.col("of.h").alias("h")), "candidate_rows")
    found = docs.select(F.col(key).alias("__k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = found.join(one, F.col("__k").eqNullSafe(F.col("k")) & (F.xxhash64("text") == F.col("h"))).select("fp", "text")
    texts = materialise(found.groupBy("fp").agg(F.first("text").alias("text")), "candidate_texts")

    close = materialise(check(first, texts, shingle, similarity), "simhash_links")
    known = materialise(components(close).withColumnRenamed("node", "fp"), "simhash_labels")
    told = sets.select("fp", "n").join(known, "fp", "left").select("fp", "n", F.coalesce("label", "fp").alias("label"))
    placed = materialise(members.join(told, "fp"), "placed_members")
    this = F.struct("label", "fp", "n")
    ends = placed.groupBy("cell").agg(F.min(this).alias("s"), F.max(this).alias("z")).where("s.label < z.label")
    ends = placed.join(ends, "cell").select("label", F.struct("fp", "n").alias("x"), F.explode(F.array("s", "z")).alias("y")).where("label <> y.label")
    ends = materialise(fitting(ends.select("x", "y"), similarity), "pairs_with_ends")
    edges = materialise(check(ends.join(first, ["a", "b"], "left_anti"), texts, shingle, similarity).unionByName(close), "links_with_ends")

    labels = materialise(components(edges).withColumnRenamed("node", "fp"), "first_labels")
    placed = members.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    open_cells = placed.groupBy("cell").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("cell")
    placed = materialise(placed.join(open_cells, "cell", "left_semi"), "open_members")
    rest = rare_pairs(placed.select("fp", "label").distinct().join(texts, "fp"), shingle, similarity)
    rest = materialise(rest.join(ends.unionByName(first), ["a", "b"], "left_anti"), "other_pairs")
    more = materialise(check(rest, texts, shingle, similarity), "other_links")

    # components that further links join; these are few
    of = lambda end: labels.select(F.col("fp").alias(end), F.col("label").alias(f"of_{end}"))
    joined = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    joined = small(components(joined).select(F.col("label").alias("least"), F.col("node").alias("label")), "joined_components")
    placed_all = marked.select("fp").distinct().join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    labels = materialise(placed_all.join(joined, "label", "left").select("fp", F.coalesce("least", "label").alias("label")), "labels")
    spark = docs.sparkSession
    rows = materialise(marked.select("k", "h", "fp"), "marked")
    discard(spark, marked, sets, first, members, one, texts, close, known, ends, edges, placed, rest, more)
    return rows, labels


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per row of docs: key and component_id, the least key that a chain of pairs of at least this similarity reaches."""
    rows, labels = labelled(docs, key, text, shingle, similarity)
    least = rows.groupBy("fp").agg(F.min("k").alias("least"))
    named = materialise(least.join(labels, "fp"), "least_of_sets")
    ids = named.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = materialise(named.join(ids, "label").select("fp", "component_id"), "classes")
    return rows.select("k", "fp").join(classes, "fp").select(F.col("k").alias(key), "component_id")


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group: of its least key, or without a key where none has one."""
    rows, labels = labelled(docs, key, text, shingle, similarity)
    order = F.struct(F.col("k").isNull(), "k", "h")
    least = rows.groupBy("fp").agg(F.min(order).alias("of"), F.count("*").alias("n"))
    of = least.join(labels, "fp").groupBy("label").agg(F.min("of").alias("of")).select(F.col("of.k").alias("__of"), F.col("of.h").alias("__with"))
    # those that go are fewer than those that stay, and the texts need not be shuffled where they can be broadcast
    gone = rows.select("k", "h").distinct().join(of, F.col("k").eqNullSafe(F.col("__of")) & (F.col("h") == F.col("__with")), "left_anti")
    gone = small(gone.select(F.col("k").alias("__k"), F.col("h").alias("__h")), "rows_that_go")
    met = docs.join(gone, docs[key].eqNullSafe(gone["__k"]) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == gone["__h"]), "left_anti")
    # rows that repeat a key and a text meet only with each other
    twice = rows.groupBy("k", "h").agg(F.count("*").alias("n")).where("n > 1").select(F.col("k").alias("__k"), F.col("h").alias("__h"), F.lit(True).alias("__twice"))
    twice = small(twice, "repeated_rows")
    met = met.withColumn("__text", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    met = met.join(twice, met[key].eqNullSafe(twice["__k"]) & (met["__text"] == twice["__h"]), "left").drop("__k", "__h")
    one = met.where("__twice").dropDuplicates([key, "__text"])
    return met.where("__twice is null").unionByName(one).select(*docs.columns)
