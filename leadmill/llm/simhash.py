"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint's 64 bits are cut into segments; the bit count of each segment
embeds it as a point. The Manhattan distance of two points is a lower bound of
the Hamming distance of their fingerprints. Points at most `distance` (2) apart
share a lattice cell within one step of both, so each distinct fingerprint is
entered into its own cell and its one-step neighbours, and cells with several
fingerprints give the candidates: the grid range join.

Exact check: the fingerprints of a shared cell are verified by the values that
differ from each in at most one bit. Two fingerprints share such a value if and
only if they differ in at most two bits. Every value's members are linked to its
least member, so work grows with the members of a group and not with its pairs,
and no link between different texts is lost. Equal fingerprints are merged first.

Defined results: null or empty text, or one without words, has fingerprint zero,
linked like any other; texts below three words hash their whole word sequence;
repeated rows each get a row; a null doc_id never becomes a component's id
unless all its documents lack one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.llm.common import materialise
from leadmill.llm.components import components

#: Two bits each: the bound is then tight enough that unrelated fingerprints rarely share a cell.
SEGMENTS = 32


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have, as a signed 64-bit integer."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[k : k + 4096, None].view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint_text(text: str | None) -> int:
    """SimHash of one text as a signed 64-bit integer."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    shingles = zip(words, words[1:], words[2:]) if len(words) > 2 else [words]
    return majority(np.array([digest(join(x), 42) for x in shingles], np.uint64))


def fingerprint(text: Column) -> Column:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_text(x) for x in texts], dtype="int64")

    return of(text)


def enter(fps: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """fp and cell: the fingerprint's point and its one-step neighbours, a cell being
    one number whose digits of base width + 1 are the bit counts of the segments."""
    width = 64 // segments
    mask = F.lit((1 << width) - 1)
    counts = F.transform(F.sequence(F.lit(0), F.lit(segments - 1)), lambda k: F.bit_count(F.call_function("shiftrightunsigned", F.col("fp"), k * width).bitwiseAND(mask)).cast("long"))
    digit = F.array(*[F.lit((width + 1) ** k) for k in range(segments)])
    point = F.aggregate(F.zip_with("counts", digit, lambda c, d: c * d), F.lit(0).cast("long"), lambda a, x: a + x)
    up = F.zip_with("counts", digit, lambda c, d: F.when(c < width, F.col("point") + d))
    down = F.zip_with("counts", digit, lambda c, d: F.when(c > 0, F.col("point") - d))
    placed = fps.select("fp", counts.alias("counts")).select("fp", "counts", point.alias("point"))
    return placed.select("fp", F.explode(F.array_compact(F.concat(F.array("point"), up, down))).alias("cell"))


def links(fps: DataFrame, distance: int = 2) -> DataFrame:
    """Edges (a, b) that connect all fingerprints at most two bits apart; fps: distinct column fp."""
    if distance != 2:
        raise ValueError("cells and one-bit values are made for a distance of two")
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entered = enter(fps.repartition(tasks, "fp"))
    shared = entered.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell")
    candidates = materialise(entered.join(shared, "cell", "left_semi").select("fp").distinct(), "candidates")
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k)))
    near = F.concat(F.array("fp"), flips)
    values = candidates.select("fp", F.explode(near).alias("value"))
    least = values.groupBy("value").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z").select("value", "a")
    found = values.join(least, "value").where("fp <> a")
    return found.where(F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= distance).select("a", F.col("fp").alias("b"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, fp (long), fingerprint (hex) and component_id."""
    marked = materialise(docs.select(F.col(key), fingerprint(F.col(text)).alias("fp")), "fingerprints")
    groups = materialise(marked.groupBy("fp").agg(F.min(key).alias("least")), "distinct_fingerprints")
    linked = groups.join(components(links(groups.select("fp"))).withColumnRenamed("node", "fp"), "fp")
    ids = linked.groupBy("label").agg(F.min("least").alias("component_id"))
    named = linked.join(ids, "label").select("fp", "component_id")
    classes = materialise(groups.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "classes")
    return marked.join(classes, "fp").select(key, "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
