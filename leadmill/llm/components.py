"""Connected components over an edge table, by rounds of minimum labels with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadmill.llm.common import discard, materialise


def components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """(node, label) for every node of the edges; label is the smallest node reachable.

    Alternates large-star and small-star rounds, each written to the shared folder,
    until a round changes nothing: the number of rounds grows with the logarithm of
    a component's size, and no component is gathered in one row or task.
    """
    forward = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    state = materialise(forward, name)
    stamp = lambda x: tuple(x.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
    last = stamp(state)
    while last[0]:
        # large star: every larger neighbour of u is linked to the least of u and its neighbours
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialise(large, name)
        # small star: u and its smaller neighbours are linked to the least of these
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        small = materialise(small.select("e.u", "e.v").where("u <> v").distinct(), name)
        now = stamp(small)
        discard(state.sparkSession, state, large)
        state = small
        if now == last:
            break
        last = now
    leaves = state.select(F.col("u").alias("node"), F.col("v").alias("label"))
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return leaves.unionByName(roots)
