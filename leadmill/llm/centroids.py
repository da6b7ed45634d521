"""Clusters of vectors around centroids: Lloyd's rounds in exact integers, the nearest
centroid by the threshold algorithm.

Each dimension keeps its centroid values in order. A vector enters every list at its
own value and walks outward from there, nearer neighbour first; centroids met in
any list are compared exactly. The next values of all lists together are the least
distance that an unseen centroid can have, so the walk ends once their squares' sum
is strictly above the best distance found: an unseen centroid can't tie either.

Vectors stay where they are. A round sends the centroids to the tasks (k times the
dimensions, whatever the corpus) and brings back sums: one for each task, cluster
and dimension, added up by Spark, so k times the dimensions numbers reach the driver.

Defined results: vectors of another length, with a null or a non-finite component or
null themselves are left out; an empty table gives no rows; with fewer vectors than
clusters each is a centroid; repeated rows count each (two of them may both start a
cluster, the later one stays empty); a null id can't start a cluster but is assigned;
other columns pass unless they bear the name of a result column, which they lose to it.
Components of any size are exact; distances beyond a long stay at its greatest value.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadmill.llm.common import discard, materialise

RESULT = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
MOST = (1 << 63) - 1
#: Components below this keep every squared distance of up to 2 ** 10 dimensions within 64 bits.
NARROW = 1 << 25
#: Sums travel in parts of so many bits, so that they stay longs however many vectors there are.
PART = 30
#: Vectors that advance together, which bounds a task's memory.
TOGETHER = 2048


def whole_numbers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of a matrix of doubles: int64 where all are narrow, else Python's integers."""
    scaled = np.floor(values * scale)
    if not scaled.size or np.abs(scaled).max() < NARROW:
        return scaled.astype(np.int64)
    exact = lambda x: math.floor(x * scale) if abs(x) < 2.0**53 else int(x) * scale
    return np.array([[exact(float(x)) for x in row] for row in values], object).reshape(values.shape)


class Nearest:
    """The centroids' values in order of each dimension."""

    def __init__(self, centroids: list[list[int]]):
        wide = any(abs(x) >= NARROW for c in centroids for x in c)
        self.centroids = np.array(centroids, object if wide else np.int64)
        self.order = np.argsort(self.centroids, axis=0, kind="stable").T
        self.lists = np.take_along_axis(self.centroids, self.order.T, axis=0).T

    def find(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each vector its nearest centroid (the smaller number of ties) and the squared distance."""
        k, dims = self.centroids.shape
        kind = object if object in (vectors.dtype, self.centroids.dtype) else np.int64
        vectors, lists, centroids = vectors.astype(kind), self.lists.astype(kind), self.centroids.astype(kind)
        n = len(vectors)
        best, nearest = np.full(n, -1, kind), np.full(n, k)
        above = np.stack([np.searchsorted(lists[d], vectors[:, d]) for d in range(dims)], 1).reshape(n, dims)
        below = above - 1
        seen = np.zeros((n, k), bool)
        walking, column = np.arange(n), np.arange(dims)
        for _ in range(k):
            if not len(walking):
                break
            at, low, high = vectors[walking], below[walking], above[walking]
            down = at - lists[column, np.maximum(low, 0)]
            up = lists[column, np.minimum(high, k - 1)] - at
            lower = (low >= 0) & ((high >= k) | (down <= up).astype(bool))
            frontier = np.where(lower, down, up)
            # what no list has shown yet is at least as far as all frontiers together
            bound = (frontier * frontier).sum(1)
            going = ((best[walking] < 0) | (bound <= best[walking])).astype(bool)
            walking, low, high, lower = walking[going], low[going], high[going], lower[going]
            met = self.order[column, np.where(lower, low, high)]
            new = np.zeros((len(walking), k), bool)
            new[np.arange(len(walking))[:, None], met] = True
            new &= ~seen[walking]
            seen[walking] |= new
            for c in np.flatnonzero(new.any(0)):
                rows = walking[new[:, c]]
                apart = vectors[rows] - centroids[c]
                far = (apart * apart).sum(1)
                closer = ((best[rows] < 0) | (far < best[rows]) | ((far == best[rows]) & (c < nearest[rows]))).astype(bool)
                best[rows[closer]], nearest[rows[closer]] = far[closer], c
            below[walking], above[walking] = np.where(lower, low - 1, low), np.where(lower, high, high + 1)
        return nearest, best


def batches(vectors: pa.Array | pa.ChunkedArray, dims: int, scale: int) -> Iterator[np.ndarray]:
    """A column of vectors as matrices of whole numbers, TOGETHER rows at most each."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    for k in range(0, len(flat), TOGETHER):
        yield whole_numbers(flat[k : k + TOGETHER], scale)


def parts(total: int) -> Iterator[tuple[int, int]]:
    """An integer of any size as numbered parts of PART bits, all of its sign."""
    sign, rest, k = (-1 if total < 0 else 1), abs(total), 0
    while rest:
        yield k, sign * (rest & ((1 << PART) - 1))
        rest, k = rest >> PART, k + 1


def valid(vector: Column, dims: int) -> Column:
    """Exactly `dims` components, none null, infinite or not a number."""
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce((F.size(vector) == dims) & F.forall(vector, lambda x: F.coalesce(fits(x.cast("double")), F.lit(False))), F.lit(False))


def sums(vectors: DataFrame, vector: str, centroids: list[list[int]], dims: int, scale: int) -> dict[int, tuple[int, list[int]]]:
    """For each cluster that has vectors their number and the exact sum of each component."""

    def add(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Nearest(centroids)
        totals: dict[int, list[int]] = {}
        for batch in found:
            for x in batches(batch.column(0), dims, scale):
                near, _ = index.find(x)
                for c in np.unique(near):
                    mine = x[near == c]
                    held = totals.setdefault(int(c), [0] * (dims + 1))
                    held[0] += len(mine)
                    for d, total in enumerate(mine.sum(0)):
                        held[d + 1] += int(total)
        rows = [(c, d, k, v) for c, held in totals.items() for d, total in enumerate(held) for k, v in parts(total)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["c", "d", "k", "v"])

    told = vectors.select(F.col(vector)).mapInArrow(add, "c int, d int, k int, v long").groupBy("c", "d", "k").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    result: dict[int, list[int]] = {}
    for r in told.collect():  # clusters x dimensions x parts of a sum
        held = result.setdefault(r["c"], [0] * (dims + 1))
        held[r["d"]] += int(r["v"]) << PART * r["k"]
    return {c: (held[0], held[1:]) for c, held in result.items()}


def seeds(vectors: DataFrame, key: str, vector: str, k: int, salt: str, scale: int) -> list[list[int]]:
    """The k vectors with the smallest SHA-256 of `salt:id`; ties by the vector."""
    hashed = F.sha2(F.concat(F.lit(f"{salt}:"), F.col(key).cast("string")), 256)
    first = vectors.where(F.col(key).isNotNull()).select(hashed.alias("h"), F.col(vector).cast("array<double>").alias("v")).orderBy("h", "v").limit(k).collect()
    return [[int(x) for x in whole_numbers(np.array([r["v"]]), scale)[0]] for r in first]


def fit(vectors: DataFrame, key: str, vector: str, k: int, rounds: int, salt: str, dims: int, scale: int) -> list[list[int]]:
    centroids = seeds(vectors, key, vector, k, salt, scale)
    for _ in range(rounds if centroids else 0):
        before = centroids
        found = sums(vectors, vector, centroids, dims, scale)
        centroids = [[t // found[c][0] for t in found[c][1]] if c in found else old for c, old in enumerate(before)]
        if centroids == before:
            break  # all further rounds would repeat this one
    return centroids


def cluster(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 8, rounds: int = 10, salt: str = "3", dims: int = 64, scale: int = 1024) -> DataFrame:
    """df's valid vectors with the columns of RESULT; the vector itself goes."""
    spark, passed = df.sparkSession, [c for c in df.columns if c != vector and c.lower() not in RESULT]
    # a struct holds what passes, whatever its names are
    held = materialise(df.where(valid(F.col(f"`{vector}`"), dims)).select(F.struct(*[F.col(f"`{c}`") for c in passed]).alias("row"), F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("vector")), "vectors")
    centroids = fit(held, "key", "vector", k, rounds, salt, dims, scale)

    @F.pandas_udf("cluster int, distance long")
    def assign(found: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index = Nearest(centroids)
        for series in found:
            at = [index.find(whole_numbers(np.stack(series.iloc[i : i + TOGETHER].to_list()).astype(np.float64), scale)) for i in range(0, len(series), TOGETHER)]
            near = np.concatenate([a for a, _ in at]) if at else np.zeros(0, int)
            far = [min(int(x), MOST) for _, b in at for x in b]
            yield pd.DataFrame({"cluster": near.astype(np.int32), "distance": np.array(far, np.int64)})

    result = T.StructType([*held.schema["row"].dataType.fields, *T._parse_datatype_string("cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string").fields])
    if not centroids:
        return spark.createDataFrame([], result)
    assigned = materialise(held.select("row", assign("vector").alias("to")), "assigned")
    totals = {r["cluster"]: int(r["total"]) for r in assigned.groupBy("to.cluster").agg(F.sum(F.col("to.distance").cast("decimal(38,0)")).alias("total")).collect()}  # k rows
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    facts = [(c, min(totals[c], MOST), digest(centroids[c])) for c in sorted(totals)]
    about = F.broadcast(spark.createDataFrame(facts, "cluster int, cluster_inertia long, centroid_sha256 string"))  # k rows
    whole = min(sum(totals.values()), MOST)
    discard(spark, held)
    own = [F.col(f"row.`{f.name}`").alias(f.name) for f in held.schema["row"].dataType.fields]
    return assigned.join(about, F.col("to.cluster") == about["cluster"]).select(*own, "to.cluster", "to.distance", "cluster_inertia", F.lit(whole).cast("long").alias("inertia"), "centroid_sha256")
