"""Exact substring dedup: words inside a window of 35 words that starts anywhere else are removed.

The method named for this operator, broadcast suffix automata of reference shards,
streams every document through the automaton of every shard: work grows with
documents times shards, and a word-level automaton holds up to two states a word.
The README has figures. This module keeps the matching exact at a cost that grows
with the input; `SuffixAutomaton` serves as the reference on small data.

1. Every window of 35 words has an anchor: the 8-word gram of least hash inside it.
   Equal windows have equal anchors, so a window can only repeat if its anchor
   does. Anchors are 7 % of the words; those found twice are kept by a shuffle.
2. Documents with repeated anchors emit the hashes of the windows of those anchors
   only (96 bits in two independent parts), and windows found twice are kept.
3. Starts of repeated windows return to their documents, which drop the words covered.

A frequent passage is counted by partial aggregation and joined as a stream; its
occurrences are never gathered. Texts move whole, and only those that a broadcast
bitmap of document hashes doesn't rule out: a text without repeated anchors or
windows stays in its place.

Defined results: null or empty text has no words and keeps the empty string;
repeated rows are elsewhere for each other, so all their windows repeat; a text
below 35 words loses nothing; keys may be null or large, and different texts may
share one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadmill.llm.common import discard, materialise, small

WINDOW, GRAM = 35, 8
#: Bits of a bitmap of documents (16 MB at most, whatever their number) and of each of its rows, as bitmap_construct_agg() makes them.
MARKS, ROW_MARKS = 1 << 27, 1 << 15
#: Odd multipliers of two polynomial hashes modulo 2 ** 64.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


class WordHashes(dict):
    """Word to 64-bit hash; forgets when it grows beyond 300,000 words."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word, 7)
        if len(self) > 300_000:
            self.clear()
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def window_hashes(words: np.ndarray, size: int, base: int) -> np.ndarray:
    """Polynomial hash of every window of `size` words, by doubling."""
    out, done, block, width = None, 0, words, 1
    scale = lambda n: np.uint64(pow(base, n, 1 << 64))
    n = len(words) - size + 1
    left = size
    while left:
        if left & 1:
            part = block[done : done + n]
            out = part.copy() if out is None else out * scale(width) + part
            done += width
        left >>= 1
        if left:
            block = block[: len(block) - width] * scale(width) + block[width:]
            width *= 2
    return out


def anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every window start the hash of its anchor, and the place of the anchor (leftmost of equal ones)."""
    grams = mixed(window_hashes(words, GRAM, BASES[0]))
    reach = WINDOW - GRAM + 1
    n, width, block = len(grams) - reach + 1, 1, grams
    places = np.arange(len(grams))
    while width < reach:
        step = min(width, reach - width)
        left, right = block[: len(block) - step], block[step:]
        places = np.where(left <= right, places[: len(places) - step], places[step:])
        block = np.minimum(left, right)
        width += step
    return block[:n], places[:n]


def anchor_counts(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchors of one text and at how many places each is chosen."""
    found, places = anchors(words)
    heads = np.unique(places, return_index=True)[1]
    return np.unique(found[heads], return_counts=True)


def _key(docs: DataFrame, key: str, text: str) -> DataFrame:
    """k (the key as text, since pandas turns whole numbers beside a null into floats), t, and g and h, which name the document in 16 bytes wherever its text isn't needed."""
    whole = docs.select(F.col(key).cast("string").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return whole.select("k", "t", F.xxhash64(F.lit(1), "k", "t").alias("g"), F.xxhash64("t").alias("h"))


def _back(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """left joined to right, which has one row for each document (g2, h2)."""
    return left.join(right, (left.h == right.h2) & (left.g == right.g2), how).drop("h2", "g2")


def _marks(ids: DataFrame) -> DataFrame:
    """A bitmap of the documents g2 of ids: rows of ROW_MARKS bits by their number."""
    place = F.pmod("g2", F.lit(MARKS))
    placed = ids.select(F.floor(place / ROW_MARKS).cast("int").alias("row"), (place % ROW_MARKS).alias("bit")).repartition("row")
    return placed.groupBy("row").agg(F.bitmap_construct_agg("bit").alias("bits"))


def _marked(whole: DataFrame, marks: DataFrame, wanted: bool) -> DataFrame:
    """Rows of whole that may be marked (a document that isn't may share a mark), or those that surely aren't; neither moves."""
    place = F.pmod("g", F.lit(MARKS))
    met = whole.join(F.broadcast(marks), F.floor(place / ROW_MARKS).cast("int") == F.col("row"), "left")
    byte = F.conv(F.hex(F.substring("bits", (place % ROW_MARKS / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.coalesce(F.call_function("shiftright", byte, (place % 8).cast("int")) % 2 == 1, F.lit(False))
    return met.where(held if wanted else ~held).select(whole.columns)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, n_words, n_removed, removed (spans) and kept (text)."""
    whole = _key(docs, key, text)

    def find_anchors(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for b in batches:
            rows = []
            for g, h, t in zip(b["g"], b["h"], b["t"]):
                words = t.encode("utf-8", "replace").split()
                if len(words) >= WINDOW:
                    a, n = anchor_counts(known.of(words))
                    rows.append((g, h, a.view(np.int64), n.astype(np.int32)))
            yield pd.DataFrame(rows, columns=["g", "h", "anchor", "n"])

    found = materialise(whole.select("g", "h", "t").mapInPandas(find_anchors, "g long, h long, anchor array<long>, n array<int>"), "anchors")
    each = found.select("g", "h", F.inline(F.arrays_zip("anchor", "n")))
    # a table of its own, one row for each anchor: broadcast where it is small, else Spark can split the rows of a frequent one
    twice = small(each.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"), "repeated_anchors")
    candidates = each.select("g", "h", "anchor").join(twice, "anchor", "left_semi").groupBy("g", "h").agg(F.collect_set("anchor").alias("anchor"))
    candidates = materialise(candidates.select(F.col("g").alias("g2"), F.col("h").alias("h2"), "anchor"), "candidates")
    discard(docs.sparkSession, found, twice)

    def find_windows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for b in batches:
            rows = []
            for g, h, t, wanted in zip(b["g"], b["h"], b["t"], b["anchor"]):
                words = known.of(t.encode("utf-8", "replace").split())
                starts = np.flatnonzero(np.isin(anchors(words)[0].view(np.int64), np.asarray(wanted, np.int64)))
                one, two = window_hashes(words, WINDOW, BASES[0]), window_hashes(mixed(words), WINDOW, BASES[1])
                rows.append((g, h, starts.astype(np.int32), one[starts].view(np.int64), (two[starts] >> np.uint64(32)).astype(np.uint32).view(np.int32)))
            yield pd.DataFrame(rows, columns=["g", "h", "start", "one", "two"])

    marks = materialise(_marks(candidates), "marks")
    held = _back(_marked(whole.drop("k"), marks, True), candidates, "inner").select("g", "h", "t", "anchor")
    windows = materialise(held.mapInPandas(find_windows, "g long, h long, start array<int>, one array<long>, two array<int>"), "windows")
    rows = windows.select("g", "h", F.inline(F.arrays_zip("start", "one", "two")))
    repeated = small(rows.groupBy("one", "two").agg(F.count("*").alias("n")).where("n > 1").select("one", "two"), "repeated_windows")
    hit = rows.join(repeated, ["one", "two"], "left_semi").groupBy("g", "h").agg(F.collect_set("start").alias("start"))
    hit = materialise(hit.select(F.col("g").alias("g2"), F.col("h").alias("h2"), "start"), "repeats")
    discard(docs.sparkSession, windows, repeated, candidates, marks)

    def cut(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t, starts in zip(b["k"], b["t"], b["start"]):
                words = t.encode("utf-8", "replace").split()
                gone = np.zeros(len(words) + 1, np.int32)
                if starts is not None:
                    s = np.asarray(starts, np.int64)
                    gone[: len(words) + 1] = np.cumsum(np.bincount(s, minlength=len(words) + 1) - np.bincount(s + WINDOW, minlength=len(words) + 1))
                covered = gone[:-1] > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
                kept = b" ".join(w for w, c in zip(words, covered.tolist()) if not c).decode("utf-8", "replace")
                rows.append((k, len(words), int(covered.sum()), [{"first": int(x), "after": int(y)} for x, y in zip(edges[::2], edges[1::2])], kept))
            yield pd.DataFrame(rows, columns=["k", "n_words", "n_removed", "removed", "kept"])

    marks = materialise(_marks(hit), "marks")
    out = _back(_marked(whole, marks, True), hit, "left").select("k", "t", "start")
    out = out.unionByName(_marked(whole, marks, False).select("k", "t", F.lit(None).cast("array<int>").alias("start")))
    out = out.mapInPandas(cut, "k string, n_words long, n_removed long, removed array<struct<first: int, after: int>>, kept string")
    return out.select(F.col("k").cast(docs.schema[key].dataType).alias(key), "n_words", "n_removed", "removed", "kept")


class SuffixAutomaton:
    """Word-level suffix automaton with occurrence counts; a reference for small data."""

    def __init__(self, texts: Iterable[list]):
        self.next, self.link, self.length, self.count = [{}], [-1], [0], [0]
        for n, words in enumerate(texts):
            last = 0
            for w in [*words, ("end", n)]:
                last = self._add(last, w)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[s]] += self.count[s]

    def _state(self, length: int, link: int, arcs: dict, count: int) -> int:
        self.next.append(arcs), self.link.append(link), self.length.append(length), self.count.append(count)
        return len(self.next) - 1

    def _split(self, p: int, w) -> int:
        q = self.next[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]), 0)
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _add(self, last: int, w) -> int:
        if w in self.next[last]:
            q = self._split(last, w)
            self.count[q] += 1
            return q
        new, p = self._state(self.length[last] + 1, 0, {}, 1), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w)
        return new

    def repeated(self, words: list) -> list[int]:
        """Matching statistics: at each word, the longest match ending there that occurs twice or more."""
        out, s, n = [], 0, 0
        for w in words:
            while s and w not in self.next[s]:
                s = self.link[s]
                n = self.length[s]
            if w in self.next[s]:
                s, n = self.next[s][w], n + 1
            t, m = s, n
            while t and self.count[t] < 2:
                t = self.link[t]
                m = self.length[t]
            out.append(m)
        return out
