"""SentencePiece encoding and decoding in numpy batches inside Spark tasks.

Texts are cut into units (white space and the word after it), each distinct unit
of a batch is encoded once, and units of equal length advance together: the
hashes of all their substrings probe the sorted hashes of the pieces, which
gives a lattice of piece numbers. Over it run

* for unigram models the Viterbi recurrence, with vectorised maxima and stored
  backpointers;
* for BPE models merges by rank: in each round every unit of the batch merges
  its best pair, by vectorised maxima over the same lattice. The scores of a BPE
  model are ranks, whose sum a Viterbi path would minimise to other pieces than
  the library's, so the recurrence is chosen by the model's type.

Characters without a piece become their UTF-8 bytes (byte fallback). Decoding
joins pieces, turns byte pieces back and drops the space put in front.

Defined results: null or empty text has no pieces and decodes to the empty
string; repeated rows are encoded each for itself; units longer than 48
characters go through the same merges with a heap, so that time stays near
linear in their length.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
LONG = 48
KNOWN = 200_000
#: Characters that are cut into units at a time.
GROUP = 500_000
#: Piece types of the model format, and odd multipliers of the substring hash.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BASE, SALT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
UPPER = np.uint64(44)
UNIT = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


class Model(NamedTuple):
    unigram: bool
    pieces: list[str]
    scores: np.ndarray
    kinds: np.ndarray
    keys: np.ndarray  # sorted hashes of the pieces that text can match
    ids: np.ndarray  # their numbers
    first: np.ndarray  # by the upper bits of a hash: the first key with these bits, -1 if none
    most: int  # keys with the same upper bits, at most
    longest: int
    byte: np.ndarray  # number of each byte's piece
    unknown: int
    prefix: bool


def substring_hashes(codes: np.ndarray, longest: int) -> Iterator[np.ndarray]:
    """Hashes of all substrings, by length: units x starts for each of 1 to longest characters."""
    size = codes.shape[1]
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * SALT
    mixed ^= mixed >> np.uint64(29)
    run = mixed
    for k in range(min(longest, size)):
        if k:
            run = run[:, : size - k] * BASE + mixed[:, k:]
        yield (run ^ (run >> np.uint64(32))) * BASE


def load(path: str) -> Model:
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("models that change characters or white space aren't supported")
    pieces = [p.piece for p in proto.pieces]
    kinds = np.array([p.type for p in proto.pieces])
    byte = np.full(256, -1, np.int64)
    for k in np.flatnonzero(kinds == BYTE):
        byte[int(pieces[k][3:5], 16)] = k
    usable = np.flatnonzero(np.isin(kinds, (NORMAL, USER)))
    sizes = np.array([len(p) for p in pieces])
    hashes = np.zeros(len(usable), np.uint64)
    for size in np.unique(sizes[usable]):
        at = np.flatnonzero(sizes[usable] == size)
        codes = np.array([[ord(c) for c in pieces[usable[k]]] for k in at], np.uint32)
        *_, last = substring_hashes(codes, size)
        hashes[at] = last[:, 0]
    order = np.argsort(hashes)
    if len(np.unique(hashes)) != len(hashes):
        raise ValueError("two pieces share a hash")
    upper, start, n = np.unique(hashes[order] >> UPPER, return_index=True, return_counts=True)
    first = np.full(1 << 20, -1, np.int32)
    first[upper.astype(np.int64)] = start
    unknown = int(np.flatnonzero(kinds == UNKNOWN)[0])
    return Model(proto.trainer_spec.model_type == 1, pieces, np.array([p.score for p in proto.pieces], np.float64), kinds, hashes[order], usable[order].astype(np.int32), first, int(n.max()), int(sizes[usable].max()), byte, unknown, proto.normalizer_spec.add_dummy_prefix)


def lattice(model: Model, codes: np.ndarray) -> np.ndarray:
    """Piece number of every substring (units x starts x lengths), -1 where there is none."""
    n, size = codes.shape
    found = np.full((n, size, min(model.longest, size)), -1, np.int32)
    for k, hashes in enumerate(substring_hashes(codes, model.longest)):
        at = model.first[(hashes >> UPPER).astype(np.int64)]
        row, start = np.nonzero(at >= 0)
        at, wanted = at[row, start], hashes[row, start]
        for step in range(model.most):
            place = np.minimum(at + step, len(model.keys) - 1)
            same = model.keys[place] == wanted
            found[row[same], start[same], k] = model.ids[place[same]]
    return found


def viterbi(model: Model, found: np.ndarray) -> np.ndarray:
    """Best-scoring segmentation: units x characters, 1 where a piece starts. Ties go to the longer last piece."""
    n, size, longest = found.shape
    low = model.scores.min() - 10
    best = np.full((n, size + 1), -np.inf)
    best[:, 0] = 0
    back = np.zeros((n, size + 1), np.int64)
    for end in range(1, size + 1):
        starts = np.arange(max(0, end - longest), end)
        ids = found[:, starts, end - starts - 1]
        gain = np.where(ids >= 0, model.scores[ids], np.where(end - starts == 1, low, -np.inf))
        total = best[:, starts] + gain
        k = total.argmax(1)
        best[:, end] = total[np.arange(n), k]
        back[:, end] = starts[k]
    heads = np.zeros((n, size), bool)
    at, rows = np.full(n, size), np.arange(n)
    while len(rows):
        at[rows] = back[rows, at[rows]]
        heads[rows, at[rows]] = True
        rows = rows[at[rows] > 0]
    return heads


def merges(model: Model, found: np.ndarray) -> np.ndarray:
    """Merges by rank, leftmost first among equals: units x characters, 1 where a piece starts."""
    n, size, longest = found.shape
    heads = np.ones((n, size), bool)
    if size < 2:
        return heads
    ends = np.broadcast_to(np.arange(1, size + 1), (n, size)).copy()  # where the symbol that starts here ends
    score = np.append(model.scores, -np.inf)  # number -1: no piece
    pair = np.full((n, size), -np.inf)  # score of the symbol that starts here with the next one
    pair[:, :-1] = score[found[:, :-1, 1]] if longest > 1 else -np.inf
    live = np.arange(n)
    while True:
        at = pair[live].argmax(1)
        some = pair[live, at] > -np.inf
        live, at = live[some], at[some]
        if not len(live):
            return heads
        middle = ends[live, at]
        heads[live, middle] = False
        pair[live, middle] = -np.inf
        end = ends[live, middle]
        ends[live, at] = end
        # the merged symbol with the next one
        after = np.where(end < size, ends[live, np.minimum(end, size - 1)], size + longest)
        width = after - at
        fits = (end < size) & (width <= longest)
        pair[live, at] = np.where(fits, score[found[live, at, np.where(fits, width - 1, 0)]], -np.inf)
        # the symbol before with the merged one
        rows = np.flatnonzero(at > 0)
        r, a, e = live[rows], at[rows], end[rows]
        before = _head_before(heads[r], a)
        width = e - before
        fits = width <= longest
        pair[r, before] = np.where(fits, score[found[r, before, np.where(fits, width - 1, 0)]], -np.inf)


def _head_before(heads: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The last piece start before each position."""
    places = np.where(heads & (np.arange(heads.shape[1]) < at[:, None]), np.arange(heads.shape[1]), -1)
    return places.max(1)


def encode_long(model: Model, rank: dict[str, int], unit: str) -> list[int]:
    """One long unit by a heap of pairs; the same merges."""
    symbols = list(unit)
    after, before = list(range(1, len(unit) + 1)), list(range(-1, len(unit) - 1))
    heap: list[tuple[float, int, str]] = []

    def offer(a: int) -> None:
        if a >= 0 and after[a] < len(unit):
            both = symbols[a] + symbols[after[a]]
            if both in rank:
                heapq.heappush(heap, (-model.scores[rank[both]], a, both))

    for a in range(len(unit) - 1):
        offer(a)
    while heap:
        _, a, both = heapq.heappop(heap)
        b = after[a]
        if not symbols[a] or b >= len(unit) or symbols[a] + symbols[b] != both:
            continue
        symbols[a], symbols[b] = both, ""
        after[a] = after[b]
        if after[a] < len(unit):
            before[after[a]] = a
        offer(before[a])
        offer(a)
    return [x for s in symbols if s for x in ([rank[s]] if s in rank else fallback(model, s))]


def fallback(model: Model, text: str) -> list[int]:
    found = [int(model.byte[b]) for b in text.encode("utf-8", "replace")]
    return found if min(found) >= 0 else [model.unknown]


class Encoder:
    """Encodes texts; remembers up to KNOWN units, with the pieces of all of them in one pool."""

    def __init__(self, path: str, segmentation: str = "model"):
        if segmentation not in ("model", "viterbi"):
            raise ValueError("segmentation is model or viterbi")
        self.model = load(path)
        self.by_path = self.model.unigram or segmentation == "viterbi"
        usable = np.isin(self.model.kinds, (NORMAL, USER))
        self.rank = {p: k for k, p in enumerate(self.model.pieces) if usable[k]}
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.pool, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _learn(self, units: list[str]) -> None:
        """Pieces of new units, equal lengths together."""
        by_size: dict[int, list[str]] = {}
        for u in units:
            by_size.setdefault(len(u), []).append(u)
        pools, sizes = [self.pool], [self.sizes]
        for size, same in by_size.items():
            long = size > LONG and not self.by_path
            step = max(1, 400_000 // (size * min(size, self.model.longest)))
            for lo in range(0, len(same), step):
                part = same[lo : lo + step]
                if long:
                    each = [encode_long(self.model, self.rank, u) for u in part]
                    ids, n = np.array([x for e in each for x in e], np.int32), np.array([len(e) for e in each])
                else:
                    ids, n = self._equal(part, size)
                self.number.update(zip(part, range(len(self.number), len(self.number) + len(part))))
                pools.append(ids)
                sizes.append(n)
        self.pool, self.sizes = np.concatenate(pools), np.concatenate(sizes)

    def _equal(self, units: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of units of one length, unit by unit, and how many each has."""
        m = self.model
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(units), size)
        found = lattice(m, codes)
        heads = viterbi(m, found) if self.by_path else merges(m, found)
        row, start = np.nonzero(heads)
        stop = np.append(start[1:], size)
        stop[np.append(row[1:] != row[:-1], True)] = size
        ids = found[row, start, stop - start - 1]
        none = np.flatnonzero(ids < 0)
        if not len(none):
            return ids, heads.sum(1)
        width = np.ones(len(ids), np.int64)
        spelled = [fallback(m, units[row[k]][start[k]]) for k in none]
        width[none] = [len(x) for x in spelled]
        out = np.repeat(ids, width)
        out[np.flatnonzero(out < 0)] = [x for s in spelled for x in s]
        return out, np.bincount(row, weights=width, minlength=len(units)).astype(np.int64)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        cut = [UNIT.findall((SPACE if self.model.prefix else "") + t.replace(" ", SPACE)) if t else [] for t in texts]
        units = [u for c in cut for u in c]
        if len(self.number) > KNOWN:
            self._forget()
        new = set(units).difference(self.number)
        if new:
            self._learn(sorted(new))
        order = np.fromiter(map(self.number.__getitem__, units), np.int64, len(units))
        sizes = self.sizes[order]
        ends = np.cumsum(sizes)
        starts = (np.cumsum(self.sizes) - self.sizes)[order]
        ids = self.pool[np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
        bounds = np.cumsum([len(c) for c in cut])
        return np.split(ids, np.append(0, ends)[bounds[:-1]])


class Decoder:
    def __init__(self, model: Model | str):
        self.model = load(model) if isinstance(model, str) else model
        text = lambda k, p: bytes([int(p[3:5], 16)]) if self.model.kinds[k] == BYTE else b"" if self.model.kinds[k] == CONTROL else " ⁇ ".encode() if self.model.kinds[k] == UNKNOWN else p.replace(SPACE, " ").encode()
        self.bytes = [text(k, p) for k, p in enumerate(self.model.pieces)]

    def decode(self, ids: np.ndarray) -> str:
        out = b"".join(map(self.bytes.__getitem__, ids.tolist()))
        if self.model.prefix and out[:1] == b" ":
            out = out[1:]
        return out.decode("utf-8", "replace")


def groups(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Consecutive texts of at most GROUP characters together, a longer one by itself."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t or "") > GROUP:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t or "")
    if part:
        yield part


def encode(docs: DataFrame, text: str = "text", model: str = "piece_bpe_32k.model", check: bool = False, segmentation: str = "model") -> DataFrame:
    """docs with piece_ids and n_pieces; with check also round_trip: whether they decode to the text.

    segmentation: "model" gives the library's pieces, "viterbi" the path of best scores."""
    path = public_tokenizers.path(model)

    @F.pandas_udf("piece_ids array<int>, n_pieces int, round_trip boolean")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(path, segmentation)
        decoder = Decoder(encoder.model)
        for texts in batches:
            for values in groups(texts.tolist()):
                ids = encoder.encode(values)
                same = [decoder.decode(i) == (t or "") for i, t in zip(ids, values)] if check else [None] * len(ids)
                yield pd.DataFrame({"piece_ids": ids, "n_pieces": [len(i) for i in ids], "round_trip": same})

    kept = [c for c in docs.columns if c.lower() not in ("piece_ids", "n_pieces", "round_trip")]
    out = docs.select(*kept, of(F.col(text)).alias("__e"))
    return out.select(*kept, "__e.piece_ids", "__e.n_pieces", *(["__e.round_trip"] if check else []))


def decode(ids: DataFrame, column: str = "piece_ids", model: str = "piece_bpe_32k.model") -> DataFrame:
    """ids with decoded: the text of their pieces; null pieces decode to the empty string."""
    path = public_tokenizers.path(model)

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = Decoder(path)
        for values in batches:
            yield pd.Series([decoder.decode(np.asarray(v)) if v is not None else "" for v in values], dtype=object)

    return ids.withColumn("decoded", of(F.col(column)))
